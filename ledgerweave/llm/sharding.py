"""Shards over fixed virtual slots, with DataFrame functions only.

A record's slot is a hash of its id, one of a fixed number of slots; the slots, not the records, belong to shards.
The slot map is a table of versions: version 0 deals the slots in turn, each later version stores only the slots
that it moves, and a version is read as the last move of every slot up to it. `rebalance` adds a version from the
bytes that each slot holds: an overfull shard keeps its largest slots up to its fair share and hands over the rest,
which go to the emptiest shard one after the other, largest first. So shards are equal in bytes up to about the
size of a small slot, and few bytes move. `rebalance(..., into=[16])` grows the map: slots move into the new shard only.

Texts are read once, into narrow rows. Slots are aggregated with partial sums; a slot that many rows share (one id
in a third of all rows) is cut into parts that are slots of their own, its rows dealt over them in turn. What is
broadcast are the slots and their parts, at most 1.5 times `slots` rows whatever the input. Positions in a shard are
the offset of the slot, from the slots' counts, and the place in the slot: no task holds a shard.

Defined results: null text has no bytes and counts as the crc of nothing; rows with a null id share a slot; of
repeated rows each has a position of its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, written

#: Virtual slots; fixed for the life of a dataset.
SLOTS = 4096
#: A slot is hot from so many rows if it also holds more than HOT_TIMES the bytes of a slot on average.
HOT_ROWS, HOT_TIMES = 64, 4


def slotted(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, slot, part for every row; part is 0 but in hot slots."""
    text, number = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col).cast("long")
    rows = written(docs.select(
        number.alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        (F.conv(F.substring(F.md5(F.coalesce(number.cast("string"), F.lit("-")).cast("binary")), 1, 8), 16, 10).cast("long") % slots).cast("int").alias("slot"),
        F.monotonically_increasing_id().alias("turn"),
    ), "slotted")
    held = rows.groupBy("slot").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))
    limit = max(1, HOT_TIMES * (held.agg(F.sum("bytes")).first()[0] or 0) // slots)
    hot = held.filter((F.col("rows") > HOT_ROWS) & (F.col("bytes") > limit)).select("slot", F.least("rows", F.ceil(F.col("bytes") / limit)).alias("parts"))
    return rows.join(F.broadcast(hot), "slot", "left").select(
        "doc_id", "size", "text_crc32", "slot", F.coalesce(F.pmod("turn", "parts"), F.lit(0)).cast("int").alias("part")
    )


def slot_loads(rows: DataFrame) -> DataFrame:
    """slot, part, rows, bytes of every slot that holds rows."""
    return rows.groupBy("slot", "part").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))


def first_map(spark: SparkSession, path: str, slots: int = SLOTS, shards: int = 16) -> int:
    """Store version 0, the slots dealt over the shards in turn."""
    every = spark.range(slots).select(F.col("id").cast("int").alias("slot"), F.lit(0).alias("part"), F.pmod("id", F.lit(shards)).cast("int").alias("shard"))
    every.write.parquet(f"{path}/version=0")
    return 0


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """slot, part, shard as of a version (the last one without)."""
    moves = spark.read.schema("slot int, part int, shard int, version int").parquet(path)
    if version is not None:
        moves = moves.filter(F.col("version") <= version)
    return moves.groupBy("slot", "part").agg(F.max_by("shard", "version").alias("shard"))


def last_version(spark: SparkSession, path: str) -> int:
    return spark.read.schema("slot int, part int, shard int, version int").parquet(path).agg(F.max("version")).first()[0]


def placed(loads: DataFrame, slot_map: DataFrame, shards: int) -> DataFrame:
    """loads with their shard; a part that the map doesn't know yet starts at its slot's turn."""
    return loads.join(slot_map, ["slot", "part"], "left").withColumn("shard", F.coalesce("shard", F.pmod(F.col("slot") + F.col("part"), F.lit(shards)).cast("int")))


def moves(loads: DataFrame, slot_map: DataFrame, shards: int, into: list[int] | None = None) -> DataFrame:
    """slot, part, shard of the slots that change places so that the shards hold about the same bytes; into: the shards that may receive."""
    spark, known = loads.sparkSession, placed(loads, slot_map, shards)
    fair = (loads.agg(F.sum("bytes")).first()[0] or 0) // shards
    largest = Window.partitionBy("shard").orderBy(F.desc("bytes"), "slot", "part")
    filled = F.sum("bytes").over(largest.rowsBetween(Window.unboundedPreceding, 0))
    known = known.withColumn("stays", (filled <= fair) | (F.row_number().over(largest) == 1))
    kept = {r["shard"]: r["bytes"] for r in known.filter("stays").groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()}  # a row a shard
    into = list(range(shards)) if into is None else into
    # One row: the slots that are handed over, at most as many as there are slots. A fold gives each to the emptiest shard.
    handed = known.filter(~F.col("stays")).groupBy().agg(
        F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "slot", "part", F.col("shard").alias("old")))).alias("handed")
    )
    start = F.struct(F.array(*[F.lit(kept.get(s, 0)).cast("long") for s in into]).alias("held"), F.array_repeat(F.lit(0), 0).alias("picks"))

    def give(state, slot):
        pick = (F.array_position(state["held"], F.array_min(state["held"])) - 1).cast("int")
        return F.struct(
            F.transform(state["held"], lambda h, i: F.when(i == pick, h - slot["less"]).otherwise(h)).alias("held"),
            F.concat(state["picks"], F.array(pick)).alias("picks"),
        )

    shard_of = F.array(*[F.lit(s) for s in into])
    picks = handed.select("handed", F.aggregate("handed", start, give)["picks"].alias("picks"))
    each = picks.select(F.explode(F.arrays_zip("handed", "picks")).alias("x")).select(
        F.col("x.handed.slot").alias("slot"), F.col("x.handed.part").alias("part"), F.col("x.handed.old").alias("old"),
        F.element_at(shard_of, F.col("x.picks") + 1).alias("shard"),
    )
    return each.filter(F.col("shard") != F.col("old")).select("slot", "part", "shard")


def rebalance(spark: SparkSession, path: str, loads: DataFrame, shards: int = 16, into: list[int] | None = None) -> int:
    """Store the next version of the map, the moves only. A version that exists already is never written over."""
    version = last_version(spark, path)
    parts = loads.filter("part > 0").select("slot", "part", F.pmod(F.col("slot") + F.col("part"), F.lit(shards)).cast("int").alias("shard"))
    known = read_map(spark, path, version)
    moved = moves(loads, known, shards, into)
    fresh_parts = parts.join(known, ["slot", "part"], "left_anti").join(moved, ["slot", "part"], "left_anti")
    moved.unionByName(fresh_parts).write.parquet(f"{path}/version={version + 1}")
    return version + 1


def positions(rows: DataFrame, loads: DataFrame, slot_map: DataFrame, shards: int = 16) -> DataFrame:
    """rows with shard and position, gapless from 0 in each shard, in the order of slots and then of ids."""
    before = Window.partitionBy("shard").orderBy("slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    units = placed(loads, slot_map, shards).select("slot", "part", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("slot", "part").orderBy("doc_id", "text_crc32", "size")
    return rows.withColumn("place", F.row_number().over(inside)).join(F.broadcast(units), ["slot", "part"]).withColumn(
        "position", (F.col("offset") + F.col("place") - 1).cast("long")
    )


def sharded(docs: DataFrame, shards: int = 16, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, position, slot, part, version; the map is stored at path (a new one without)."""
    spark = docs.sparkSession
    path = path or fresh(spark, "slot-map")
    rows = slotted(docs, slots)
    loads = written(slot_loads(rows), "slot-loads")
    first_map(spark, path, slots, shards)
    version = rebalance(spark, path, loads, shards)
    return positions(rows, loads, read_map(spark, path, version), shards).select(
        "doc_id", "size", "text_crc32", "shard", "position", "slot", "part", F.lit(version).alias("version")
    )


#: For tables without hot slots, as on the registered data of the SQL check.
ORACLE = """
WITH RECURSIVE bits AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b::BIGINT, range(8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size,
        xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32,
        (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '-')), 1, 8))::BIGINT % 4096)::INT AS vs FROM documents, bits),
loads AS (SELECT vs, count(*) AS n, sum(size)::BIGINT AS bytes, vs % 16 AS shard FROM d GROUP BY vs),
cut AS (SELECT *, sum(bytes) OVER w <= (SELECT sum(bytes) // 16 FROM loads) OR row_number() OVER w = 1 AS stays FROM loads
        WINDOW w AS (PARTITION BY shard ORDER BY bytes DESC, vs ROWS UNBOUNDED PRECEDING)),
handed AS (SELECT vs, bytes, row_number() OVER (ORDER BY bytes DESC, vs) AS k FROM cut WHERE NOT stays),
kept AS (SELECT list(coalesce(b, 0)::BIGINT ORDER BY s) AS held FROM range(16) r(s) LEFT JOIN (SELECT shard, sum(bytes) AS b FROM cut WHERE stays GROUP BY shard) ON shard = s),
fold AS (SELECT 0::BIGINT AS k, held, NULL::BIGINT AS vs, NULL::INT AS shard FROM kept
    UNION ALL SELECT h.k, list_transform(f.held, lambda x, i: CASE WHEN i = list_position(f.held, list_min(f.held)) THEN x + h.bytes ELSE x END),
        h.vs, list_position(f.held, list_min(f.held))::INT - 1 FROM fold f JOIN handed h ON h.k = f.k + 1),
units AS (SELECT c.vs, c.n, coalesce(f.shard, c.shard)::INT AS shard FROM cut c LEFT JOIN fold f ON f.vs = c.vs)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY vs, doc_id, text_crc32, size) - 1 AS slot, NULL::INT AS grown_shard,
    vs AS virtual_slot
FROM d JOIN units USING (vs)
"""
