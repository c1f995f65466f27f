"""Exact copies by sorting whole contents, with DataFrame operators only.

Sampled splitters deal the normalised texts over ranges, each range is sorted externally, and neighbours with the
same full text form a group (a window over the sorted range; membership is never decided by a digest there). Ranges
are cut and sorted by a head of the text, a hash, then the whole text. A text that many rows share would fill one
range, so the rows of every hot text are dealt over parts in turn; the texts of the parts' few winners are then
compared again in full, and the parts' rows find their winner by the SHA-256 of the text. Hot texts are counted
exactly, with partial sums before the shuffle.

Of a group, the row with the most code points in its original text stays, then the smallest doc_id (nulls last).

Defined results: null text counts as empty; empty and blank texts form one group; a null id may stay only if no
other row of its group is as long; of repeated rows exactly one is kept; an empty table gives an empty result;
other columns are ignored, or carried unchanged in the struct column `row`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, tasks_for, written

#: Fixed value: the characters that do not count, [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
#: Characters of a text that order the ranges; a hash orders texts with the same head.
HEAD = 32
#: A text is hot from this share of a range's rows, or so many rows, whichever is more.
HOT_SHARE, HOT_ROWS = 0.5, 128


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row; with carry also `row`, the input row."""
    spark = docs.sparkSession
    n = partitions(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.translate(text, BLANKS, "").alias("norm"), F.length(text).alias("points"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []),
    )
    # At most n / HOT_SHARE texts can have so many rows: that bounds the broadcast.
    count = docs.count()
    limit = max(HOT_ROWS, int(HOT_SHARE * count / n))
    hot = (
        rows.groupBy(F.xxhash64("norm").alias("hot_key")).agg(F.count(F.lit(1)).alias("hot_rows"))
        .filter(F.col("hot_rows") > limit).withColumn("salts", F.ceil(F.col("hot_rows") / limit))
    )
    salted = rows.join(F.broadcast(hot), F.xxhash64("norm") == F.col("hot_key"), "left").select(
        "doc_id", "norm", "points", *(["row"] if carry else []), F.col("salts").isNotNull().alias("hot"),
        F.substring("norm", 1, HEAD).alias("head"), F.xxhash64("norm").alias("tag"),
        F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("salts")), F.lit(0)).alias("salt"),
    )
    # Ranges are cut by the head of the text and a hash: only those are sampled for the splitters, not whole texts.
    ranged = salted.repartitionByRange(n, "head", "tag", "salt")
    group = Window.partitionBy("head", "tag", "norm", "salt")
    best = group.orderBy(F.desc("points"), F.asc_nulls_last("doc_id"))
    local = ranged.select(
        "doc_id", *(["row"] if carry else []), "hot", F.first("doc_id").over(best).alias("best_id"), F.first("points").over(best).alias("best_points"),
        F.count(F.lit(1)).over(group).alias("rows"), F.row_number().over(best).alias("place"), "norm", "salt",
    )
    # Only the winners of hot texts keep their text for the second comparison.
    local = local.withColumn("text_sha256", F.sha2(F.col("norm").cast("binary"), 256)).withColumn(
        "norm", F.when(F.col("hot") & (F.col("place") == 1), F.col("norm"))
    )
    local = written(local.coalesce(tasks_for(spark, count)), "exact")
    winner = F.min(F.struct((-F.col("best_points")).alias("points"), F.col("best_id").isNull().alias("no_id"), F.col("best_id").alias("id"), F.col("salt").alias("part")))
    merged = (
        local.filter("hot and place = 1").groupBy("norm").agg(winner.alias("w"), F.sum("rows").alias("all_rows"), F.first("text_sha256").alias("of"))
        .select("of", F.col("w.id").alias("hot_id"), F.col("w.part").alias("hot_part"), "all_rows")
    )
    joined = local.drop("norm").join(F.broadcast(merged), F.col("hot") & (F.col("text_sha256") == F.col("of")), "left")
    is_hot = F.col("of").isNotNull()
    return joined.select(
        "doc_id", F.when(is_hot, F.col("hot_id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("all_rows", "rows").cast("long").alias("group_size"),
        ((F.col("place") == 1) & (~is_hot | (F.col("salt") == F.col("hot_part")))).alias("kept"),
        "text_sha256", *(["row"] if carry else []),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    return exact_groups(docs, id_col, text_col, carry=True).filter("kept").select("row.*")


ORACLE = """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points,
    translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
    row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
