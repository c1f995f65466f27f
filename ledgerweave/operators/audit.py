"""A tamper-evident log: fingerprints, hash chains, and results read back from entries.

A chain is one (run, scope) or any other key; entries of a chain are ordered by seq from 1. The hash of an entry
covers the hash before it, its time, kind, subject and payload, joined by U+001F.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ledgerweave.config import EXCEPTION
from ledgerweave.sources.files import exists

from .order import positions

#: The hash before a chain's first entry, and the separator of the hashed fields.
GENESIS, SEPARATOR = "0" * 64, "\u001f"
FIELDS = ("recorded_at", "kind", "subject", "payload")


def entry_hash(previous: Column) -> Column:
    return F.sha2(F.concat_ws(SEPARATOR, previous, *[F.col(c) for c in FIELDS]), 256)


def fingerprint(spark: SparkSession, paths: list[str], variant: str = "") -> DataFrame:
    """One row `fingerprint`: of the files' contents, whatever their names and order, and of the run's variant. Absent files are skipped."""
    there = [p for p in paths if exists(spark, p)]
    if not there:
        digests = spark.range(1).select(F.lit("").alias("all"))
    else:
        files = spark.read.format("binaryFile").load(there).select(F.sha2("content", 256).alias("d"))
        digests = files.agg(F.concat_ws("", F.array_sort(F.collect_list("d"))).alias("all"))
    inner = F.sha2(F.col("all").cast("binary"), 256)
    return digests.select(F.sha2(F.concat(inner, F.lit(":" + variant)).cast("binary"), 256).alias("fingerprint"))


def existing_run(runs: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Runs that were made from the same inputs and variant."""
    return runs.join(fingerprints, "fingerprint", "left_semi")


#: The order of the quarantined files in the log.
SOURCES = ["settlement_report", "bank_statement", "orders"]


def audit_records(results: DataFrame, bank: DataFrame, quarantine: DataFrame | None = None) -> DataFrame:
    """scope, file, line, kind, subject, payload (JSON, keys in order): quarantined records by file and line first, then results in statement order.

    bank: scope, txn_id, txn_seq. A quarantine without a scope counts as scope 0.
    """
    payload = F.to_json(
        F.struct(
            "candidates_considered", F.round("confidence", 3).alias("confidence"), "delta_paise", "exception_type", "reason", F.col("row_ids").alias("rows"), "tier"
        ), {"ignoreNullFields": "false"},
    )
    kind = F.when(F.col("tier") == EXCEPTION, "exception").otherwise("match")
    placed = results.join(bank.select("scope", "txn_id", "txn_seq"), ["scope", "txn_id"])
    out = placed.select("scope", F.lit(len(SOURCES)).alias("file"), F.col("txn_seq").alias("line"), kind.alias("kind"), F.col("txn_id").alias("subject"), payload.alias("payload"))
    if quarantine is None:
        return out
    scope = F.coalesce(F.col("scope"), F.lit(0)) if "scope" in quarantine.columns else F.lit(0)
    bad = quarantine.select(
        scope.cast("long").alias("scope"), (F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source")) - 1).cast("int").alias("file"), F.col("line_no").alias("line"), F.lit("quarantine").alias("kind"),
        F.concat_ws(":", "source", F.col("line_no").cast("string")).alias("subject"), F.to_json(F.struct(F.substring("raw", 1, 200).alias("raw"), "reason")).alias("payload"),
    )
    return bad.unionByName(out)


def numbered(records: DataFrame, chain: str = "scope") -> DataFrame:
    """records with seq, from 1 in each chain, in their order; no task holds a chain."""
    return positions(records, chain, ["file", "line", "subject"], "seq")


def chain_append(entries: DataFrame, chain: str = "chain_id") -> DataFrame:
    """entries (chain, seq, FIELDS) with prev_hash and hash. Chains are folded side by side, each in the order of seq.

    A fold is sequential in its chain; rows stream through in sorted batches, so no chain is held as a whole.
    """
    dealt = entries.repartition(chain).sortWithinPartitions(chain, "seq")

    def fold(batches):
        of, previous = None, GENESIS
        for batch in batches:
            before, after = [], []
            for key, *fields in zip(*(batch.column(c).to_pylist() for c in (chain, *FIELDS))):
                previous = GENESIS if of is None or key != of[0] else previous
                of = (key,)
                before.append(previous)
                previous = hashlib.sha256(SEPARATOR.join([previous, *fields]).encode()).hexdigest()
                after.append(previous)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.string()), pa.array(after, pa.string())], [*batch.schema.names, "prev_hash", "hash"])

    return dealt.mapInArrow(fold, StructType([*entries.schema.fields, StructField("prev_hash", StringType()), StructField("hash", StringType())]))


def chain_tips(chained: DataFrame, chain: str = "chain_id") -> DataFrame:
    """The last hash of each chain; hashed in key order they make the tip over all chains."""
    return chained.groupBy(chain).agg(F.max_by("hash", "seq").alias("tip"), F.max("seq").alias("entries"))


def verify_chain(chained: DataFrame, chain: str = "chain_id") -> DataFrame:
    """chain, seq, expected, found of each break. Every hash is recomputed from the stored hash before it, so all entries are checked at once."""
    before = F.coalesce(F.lag("hash").over(Window.partitionBy(chain).orderBy("seq")), F.lit(GENESIS))
    checked = chained.withColumn("before", before).withColumn("expected", entry_hash(F.col("before")))
    return checked.filter((F.col("prev_hash") != F.col("before")) | (F.col("hash") != F.col("expected"))).select(chain, "seq", "expected", F.col("hash").alias("found"))


def rehydrate(entries: DataFrame) -> DataFrame:
    """Results from the payloads of match and exception entries."""
    kind = "candidates_considered long, confidence double, delta_paise long, exception_type string, reason string, rows array<string>, tier string"
    p = F.from_json("payload", kind)
    return entries.filter(F.col("kind").isin("match", "exception")).select("scope", F.col("subject").alias("txn_id"), p.alias("p")).select(
        "scope", "txn_id", "p.tier", F.col("p.rows").alias("row_ids"), "p.delta_paise", "p.confidence", "p.reason", "p.exception_type", "p.candidates_considered"
    )
