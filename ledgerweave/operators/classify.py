"""Typed exceptions for the lines that nothing matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.config import EXCEPTION, REASONS
from ledgerweave.functions.scalar import exception_action, is_gateway

RESULT = [
    "scope", "txn_id", "tier", "row_ids", "delta_paise", "confidence", "reason", "exception_type", "candidates_considered",
]


def exception_type(had: Column, gateway: Column, declined: Column, rows_left: Column) -> Column:
    """In order: candidates were there; no gateway is named; arithmetic was declined; rows are left, or none."""
    return (
        F.when(had, "ambiguous_candidates").when(~gateway, "orphan_credit").when(declined, "arithmetic_unsafe")
        .when(rows_left, "no_candidate").otherwise("missing_in_bank")
    )


def classify_exceptions(lines: DataFrame, tokens=("RAZORPAY", "RZP")) -> DataFrame:
    """Results for unmatched lines: scope, txn_id, is_credit, narration, n_pending, declined, rows_left."""
    kind = F.when(~F.col("is_credit"), "chargeback_debit").otherwise(
        exception_type(F.col("n_pending") > 0, is_gateway(F.col("narration"), tokens), F.col("declined"), F.col("rows_left"))
    )
    plain = {k: v for k, v in REASONS.items() if k in ("chargeback_debit", "orphan_credit", "arithmetic_unsafe", "missing_in_bank", "no_candidate")}
    reason = F.when(F.col("exception_type") == "ambiguous_candidates", F.format_string(REASONS["ambiguous_candidates"], F.col("n_pending"))).otherwise(
        F.create_map(*[F.lit(x) for p in plain.items() for x in p])[F.col("exception_type")]
    )
    return lines.withColumn("exception_type", kind).select(
        "scope", "txn_id", F.lit(EXCEPTION).alias("tier"), F.array().cast("array<string>").alias("row_ids"), F.lit(0).cast("long").alias("delta_paise"),
        F.lit(0.0).alias("confidence"), reason.alias("reason"), "exception_type", F.col("n_pending").cast("long").alias("candidates_considered"),
    )


def exception_queue(results: DataFrame) -> DataFrame:
    """exception_type, n, action; the longest queue first."""
    counted = results.filter(F.col("tier") == EXCEPTION).groupBy("exception_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("action", exception_action(F.col("exception_type"))).orderBy(F.desc("n"), "exception_type")


def tier_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


def line_filter(results: DataFrame, which: str) -> DataFrame:
    """all, matched, exceptions, or the name of a tier or of a type of exception."""
    if which == "all":
        return results
    if which in ("matched", "exceptions"):
        return results.filter((F.col("tier") == EXCEPTION) == (which == "exceptions"))
    return results.filter((F.col("tier") == which) | (F.col("exception_type") == which))
