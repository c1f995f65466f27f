"""Payments charged above the contracted rate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checked_payments(settlement: DataFrame) -> DataFrame:
    return settlement.filter("kind = 'payment' and gross_paise > 0")


def detect_fee_drift(settlement: DataFrame, contracted_bps: int = 200, gst_bps: int = 1800, tolerance_bps: int = 4) -> DataFrame:
    """scope, row_id, method, gross_paise, charged_paise, expected_paise, excess_paise, effective_bps of each flagged payment.

    Flagged: the fee alone exceeds the rate and its tolerance, and fee with tax exceeds what is expected.
    """
    div = lambda a, b: F.call_function("div", a, b if not isinstance(b, int) else F.lit(b))
    fee = div(F.col("gross_paise") * contracted_bps, 10_000)
    priced = checked_payments(settlement).select(
        "scope", "row_id", "method", "gross_paise", (F.col("fee_paise") + F.col("tax_paise")).alias("charged_paise"), (fee + div(fee * gst_bps, 10_000)).alias("expected_paise"),
        div(F.col("fee_paise") * 10_000, F.col("gross_paise")).alias("effective_bps"),
    )
    flagged = priced.filter((F.col("effective_bps") > contracted_bps + tolerance_bps) & (F.col("charged_paise") > F.col("expected_paise")))
    return flagged.withColumn("excess_paise", F.col("charged_paise") - F.col("expected_paise"))


def drift_summary(settlement: DataFrame, **rates) -> DataFrame:
    """One row: rows_checked, flagged, total_excess_paise; from one scan of the report."""
    found = detect_fee_drift(settlement, **rates).agg(F.count(F.lit(1)).alias("flagged"), F.coalesce(F.sum("excess_paise"), F.lit(0)).alias("total_excess_paise"))
    return checked_payments(settlement).agg(F.count(F.lit(1)).alias("rows_checked")).join(F.broadcast(found))  # one row each


def drift_by_method(findings: DataFrame) -> DataFrame:
    return findings.groupBy("method").agg(F.sum("excess_paise").alias("excess_paise")).orderBy(F.desc("excess_paise"), "method")


def top_drift(findings: DataFrame, n: int = 20) -> DataFrame:
    return findings.orderBy(F.desc("excess_paise"), "row_id").limit(n)
