"""What stands behind a result: the parts of a matched credit, and what lay near an unmatched one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.config import EXCEPTION
from ledgerweave.functions.scalar import exception_action, format_inr

from .index import available

#: Days around an unmatched line that are looked at.
NEAR = 3


def explain_matched(results: DataFrame, settlement: DataFrame, bank: DataFrame) -> DataFrame:
    """One row for each matched line: counts and sums of its parts, computed net, residual and a sentence."""
    rows = results.filter(F.col("tier") != EXCEPTION).select("scope", "txn_id", "tier", "reason", F.explode("row_ids").alias("row_id"))
    joined = rows.join(settlement.select("scope", "row_id", "kind", "gross_paise", "fee_paise", "tax_paise", "net_paise"), ["scope", "row_id"])
    of = lambda kind, c: F.sum(F.when(F.col("kind") == kind, c).otherwise(0))
    parts = joined.groupBy("scope", "txn_id", "tier", "reason").agg(
        of("payment", 1).alias("payments"), of("payment", F.col("gross_paise")).alias("gross_paise"), of("payment", F.col("fee_paise")).alias("fee"), of("payment", F.col("tax_paise")).alias("tax"),
        of("refund", 1).alias("refunds"), of("refund", F.abs("gross_paise")).alias("refunded"), of("adjustment", 1).alias("adjustments"), of("adjustment", F.col("net_paise")).alias("adjusted"),
    )
    net = F.col("gross_paise") - F.col("fee") - F.col("tax") - F.col("refunded") + F.col("adjusted")
    told = F.concat(
        format_inr(F.col("credit_paise")), F.lit(" = "), F.col("payments"), F.lit(" payments ("), format_inr(F.col("gross_paise")), F.lit(") - platform fee ("), format_inr(F.col("fee")),
        F.lit(") - GST on fee ("), format_inr(F.col("tax")), F.lit(")"),
        F.when(F.col("refunds") > 0, F.concat(F.lit(" - "), F.col("refunds"), F.lit(" refunds ("), format_inr(F.col("refunded")), F.lit(")"))).otherwise(""),
        F.when(F.col("adjustments") > 0, F.concat(F.lit(" + adjustments ("), format_inr(F.col("adjusted")), F.lit(")"))).otherwise(""),
    )
    return parts.join(bank.select("scope", "txn_id", "credit_paise"), ["scope", "txn_id"]).select(
        "scope", "txn_id", "tier", "reason", "credit_paise", "payments", "gross_paise", (-F.col("fee")).alias("platform_fee_paise"), (-F.col("tax")).alias("gst_on_fee_paise"),
        "refunds", (-F.col("refunded")).alias("refund_paise"), "adjustments", F.col("adjusted").alias("adjustment_paise"), net.alias("computed_net_paise"),
        (F.col("credit_paise") - net).alias("residual_paise"), told.alias("narrative"),
    )


def explain_unmatched(results: DataFrame, bank: DataFrame, settlement: DataFrame, claims: DataFrame) -> DataFrame:
    """One row for each unmatched line: unclaimed rows and their net near its date, and unclaimed rows in all.

    Unclaimed rows are summed by day first; each line then meets seven days.
    """
    free = available(settlement, claims)
    by_day = free.groupBy("scope", "settled_on").agg(F.count(F.lit(1)).alias("n"), F.sum("net_paise").alias("net"))
    total = free.groupBy("scope").agg(F.count(F.lit(1)).alias("total"))
    open_ = results.filter(F.col("tier") == EXCEPTION).join(bank.select("scope", "txn_id", "value_date", "narration", "credit_paise", "debit_paise"), ["scope", "txn_id"])
    probes = open_.select("scope", "txn_id", F.explode(F.sequence(F.date_sub("value_date", NEAR), F.date_add("value_date", NEAR))).alias("settled_on"))
    near = probes.join(by_day, ["scope", "settled_on"]).groupBy("scope", "txn_id").agg(F.sum("n").alias("n"), F.sum("net").alias("net"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return open_.join(near, ["scope", "txn_id"], "left").join(total, "scope", "left").select(
        "scope", "txn_id", "reason", "exception_type", exception_action(F.col("exception_type")).alias("suggested_action"), (F.col("credit_paise") - F.col("debit_paise")).alias("bank_credit_paise"),
        "narration", "candidates_considered", zero("n").alias("unclaimed_rows_near_this_date"), zero("net").alias("unclaimed_net_paise"), zero("total").alias("total_unclaimed_rows"),
    )


def result_lines(results: DataFrame, bank: DataFrame) -> DataFrame:
    """Results beside their bank lines, as a display needs them."""
    amount = F.col("credit_paise") - F.col("debit_paise")
    return results.join(bank, ["scope", "txn_id"]).select(
        "scope", "txn_seq", "txn_id", "value_date", "narration", amount.alias("amount_paise"), format_inr(amount).alias("amount"), "tier", (F.col("tier") != EXCEPTION).alias("matched"),
        F.size("row_ids").cast("long").alias("n_rows"), "delta_paise", F.round("confidence", 2).alias("confidence"), "reason", "exception_type",
        F.coalesce(exception_action(F.col("exception_type")), F.lit("")).alias("action"),
    )


def unclaimed_rows(settlement: DataFrame, claims: DataFrame) -> DataFrame:
    return available(settlement, claims)
