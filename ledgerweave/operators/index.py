"""Groups, reference map, day pools and what is still available. Tables are keyed by (scope, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLAIMS = "scope long, row_id string, txn_id string, tier string, round int"


def available(settlement: DataFrame, claims: DataFrame | None) -> DataFrame:
    """Settlement rows that nothing has claimed."""
    if claims is None:
        return settlement
    return settlement.join(claims.select("scope", "row_id"), ["scope", "row_id"], "left_anti")


def settlement_groups(settlement: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """scope, settlement_id, group_day (of the first row in file order, claimed or not), n, net of the available rows."""
    named = settlement.filter("settlement_id is not null")
    if claims is None:
        return named.groupBy("scope", "settlement_id").agg(
            F.min_by("settled_on", "row_seq").alias("group_day"), F.count(F.lit(1)).alias("n"), F.sum("net_paise").alias("net")
        )
    taken = named.join(claims.select("scope", "row_id", F.lit(True).alias("taken")), ["scope", "row_id"], "left")
    free = F.col("taken").isNull()
    return (
        taken.groupBy("scope", "settlement_id")
        .agg(F.min_by("settled_on", "row_seq").alias("group_day"), F.count(F.when(free, 1)).alias("n"), F.sum(F.when(free, F.col("net_paise"))).alias("net"))
        .filter("n > 0")
    )


def utr_map(settlement: DataFrame) -> DataFrame:
    """Distinct (scope, utr, settlement_id) of the rows that have both."""
    return settlement.filter("utr is not null and settlement_id is not null").select("scope", "utr", "settlement_id").distinct()


def day_pools(settlement: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """scope, settled_on, n, net of the available rows without a settlement id."""
    return (
        available(settlement.filter("settlement_id is null"), claims).groupBy("scope", "settled_on")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("net_paise").alias("net"))
    )


def day_pools_in_window(lines: DataFrame, pools: DataFrame, window: int = 3) -> DataFrame:
    """Every line with every pool that settles at most `window` days from it: an equi-join on exploded days."""
    days = F.sequence(F.date_sub("value_date", window), F.date_add("value_date", window))
    probes = lines.withColumn("settled_on", F.explode(days))
    return probes.join(pools, ["scope", "settled_on"]).withColumn("lag", F.datediff("value_date", "settled_on"))


def candidates_still_available(candidates: DataFrame, claims: DataFrame) -> DataFrame:
    """Candidates (scope, txn_id, cand_no, row_ids, ...) none of whose rows is claimed."""
    rows = candidates.select("scope", "txn_id", "cand_no", F.explode("row_ids").alias("row_id"))
    spoilt = rows.join(claims.select("scope", "row_id"), ["scope", "row_id"], "left_semi").select("scope", "txn_id", "cand_no").distinct()
    return candidates.join(spoilt, ["scope", "txn_id", "cand_no"], "left_anti")


def split_lines(bank: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Credits, and all other lines."""
    return bank.filter("credit_paise > 0"), bank.filter("not coalesce(credit_paise > 0, false)")
