"""Part-paid batches that a narration names: remainders, slices and exact subsets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ledgerweave.config import ReconcileConfig
from ledgerweave.functions.scalar import collision_risk_sql

from .arith import subsets
from .index import available, settlement_groups, utr_map
from .pools import SET_RISK, unsafe
from .tiers import named_in_window

MEMBERS = "array<struct<row_id:string,net_paise:bigint>>"
#: One named batch of one line.
ASKED = ["scope", "txn_id", "utr_pos", "settlement_id"]


def unseen(rows: DataFrame, gone: DataFrame | None) -> DataFrame:
    """rows (scope, row_id, txn_seq, ...) that no earlier line has taken. gone: scope, row_id, seq."""
    if gone is None:
        return rows
    taken = gone.selectExpr("scope AS g_scope", "row_id AS g_row", "seq AS g_seq")
    return rows.join(taken, F.expr("scope = g_scope AND row_id = g_row AND g_seq < txn_seq"), "left_anti")


def less_taken(held: DataFrame, keys: list[str], of: list[str], sums: dict[str, str], guess: DataFrame | None) -> DataFrame:
    """held (keys, txn_seq, totals) with what earlier lines take of the same batch or day (of) off its totals. sums: total -> column of guess."""
    if guess is None:
        return held
    by = guess.groupBy(*of, "seq").agg(*[F.expr(f"sum({c}) AS taken_{t}") for t, c in sums.items()])
    off = held.select(*dict.fromkeys([*keys, *of, "txn_seq"])).join(by, of).filter("seq < txn_seq").groupBy(*keys).agg(*[F.expr(f"sum(taken_{t}) AS taken_{t}") for t in sums])
    return held.join(off, keys, "left").selectExpr(*[f"{c} - coalesce(taken_{c}, 0) AS {c}" if c in sums else c for c in held.columns])


def part_paid(named: DataFrame, groups: DataFrame, guess: DataFrame | None = None) -> DataFrame:
    """Lines with each named batch (tiers.named_in_window) that could hold them: two rows or more, total at least the credit."""
    held = named.join(groups.select("scope", "settlement_id", "n", "net"), ["scope", "settlement_id"])
    return less_taken(held, ASKED, ["scope", "settlement_id"], {"n": "one", "net": "net_paise"}, guess).filter((F.col("n") >= 2) & (F.col("net") >= F.col("credit_paise")))


def part_paid_of(lines: DataFrame, settlement: DataFrame, config: ReconcileConfig, claims: DataFrame | None = None) -> DataFrame:
    groups = settlement_groups(settlement, claims)
    return part_paid(named_in_window(lines, utr_map(settlement), groups.select("scope", "settlement_id", "group_day"), config.date_window_days), groups)


def remaining_rows(part: DataFrame) -> DataFrame:
    """Batches whose whole remainder is the credit."""
    return part.filter("net = credit_paise")


def sliced(part: DataFrame, rows: DataFrame, gone: DataFrame | None = None, listed: int = 0) -> DataFrame:
    """part with lead and trail: how many rows by row_id from the start, and else
    from the end, sum to the credit; high and low: the last and first row of that slice. amounts: (row_id, net_paise) of batches of up to `listed` rows."""
    keys = [*ASKED, "txn_seq", "credit_paise", "n", "net", "lag"]
    joined = unseen(part.select(*keys).join(rows.select("scope", "settlement_id", "row_id", "net_paise"), ["scope", "settlement_id"]), gone)
    order = "OVER (PARTITION BY scope, txn_id, utr_pos, settlement_id ORDER BY row_id ROWS UNBOUNDED PRECEDING)"
    running = joined.selectExpr("*", f"sum(net_paise) {order} AS running", f"row_number() {order} AS place")
    ahead, behind = "running = credit_paise", "net - running + net_paise = credit_paise"
    return running.groupBy(*keys).agg(
        F.expr(f"min(if({ahead}, CAST(place AS BIGINT), null)) AS lead"), F.expr(f"min(if({ahead}, row_id, null)) AS high"), F.expr(f"n - max(if({behind}, place, null)) + 1 AS trail"),
        F.expr(f"max(if({behind}, row_id, null)) AS low"), F.expr(f"sort_array(collect_list(if(n <= {listed}, struct(row_id, net_paise), null))) AS amounts"),
    )


def slices(part: DataFrame, settlement: DataFrame, claims: DataFrame | None = None, leading: bool = True) -> DataFrame:
    """scope, txn_id, settlement_id, taken, n, risk: the shortest prefix (or suffix) by row_id that sums to the credit."""
    cut_at = sliced(part.filter("net > credit_paise"), available(settlement, claims)).withColumn("taken", F.col("lead" if leading else "trail")).filter("taken is not null")
    return cut_at.selectExpr("scope", "txn_id", "settlement_id", "taken", "n", f"{SLICE_RISK} AS risk")


SLICE_RISK = collision_risk_sql("2 * n", "greatest(net, 1)")


@F.pandas_udf(ArrayType(ArrayType(IntegerType())))
def _subsets(amounts: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([[list(s) for s in subsets(a, int(t))] if len(a) else [] for a, t in zip(amounts, target)], dtype=object)


def anchored_candidates(named: DataFrame, groups: DataFrame, rows: DataFrame, config: ReconcileConfig, guess: DataFrame | None = None, gone: DataFrame | None = None) -> DataFrame:
    """A row for each candidate of a line in the batches that it names, and one without strategy for each batch that is declined.

    scope, txn_id, txn_seq, utr_pos, settlement_id, strategy, low, high, members, lag, risk, n_rows, declined. A whole
    remainder or a slice is told by its bounds, a subset by its members. guess: rows that lines take in this pass;
    gone: those and all taken before.
    """
    at = sliced(part_paid(named, groups, guess), rows, gone, config.subset_safe_rows)
    hard = "net > credit_paise AND lead is null AND trail is null"
    at = at.selectExpr("*", f"{hard} AND {unsafe(config)} AS declined", f"{hard} AND NOT {unsafe(config)} AS ask", "net = credit_paise AS rest")
    at = at.withColumn("sets", _subsets(F.expr("if(ask, amounts.net_paise, array())"), "credit_paise")).selectExpr("*", "explode_outer(sets) AS chosen")
    return at.selectExpr(
        *ASKED, "txn_seq", "CASE WHEN rest THEN 'remaining rows of a partly paid batch' WHEN lead is not null THEN 'leading slice of the batch' WHEN trail is not null THEN 'trailing slice of the batch' "
        "WHEN chosen is not null THEN 'exact subset of the named batch' END AS strategy",
        "if(lead is null AND NOT rest, low, null) AS low", "if(lead is not null AND NOT rest, high, null) AS high", "transform(chosen, i -> amounts[i]) AS members", "lag",
        f"CASE WHEN rest THEN 0.0D WHEN chosen is not null THEN {SET_RISK} WHEN lead is not null OR trail is not null THEN {SLICE_RISK} END AS risk",
        "CAST(CASE WHEN rest THEN n ELSE coalesce(lead, trail, size(chosen)) END AS BIGINT) AS n_rows", "declined",
    ).filter("strategy is not null or declined")
