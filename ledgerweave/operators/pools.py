"""Pools of a settle date without a batch: sets of whole days, held-back rows, exact subsets, nearest day first."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.config import ReconcileConfig
from ledgerweave.functions.scalar import collision_risk_sql

from .arith import MOST_NEGATIVE, MOST_POSITIVE, MOST_TARGET, complement, decidable, subsets
from .index import day_pools_in_window

#: Days that may be taken together.
MOST_DAYS = 4


def day_masks(window: int) -> list[list[int]]:
    """The sets of up to MOST_DAYS offsets, as the table that pool totals are joined with."""
    days = range(-window, window + 1)
    return [list(c) for k in range(1, MOST_DAYS + 1) for c in combinations(days, k)]


def combined_days(near: DataFrame, window: int) -> DataFrame:
    """scope, txn_id, credit_paise, and m (offset of the day from the line's -> n, net, ...), days, spread, hits: the sets of offsets whose whole pools sum to the credit.

    near: scope, txn_id, credit_paise, lag, n, net of every pool in a line's window.
    """
    kept = ", ".join(c for c in near.columns if c not in ("scope", "txn_id", "credit_paise", "lag"))
    entries = F.expr(f"map_from_entries(collect_list(struct(-lag, struct({kept})))) AS m")
    masks = ", ".join(f"array({', '.join(map(str, m))})" for m in day_masks(window))
    hits = f"filter(array({masks}), k -> forall(k, d -> map_contains_key(m, d)) AND aggregate(k, 0L, (a, d) -> a + m[d].net) = credit_paise) AS hits"
    return near.groupBy("scope", "txn_id", "credit_paise").agg(entries, F.expr("sum(net) AS spread"), F.expr("count(1) AS days")).selectExpr("*", hits)


#: Of a row of combined_days with one of its hits as `mask`.
MASK_ROWS = "aggregate(mask, 0L, (a, d) -> a + m[d].n)"
MASK_RISK = collision_risk_sql("pow(2.0D, days)", "greatest(spread, 1)")


def day_combinations(lines: DataFrame, pools: DataFrame, window: int = 3) -> DataFrame:
    """scope, txn_id, days (offsets from the value date, joined by a comma), n_rows, risk of every set of whole day pools that sums to the credit."""
    near = day_pools_in_window(lines, pools, window).select("scope", "txn_id", "credit_paise", "lag", "net", "n")
    hit = combined_days(near, window).selectExpr("*", "explode(hits) AS mask")
    return hit.selectExpr("scope", "txn_id", "array_join(CAST(mask AS array<string>), ',') AS days", f"{MASK_ROWS} AS n_rows", f"{MASK_RISK} AS risk")


#: Risks of a pool of n rows and net in all: of an exact subset, and of leaving out up to three rows.
SET_RISK = collision_risk_sql("pow(2.0D, n)", "greatest(net, 1)")
DROP_RISK = collision_risk_sql("1.0D + n + CAST(n AS DOUBLE) * (n - 1) / 2 + CAST(n AS DOUBLE) * (n - 1) * (n - 2) / 6", "greatest(net, 1)")


def unsafe(config: ReconcileConfig) -> str:
    """Whether a pool is too large, for its total, for an exact subset to be evidence."""
    return f"(n > {config.subset_safe_rows} OR {SET_RISK} > {config.max_collision_risk}D)"


def _way(amounts: np.ndarray, target: int, may_drop: bool, may_set: bool, most: int) -> list[list[int]] | None:
    """The positions kept: all but the dropped ones, else up to two exact subsets."""
    if not len(amounts):
        return None
    if may_drop:
        drop = complement(amounts, target, most)
        if drop is not None and len(drop) < len(amounts):
            return [[-1, *(i for i in range(len(amounts)) if i not in drop)]]
    return [list(s) for s in subsets(amounts, target)] or None if may_set else None


def by_line(rows: DataFrame) -> DataFrame:
    """rows dealt by their line over a set number of tasks: few bytes and much work, so the number isn't cut down by their size."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "scope", "txn_id")


def _judged(pairs: DataFrame, rows, config: ReconcileConfig, ask: str) -> DataFrame:
    """pairs (a line and a day) and, where asked, how and kept: what of the day's rows is the credit. Only pools that pass a gate, and hold enough, meet their rows."""
    most = config.max_complement_drop

    @F.pandas_udf("array<array<int>>")
    def way(amounts: pd.Series, target: pd.Series, may_drop: pd.Series, may_set: pd.Series) -> pd.Series:
        return pd.Series([_way(a, int(t), d, s, most) for a, t, d, s in zip(amounts, target, may_drop, may_set)], dtype=object)

    pairs = pairs.selectExpr(
        "*", f"{unsafe(config)} AS unsafe", f"{DROP_RISK} AS drop_risk", f"{SET_RISK} AS set_risk", f"{ask} AND net > credit_paise AND {DROP_RISK} <= {config.max_collision_risk}D AS may_drop",
        f"{ask} AND plus >= credit_paise AND NOT {unsafe(config)} AS may_set",
    )
    # Pairs keep their row where no pool is asked for, so that they need not be joined with their answers.
    held = rows(pairs, "may_drop OR may_set").groupBy("scope", "txn_id", "day").agg(
        F.expr("sort_array(collect_list(if(row_id is null, null, struct(row_seq, row_id, net_paise)))) AS pool"), *[F.expr(f"first({c}) AS {c}") for c in pairs.columns if c not in ("scope", "txn_id", "day")]
    )
    held = held.withColumn("way", way(F.expr("pool.net_paise"), "credit_paise", "may_drop", "may_set"))
    # Positions of held-back ways come after a -1.
    return held.selectExpr(
        *[c for c in pairs.columns if c not in ("may_drop", "may_set")], "if(way is null, null, if(way[0][0] = -1, 'drop', 'set')) AS how",
        "transform(way, one -> transform(filter(one, i -> i >= 0), i -> named_struct('row_id', pool[i].row_id, 'net_paise', pool[i].net_paise))) AS kept",
    )


def with_rows_of(loose: DataFrame, unseen=lambda rows: rows):
    """A function that adds the rows (row_seq, row_id, net_paise; null if none) of a line's day to pairs (scope, day, ...) for which a condition holds."""
    one = loose.selectExpr("scope AS l_scope", "settled_on AS l_day", "row_seq", "row_id", "net_paise")
    return lambda pairs, when: unseen(pairs.join(one, F.expr(f"scope = l_scope AND day = l_day AND ({when})"), "left").drop("l_scope", "l_day"))


PLACED = ["scope", "txn_id", "txn_seq", "credit_paise", "day", "lag", "n", "net", "plus"]


def near_pools(near: DataFrame, rows, config: ReconcileConfig) -> DataFrame:
    """The pools in each line's window, a row for each (PLACED) with its place, nearest first; on the first m, days, spread and hits (combined_days).

    Where no set of whole days is the credit, the nearest day is judged at once: how and kept.
    near: PLACED. rows: with_rows_of.
    """
    line = combined_days(by_line(near.select(*PLACED)), config.date_window_days)
    order = "posexplode(array_sort(transform(map_entries(m), e -> struct(abs(e.key) AS far, e.value.day AS day, -e.key AS lag, e.value AS p)))) AS (at, e)"
    pairs = line.selectExpr("scope", "txn_id", "credit_paise", "m", "days", "spread", "hits", order).selectExpr(
        "scope", "txn_id", "e.p.txn_seq", "credit_paise", "e.day", "e.lag", "e.p.n", "e.p.net", "e.p.plus", "at + 1 AS place",
        *(f"if(at = 0, {c}, null) AS {c}" for c in ("m", "days", "spread", "hits")), "size(hits) = 0 AS open",
    )
    return _judged(pairs, rows, config, "open AND place = 1")


def nearest_first(near: DataFrame, rows, config: ReconcileConfig) -> DataFrame:
    """Day pools tried one by one, nearest first: scope, txn_id, day (null: none yields), lag, strategy, members, risk, days_tried, declined.

    A row for each way to the credit of the first day that yields one: all but up to three held-back rows, else an
    exact subset (two of them stand for any more). declined: a pool tried before was too large for a subset to be
    evidence. near: near_pools, kept; lines with a set of whole days are left out. The farther days are only joined
    for lines that the nearest one leaves open.
    """
    line = ["scope", "txn_id"]
    near = near.filter("open").drop("m", "days", "spread", "hits", "open")
    first = near.filter("place = 1")
    still = near.filter("place > 1").join(first.filter("how is not null").select(*line), line, "left_anti").drop("unsafe", "drop_risk", "set_risk", "how", "kept")
    tried = first.unionByName(_judged(still, rows, config, "true"))
    of_line = "OVER (PARTITION BY scope, txn_id)"
    tried = tried.selectExpr("*", f"min(if(how is not null, place, null)) {of_line} AS stop", f"count(1) {of_line} AS pools")
    tried = tried.selectExpr("*", f"max(unsafe AND (stop is null OR place < stop)) {of_line} AS declined").filter("place = coalesce(stop, 1)")
    return tried.selectExpr(
        *line, "txn_seq", "if(stop is null, null, day) AS day", "if(stop is null, null, lag) AS lag",
        "CASE how WHEN 'drop' THEN 'day group minus held-back rows' WHEN 'set' THEN 'exact subset of one settle-date group' END AS strategy", "explode_outer(kept) AS members",
        "CASE how WHEN 'drop' THEN drop_risk WHEN 'set' THEN set_risk END AS risk", "CAST(coalesce(stop, pools) AS BIGINT) AS days_tried", "declined",
    )


def complement_one(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """pool, dropped: the first row whose amount is what the pool has too much. rows: pool, pos, amount; targets: pool, gap."""
    return rows.join(targets.filter("gap > 0"), "pool").filter("amount = gap").groupBy("pool").agg(F.min("pos").alias("dropped"))


def complement_two(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """pool, first, second: of the pairs that make up the gap the one whose later row comes first, with its latest partner.

    An equi-join on (pool, amount = gap - amount).
    """
    later = rows.join(targets.filter("gap > 0"), "pool").select("pool", F.col("pos").alias("second"), (F.col("gap") - F.col("amount")).alias("amount"))
    pairs = later.join(rows.withColumnRenamed("pos", "first"), ["pool", "amount"]).filter("first < second")
    return pairs.groupBy("pool").agg(F.min(F.struct("second", -F.col("first"))).alias("p")).select("pool", (-F.col("p.col2")).alias("first"), F.col("p.second").alias("second"))


def solve(pools: DataFrame, how: str, most: int = 3) -> DataFrame:
    """pools (amounts array, target, ...) and `answer`: the dropped positions (how = complement) or up to two sets of positions (subset), as text; null where arith can't tell."""
    @F.pandas_udf("string")
    def answer(amounts: pd.Series, target: pd.Series) -> pd.Series:
        text = lambda rows: ",".join(map(str, rows))
        if how == "complement":
            return pd.Series([None if (d := complement(a, t, most)) is None else text(d) for a, t in zip(amounts, target)], dtype=object)
        return pd.Series(["|".join(sorted(map(text, subsets(a, t)))) if decidable(a, t) else None for a, t in zip(amounts, target)], dtype=object)

    return pools.withColumn("answer", answer("amounts", "target"))


def subset_ways(pools: DataFrame, most_rows: int) -> DataFrame:
    """pool, n, ways (0, 1, or 2 for more), declined: one row a pool. pools: pool, amounts (array), target.

    Declined, with ways null: more than most_rows rows, or a target, payments, refunds or sums beyond the bounds of arith.
    """
    n, plus, minus = F.size("amounts").cast("long"), F.size(F.filter("amounts", lambda x: x > 0)), F.size(F.filter("amounts", lambda x: x < 0))
    beyond = (n > most_rows) | (F.col("target") <= 0) | (F.col("target") > MOST_TARGET) | (plus > MOST_POSITIVE) | (minus > MOST_NEGATIVE)
    # Small in bytes, but large pools take long: Spark would put them all into few tasks. By the pool itself they lie already.
    parts = int(pools.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = pools.select("pool", "target", n.alias("n"), beyond.alias("beyond"), "amounts").repartition(parts, F.xxhash64("pool"))
    solved = solve(asked.withColumn("amounts", F.when(F.col("beyond"), F.array().cast("array<bigint>")).otherwise(F.col("amounts"))), "subset")
    declined = F.col("beyond") | F.col("answer").isNull()
    ways = F.when(declined, None).when(F.col("answer") == "", 0).otherwise(F.size(F.split("answer", r"\|")))
    return solved.select("pool", "n", ways.cast("int").alias("ways"), declined.alias("declined"))
