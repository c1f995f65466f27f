"""Exact and fuzzy candidates by joins, and claiming in the order of the statement without a loop over lines."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby

import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ledgerweave.config import ReconcileConfig
from ledgerweave.functions.scalar import extract_utrs
from ledgerweave.storage import cut

from .components import components


def named_batches(lines: DataFrame, utr_map: DataFrame) -> DataFrame:
    """Every batch that a narration names: a row for each occurrence of a reference (utr_pos) and batch."""
    refs = lines.select("*", F.posexplode(extract_utrs(F.col("narration"))).alias("utr_pos", "utr"))
    return refs.join(utr_map, ["scope", "utr"])


def named_in_window(lines: DataFrame, utr_map: DataFrame, batch_days: DataFrame, window: int) -> DataFrame:
    """The same with `lag` for batches (scope, settlement_id, group_day) whose day is within the window of the line's."""
    hits = named_batches(lines, utr_map).join(batch_days, ["scope", "settlement_id"]).withColumn("lag", F.datediff("value_date", "group_day"))
    return hits.filter(F.abs("lag") <= window)


def exact_edges(named: DataFrame, groups: DataFrame) -> DataFrame:
    """scope, txn_id, txn_seq, settlement_id, times, delta, lag: named batches (named_in_window) whose available total is the credit."""
    hits = named.join(groups.select("scope", "settlement_id", "net"), ["scope", "settlement_id"]).filter(F.col("net") == F.col("credit_paise"))
    edges = hits.groupBy("scope", "txn_id", "txn_seq", "settlement_id", "lag").agg(F.count(F.lit(1)).alias("times"), F.lit(0).cast("long").alias("delta"))
    return edges.select(*EDGES)


def fuzzy_edges(lines: DataFrame, groups: DataFrame, config: ReconcileConfig, few_groups: bool = False) -> DataFrame:
    """The same for batches within the window and the tolerance; a band join on (scope, day, amount bucket).

    The lines are spread over the days and buckets that may hold their batch; with few_groups the batches are
    spread instead, so that the lines are only scanned where Spark finds the batches small enough to broadcast.
    """
    window, tolerance = config.date_window_days, config.amount_tolerance_paise
    bucket = lambda c: F.floor(F.col(c) / F.lit(float(tolerance + 1))).cast("long")
    days = lambda c: F.explode(F.sequence(F.date_sub(c, window), F.date_add(c, window)))
    near = lambda c: F.explode(F.array(*[bucket(c) + k for k in (-1, 0, 1)]))
    left = lines.select("scope", "txn_id", "txn_seq", "value_date", "credit_paise")
    right = groups.select("scope", "settlement_id", "group_day", "net")
    if few_groups:
        left = left.withColumn("day", F.col("value_date")).withColumn("bucket", bucket("credit_paise"))
        right = right.withColumn("day", days("group_day")).withColumn("bucket", near("net"))
    else:
        left = left.withColumn("day", days("value_date")).withColumn("bucket", near("credit_paise"))
        right = right.withColumn("day", F.col("group_day")).withColumn("bucket", bucket("net"))
    hits = left.join(right, ["scope", "day", "bucket"]).withColumn("delta", F.col("credit_paise") - F.col("net")).filter(F.abs("delta") <= tolerance)
    return hits.select("scope", "txn_id", "txn_seq", "settlement_id", F.lit(1).cast("long").alias("times"), "delta", F.datediff("value_date", "group_day").alias("lag"))


EDGE = "scope long, txn_id string, txn_seq long, settlement_id string, times long, delta long, lag int, wins boolean"
EDGES = [c.split()[0] for c in EDGE.split(", ")][:-1]


def claim_in_order(edges: DataFrame) -> DataFrame:
    """edges and `wins`: whether the line claims the batch in a pass over the lines in order.

    A line claims when exactly one of its batches is left. Lines that share no batch with another line are decided
    by windows alone. The others form connected components of lines and batches; those in which some line has just
    one option are replayed in order, each on its own, and in the rest nobody claims.
    """
    return claimed(edges)[0]


def claimed(edges: DataFrame) -> tuple[DataFrame, bool]:
    """claim_in_order, over written tables, and whether any line wins."""
    batch, line = "OVER (PARTITION BY scope, settlement_id)", "OVER (PARTITION BY scope, txn_id)"
    seen = edges.selectExpr("*", f"min(txn_seq) {batch} <> max(txn_seq) {batch} AS wanted").selectExpr(*EDGES, f"max(wanted) {line} AS contested", f"sum(times) {line} AS options")
    may = Observation()
    seen = cut(seen.observe(may, F.expr("count_if(contested AND options = 1) AS fought"), F.expr("count_if(NOT contested AND options = 1) AS clear")), "edges")
    if not may.get["fought"]:
        return seen.selectExpr(*EDGES, "NOT contested AND options = 1 AS wins"), may.get["clear"] > 0
    fought = seen.filter("contested")
    placed = fought.join(components(fought), ["scope", "txn_seq"])
    live = placed.groupBy("scope", "component").agg(F.min("options").alias("least")).filter("least = 1").selectExpr("scope", "component", "true AS live")
    placed = placed.join(live, ["scope", "component"], "left")
    still = placed.filter("live is null").selectExpr(*EDGES, "false AS wins")
    # Many small components to a task, one after the other: a call for each would cost more than its lines.
    dealt = placed.filter("live").select(*EDGES, "component").repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "scope", "component")
    replayed = dealt.sortWithinPartitions("scope", "component", "txn_seq", "settlement_id").mapInPandas(_replayed, EDGE)
    clear = seen.filter("not contested").selectExpr(*EDGES, "options = 1 AS wins")
    return clear.unionByName(cut(still.unionByName(replayed), "contested")), True


def _replayed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Components one after the other, their lines in order. The edges of the last line of a part wait for the next part."""
    held, of, gone = None, None, set()
    for edges in chain(parts, [None]):
        if edges is None:
            edges, held = held, None
        else:
            edges = edges if held is None else pd.concat([held, edges], ignore_index=True)
            last = (edges.scope == edges.scope.iloc[-1]) & (edges.txn_seq == edges.txn_seq.iloc[-1]) if len(edges) else None
            held, edges = (edges[last], edges[~last]) if len(edges) else (None, None)
        if edges is None or not len(edges):
            continue
        wins, at = [False] * len(edges), 0
        for line, mine in groupby(zip(edges.scope, edges.component, edges.txn_seq, edges.settlement_id, edges.times), lambda e: e[:3]):
            if line[:2] != of:
                of, gone = line[:2], set()
            left, first = [], at
            for at, e in enumerate(mine, start=first):
                if e[3] not in gone:
                    left.append((at, e))
            at += 1
            if len(left) == 1 and left[0][1][4] == 1:
                wins[left[0][0]] = True
                gone.add(left[0][1][3])
        yield edges[EDGES].assign(wins=wins)


def claim_priority(edges: DataFrame) -> DataFrame:
    """For each edge, whether its line is the first of the statement that wants the batch."""
    first = F.min("txn_seq").over(Window.partitionBy("scope", "settlement_id"))
    return edges.withColumn("first_claimant", first == F.col("txn_seq"))
