"""Connected components of the graph of lines and the batches that they want."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ledgerweave.storage import cut


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """scope, txn_seq, component (its smallest txn_seq) of every line of a written table of edges (scope, txn_seq, settlement_id).

    Each round hands the smallest label over to a line's batches and back, and then jumps to the label's own label,
    so that a chain of n lines takes about log2(n) rounds. Minima are formed with partial sums.
    """
    pairs = edges.select("scope", "txn_seq", "settlement_id").distinct()
    first = pairs.groupBy("scope", "settlement_id").agg(F.min("txn_seq").alias("low"))
    labels = cut(pairs.join(first, ["scope", "settlement_id"]).groupBy("scope", "txn_seq").agg(F.min("low").alias("component")), "labels")
    for _ in range(most_rounds):
        lows = pairs.join(labels, ["scope", "txn_seq"]).groupBy("scope", "settlement_id").agg(F.min("component").alias("low"))
        near = pairs.join(lows, ["scope", "settlement_id"]).groupBy("scope", "txn_seq").agg(F.min("low").alias("low"))
        far = labels.select("scope", F.col("txn_seq").alias("low"), F.col("component").alias("lower"))
        joined = near.join(far, ["scope", "low"]).join(labels, ["scope", "txn_seq"])
        seen = Observation()
        new = joined.select("scope", "txn_seq", F.least("low", "lower").alias("new"), "component").observe(seen, F.count_if(F.col("new") < F.col("component")).alias("fell"))
        labels = cut(new.select("scope", "txn_seq", F.col("new").alias("component")), "labels")
        if not seen.get["fell"]:
            return labels
    raise RuntimeError("components did not settle")
