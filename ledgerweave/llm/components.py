"""Connected components of a table of links, with DataFrame operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, Steps, partitions


def _all_stars(edges: DataFrame, steps: Steps) -> bool:
    """Whether every larger end hangs on one smaller end that hangs on nothing: then all is settled."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above"))
    )
    odd = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).filter("below > 1 or below + above > 1")
    return steps.fewer(odd).isEmpty()


def _with_low(edges: DataFrame, low: DataFrame, limit: int) -> DataFrame:
    """edges and `m`, the smallest neighbour of u. Nodes of over `limit` edges are few, and meet their edges where those lie."""
    hubs = F.broadcast(low.filter(F.col("n") > limit).select("u", "m"))
    rest = edges.join(hubs.select("u"), "u", "left_anti").join(low.filter(F.col("n") <= limit).select("u", "m"), "u")
    return edges.join(hubs, "u").unionByName(rest)


def components(links: DataFrame, steps: Steps | None = None, most_rounds: int = 60) -> DataFrame:
    """node, component (smallest node reachable) for every node of links (a, b); nodes without links don't appear.

    Alternates two star steps until only stars are left: every node's larger neighbours are tied to its smallest
    neighbour, then every node and its smaller neighbours are. The number of rounds grows with the logarithm of the
    number of nodes. Minima are taken with partial sums. Edges of hubs (at most twice the number of partitions, by
    the bound on their edges) aren't shuffled: the hubs are broadcast. Each round is written to the shared folder,
    in the folder of `steps` if given, in as many tasks as its rows are worth; the smallest neighbours too, as both
    the hubs and the rest are read from them.
    Repeated links, self-links and nulls are ignored. links are read once, so they needn't be written before.
    """
    steps = steps or Steps(links.sparkSession, "components")
    keep, n = steps.written, partitions(links.sparkSession)
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = keep(edges, "links")
    for _ in range(most_rounds):
        if _all_stars(edges, steps):
            break
        rows = edges.count()
        limit, most = max(HOT_ROWS, rows // n), 2 * rows  # no table of the round has more
        lowest = lambda e: e.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = keep(lowest(both).select("u", F.least("u", "m").alias("m"), "n"), "lowest", most)
        large = keep(_with_low(both, low, limit).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "links", most)
        low = keep(lowest(large), "lowest", most)
        small = _with_low(large, low, limit).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = keep(small.filter("u <> v").distinct(), "links", most)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
