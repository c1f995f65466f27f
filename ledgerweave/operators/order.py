"""Numbers of rows in an order, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.storage import cut

#: Bits of monotonically_increasing_id that count the rows of a task.
IN_TASK = 33


def positions(rows: DataFrame, group: str, order: list[str], name: str = "position") -> DataFrame:
    """rows with their place, from 1, in their group, by the order's columns (rows equal in all of them in any order).

    Rows are dealt by ranges of (group, order) and sorted there; the first place of a range in a group follows from the
    counts of the ranges before it, a row for each range and group in it. The result is sorted within its partitions.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order).withColumn("_seat", F.monotonically_increasing_id())
    ranged = cut(ranged, "ranges").withColumn("_range", F.shiftright("_seat", IN_TASK))
    runs = ranged.groupBy("_range", F.col(group).alias("_of")).agg(F.min("_seat").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    runs = runs.selectExpr("_range AS _r", "_of", "coalesce(sum(_rows) OVER (PARTITION BY _of ORDER BY _range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - _first AS _shift")
    placed = ranged.join(runs, (F.col("_range") == F.col("_r")) & F.col(group).eqNullSafe(F.col("_of")))
    return placed.select(*rows.columns, (F.col("_seat") + F.col("_shift") + 1).alias(name))
