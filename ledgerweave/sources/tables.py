"""Result and audit tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.operators.explain import result_lines
from ledgerweave.operators.order import positions


def write_results(results: DataFrame, bank: DataFrame, path: str, form: str = "parquet") -> None:
    """Results beside their bank lines, with their `position` in the statement, partitioned by scope, as Parquet or JSON.

    Every file is sorted, and files of a scope hold ranges of positions that don't overlap: statement order needs no sort.
    """
    lines = positions(result_lines(results, bank), "scope", ["txn_seq"])
    lines.repartitionByRange("scope", "position").sortWithinPartitions("scope", "position").write.partitionBy("scope").format(form).save(path)


def write_quarantine(quarantine: DataFrame, path: str) -> None:
    quarantine.withColumn("raw", F.substring("raw", 1, 120)).write.parquet(path)


def write_drift(findings: DataFrame, path: str) -> None:
    findings.write.partitionBy("scope").parquet(path)


STARTED = "run_id string, fingerprint string, config_json string, started_at string"


def start_run(spark: SparkSession, path: str, run_id: str, fingerprint: str, config_json: str, started_at: str) -> str:
    """The id of the run to work under: of the earliest run of the same fingerprint if there is one, and then nothing is written.

    Two that start at the same time both write, read again, and so agree on the earlier of them.
    """
    def earliest():
        try:
            return spark.read.schema(STARTED).parquet(f"{path}/started").filter(F.col("fingerprint") == fingerprint).orderBy("started_at", "run_id").first()
        except AnalysisException:  # no run was ever started here
            return None

    found = earliest()
    if not found:
        spark.createDataFrame([(run_id, fingerprint, config_json, started_at)], STARTED).write.mode("append").parquet(f"{path}/started")
        found = earliest()
    return found.run_id


def finish_run(path: str, run_id: str, summary: DataFrame, finished_at: str) -> None:
    """Stores a run's summary (one row) among the finished runs; done again, it replaces it."""
    row = summary.select(F.lit(finished_at).alias("finished_at"), "*")
    row.write.mode("overwrite").parquet(f"{path}/finished/run_id={run_id}")


def finished(spark: SparkSession, path: str) -> DataFrame | None:
    """run_id and summary of the finished runs; none if there are none."""
    try:
        done = spark.read.parquet(f"{path}/finished")
    except AnalysisException:
        return None
    return done.withColumn("run_id", F.col("run_id").cast("string"))


def runs(spark: SparkSession, path: str) -> DataFrame:
    """Every run that was started, the earliest of each fingerprint, with its summary where it is finished."""
    started = spark.read.schema(STARTED).parquet(f"{path}/started")
    started = started.groupBy("fingerprint").agg(F.min_by(F.struct(*[c.split()[0] for c in STARTED.split(", ")]), F.struct("started_at", "run_id")).alias("r")).select("r.*")
    done = finished(spark, path)
    return started if done is None else started.join(done, "run_id", "left")


def write_part(df: DataFrame, path: str, run_id: str) -> None:
    """A run's part of a table that all runs share. Written again, after a lost driver, it takes the place of what was there."""
    df.write.mode("overwrite").parquet(f"{path}/run_id={run_id}")


def append_audit(entries: DataFrame, path: str) -> None:
    """Entries of one or more runs (run_id). A run's entries are replaced as a whole: an append that is repeated leaves each entry once."""
    entries.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def of_finished(spark: SparkSession, path: str, runs_path: str) -> DataFrame:
    """Rows of a shared table whose runs are finished; what a run wrote before it was lost is not seen."""
    return spark.read.parquet(path).withColumn("run_id", F.col("run_id").cast("string")).join(finished(spark, runs_path).select("run_id"), "run_id", "left_semi")


def read_audit(spark: SparkSession, path: str, run_id: str | None = None, limit: int = 500) -> DataFrame:
    entries = spark.read.parquet(path).withColumn("run_id", F.col("run_id").cast("string"))
    return (entries.filter(F.col("run_id") == run_id) if run_id else entries).orderBy("seq").limit(limit)
