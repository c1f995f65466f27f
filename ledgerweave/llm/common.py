"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of our own in a local session without it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        where = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again.

    Cuts the lineage with one copy that outlives any executor; later stages prune columns in the scan.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Steps:
    """Tables of the steps of one run, in one folder that is emptied once no later step reads them.

    tasks: how many tasks work on a table at most; None leaves them as they come.
    files: how many tasks write one at most, unless the work of those tasks is heavy. Most of these tables are narrow, and
    Hadoop starts several processes for a file where it has no native library, which for a moment share the memory of
    the executor that writes it.
    """

    def __init__(self, spark: SparkSession, name: str, tasks: int | None = None):
        self.spark, self.path, self.made, self.tasks = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0, tasks
        cores = spark.sparkContext.defaultParallelism
        self.files = tasks and min(tasks, max(cores, tasks // TASKS_A_FILE // cores * cores))

    def fewer(self, df: DataFrame, rows: int | None = None, most: int | None = None) -> DataFrame:
        """df in `most` (`tasks`) tasks at most; with rows (what it has at most) also in no more than those are worth.

        Its partitions are joined, not dealt anew: rows that lie together stay together.
        """
        most = [x for x in (most or self.tasks, None if rows is None else tasks_for(self.spark, rows, least=1)) if x]
        return df.coalesce(min(most)) if most else df

    def written(self, df: DataFrame, name: str, rows: int | None = None, codec: str = "zstd", heavy: bool = False) -> DataFrame:
        self.made += 1
        path = f"{self.path}/{self.made}-{name}"
        self.fewer(df, rows, self.tasks if heavy else self.files).write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def emptied(self) -> None:
        self.spark.range(0).write.mode("overwrite").parquet(self.path)


#: A key is hot from so many rows, or from the rows that a task gets on average, whichever is more.
HOT_ROWS = 256


def hot_keys(rows: DataFrame, key: str, n: int) -> DataFrame:
    """key, salts for every hot key of a written table: n rows at most. salts is the number of parts that its rows are split into."""
    limit = max(HOT_ROWS, rows.count() // n)
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("hot_rows")).filter(F.col("hot_rows") > limit).select(
        key, F.ceil(F.col("hot_rows") / limit).cast("int").alias("salts")
    )


def joined_hot(rows: DataFrame, table: DataFrame, key: str, n: int) -> DataFrame:
    """Inner join of a written table with another on key; rows of hot keys are split, and the other side's copied to the parts."""
    hot = F.broadcast(hot_keys(rows, key, n))
    left = rows.join(hot, key, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("salts")).cast("int"), F.lit(0)))
    right = table.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts") - 1, F.lit(0)))))
    return left.drop("salts").join(right.drop("salts"), [key, "salt"]).drop("salt")


def bucketed(df: DataFrame, key: str, n: int, name: str) -> DataFrame:
    """Write df to the shared folder in n hash buckets of key and read it again: joins on key move the other side only."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    writer = df.write.bucketBy(n, key).option("path", f"{shared_dir(spark)}/{table}").option("compression", "uncompressed")
    writer.saveAsTable(table)
    return spark.table(table)


def partitions(spark: SparkSession) -> int:
    """How many tasks a shuffle of corpus-sized rows is dealt over."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Rows that are worth a task of their own, at least; tasks that are worth a file in a table of steps (each core has one at least).
TASK_ROWS, TASKS_A_FILE = 2048, 4


def tasks_for(spark: SparkSession, rows: int, least: int | None = None) -> int:
    """How many tasks so many rows are worth: every core has one (or `least` of them do), and a small table isn't cut into as many as a large one."""
    return min(partitions(spark), max(least or spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Rows and bytes that go to a Python worker at a time, at most.
BATCH_ROWS, BATCH_BYTES = 250, 32 << 20


def lean_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at a time: documents are long, and Spark's own bounds are for short rows.

    These are settings of the session, and stay: results are computed later than they are asked for.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, most)


def ids_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the identifier and the text (null as empty), under fixed names; other columns go, so none can clash."""
    lean_batches(docs.sparkSession)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
