"""Tables that cut lineage, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; where that is unset (tests), one of this process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all nodes share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loom-checkpoint-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


@contextmanager
def _shuffles_go(spark: SparkSession):
    """Shuffle files of what is written inside are removed as soon as it is written."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts go to Python in batches of so many rows at most, for this session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


#: Bytes of a file, or of a shuffle, of which Spark makes a broadcast by itself: rows of a few bytes take twenty times as much in the driver.
BROADCAST = 1 << 20


def small_broadcasts(spark: SparkSession, most: int = BROADCAST) -> None:
    """What Spark broadcasts by itself is at most so large, for this session: the driver's memory doesn't grow with tables of names and numbers."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) if not spark.conf.get(key).startswith("-") else -1
    if now > most:
        spark.conf.set(key, str(most))


def spread(rows: DataFrame, key: str) -> DataFrame:
    """`rows` over all cores, by a key: a file of one row group is one task, however many rows it has."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


class Scratch:
    """Intermediate tables as Parquet in the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        small_batches(spark)
        small_broadcasts(spark)
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def cut(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """`df` as a table, in a folder for each value of `by` if given."""
        path = f"{self.root}/{name}"
        with _shuffles_go(self.spark):
            (df.write.partitionBy(by) if by else df.write).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def observed(self, df: DataFrame, name: str, by: str | None = None, **what: Column) -> tuple[DataFrame, dict]:
        """`df` as a table, and aggregates of its rows that are taken while it is written: no second scan, no second job.

        They are taken in the tasks that write, of which each counts once, so that a task that is run again adds nothing.
        """
        seen = Observation()
        table = self.cut(df.observe(seen, *[c.alias(n) for n, c in what.items()]), name, by)
        return table, seen.get

    def counted(self, df: DataFrame, name: str) -> tuple[DataFrame, int]:
        """`df` as a table, and the number of its rows."""
        table, seen = self.observed(df, name, n=F.count("*"))
        return table, seen["n"]

    def drop(self, *names: str) -> None:
        """Removes tables that nothing reads any more."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def numbered(self, df: DataFrame, number: str, *order: str, name: str = "numbered") -> DataFrame:
        """`df` with `number`, dense from 0 in this order: rows are dealt by ranges and written, then ranges are numbered by their counts.

        One evaluation decides the ranges; a row for each range comes to the driver.
        """
        at = F.monotonically_increasing_id()
        rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
        rows = self.cut(rows.withColumn("__p", F.shiftright(at, 33)).withColumn("__i", at.bitwiseAND(F.lit((1 << 33) - 1))), name)
        base, total = [], 0
        for p, n in sorted((r[0], r[1]) for r in rows.groupBy("__p").agg(F.count("*")).collect()):
            base.append((p, total))
            total += n
        bases = self.spark.createDataFrame(base, "__p long, __base long")
        return rows.join(F.broadcast(bases), "__p").select(*df.columns, (F.col("__base") + F.col("__i")).alias(number))
