"""Directory scan: the files of a tree that are worth indexing, in any store that `stores` opens.

The tree is a data source (`tree`): tasks list folders, and size and extension are tested there. Contents are read by tasks over paths.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from .stores import store
from .tree import FOLDERS, Tree

MAX_BYTES = 1 << 20
#: Bytes of contents in a batch, about.
BATCH = 8 << 20


def wanted() -> Column:
    """Which files of a tree are indexed, by their length and extension."""
    return (F.col("length") <= MAX_BYTES) & F.col("extension").isin(*S.CODE_EXTENSIONS, *S.DOC_EXTENSIONS)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path (relative to root), mtime, length, chunk_type of the wanted files, and `at`, their place; no content is read."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Tree)
    files = spark.read.format(Tree.name()).option("root", root).option("folders", FOLDERS).load()
    return files.where(wanted()).withColumn("chunk_type", S.chunk_type(F.col("path"))).select("path", "mtime", "length", "chunk_type", "at")


def read(files: DataFrame, root: str) -> DataFrame:
    """`files` of a listing with `content` in place of `at`. Files that are gone meanwhile, or that may not be read, are left out."""

    def run(batches):
        at_root = store(root)
        for batch in batches:
            keep, contents, held = [], [], 0
            for k, at in enumerate(batch.column("at").to_pylist()):
                try:
                    contents.append(at_root.read(at))
                except (FileNotFoundError, PermissionError):
                    continue
                keep.append(k)
                held += len(contents[-1])
                if held >= BATCH:
                    yield _with(batch, keep, contents)
                    keep, contents, held = [], [], 0
            yield _with(batch, keep, contents)

    rest = [c for c in files.columns if c != "at"]
    schema = files.select(*rest, F.lit(b"").alias("content")).schema
    return files.repartition(F.xxhash64("at")).mapInArrow(run, schema)


def _with(batch: pa.RecordBatch, keep: list[int], contents: list[bytes]) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n != "at"]
    return pa.RecordBatch.from_arrays([*batch.take(pa.array(keep, pa.int64())).select(names).columns, pa.array(contents, pa.binary())], [*names, "content"])


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path (relative to root), mtime, length, chunk_type and content; size and directories are filtered before content is read."""
    return read(listing(spark, root), root)


def texts(files: DataFrame) -> DataFrame:
    """The scan with `text`, and `error` instead where the bytes are no UTF-8."""
    raw = F.col("content").cast("string")
    fine = F.is_valid_utf8(raw)
    return files.withColumn("text", F.when(fine, raw)).withColumn("error", F.when(~fine, F.lit("invalid UTF-8"))).withColumn("hash", S.content_hash(F.col("content")))
