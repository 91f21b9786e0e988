"""Refresh as a stream: files that come, change or go, whatever their names start with, trigger one refresh for each micro-batch."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import Index
from .changes import PARTS, changes


def watch(spark: SparkSession, root: str, index: Index, checkpoint: str, once: bool = True, every: str = "10 seconds", parts: int = PARTS) -> StreamingQuery:
    """A query that keeps an index fresh; `once`: for what is there now, then it ends, else the tree is listed `every` so often."""

    def run(batch, _id: int) -> None:
        if batch.count():  # every partition has to run, as each keeps its state
            index.try_refresh(root)

    writer = changes(spark, root, parts).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
