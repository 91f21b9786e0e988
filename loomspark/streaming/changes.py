"""What changes in a tree, as a stream: files that come, go, or have another time or length.

Each micro-batch of the tree's source is its whole listing. Paths are dealt by hash to `parts` keys, whose state is the listing
before; a key compares both. A key that has no file any more gets no rows, so it is called by its timeout, which
is due with the next batch: then all that it held is gone. Parts are even whatever folders hold; state and
work of a batch grow with the tree, what comes out with the change.

Defined results
---------------
- the first batch: all files are added; a file whose time and length are the same is no change, whatever its content;
- a batch that runs again after a failure compares with the state before it: nothing is lost, as the listing is taken anew;
- a folder that cannot be listed fails the batch, so its files are not taken for removed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import scan
from ..sources.tree import FOLDERS, Tree

#: Keys over which paths are dealt; a tree of n files has n / PARTS in one.
PARTS = 1024
SCHEMA = "path string, status string, mtime long, length long"


def compare(before: dict[str, list[int]], now: dict[str, list[int]]) -> list[tuple]:
    """(path, status, mtime, length): of what is gone, as it was."""
    out = [(p, "removed", *x) for p, x in before.items() if p not in now]
    return out + [(p, "updated" if p in before else "added", *x) for p, x in now.items() if before.get(p) != x]


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    before = json.loads(state.get[0]) if state.exists else {}
    now: dict[str, list[int]] = {}
    if not state.hasTimedOut:
        for pdf in frames:
            now |= {p: [int(m), int(n)] for p, m, n in zip(pdf["path"], pdf["mtime"], pdf["length"])}
    if now:
        state.update((json.dumps(now),))
        state.setTimeoutDuration(1)
    elif state.exists:
        state.remove()
    yield pd.DataFrame(compare(before, now), columns=[c.split()[0] for c in SCHEMA.split(", ")])


def changes(spark: SparkSession, root: str, parts: int = PARTS) -> DataFrame:
    """A streaming frame of path, status (added, updated, removed), mtime and length."""
    spark.dataSource.register(Tree)
    files = spark.readStream.format(Tree.name()).option("root", root).option("folders", FOLDERS).load().where(scan.wanted())
    keyed = files.select("path", "mtime", "length", F.pmod(F.xxhash64("path"), F.lit(parts)).alias("part"))
    return keyed.groupBy("part").applyInPandasWithState(_step, SCHEMA, "listing string", "append", GroupStateTimeout.ProcessingTimeTimeout)
