"""A tree of files as a data source: `spark.read.format("loom_tree").option("root", ...)`, a row for each file.

The planner lists folders from the root on until there are `folders` to share out; each partition lists its own ones, with
all below. Comparisons of `length`, `mtime` and `extension` with values are pushed to these listings, so what they
reject never becomes a row. Folders that are never wanted are not entered. No content is read.

As a stream, each micro-batch is the whole listing as it is then: its offset is the time at which it was asked for. A batch that is
run again lists again, so what follows has to compare with its own state (`streaming.changes`) and not to count rows.
"""

from __future__ import annotations

import operator
import os
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

from .stores import entered, store

#: path: relative to the root; at: the file's place in its store.
SCHEMA = "path string, extension string, mtime long, length long, at binary"
FOLDERS = 256
#: Partitions, at most.
TASKS = 4096
ROWS = 8192
_TESTS = {EqualTo: operator.eq, LessThan: operator.lt, LessThanOrEqual: operator.le, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, In: lambda x, values: x in values}


def extension(path: str) -> str:
    """What stands after the last point of the name, which may not start it, in lower case; else nothing."""
    before, _, after = path.rpartition("/")[2].rpartition(".")
    return after.lower() if before else ""


class Folders(InputPartition):
    """Folders, alone or with all that is below."""

    def __init__(self, folders: list[bytes], deep: bool):
        super().__init__(folders)
        self.deep = deep


def frontier(at, folders: int) -> tuple[list[bytes], list[bytes]]:
    """Folders that were listed, and those below them that are left."""
    listed, left = [], [at.base]
    while left and len(left) < folders:
        listed += left
        left = [path for f in left for path, is_folder, _, _ in at.entries(f) if is_folder and entered(path)]
    return listed, left


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.folders, self.tests = options["root"], int(options.get("folders", FOLDERS)), []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("length",), ("mtime",), ("extension",)):
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[Folders]:
        listed, left = frontier(store(self.root), self.folders)
        share = lambda x: [p for k in range(TASKS // 2) if (p := x[k :: TASKS // 2])]
        return [Folders(p, False) for p in share(listed)] + [Folders(p, True) for p in share(left)]

    def files(self, partition: Folders) -> Iterator[tuple]:
        at = store(self.root)
        left, cut = list(partition.value), len(at.base.rstrip(b"/")) + 1
        while left:
            folder = left.pop()
            try:
                for place, is_folder, mtime, length in at.entries(folder):
                    if not entered(place):
                        continue
                    if is_folder:
                        left += [place] * partition.deep
                        continue
                    path = os.fsdecode(place[cut:]).encode("utf-8", "replace").decode()
                    row = {"path": path, "extension": extension(path), "mtime": mtime, "length": length, "at": place}
                    if all(_TESTS[kind](row[column], value) for column, kind, value in self.tests):
                        yield tuple(row.values())
            except FileNotFoundError:  # gone meanwhile
                continue

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        names, types = zip(*((c.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in SCHEMA.split(", ")))
        batch = []
        for row in self.files(partition):
            batch.append(row)
            if len(batch) == ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*batch), types)], list(names))
                batch = []
        if batch:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*batch), types)], list(names))


class TreeStreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.now = TreeReader(options)

    def initialOffset(self) -> dict:
        return {"asked": 0}

    def latestOffset(self) -> dict:
        return {"asked": time.time_ns() // 1_000_000}

    def partitions(self, start: dict, end: dict) -> list[Folders]:
        return self.now.partitions()

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        return self.now.read(partition)


class Tree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "loom_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)

    def streamReader(self, schema) -> TreeStreamReader:
        return TreeStreamReader(self.options)
