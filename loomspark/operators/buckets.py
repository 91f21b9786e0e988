"""Tables of an index in buckets of paths, copy on write.

A bucket is a range of paths. A manifest names the versions that make up each bucket of each table; a change writes the buckets
that it touches under a new version, and one rename makes the next manifest current. Files of a path are never split over
buckets; a bucket that has grown beyond twice `size` bytes of contents is cut into ranges when it is next written.

Small buckets share files: those whose ids are in one stretch of `per` ids, about 32 MiB of contents, have one folder in each version.
A row says its bucket and version, and counts if the manifest has both; so the number of files and of folders that a read names goes with
the contents and not with the buckets. A folder of which less than half of the buckets are current is written anew with the next change to it.

Rows of a bucket are in the order of their keys, and the manifest counts them. So an id that is dense in the order of
all rows is the number of rows in the buckets before plus the place in the bucket, and no row changes when another bucket does.
"""

from __future__ import annotations

import bisect
import json
import os
import shutil
import time
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import names

#: Bytes of contents in a bucket, about; smaller buckets share a folder of so many.
SIZE = 32 << 20
#: Of the folders and the manifest; an index in another layout is recreated.
LAYOUT = 2


@dataclass
class Bucket:
    id: int
    first: str  # the smallest path that belongs to it
    versions: dict[str, list[int]] = field(default_factory=dict)
    rows: dict[str, int] = field(default_factory=dict)


@dataclass
class Manifest:
    buckets: list[Bucket] = field(default_factory=list)
    whole: dict[str, list[int]] = field(default_factory=dict)  # tables without buckets
    next_id: int = 0
    model: str = ""  # of the vectors
    last_indexed: str = ""
    per: int = 1  # ids that share a folder
    wrote: dict[str, int] = field(default_factory=dict)  # buckets that a folder was written with

    def place(self, name: str, v: int, b: Bucket) -> str:
        """The folder of a bucket's rows of one version."""
        return f"v={v}/{name}/bucket={b.id if name == 'lists' else b.id // self.per * self.per}"

    def places(self) -> set[str]:
        """The folders that hold what is current."""
        return {self.place(name, v, b) for b in self.buckets for name, held in b.versions.items() for v in held} | {f"v={v}/{name}" for name, held in self.whole.items() for v in held}

    def parts(self) -> set[str]:
        """The parts of tables that are current, one for each bucket, table and version."""
        return {f"v={v}/{name}/bucket={b.id}" for b in self.buckets for name, held in b.versions.items() for v in held} | {f"v={v}/{name}" for name, held in self.whole.items() for v in held}

    def total(self, name: str) -> int:
        return sum(b.rows.get(name, 0) for b in self.buckets)

    def sparse(self, names: Iterable[str], some: list[Bucket]) -> list[Bucket]:
        """The other buckets of folders that would be less than half current when `some` are written anew."""
        ids, folders = {b.id for b in some}, {self.place(name, v, b) for b in some for name in names for v in b.versions.get(name, [])}
        rest: dict[str, list[Bucket]] = {f: [] for f in folders}
        for b in self.buckets:
            if b.id not in ids:
                for f in {self.place(name, v, b) for name in names for v in b.versions.get(name, [])} & folders:
                    rest[f].append(b)
        return list({b.id: b for f, held in rest.items() if 2 * len(held) < self.wrote.get(f, 0) for b in held}.values())

    def new(self, first: str) -> Bucket:
        self.next_id += 1
        return Bucket(self.next_id - 1, first)


def holder(buckets: list[Bucket], path: str) -> Bucket:
    """The bucket whose range a path is in; the first one has the empty path for its first."""
    return buckets[bisect.bisect_right(buckets, path, key=lambda b: b.first) - 1]


def bucket_of(buckets: list[Bucket], path: Column) -> Column:
    """The id of the bucket whose range a path is in."""
    firsts, ids = [b.first for b in buckets], [b.id for b in buckets]

    @F.pandas_udf("int")
    def run(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: ids[bisect.bisect_right(firsts, p) - 1]).astype("int32")

    return run(path)


class Store:
    """`tables`: (schema, columns of the key) of each table with buckets; the first column of a key is a path."""

    def __init__(self, spark: SparkSession, folder: Path, tables: dict[str, tuple[str, tuple[str, ...]]], version: int, size: int = SIZE):
        self.spark, self.folder, self.tables, self.version, self.per = spark, folder, tables, version, max(1, SIZE // size)

    def manifest(self) -> Manifest:
        try:
            held = json.loads((self.folder / "_CURRENT").read_text())
            if (held.pop("version", None), held.pop("layout", None)) != (self.version, LAYOUT):  # another format is recreated
                return Manifest(per=self.per)
            return Manifest(**held | {"buckets": [Bucket(**b) for b in held["buckets"]]})
        except (FileNotFoundError, ValueError):
            return Manifest(per=self.per)

    def next_version(self) -> int:
        return max([int(p.name[2:]) for p in self.folder.glob("v=*")], default=0) + 1

    def commit(self, now: Manifest) -> None:
        """Makes a manifest current. Readers keep what they have: what neither it nor the one before it needs is removed."""
        before, now.last_indexed = self.manifest(), time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
        staged = self.folder / f"_CURRENT.{os.getpid()}"
        needed = before.places() | (current := now.places())
        now.wrote = {f: n for f, n in now.wrote.items() if f in current}
        staged.write_text(json.dumps({"version": self.version, "layout": LAYOUT, **asdict(now)}))
        os.replace(staged, self.folder / "_CURRENT")
        kept = {str(Path(p).parent) for p in needed} | needed
        for p in [*self.folder.glob("v=*/*/bucket=*"), *self.folder.glob("v=*/*")]:
            if str(p.relative_to(self.folder)) not in kept:
                shutil.rmtree(p, ignore_errors=True)

    # --- rows ---

    def read(self, name: str, manifest: Manifest, buckets: Iterable[Bucket]) -> DataFrame:
        """The rows of some buckets, with the bucket as `at` and the place in it as `pos`."""
        schema = self.tables[name][0] + ", at int, pos long"
        held = [(b, v) for b in buckets for v in b.versions.get(name, [])]
        if not held:
            return self.spark.createDataFrame([], schema)
        folders, ids = sorted({manifest.place(name, v, b) for b, v in held}), [b.id for b, _ in held]
        rows = self.spark.read.schema(schema + ", v int").option("recursiveFileLookup", True).parquet(*[str(self.folder / f) for f in folders])
        if manifest.per > 1:  # else a folder is one bucket's
            current = self.spark.createDataFrame(pa.table({"at": pa.array(ids, pa.int32()), "v": pa.array([v for _, v in held], pa.int32())}))
            rows = rows.where(F.col("at").between(min(ids), max(ids))).join(F.broadcast(current), ["at", "v"], "left_semi")
        return rows.select(*[c.split()[0] for c in schema.split(", ")])

    def write(self, name: str, rows: DataFrame, now: Manifest, into: list[Bucket], v: int, append: bool = False) -> None:
        """Rows as the table's content of the buckets `into`, or more of it; notes the version and counts there."""
        schema, key = self.tables[name]
        columns = [c.split()[0] for c in schema.split(", ")]
        order = Window.partitionBy("at").orderBy(*key)  # a bucket is bounded: no file is over the scan's limit, and what is too large is cut
        rows = rows.select(*columns, bucket_of(now.buckets, F.col(key[0])).alias("at")).withColumn("pos", (F.row_number().over(order) - 1).cast("long"))
        path = str(self.folder / f"v={v}/{name}")
        rows.withColumns({"v": F.lit(v), "bucket": F.col("at") - F.col("at") % now.per}).write.partitionBy("bucket").parquet(path)
        counts = dict(self.spark.read.schema("at int").option("recursiveFileLookup", True).parquet(path).groupBy("at").count().collect())
        for b in into:
            n = counts.get(b.id, 0)
            b.versions[name] = [*(b.versions.get(name, []) if append else []), *([v] if n else [])]
            b.rows[name] = n + (b.rows.get(name, 0) if append else 0)
            if n:
                now.wrote[now.place(name, v, b)] = now.wrote.get(now.place(name, v, b), 0) + 1
            if name == "chunks":  # its lists are of other rows
                b.versions.pop("lists", None)

    def write_lists(self, rows: DataFrame, into: list[Bucket], v: int) -> None:
        """Posting lists of whole buckets, a file each, in the order of tokens."""
        rows.withColumn("bucket", F.col("at")).write.partitionBy("bucket").parquet(str(self.folder / f"v={v}/lists"))
        for b in into:
            b.versions["lists"] = [v]

    def lists(self, held: list[Bucket]) -> DataFrame:
        parts = [p for p in (self.folder / f"v={v}/lists/bucket={b.id}" for b in held for v in b.versions.get("lists", [])) if p.exists()]
        return self.spark.read.schema(names.LISTS).option("recursiveFileLookup", True).parquet(*map(str, parts)) if parts else self.spark.createDataFrame([], names.LISTS)

    def numbered(self, name: str, manifest: Manifest, number: str, only: Iterable[Bucket] | None = None) -> DataFrame:
        """All rows (of the buckets `only`) with their dense number in the order of keys."""
        base, total = [], 0
        for b in manifest.buckets:
            base.append((b.id, total))
            total += b.rows.get(name, 0)
        bases = self.spark.createDataFrame(pa.table(dict(zip(("at", "base"), map(pa.array, zip(*base), (pa.int32(), pa.int64())))))) if base else self.spark.createDataFrame([], "at int, base long")
        rows = self.read(name, manifest, manifest.buckets if only is None else only).join(F.broadcast(bases), "at")
        return rows.select((F.col("base") + F.col("pos")).alias(number), *[c.split()[0] for c in self.tables[name][0].split(", ")], *(["at", "pos"] if only is not None else []))

    def cuts(self, files: DataFrame, size: int) -> list[str]:
        """Paths at which buckets begin that are not to hold more than twice `size` bytes; `files` has at, path, length."""
        large = {r["at"]: r["n"] for r in files.groupBy("at").agg(F.sum("length").alias("n")).where(F.col("n") > 2 * size).collect()}
        if not large:
            return []
        # files are dealt by ranges of paths, not more than there are tasks at a time, and each range is cut by the sum of what comes before
        ranges = min(sum(-(-n // size) for n in large.values()), max(self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        rows = files.where(F.col("at").isin(*large)).select("at", "path", "length").repartitionByRange(ranges, "path").withColumn("p", F.spark_partition_id())
        of = Window.partitionBy("p", "at")
        total, before = F.sum("length").over(of), F.sum("length").over(of.orderBy("path").rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("slot", F.floor(F.coalesce(before, F.lit(0)) * F.ceil(total / size) / F.greatest(total, F.lit(1))))
        rows = rows.withColumn("last", F.lag("slot").over(of.orderBy("path"))).where("last IS NULL OR last <> slot")
        found = rows.select("at", "path").collect()  # a row for each bucket
        first: dict[int, str] = {}  # the first range of a bucket begins where the bucket does
        for r in found:
            first[r["at"]] = min(first.get(r["at"], r["path"]), r["path"])
        return sorted({r["path"] for r in found} - set(first.values()))
