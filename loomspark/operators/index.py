"""The index on disk: buckets of Parquet tables, a manifest of the current ones, refresh by difference, vectors, lock and dirty flag."""

from __future__ import annotations

import os
from copy import deepcopy
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..scratch import Scratch, small_batches
from ..sources import code, docs, scan, schemas
from . import buckets, connectors, hierarchy, names, search

_BUCKETED = {"files": (schemas.FILES, ("path",)), "chunks": (schemas.RAW, ("file", "seq")), "vectors": ("file string, seq int, embedding array<float>", ("file", "seq"))}
_WHOLE = {"summaries": schemas.SUMMARIES}

#: Chunks that are embedded before their vectors are saved, about.
EMBED_ROUND = 200_000


@dataclass
class Changes:
    added: int = 0
    updated: int = 0
    removed: int = 0
    pending: int = 0

    @property
    def any(self) -> bool:
        return bool(self.added or self.updated or self.removed)

    @property
    def total(self) -> int:
        return self.added + self.updated + self.removed


def compared(now: DataFrame, before: DataFrame) -> DataFrame:
    """path, status: added, removed, stale (another time, so another content may be) or same. One full join on the path."""
    j = now.select("path", F.col("mtime").alias("new")).join(before.select("path", F.col("mtime").alias("old")), "path", "full_outer")
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "stale").otherwise("same")
    return j.select("path", status.alias("status"))


def without(rows: DataFrame, paths: DataFrame, column: str = "file") -> DataFrame:
    """Rows of files that stay."""
    return rows.join(paths.select(F.col("path").alias(column)), column, "left_anti")


class Index:
    """`folder` holds the tables; its file system has to be the driver's for the pointer and the lock.

    `bucket_bytes`: contents of a bucket, about. What a refresh writes are the buckets that hold changed files.
    """

    def __init__(self, spark: SparkSession, folder: str, bucket_bytes: int = buckets.SIZE):
        self.spark, self.folder, self.bucket_bytes = spark, Path(folder), bucket_bytes
        self.folder.mkdir(parents=True, exist_ok=True)
        self.store = buckets.Store(spark, self.folder, _BUCKETED, schemas.VERSION, bucket_bytes)

    # --- tables ---

    def table(self, name: str) -> DataFrame:
        held = self.store.manifest()
        if name == "chunks":
            return self.store.numbered("chunks", held, "chunk_id")
        if name in _BUCKETED:
            return self.store.read(name, held, held.buckets).drop("at", "pos")
        parts = [str(self.folder / f"v={v}/{name}") for v in held.whole.get(name, [])]
        return self.spark.read.schema(_WHOLE[name]).parquet(*parts) if parts else self.spark.createDataFrame([], _WHOLE[name])

    @property
    def files(self) -> DataFrame:
        return self.table("files")

    @property
    def chunks(self) -> DataFrame:
        return self.table("chunks")

    @property
    def embeddings(self) -> DataFrame:
        """chunk_id, embedding."""
        return self.table("vectors").join(self.chunks.select("file", "seq", "chunk_id"), ["file", "seq"]).select("chunk_id", "embedding")

    def save(self, append: bool = False, **tables: DataFrame) -> None:
        """`tables` in place of what there is, or more rows of them; tables that are not given stay as they are."""
        now, v = self.store.manifest(), self.store.next_version()
        for name, rows in tables.items():
            if name in _BUCKETED:
                now.buckets = now.buckets or self._ranges(now, rows if name == "chunks" else None)
                self.store.write(name, rows, now, now.buckets, v, append)
            else:
                rows.write.parquet(str(self.folder / f"v={v}/{name}"))
                now.whole[name] = [*(now.whole.get(name, []) if append else []), v]
        self.store.commit(now)

    def _ranges(self, now: buckets.Manifest, chunks: DataFrame | None) -> list[buckets.Bucket]:
        """The first buckets of an index: ranges of paths by the contents of what is saved."""
        one = now.new("")
        if chunks is None:
            return [one]
        sizes = chunks.groupBy(F.col("file").alias("path")).agg(F.sum(F.octet_length("content")).alias("length")).withColumn("at", F.lit(one.id))
        return [one, *(now.new(c) for c in self.store.cuts(sizes, self.bucket_bytes))]

    # --- names ---

    def index_names(self) -> int:
        """Posting lists for the buckets that have none; how many there were. A refresh drops the lists of what it writes anew."""
        now, v = self.store.manifest(), self.store.next_version()
        lacking = [b for b in now.buckets if b.rows.get("chunks") and "lists" not in b.versions]
        if lacking:
            small_batches(self.spark)
            self.store.write_lists(names.lists(self.store.read("chunks", now, lacking)), lacking, v)
            self.store.commit(now)
        return len(lacking)

    def _having(self, scratch: Scratch, name: str, words: list[set[str]], starts) -> DataFrame:
        """Chunks that may have all tokens of a word or one of the starts: by their lists, and all of buckets without. Buckets without candidates are not read."""
        held = self.store.manifest()
        listed = [b for b in held.buckets if "lists" in b.versions]
        found = scratch.cut(names.candidates(self.store.lists(listed), words, starts), name)
        hit = {r["at"] for r in found.select("at").distinct().collect()}  # at most as many as the manifest has
        some = self.store.numbered("chunks", held, "chunk_id", [b for b in listed if b.id in hit]).join(found, ["at", "pos"], "left_semi")
        rest = self.store.numbered("chunks", held, "chunk_id", [b for b in held.buckets if "lists" not in b.versions])
        return some.unionByName(rest).drop("at", "pos")

    def named(self, query: str) -> DataFrame:
        """The chunks that a search by name has to score: all, if lists can't tell."""
        tokens = names.asked(query)
        return self.chunks if tokens is None else self._having(Scratch(self.spark, "names"), "named", *tokens)

    def search_by_name(self, query: str, top: int = 5, kind: str | None = None) -> DataFrame:
        """What `search.search_by_name` finds in all chunks, from candidates; names are counted among those that begin like the found ones."""
        scratch = Scratch(self.spark, "names")
        best = scratch.cut(search.ranked_by_name(self.named(query), query, top, kind), "best")
        starts = [r[0] for r in best.where("name IS NOT NULL").select(names.start(F.col("name"))).distinct().collect()]  # `top` at most
        return search.shown_by_name(best, self._having(scratch, "same", [], starts))

    # --- refresh ---

    def _parsed(self, found: DataFrame) -> DataFrame:
        code_files, doc_files = found.where("chunk_type = 'code'"), found.where("chunk_type = 'doc'")
        return code.definitions(code_files).unionByName(docs.sections(doc_files))

    def refresh(self, root: str) -> Changes:
        """Brings the index to the state of a tree. Contents are read, once, of new files and of those with another time only; buckets without such files stay."""
        scratch, before = Scratch(self.spark, "refresh"), self.files
        found = scratch.cut(scan.listing(self.spark, root), "listing")
        kinds = {kind: F.count_if(F.col("status") == kind) for kind in ("added", "removed", "stale")}
        status, counts = scratch.observed(compared(found, before), "status", **kinds)
        if not any(counts.values()):
            scratch.drop("listing", "status")
            return Changes(pending=self.pending())
        fresh = scan.texts(scan.read(found.join(status.where(F.col("status").isin("added", "stale")), "path"), root)).drop("content")
        fresh = fresh.join(before.select("path", F.col("hash").alias("old_hash")), "path", "left")
        fresh = fresh.withColumn("same", F.col("hash").eqNullSafe(F.col("old_hash")))
        fresh, seen = scratch.observed(fresh, "fresh", updated=F.count_if(F.expr("status = 'stale' AND NOT same")))
        removed = status.where("status = 'removed'").select("path", F.lit(False).alias("same"))
        self._write(scratch, fresh, fresh.select("path", "same").unionByName(removed))
        scratch.drop("listing", "status", "fresh", "touched")
        return Changes(counts["added"], seen["updated"], counts["removed"], self.pending())

    def _write(self, scratch: Scratch, fresh: DataFrame, paths: DataFrame) -> None:
        """Writes the buckets of `paths` anew: of those with another content all tables, of the others their files' times."""
        now, v = self.store.manifest(), self.store.next_version()
        now.buckets = now.buckets or [now.new("")]
        before = deepcopy(now)
        old, old_ids = before.buckets, {b.id for b in before.buckets}
        paths = scratch.cut(paths.withColumn("at", buckets.bucket_of(old, F.col("path"))), "touched")
        same = {r["at"]: r["same"] for r in paths.groupBy("at").agg(F.min("same").alias("same")).collect()}
        touched, changed = [b for b in old if b.id in same], [b for b in old if b.id in same and not same[b.id]]
        changed += before.sparse(("chunks", "vectors"), changed)
        touched += [b for b in changed if b.id not in same]
        touched += before.sparse(("files",), touched)
        gone = paths.where(~F.col("same"))
        rows = fresh.select("path", "mtime", "hash", "chunk_type", "error", "length", "same")
        times = rows.where("same").select("path", F.col("mtime").alias("new"))
        files = without(self.store.read("files", before, touched).drop("at", "pos"), gone, "path").join(times, "path", "left")
        files = files.withColumn("mtime", F.coalesce("new", "mtime")).drop("new").unionByName(rows.where(~F.col("same")).drop("same"))
        cuts = self.store.cuts(files.select(buckets.bucket_of(old, F.col("path")).alias("at"), "path", "length"), self.bucket_bytes)
        if cuts:  # a bucket that is cut is written under new ids
            split, held = {b.id: b for b in (buckets.holder(old, c) for c in cuts)}, {b.id for b in changed}
            changed += [b for b in touched if b.id in split and b.id not in held]
            firsts = {b.first for b in split.values()} | set(cuts)
            now.buckets = sorted([b for b in now.buckets if b.id not in split] + [now.new(f) for f in sorted(firsts)], key=lambda b: b.first)

        def into(some: list[buckets.Bucket]) -> list[buckets.Bucket]:
            ids = {b.id for b in some}
            return [b for b in now.buckets if b.id in ids or b.id not in old_ids]

        self.store.write("files", files, now, into(touched), v)
        if changed:
            kept = lambda name: without(self.store.read(name, before, changed).drop("at", "pos"), gone)
            self.store.write("chunks", kept("chunks").unionByName(self._parsed(fresh.where(~F.col("same")))), now, into(changed), v)
            if any(b.versions.get("vectors") for b in changed):
                self.store.write("vectors", kept("vectors"), now, into(changed), v)
        self.store.commit(now)

    def reindex(self, root: str) -> Changes:
        self.store.commit(buckets.Manifest(next_id=self.store.manifest().next_id, per=self.store.per))
        return self.refresh(root)

    # --- vectors ---

    def pending(self) -> int:
        """Chunks without vectors, by the manifest's counts: no table is read."""
        held = self.store.manifest()
        return held.total("chunks") - held.total("vectors")

    def embed(self, embedder, batch_size: int = 500, round_size: int | None = None) -> int:
        """Vectors for the chunks that have none; how many there were.

        They are made and saved in rounds of about `round_size` (EMBED_ROUND) chunks: after a failure, the next call goes on with the rest.
        Only buckets that lack vectors are read.
        """
        if batch_size <= 0:
            raise ValueError("batch_size has to be positive")
        text = S.embedding_text(F.col("chunk_type"), F.col("kind"), F.col("name"), F.col("content"))

        def run(frames, client):
            for pdf in frames:
                out = []
                for i in range(0, len(pdf), batch_size):
                    out += client(list(pdf["text"].iloc[i : i + batch_size]))
                yield pdf[["file", "seq"]].assign(embedding=out)

        n = self.pending()
        rounds = -(-n // (round_size or EMBED_ROUND))
        for r in range(rounds):
            now, v = self.store.manifest(), self.store.next_version()
            lacking = [b for b in now.buckets if b.rows.get("chunks", 0) > b.rows.get("vectors", 0)]
            todo = self.store.read("chunks", now, lacking).join(self.store.read("vectors", now, lacking).select("file", "seq"), ["file", "seq"], "left_anti")
            todo = todo.where(F.pmod(F.xxhash64("file", "seq"), F.lit(rounds)) == r)
            todo, client = connectors.dealt(todo.select("file", "seq", text.alias("text")), embedder)
            made = todo.mapInPandas(lambda frames, client=client: run(frames, client), _BUCKETED["vectors"][0])
            self.store.write("vectors", made, now, lacking, v, append=True)
            now.model = getattr(embedder, "name", type(embedder).__name__)
            self.store.commit(now)
        return n

    def status(self) -> dict:
        row = hierarchy.status(self.chunks, self.embeddings).first().asDict()
        files = self.files.agg(F.count("*").alias("n_indexed_files"), F.count("error").alias("n_errors")).first().asDict()
        return row | files | {"version": schemas.VERSION, "locked": self.holder() is not None}

    def report(self, root: str = "", embed=None) -> DataFrame:
        """One row of all that is known of the index: `embed` is the embedder of queries, if there is one."""
        held, chunks = self.store.manifest(), self.chunks
        files = self.files.agg(F.count("*").alias("file_count"), *[F.count(F.when(F.col("chunk_type") == kind, 1)).alias(f"{kind}_files") for kind in ("code", "doc")])
        twice = chunks.groupBy("name").agg(F.count("*").alias("n")).agg(F.count(F.when(F.col("n") > 1, 1)).alias("duplicate_names"))
        said = chunks.select(F.explode(F.array("name", "content", "context", "signature", "doc_summary")).alias("s")).unionByName(self.files.select(F.explode(F.array("path", "hash")).alias("s")))
        said = said.unionByName(self.spark.createDataFrame([(root,), (held.model,)], "s string")).agg(F.count_distinct("s").alias("string_table_size"))
        n, vectors = held.total("chunks"), held.total("vectors")
        out = files.join(F.broadcast(twice), F.lit(True)).join(F.broadcast(said), F.lit(True)).withColumns({
            "version": F.lit(schemas.VERSION), "root": F.lit(root), "last_indexed": F.lit(held.last_indexed), "chunk_count": F.lit(n).cast("long"), "embedding_count": F.lit(vectors).cast("long"),
            "embedding_model": F.lit(held.model), "has_embeddings": F.lit(0 < vectors == n), "pending_embeddings": F.lit(n - vectors).cast("long"), "embed_recommendation": S.recommendation(F.lit(n - vectors)),
            "embedder_available": F.lit(embed is not None), "query_cache_size": F.lit(search.cache_size(embed)),
        })
        order = "version root last_indexed file_count code_files doc_files chunk_count embedding_count embedding_model has_embeddings pending_embeddings embed_recommendation duplicate_names embedder_available query_cache_size string_table_size"
        return out.select(*order.split())

    # --- lock and dirty flag ---

    def holder(self) -> int | None:
        """The process that holds the lock; a lock of a process that is gone is removed."""
        lock = self.folder / "lock"
        try:
            pid = int(lock.read_text())
        except (FileNotFoundError, ValueError):
            return None
        try:
            os.kill(pid, 0)
        except ProcessLookupError:
            lock.unlink(missing_ok=True)
            return None
        except PermissionError:
            pass
        return pid

    def acquire(self) -> bool:
        if self.holder() is not None:
            return False
        try:
            fd = os.open(self.folder / "lock", os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError:
            return False
        with os.fdopen(fd, "w") as f:
            f.write(str(os.getpid()))
        return True

    def release(self) -> None:
        (self.folder / "lock").unlink(missing_ok=True)

    def mark_dirty(self) -> None:
        (self.folder / "dirty").touch()

    def clear_dirty(self) -> bool:
        try:
            (self.folder / "dirty").unlink()
        except FileNotFoundError:
            return False
        return True

    def ensure_fresh(self, root: str) -> Changes:
        """Refreshes under the lock, again while others ask for it meanwhile."""
        if not self.acquire():
            raise BlockingIOError("the index is locked")
        try:
            total = Changes()
            while True:
                self.clear_dirty()
                one = self.refresh(root)
                total = Changes(total.added + one.added, total.updated + one.updated, total.removed + one.removed, one.pending)
                if not (self.folder / "dirty").exists():
                    return total
        finally:
            self.release()

    def try_refresh(self, root: str) -> Changes | None:
        """Refreshes, or leaves word for the one who holds the lock; readers go on with the current version."""
        if self.holder() is not None:
            self.mark_dirty()
            return None
        return self.ensure_fresh(root)
