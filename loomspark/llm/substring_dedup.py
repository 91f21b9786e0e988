"""Substring dedup by seed and extend.

Seeds are winnowed anchors: each window of `length` words picks the five-word run of the
smallest hash in it, so equal windows pick equal anchors. Documents are joined on anchors
that more than one of them has. Around a shared anchor, the match is extended both ways:
all windows that picked it form a stretch, equal stretches are folded into classes by a
pre-aggregation, and only the windows of the classes' representatives are compared one by
one. Overlapping matched windows make up a maximal repeat.

Defined results
---------------
- null or blank text: no words, nothing removed, the hash of the empty string;
- texts shorter than `length` words: nothing removed;
- null doc_id: neither a source nor a target, its text stays whole;
- rows with the same doc_id are one document in the comparison, each row keeps its own result;
- other columns of the input, of whatever name, are carried by `dedup_text` and ignored by `repeats`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .textkernel import Words, mix, slices

ANCHOR = 5


class Windows:
    """The windows of a column of texts: word index `at`, `hash`, `row`, the `anchor` that each picked, and its stretch."""

    def __init__(self, column: pa.Array, length: int):
        self.words = words = Words(column)
        k = min(ANCHOR, length)
        self.at, self.hash = words.runs(length)
        at5, h5 = words.runs(k)
        runs = np.zeros(len(words.hash), np.uint64)
        runs[at5] = h5
        best, place = runs[self.at].copy(), self.at.copy()
        for j in range(1, length - k + 1):
            other = runs[self.at + j]
            less = other < best
            best[less] = other[less]
            place[less] = self.at[less] + j
        self.anchor = best
        self.row = words.row_of()[self.at]
        if len(self.at):
            # equal places are never in two rows
            head = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            self.head, size = head, np.diff(np.concatenate([head, [len(place)]]))
            self.stretch = np.repeat(np.arange(len(head)), size)
            nth = np.arange(len(place)) - head[self.stretch]
            total = np.add.reduceat(mix(self.hash + nth.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), head)
            self.size = size
            self.content = mix(total + size.astype(np.uint64))
        else:
            self.head = self.size = self.stretch = np.zeros(0, np.int64)
            self.content = np.zeros(0, np.uint64)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.uint64).view(np.int64)


def _anchors(length: int):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for i, j in slices(batch.column("text")):
                w = Windows(batch.column("text").slice(i, j - i), length)
                pair = np.empty(len(w.head), dtype=[("doc", np.int64), ("anchor", np.int64)])
                pair["doc"], pair["anchor"] = ids[i:j][w.row[w.head]], _signed(w.anchor[w.head])
                pair = np.unique(pair)
                yield pa.RecordBatch.from_arrays([pa.array(pair["anchor"]), pa.array(pair["doc"])], ["anchor", "doc_id"])

    return run


def _stretches(length: int):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            shared = batch.column("shared")
            for i, j in slices(batch.column("text")):
                w = Windows(batch.column("text").slice(i, j - i), length)
                flat, bounds = _lists(shared.slice(i, j - i))
                anchor = _signed(w.anchor[w.head])
                take = _member(w.row[w.head], anchor, flat, bounds)
                n = np.flatnonzero(take)
                ends = np.concatenate([w.head, [len(w.hash)]])
                hashes = _signed(w.hash)
                inside = np.repeat(take, w.size)
                offsets = np.concatenate([[0], np.cumsum(w.size[n])]).astype(np.int32)
                windows = pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes[inside] if len(ends) else hashes))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[n]), pa.array(_signed(w.content)[n]), pa.array(ids[i:j][w.row[w.head[n]]]), windows],
                    ["anchor", "content", "doc_id", "windows"],
                )

    return run


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and bounds of a column of lists of longs; null counts as empty."""
    sizes = np.array([0 if x is None else x for x in pa.compute.list_value_length(column).to_pylist()], dtype=np.int64)
    flat = pa.compute.list_flatten(column).to_numpy(zero_copy_only=False)
    return flat, np.concatenate([[0], np.cumsum(sizes)])


def _member(row: np.ndarray, value: np.ndarray, flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether value[i] is in list number row[i]."""
    out = np.zeros(len(row), dtype=bool)
    for r in np.flatnonzero(np.diff(bounds)):
        a, b = np.searchsorted(row, [r, r + 1])
        if a < b:
            out[a:b] = np.isin(value[a:b], flat[bounds[r] : bounds[r + 1]])
    return out


def _matched(w: Windows, batch, i: int, j: int) -> np.ndarray:
    """Which words of the rows i to j of a batch are covered by a matched window."""
    n = len(w.words.hash)
    hit = np.zeros(len(w.at), dtype=bool)
    if len(w.at):
        flat, bounds = _lists(batch.column("whole").slice(i, j - i))
        hit |= _member(w.row[w.head], _signed(w.content), flat, bounds)[w.stretch]
        flat, bounds = _lists(batch.column("single").slice(i, j - i))
        hit |= _member(w.row, _signed(w.hash), flat, bounds)
    return hit, n


def _cover(w: Windows, hit: np.ndarray, n: int, length: int) -> np.ndarray:
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, w.at[hit], 1)
    np.add.at(edge, w.at[hit] + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _digest(length: int):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for i, j in slices(batch.column("text")):
                w = Windows(batch.column("text").slice(i, j - i), length)
                gone = _cover(w, *_matched(w, batch, i, j), length)
                data, first, rows = w.words.data.tobytes(), w.words.first, []
                for r in range(j - i):
                    a, b = first[r], first[r + 1]
                    g = gone[a:b]
                    if b > a:
                        s, e = w.words.start[a:b], w.words.end[a:b]
                        words = data[s[0] : e[-1]].split()
                        if g.any():
                            words = [x for x, y in zip(words, g.tolist()) if not y]
                    else:
                        words = []
                    rows.append((int(b - a), int(g.sum()), hashlib.sha256(b" ".join(words)).hexdigest()))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_sha256"],
                )

    return run


def _spans(w: Windows, gone: np.ndarray, r: int) -> list[tuple[int, int]]:
    a, b = w.words.first[r], w.words.first[r + 1]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone[a:b], [False]]).astype(np.int8)))
    return list(zip((edge[0::2]).tolist(), (edge[1::2]).tolist()))


def _cut_text(length: int, at: int, kept_only: bool):
    """Texts without their repeats: a cut takes the bytes from its first word to the word after its last."""

    def run(batches):
        for batch in batches:
            for i, j in slices(batch.column("text")):
                w = Windows(batch.column("text").slice(i, j - i), length)
                gone = _cover(w, *_matched(w, batch, i, j), length)
                data, texts, keep = w.words.data.tobytes(), [], []
                column = batch.column("text").slice(i, j - i)
                for r in range(j - i):
                    a, b = w.words.first[r], w.words.first[r + 1]
                    spans = _spans(w, gone, r)
                    keep.append(not (spans and gone[a:b].all()))
                    if not spans:
                        texts.append(column[r].as_py())
                        continue
                    s, e = w.words.start[a:b], w.words.end[a:b]
                    raw = column[r].as_py().encode()
                    zero, out, since = s[0] - (len(raw) - len(raw.lstrip(b" \t\n\x0b\x0c\r"))), [], 0
                    for x, y in spans:
                        out.append(raw[since : s[x] - zero])
                        since = (s[y] - zero) if y < b - a else int(e[y - 1] - zero)
                    out.append(raw[since:])
                    texts.append(b"".join(out).decode())
                cut = pa.RecordBatch.from_arrays(
                    [pa.array(texts, pa.string()) if k == at else batch.column(k).slice(i, j - i) for k in range(batch.num_columns - 2)],
                    batch.schema.names[:-2],
                )
                yield cut.filter(pa.array(keep)) if kept_only else cut

    return run


def matches(docs: DataFrame, scratch: Scratch, length: int = 13) -> DataFrame:
    """Per doc_id what is to go: `whole` stretches and `single` windows, as hashes. Only documents with a match."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    anchors = scratch.cut(texts.mapInArrow(_anchors(length), "anchor long, doc_id long"), "anchors")
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor")
    shared = scratch.cut(shared, "shared")
    seeds = scratch.cut(anchors.join(shared, "anchor").groupBy("doc_id").agg(F.collect_list("anchor").alias("shared")), "seeds")
    scratch.drop("anchors", "shared")
    stretches = texts.join(seeds, "doc_id").select("doc_id", "text", "shared").mapInArrow(
        _stretches(length), "anchor long, content long, doc_id long, windows array<long>"
    )
    stretches = scratch.cut(stretches, "stretches")
    scratch.drop("seeds")
    classes = scratch.cut(
        stretches.groupBy("anchor", "content").agg(F.min("doc_id").alias("least"), F.first("windows").alias("windows")), "classes"
    )
    each = classes.select("anchor", "content", "least", F.explode("windows").alias("window"))
    first = each.groupBy("anchor", "window").agg(F.min("least").alias("source"))
    single = each.join(first, ["anchor", "window"]).where("source < least").select(F.col("least").alias("doc_id"), "window")
    whole = (
        stretches.select("anchor", "content", "doc_id")
        .join(classes.select("anchor", "content", "least"), ["anchor", "content"])
        .where("doc_id > least")
        .select("doc_id", "content")
    )
    # the tags meet by document only, and a document has no more of them than words
    tags = whole.select("doc_id", F.col("content").alias("w"), F.lit(None).cast("long").alias("s")).unionByName(
        single.select("doc_id", F.lit(None).cast("long").alias("w"), F.col("window").alias("s"))
    )
    found = scratch.cut(tags.groupBy("doc_id").agg(F.collect_set("w").alias("whole"), F.collect_set("s").alias("single")), "found")
    scratch.drop("stretches", "classes")
    return found


def repeats(docs: DataFrame, length: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of `docs` (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "substring")
    found = matches(docs, scratch, length)
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(found, "doc_id", "left")
    return joined.mapInArrow(_digest(length), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup_text(docs: DataFrame, length: int = 13, drop_empty: bool = True) -> DataFrame:
    """`docs` with the repeats cut out of `text`; texts without a repeat stay as they are.

    A document of which no word is left is a copy: it goes, unless `drop_empty` is false.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    found = matches(docs, scratch, length).withColumnsRenamed({"doc_id": "__id", "whole": "whole", "single": "single"})
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    at = docs.columns.index("text")
    joined = plain.join(found, plain[f"c{docs.columns.index('doc_id')}"] == F.col("__id"), "left").drop("__id")
    joined = joined.withColumnRenamed(f"c{at}", "text")
    schema = joined.select(*joined.columns[:-2]).schema
    return joined.mapInArrow(_cut_text(length, at, drop_empty), schema).toDF(*docs.columns)


def with_lengths(docs: DataFrame) -> DataFrame:
    """`docs` with `n_chars`, if it has that column, as the length of `text`."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
