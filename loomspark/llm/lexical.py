"""Ranked lexical search over tiers of postings, highest impacts first.

A document's postings (term, impact) are one row, so that any task can score it by itself. The postings of a term are dealt to
tiers by impact: the first tier takes its highest ones, about `TIERS[0]` of them, the next about `TIERS[1]`, the last all.
For each term and tier, the residual is the largest impact that the tier lacks.

Items are scored on the first tier. What a document has there is a lower bound of its score; with the residuals of
the item's other terms it is an upper bound. An item is settled if no document that the tier lacks can reach
the lower bound of the TOP-th best, and if few documents can by their upper bounds: these are scored exactly from all their
postings. Items without that proof fall through to the next tier, and at last to all postings, where only documents that
reach the lower bound found before go on. So a tier decides what is read, not what is found.

Items are taken in blocks of `ITEM_BLOCK`; weights, residuals and candidates of a block are broadcast, of which there are
as many as its items have terms, and CANDIDATES an item at most. Hot terms need no care: nothing is grouped by term but counts.

Defined results
---------------
- null, empty or termless texts: not counted, not found; an item without terms, or none of whose terms weighs anything, finds nothing;
- equal scores: the smaller doc_id, null last, then any order of equal rows;
- rows with one doc_id are different documents, rows with one item_id different items; null ids are kept;
- very long texts are read whole; empty tables give no rows; other columns are ignored;
- terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .terms import Terms
from .textkernel import slices

TOP = 50
#: Postings of a term in the tiers above the last, about.
TIERS = (1024, 16_384)
#: Documents of an item that are scored by all their postings before the item is settled; with more it falls through.
CANDIDATES = 512
ITEM_BLOCK = 1024
#: Terms of items whose hashes are broadcast; more are joined.
VOCABULARY = 4_000_000
#: Impacts are below a million; a level of the histogram is so many of them.
LEVEL = 4096
#: Scores, or products of a posting's impact with weights, that a task holds at once.
CELLS = 1 << 21


# --- the index ---


def _postings(wanted=None):
    """Rows of (row, doc_id, text) with their number of terms and their (wanted) distinct terms with counts."""

    def run(batches):
        for batch in batches:
            for i, j in slices(batch.column("text")):
                terms = Terms(batch.column("text").slice(i, j - i))
                row, term, count = terms.counted(wanted.value if wanted is not None else None)
                at = pa.array(np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), pa.array(np.diff(terms.first)), pa.ListArray.from_arrays(at, pa.array(term)), pa.ListArray.from_arrays(at, pa.array(count.astype(np.int64)))],
                    ["row", "doc_id", "n", "terms", "counts"],
                )

    return run


_INDEXED = "row long, doc_id long, n long, terms array<long>, counts array<long>"


def indexed(scratch: Scratch, docs: DataFrame, wanted: DataFrame, limit: int = VOCABULARY) -> tuple[DataFrame, int]:
    """row, doc_id, terms and impacts of all documents that have a term, only terms of `wanted` among them; and their number."""
    spark = docs.sparkSession
    texts = docs.where("text is not null").select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    few = wanted.limit(limit + 1).count() <= limit
    held = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in wanted.collect()], np.int64))) if few else None
    counted = texts.mapInArrow(_postings(held), _INDEXED).where("n > 0")
    counted = scratch.cut(counted, "counted")
    if not few:
        one = counted.select("row", F.explode(F.arrays_zip("terms", "counts")).alias("p")).select("row", F.col("p.terms").alias("term"), F.col("p.counts").alias("count"))
        kept = one.join(wanted, "term", "left_semi").groupBy("row").agg(F.collect_list(F.struct("term", "count")).alias("p"))
        kept = kept.select("row", F.col("p.term").alias("terms"), F.col("p.count").alias("counts"))
        none = F.array().cast("array<long>")
        counted = counted.select("row", "doc_id", "n").join(kept, "row", "left").withColumns({c: F.coalesce(c, none) for c in ("terms", "counts")})
    total = counted.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    # How lengths and counts make an impact.
    length = F.expr(f"50 + (cast(50 * n as decimal(38,0)) * {total.n}) div {total.l or 1}")
    impacts = F.expr("transform(counts, c -> (1000000000 * c) div (1000 * c + 20 * m))")
    out = counted.where(F.size("terms") > 0).withColumn("m", length).select("row", "doc_id", "terms", impacts.alias("impacts"))
    out = scratch.cut(out, "impacts")
    scratch.drop("counted")
    return out, total.n


def tiers(scratch: Scratch, index: DataFrame, sizes: tuple[int, ...] = TIERS) -> DataFrame:
    """term, df and, for each tier, the least impact that it takes (floor) and the largest that it lacks (rest)."""
    one = index.select(F.explode(F.arrays_zip("terms", "impacts")).alias("p")).select(F.col("p.terms").alias("term"), F.col("p.impacts").alias("impact"))
    levels = one.groupBy("term", F.expr(f"impact div {LEVEL}").alias("level")).agg(F.count("*").alias("n"), F.max("impact").alias("most"))
    levels = levels.withColumn("above", F.sum("n").over(Window.partitionBy("term").orderBy(F.desc("level"))))
    each = []
    for k, size in enumerate(sizes):
        each.append(F.coalesce(F.min(F.when(F.col("above") <= size, F.col("level") * LEVEL)), F.lit(1 << 40)).alias(f"floor{k}"))
        each.append(F.coalesce(F.max(F.when(F.col("above") > size, F.col("most"))), F.lit(0)).alias(f"rest{k}"))
    return scratch.cut(levels.groupBy("term").agg(F.sum("n").alias("df"), *each), "tiers")


# --- scores of a block of items ---


class Block:
    """Which items have which terms (both numbered), and what a term weighs."""

    def __init__(self, items: list[np.ndarray], tiers: dict[int, tuple], documents: int):
        known = [[t for t in terms.tolist() if t in tiers] for terms in items]
        weigh = lambda df: math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))  # noqa: E731  a fixed value
        weights = {t: weigh(tiers[t][0]) for terms in known for t in terms}
        pairs = sorted((t, i) for i, terms in enumerate(known) for t in terms if weights[t] > 0)
        self.items = len(items)
        self.terms = np.array(sorted({t for t, _ in pairs}), np.int64)
        self.weight = np.array([weights[t] for t in self.terms.tolist()], np.int64)
        self.bound = np.array([tiers[t][1:] for t in self.terms.tolist()], np.int64)  # floor and rest of each tier
        self.first = np.searchsorted(np.array([t for t, _ in pairs], np.int64), self.terms)
        self.first = np.append(self.first, len(pairs))
        self.item = np.array([i for _, i in pairs], np.int64)
        self.of = np.repeat(np.arange(len(self.terms)), np.diff(self.first))

    def rest(self, tier: int) -> np.ndarray:
        """What a document that the tier lacks can score, by item."""
        return self._sums(self.item, (self.weight * self.bound[:, 2 * tier + 1])[self.of], self.items)

    @staticmethod
    def _sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        if int(np.abs(values).max(initial=0)) * max(1, len(values)) < 1 << 53:
            return np.bincount(at, values, n).astype(np.int64)
        out = np.zeros(n, np.int64)
        np.add.at(out, at, values)
        return out

    def scored(self, size: np.ndarray, terms: np.ndarray, impacts: np.ndarray, less: np.ndarray | None = None):
        """(first, sums [document, item], products) of runs of documents, from their numbered terms; `less` is taken off a term's impacts."""
        many = np.diff(self.first)[terms]
        at = np.concatenate([[0], np.cumsum(size)])
        work = np.concatenate([[0], np.cumsum(many)])[at]
        i = 0
        while i < len(size):
            j = min(i + max(1, CELLS // max(1, self.items)), len(size))
            j = max(i + 1, min(j, int(np.searchsorted(work, work[i] + CELLS, side="right")) - 1))
            a, b = at[i], at[j]
            t, n = terms[a:b], many[a:b]
            posting = np.repeat(np.arange(a, b), n)
            item = self.item[np.arange(len(posting)) - np.repeat(np.cumsum(n) - n - self.first[t], n)]
            doc = np.repeat(np.repeat(np.arange(j - i), size[i:j]), n)
            worth = self.weight[t] * (impacts[a:b] - (less[t] if less is not None else 0))
            yield i, self._sums(doc * self.items + item, worth[posting - a], (j - i) * self.items).reshape(j - i, self.items)
            i = j


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, terms and impacts of a batch's rows."""
    terms, impacts = batch.column("terms"), batch.column("impacts")
    return np.diff(terms.offsets.to_numpy()), terms.flatten().to_numpy(zero_copy_only=False), impacts.flatten().to_numpy(zero_copy_only=False)


def _numbered(block: Block, batch: pa.RecordBatch, floor: np.ndarray | None = None):
    """Sizes, numbered terms and impacts of what the block knows, at `floor` of a term or above."""
    size, terms, impacts = _lists(batch)
    at = np.minimum(np.searchsorted(block.terms, terms), len(block.terms) - 1)
    keep = block.terms[at] == terms
    if floor is not None:
        keep &= impacts >= floor[at]
    size = np.diff(np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(size)])])
    return size, at[keep], impacts[keep]


_TIER = "tier int, row long, doc_id long, terms array<int>, impacts array<long>"
_FOUND = "item int, row long, doc_id long, score long"


def _deal(block, n_tiers: int):
    """Each document once for each tier that has postings of it, with terms as the block numbers them."""

    def run(batches):
        for batch in batches:
            for k in range(n_tiers):
                size, terms, impacts = _numbered(block.value, batch, block.value.bound[:, 2 * k])
                some = np.flatnonzero(size)
                at = pa.array(np.concatenate([[0], np.cumsum(size[some])]).astype(np.int32))
                part = batch.take(pa.array(some))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), k, np.int32)), part.column("row"), part.column("doc_id"), pa.ListArray.from_arrays(at, pa.array(terms.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(impacts))],
                    ["tier", "row", "doc_id", "terms", "impacts"],
                )

    return run


def _records(item, row, doc_id, score) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(row), doc_id, pa.array(score.astype(np.int64))], ["item", "row", "doc_id", "score"])


class _Best:
    """The best documents of each item so far."""

    def __init__(self, items: int, top: int, floor: np.ndarray):
        self.items, self.top, self.floor = items, top, floor.copy()
        self.held = [np.zeros(0, np.int64)] * 3  # item, score, number in `rows`
        self.rows: list[tuple[int, int | None]] = []

    def add(self, scores: np.ndarray, row: list, doc_id: list) -> None:
        doc, item = np.nonzero((scores > 0) & (scores >= self.floor))
        used, doc = np.unique(doc, return_inverse=True)
        at = len(self.rows)
        self.rows += [(row[d], doc_id[d]) for d in used.tolist()]
        self.held = [np.concatenate(x) for x in zip(self.held, (item, scores[used[doc], item] if len(doc) else doc, doc + at))]
        if len(self.held[0]) > 4 * self.items * self.top + 4096:
            self.cut()

    def cut(self) -> None:
        item, score, at = self.held
        ids = np.array([x[1] if x[1] is not None else (1 << 63) - 1 for x in self.rows], np.int64)
        order = np.lexsort([ids[at], -score, item])
        item, score, at = item[order], score[order], at[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        last = np.flatnonzero(place == self.top - 1)
        self.floor[item[last]] = np.maximum(self.floor[item[last]], score[last])
        keep = place < self.top
        item, score, at = item[keep], score[keep], at[keep]
        used, at = np.unique(at, return_inverse=True)
        self.rows = [self.rows[k] for k in used.tolist()]
        self.held = [item, score, at]


def _scan(block, open_, floor, top: int, numbered: bool):
    """The `top` best documents of each open item in a task's rows, of those that reach the item's floor."""

    def run(batches):
        b = block.value
        best = _Best(b.items, top, np.where(open_, floor, np.int64((1 << 63) - 1)))
        for batch in batches:
            size, terms, impacts = _lists(batch) if numbered else _numbered(b, batch)
            row, doc_id = batch.column("row").to_pylist(), batch.column("doc_id").to_pylist()
            for i, scores in b.scored(size, terms, impacts):
                best.add(scores, row[i : i + len(scores)], doc_id[i : i + len(scores)])
        best.cut()
        item, score, at = best.held
        rows = [best.rows[k] for k in at.tolist()]
        yield _records(item, np.array([r for r, _ in rows], np.int64), pa.array([d for _, d in rows], pa.int64()), score)

    return run


def _candidates(block, tier: int, open_, floor, rest, most: int):
    """Documents whose upper bound reaches the floor, by item; row -1 says that there are too many."""

    def run(batches):
        b, open_items = block.value, np.flatnonzero(open_)
        held = np.zeros(b.items, np.int64)
        for batch in batches:
            size, terms, impacts = _lists(batch)
            row = batch.column("row").to_numpy()
            for i, more in b.scored(size, terms, impacts, b.bound[:, 2 * tier + 1]):
                doc, item = np.nonzero((more + rest >= floor)[:, open_items])
                item = open_items[item]
                # a document without any term of the item is not among them: its bound is the rest alone, which is below the floor, or 0
                reach = more[doc, item] + rest[item] > 0
                doc, item = doc[reach], item[reach]
                held += np.bincount(item, minlength=b.items)
                over = held > most
                keep = ~over[item]
                out = np.concatenate([row[i + doc[keep]], np.full(int(over.sum()), -1)])
                items = np.concatenate([item[keep], np.flatnonzero(over)])
                held[over] = most + 1
                yield _records(items, out, pa.nulls(len(out), pa.int64()), np.zeros(len(out)))

    return run


def _exact(block, wanted):
    """The scores of candidates from all their postings; `wanted` has the items of each row."""

    def run(batches):
        for batch in batches:
            size, terms, impacts = _numbered(block.value, batch)
            row = batch.column("row").to_pylist()
            for i, scores in block.value.scored(size, terms, impacts):
                pairs = [(k, item) for k in range(len(scores)) for item in wanted.value.get(row[i + k], ()) if scores[k, item] > 0]
                doc, item = np.array(pairs, np.int64).reshape(-1, 2).T
                yield _records(item, np.array([row[i + k] for k in doc.tolist()], np.int64), batch.column("doc_id").take(pa.array(i + doc)), scores[doc, item])

    return run


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _search_block(scratch: Scratch, name: str, index: DataFrame, block, top: int, n_tiers: int, candidates: int) -> DataFrame:
    """item, rank, row, doc_id, score, tier: the one that settled the item."""
    spark, b = index.sparkSession, block.value
    dealt = None
    if n_tiers:
        dealt = scratch.cut(index.mapInArrow(_deal(block, n_tiers), _TIER), f"{name}dealt", "tier")
    open_, floor, parts = np.ones(b.items, bool), np.zeros(b.items, np.int64), []
    for k in range(n_tiers):
        here = dealt.where(F.col("tier") == k)
        low = _ranked(here.mapInArrow(_scan(block, open_, floor.copy(), top, True), _FOUND), top).where(F.col("rank") == top)
        for r in low.select("item", "score").collect():
            floor[r.item] = max(floor[r.item], r.score)
        rest = b.rest(k)
        maybe = open_ & ((rest < floor) | (rest == 0))
        if not maybe.any():
            continue
        found = here.mapInArrow(_candidates(block, k, maybe, floor.copy(), rest, candidates), _FOUND)
        found = scratch.cut(found.select("item", "row"), f"{name}c{k}")
        many = {r.item for r in found.groupBy("item").agg(F.min("row").alias("least"), F.count("*").alias("n")).where((F.col("least") < 0) | (F.col("n") > candidates)).collect()}
        settled = np.array([bool(maybe[i]) and i not in many for i in range(b.items)])
        if settled.any():
            wanted: dict[int, list[int]] = {}
            for r in found.where(F.col("item").isin([int(i) for i in np.flatnonzero(settled)])).collect():
                wanted.setdefault(r.row, []).append(r.item)
            rows = spark.createDataFrame([(r,) for r in wanted], "row long")
            exact = index.join(F.broadcast(rows), "row", "left_semi").mapInArrow(_exact(block, spark.sparkContext.broadcast(wanted)), _FOUND)
            parts.append(scratch.cut(_ranked(exact, top).withColumn("tier", F.lit(k)), f"{name}t{k}"))
            open_ = open_ & ~settled
        if not open_.any():
            break
    if open_.any():
        last = index.mapInArrow(_scan(block, open_, floor.copy(), top, False), _FOUND)
        parts.append(scratch.cut(_ranked(last, top).withColumn("tier", F.lit(n_tiers)), f"{name}last"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _item_terms(batches):
    for batch in batches:
        for i, j in slices(batch.column("text")):
            row, term, _ = Terms(batch.column("text").slice(i, j - i)).counted()
            at = pa.array(np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("item_id").slice(i, j - i), pa.ListArray.from_arrays(at, pa.array(term))], ["item_id", "terms"])


def search(docs: DataFrame, items: DataFrame, top: int = TOP, sizes: tuple[int, ...] = TIERS, candidates: int = CANDIDATES, block: int = ITEM_BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score of the `top` best documents of each item, and the `tier` that settled it."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lexical")
    asked = items.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_item_terms, "item_id long, terms array<long>")
    asked = scratch.numbered(asked, "at", "item_id", "terms", name="items")
    asked = scratch.cut(asked, "asked")
    index, documents = indexed(scratch, docs, asked.select(F.explode("terms").alias("term")).distinct())
    bounds = tiers(scratch, index, sizes)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long, tier int")
    for n in range(-(-asked.count() // block)):
        rows = asked.where(F.expr(f"at div {block}") == n)
        terms = rows.select(F.explode("terms").alias("term")).distinct()
        held = {r[0]: tuple(r[1:]) for r in bounds.join(terms, "term", "left_semi").collect()}
        own = sorted((r["at"] - n * block, np.array(r["terms"], np.int64)) for r in rows.select("at", "terms").collect())
        made = Block([t for _, t in own], held, documents)
        if not len(made.terms):  # nothing that weighs anything
            continue
        made = spark.sparkContext.broadcast(made)
        found = _search_block(scratch, f"b{n}", index, made, top, len(sizes), candidates)
        ids = rows.select((F.col("at") - n * block).cast("int").alias("item"), "item_id")
        out = out.unionByName(found.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score", "tier"))
    return out
