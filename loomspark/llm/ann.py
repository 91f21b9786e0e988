"""Approximate nearest neighbours by score-aware anisotropic quantisation.

Vectors are scaled to length 1, so that the largest inner product is the largest cosine, and cut
into subspaces of two dimensions with sixteen centres each: four bits a subspace. Centres and codes
minimise |r|^2 + (eta - 1) (r . x)^2, in which r is the residual: its part parallel to the vector, which
changes inner products that are large, costs eta times as much. Codes are found by coordinate
descent over the subspaces, and so are centres: what is fitted grows with the dimension, not with its square.

A search takes queries in blocks of `QUERY_BLOCK` (a bounded broadcast each) and scans every
code with look-up tables; the `RERANK` best distinct vectors of a chunk of rows are scored
exactly, in double precision, on the original vectors. So is every other vector whose code leaves
it open whether it is better than the worst of the best of these (`Codebook.least`), however many
they are, and the best of each chunk go on: the codes decide what is read, not what is found.

The codebook is fitted on a bounded sample: `SAMPLE` rows of the smallest hashes of vec_id.
Every row is indexed.

Defined results
---------------
- vectors null, empty, of length 0, or with null or non-finite components take no part;
- vectors of another dimension than the most frequent one of the sample are compared exactly, with those of their own dimension;
- equal vectors in a chunk share one code, and their smallest vec_ids answer, as ties go to the smaller vec_id;
- rows with the same vec_id: one query (the first in the order of the vectors), the best of the rows as a candidate, none for itself;
- null vec_id takes no part; fewer candidates than asked for: all of them; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SAMPLE = 8192
SUB = 2
CENTRES = 16
#: Cosine from which on inner products shall be kept; sets the weight of the parallel residual.
KEEP = 0.2
#: Vectors of a chunk that are scored first; the worst of their best bounds which others are.
RERANK = 48
#: More than approximate cosines lose in single precision, and than cosines differ by with the order of their sums.
ROUND, CLOSE = 1e-4, 1e-9
QUERY_BLOCK = 4096
#: Rows that are scanned together.
CHUNK = 16_384


class Codebook:
    def __init__(self, vectors: np.ndarray):
        self.dim = vectors.shape[1]
        self.subs = -(-self.dim // SUB)
        self.eta = max(1.0, (self.dim - 1) * KEEP**2 / (1 - KEEP**2))
        x = self.unit(vectors)
        rnd = np.random.default_rng(11)
        self.centres = np.zeros((self.subs, CENTRES, SUB))
        for s in range(self.subs):
            self.centres[s] = self._means(x[:, s * SUB : s * SUB + SUB], rnd)
        for _ in range(4):
            self._solve(x, self._codes(x))

    def unit(self, vectors: np.ndarray) -> np.ndarray:
        x = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        return np.pad(x, ((0, 0), (0, self.subs * SUB - self.dim)))

    @staticmethod
    def _means(x: np.ndarray, rnd) -> np.ndarray:
        c = x[rnd.permutation(len(x))[:CENTRES]]
        c = np.concatenate([c, rnd.normal(0, 1e-3, (CENTRES - len(c), SUB))])
        for _ in range(10):
            near = ((x[:, None] - c) ** 2).sum(-1).argmin(1)
            n = np.bincount(near, minlength=CENTRES)
            for k in range(SUB):
                total = np.bincount(near, x[:, k], minlength=CENTRES)
                c[:, k] = np.where(n > 0, total / np.maximum(n, 1), c[:, k])
        return c

    def _codes(self, x: np.ndarray, sweeps: int = 3) -> np.ndarray:
        n = len(x)
        codes = np.zeros((n, self.subs), np.uint8)
        parallel = np.zeros((n, self.subs))
        parts = []
        for s in range(self.subs):
            part = x[:, s * SUB : s * SUB + SUB]
            r = part[:, None] - self.centres[s]
            parts.append(((r**2).sum(-1), (r * part[:, None]).sum(-1)))
            codes[:, s] = parts[s][0].argmin(1)
            parallel[:, s] = parts[s][1][np.arange(n), codes[:, s]]
        total = parallel.sum(1)
        for _ in range(sweeps):
            for s, (square, along) in enumerate(parts):
                rest = total - parallel[:, s]
                codes[:, s] = (square + (self.eta - 1) * (rest[:, None] + along) ** 2).argmin(1)
                parallel[:, s] = along[np.arange(n), codes[:, s]]
                total = rest + parallel[:, s]
        return codes

    def _solve(self, x: np.ndarray, codes: np.ndarray) -> None:
        """Centres of less loss for these codes: those of one subspace after the other, the others fixed, by systems of SUB equations each."""
        weight = self.eta - 1
        parts = [x[:, s * SUB : s * SUB + SUB] for s in range(self.subs)]
        along = [((p - self.centres[s, codes[:, s]]) * p).sum(1) for s, p in enumerate(parts)]
        total = np.sum(along, axis=0)
        for s, p in enumerate(parts):
            k, rest = codes[:, s], total - along[s]
            # |p - c|^2 + weight * (rest + |p|^2 - c . p)^2, summed over the rows of a centre, is least where its gradient is 0
            a = np.empty((CENTRES, SUB, SUB))
            b = np.empty((CENTRES, SUB))
            pull = 1 + weight * (rest + (p * p).sum(1))
            for i in range(SUB):
                b[:, i] = np.bincount(k, p[:, i] * pull, minlength=CENTRES) + 1e-3 * self.centres[s, :, i]
                for j in range(SUB):
                    a[:, i, j] = weight * np.bincount(k, p[:, i] * p[:, j], minlength=CENTRES) + (i == j) * (np.bincount(k, minlength=CENTRES) + 1e-3)
            self.centres[s] = np.linalg.solve(a, b[:, :, None])[:, :, 0]
            along[s] = ((p - self.centres[s, k]) * p).sum(1)
            total = rest + along[s]

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """Two subspaces a byte."""
        codes = self._codes(self.unit(vectors))
        if self.subs % 2:
            codes = np.pad(codes, ((0, 0), (0, 1)))
        return codes[:, 0::2] | codes[:, 1::2] << 4

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of each query with each pair of centres: [query, byte, its value]."""
        q = self.unit(queries).reshape(len(queries), self.subs, SUB)
        one = np.einsum("qsk,sck->qsc", q, self.centres)
        if self.subs % 2:
            one = np.pad(one, ((0, 0), (0, 1), (0, 0)))
        low, high = one[:, 0::2], one[:, 1::2]
        return (high[:, :, :, None] + low[:, :, None, :]).reshape(len(queries), -1, 256).astype(np.float32)

    def scan(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Approximate cosines [query, row], from the tables alone."""
        t = self.tables(queries)
        out = np.zeros((len(queries), len(codes)), np.float32)
        for s in range(codes.shape[1]):
            out += np.take(t[:, s], codes[:, s], axis=1)
        return out

    def split(self, x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each coded vector, the length along the vector x (of length 1) that it stands for, and the length across."""
        c = np.stack([codes & 15, codes >> 4], axis=2).reshape(len(codes), -1)[:, : self.subs]
        y = self.centres[np.arange(self.subs), c].reshape(len(codes), -1)
        along = (x * y).sum(1)
        return along, np.sqrt(np.maximum((y * y).sum(1) - along**2, 0))

    @staticmethod
    def least(floor: float, along: np.ndarray, across: np.ndarray) -> np.ndarray:
        """The smallest approximate cosine that each row may have if its cosine c is floor or more.

        It is along * c + across * s with |s| <= sqrt(1 - c^2), which grows with c from 0 on; else the code's error bounds it.
        """
        loose = floor - np.hypot(1 - along, across)
        if floor < 0:
            return loose - ROUND
        return np.where(along > 0, floor * along - np.sqrt(max(0.0, 1 - floor**2)) * across, loose) - ROUND


def exact(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines in double precision, each summed in the same order: [..., d] and [..., d]."""
    dot = (queries * rows).sum(-1)
    return dot / (np.sqrt((queries * queries).sum(-1)) * np.sqrt((rows * rows).sum(-1)))


def _distinct(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows of the distinct vectors, and the k smallest ids of each."""
    x = np.ascontiguousarray(x + 0.0)  # -0.0 and 0.0 are equal
    keys = x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
    _, first, of = np.unique(keys, return_index=True, return_inverse=True)
    order = np.lexsort([ids, of])
    bounds = np.searchsorted(of[order], np.arange(len(first) + 1))
    return first, [np.unique(ids[order[a:b]])[:k] for a, b in zip(bounds[:-1], bounds[1:])]


def nearest(book: Codebook | None, qid: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, codes: np.ndarray | None, k: int):
    """Up to k (query_id, vec_id, score) for each query among these rows."""
    first, owners = _distinct(ids, x, k + 1)
    x = x[first]
    codes = codes[first] if codes is not None else None
    want = min(max(RERANK, k + 1), len(x))
    some = codes is not None and len(x) > want
    if some:
        unit = book.unit(x)
        along, across = book.split(unit, codes)
    out = []
    for i in range(0, len(q), 256):
        part = q[i : i + 256]
        if some:
            approximate, asked = book.scan(part, codes), book.unit(part)
            top = np.argpartition(-approximate, want - 1, axis=1)[:, :want]
        for j in range(len(part)):
            near = np.arange(len(x))
            if some:
                floor = np.sort(unit[top[j]] @ asked[j])[-k - 1] - CLOSE
                near = np.flatnonzero(~(approximate[j] < book.least(floor, along, across)))
                near = near[~(unit[near] @ asked[j] < floor)]
            score = exact(part[j], x[near])
            # a query's own row may be among them
            best = np.argsort(-score, kind="stable")
            cut = score[best[min(len(best) - 1, k)]]
            pairs = sorted((-s, int(o)) for c, s in zip(near[score >= cut], score[score >= cut]) for o in owners[c] if o != qid[i + j])
            seen: set[int] = set()
            for s, o in pairs:
                if o not in seen and len(seen) < k:
                    seen.add(o)
                    out.append((int(qid[i + j]), o, -float(s)))
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vec (array of doubles) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & (F.size("vec") > 0) & finite & F.exists("vec", lambda v: v != 0))


def _matrix(column) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of a column of lists."""
    return np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)


def _encode(book):
    def run(batches):
        for batch in batches:
            size, flat = _matrix(batch.column("vec"))
            codes: list = [None] * len(size)
            own = np.flatnonzero(size == book.dim)
            if len(own):
                at = np.concatenate([[0], np.cumsum(size)])[own]
                for r, c in zip(own, book.encode(flat[at[:, None] + np.arange(book.dim)])):
                    codes[r] = c.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vec"), pa.array(codes, pa.binary())], ["vec_id", "vec", "code"])

    return run


def _search(book, queries, k: int):
    def scan(batches):
        table = pa.Table.from_batches(batches).combine_chunks()
        ids = table.column("vec_id").to_numpy()
        size, flat = _matrix(table.column("vec").combine_chunks() if isinstance(table.column("vec"), pa.ChunkedArray) else table.column("vec"))
        start = np.concatenate([[0], np.cumsum(size)])[:-1]
        found = []
        for dim, (qid, q) in queries.value.items():
            own = np.flatnonzero(size == dim)
            if len(own):
                codes = None
                if dim == book.dim:
                    codes = np.frombuffer(b"".join(table.column("code").take(pa.array(own)).to_pylist()), np.uint8).reshape(len(own), -1)
                found += nearest(book, qid, q, ids[own], flat[start[own][:, None] + np.arange(dim)], codes, k)
        qs, vs, ss = zip(*found) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(qs, pa.int64()), pa.array(vs, pa.int64()), pa.array(ss, pa.float64())], ["query_id", "vec_id", "score"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK:
                yield scan(held)
                held, rows = [], 0
        if rows:
            yield scan(held)

    return run


def index(scratch: Scratch, vectors: DataFrame) -> tuple[DataFrame, Codebook | None]:
    """Every usable row with its code, and the codebook."""
    rows = usable(vectors)
    sample = [np.array(r.vec) for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(SAMPLE).collect()]
    if not sample:
        return rows.withColumn("code", F.lit(None).cast("binary")), None
    dims = [len(v) for v in sample]
    dim = max(sorted(set(dims)), key=dims.count)
    book = Codebook(np.stack([v for v in sample if len(v) == dim]))
    return scratch.cut(rows.mapInArrow(_encode(book), "vec_id long, vec array<double>, code binary"), "index"), book


def search(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by `every`."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    rows, book = index(scratch, vectors)
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    asked = scratch.cut(asked, "queries")
    blocks = -(-asked.count() // (QUERY_BLOCK // 2))  # halves, as hashes fill blocks unevenly
    found = spark.createDataFrame([], "query_id long, vec_id long, score double")
    for b in range(blocks):
        block: dict = {}
        for r in asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect():
            block.setdefault(len(r.vec), []).append((r.vec_id, r.vec))
        ready = {dim: (np.array([i for i, _ in qs]), np.array([v for _, v in qs])) for dim, qs in block.items()}
        held = spark.sparkContext.broadcast(ready)
        found = found.unionByName(scratch.cut(rows.mapInArrow(_search(book, held, k), found.schema), f"found{b}"))
        held.destroy()
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
