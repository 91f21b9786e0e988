"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A text is the log-scaled counts of its hashed three-byte strings and of a few shape terms
(how often lines and words repeat, symbols, capitals, digits), weighted by inverse document frequency. A truncated
singular-value decomposition of the labelled sample gives the latent space. The labelled vectors
are broadcast; every document's cosines with all of them are computed exactly, block by block,
and the `NEIGHBOURS` largest vote with their similarity as weight.

The sample is bounded: the `MAX_LABELLED` labelled rows of the smallest hashes of doc_id, so the
broadcast is at most MAX_LABELLED * DIMS floats, whatever the corpus holds.

Defined results
---------------
- null or empty text, or a vector of length 0: the share of label 1 in the sample;
- equal similarities (to PLACES decimals): the labelled rows of the smaller hashes of doc_id, then the smaller doc_id, vote;
- very long texts: read whole, in slices;
- no labelled rows: score 0.5 for every document;
- labels: null quality and labels without a document are ignored; a doc_id labelled twice counts twice;
- null doc_id: scored, held_out false, never learned from;
- rows with the same doc_id: each gets its own row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .language_id import held_out
from .textkernel import text_buffer

MAX_LABELLED = 3000
TERMS = 2048
DIMS = 64
NEIGHBOURS = 31
#: Similarities below this share of the nearest one weigh little: weight = similarity ** SHARPNESS.
SHARPNESS = 8
#: Decimals of a cosine that count.
PLACES = 9
_SLICE = 1 << 20
_SHAPE = 8


def features(column: pa.Array) -> np.ndarray:
    """Log-scaled term counts, one row for each text."""
    data, at = text_buffer(column)
    out = np.zeros((len(column), TERMS + _SHAPE), np.float32)
    for r in range(len(column)):
        raw = data[at[r] : at[r + 1]]
        count = np.zeros(TERMS, np.int64)
        for i in range(0, len(raw), _SLICE):  # whole texts, in slices that overlap by two bytes
            x = raw[i : i + _SLICE + 2].astype(np.uint32)
            key = (x[:-2] * np.uint32(0x01000193) ^ x[1:-1] * np.uint32(0x85EBCA6B) ^ x[2:] * np.uint32(0xC2B2AE35)) if len(x) > 2 else x[:0]
            count += np.bincount((key ^ (key >> np.uint32(15))) & np.uint32(TERMS - 1), minlength=TERMS)
        out[r, :TERMS] = np.log1p(count)
        out[r, TERMS:] = _shape(raw.tobytes())
    return out


def _shape(raw: bytes) -> list[float]:
    if not raw:
        return [0.0] * _SHAPE
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n, m = max(1, len(words)), max(1, len(lines))
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>{}[]@=_\\^~"))
    capitals = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    stops = len(raw) - len(raw.translate(None, b".!?,;:"))
    return [
        1 - len(set(words)) / n, 1 - len(set(lines)) / m, min(1.0, 10 * symbols / len(raw)), capitals / len(raw),
        digits / len(raw), stops / len(raw), float(len(words) < 20), min(1.0, len(raw) / n / 20),
    ]


class Model:
    def __init__(self, x: np.ndarray, labels: np.ndarray):
        self.labels = labels.astype(np.float64)
        self.base = float(self.labels.mean()) if len(labels) else 0.5
        if not len(labels):
            return
        # rare terms weigh more, up to a bound; the shape terms as much as a tenth of all words each
        self.idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
        y = self._weighed(x)
        rnd = np.random.default_rng(7)
        q = y @ rnd.standard_normal((y.shape[1], min(DIMS + 16, *y.shape))).astype(np.float32)
        for _ in range(4):
            q = np.linalg.qr(q)[0]
            q = y @ (y.T @ q)
        q = np.linalg.qr(q)[0]
        _, _, v = np.linalg.svd(q.T @ y, full_matrices=False)
        self.axes = np.ascontiguousarray(v[:DIMS].T).astype(np.float64)
        self.vectors = self._unit(y.astype(np.float64) @ self.axes)

    def _weighed(self, x: np.ndarray) -> np.ndarray:
        y = x * self.idf
        y[:, :TERMS] /= np.maximum(np.linalg.norm(y[:, :TERMS], axis=1, keepdims=True), 1e-9)
        y[:, TERMS:] = x[:, TERMS:]
        return y

    @staticmethod
    def _unit(z: np.ndarray) -> np.ndarray:
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(x), 0.5)
        # rounded, so that the last bits of a product, which may hang on a batch's height, neither order nor weigh
        cosine = np.round(self._unit(self._weighed(x).astype(np.float64) @ self.axes) @ self.vectors.T, PLACES)
        k = min(NEIGHBOURS, cosine.shape[1])
        least = np.partition(cosine, -k, axis=1)[:, -k, None]
        more, equal = cosine > least, cosine == least
        near = more | (equal & (np.cumsum(equal, axis=1) <= k - more.sum(axis=1, keepdims=True)))
        weight = np.where(near, np.clip(cosine, 0, 1), 0) ** SHARPNESS
        total = weight.sum(axis=1)
        vote = (weight * self.labels).sum(axis=1) / np.maximum(total, 1e-300)
        empty = ~x.any(axis=1) | (total <= 0)
        return np.where(empty, self.base, np.clip(vote, 0, 1))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    known = labels.where("doc_id is not null and quality is not null").where(~held_out())
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(MAX_LABELLED)

    def run(batches):
        for batch in batches:
            x = features(batch.column("text")).astype(np.float16)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"), pa.array([row.tobytes() for row in x], pa.binary())], ["doc_id", "quality", "x"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    rows = rows.mapInArrow(run, "doc_id long, quality int, x binary").orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "x").limit(MAX_LABELLED).collect()
    if not rows:
        return Model(np.zeros((0, TERMS + _SHAPE), np.float32), np.zeros(0))
    x = np.stack([np.frombuffer(r.x, np.float16) for r in rows]).astype(np.float32)
    return Model(x, np.array([r.quality == 1 for r in rows]))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of `docs` (doc_id, text); learns from `labels` (doc_id, quality)."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(fit(docs, labels))

    def run(batches):
        for batch in batches:
            got = [model.value.scores(features(batch.column("text").slice(i, 250))) for i in range(0, batch.num_rows, 250)]
            s = np.concatenate(got) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
