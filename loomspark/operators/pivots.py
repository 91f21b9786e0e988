"""Vectors grouped by pivots: exact search by cosine that leaves out what the triangle inequality rules out.

Of unit vectors, the distance d has d * d = 2 - 2 * cosine. With the distance of each vector to its pivot kept, a vector
is at least | d(query, pivot) - d(vector, pivot) | from the query; whole groups go by the least and largest such distance.
The best `top` of the groups that are nearest give the distance beyond which nothing counts, so the result is that of a scan.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..scratch import Scratch
from . import search

#: Pivots, at most: they are rows of the table, taken in the order of a hash, and broadcast.
PIVOTS = 256
#: Room for rounding in the bounds.
SLACK = 1e-5
_NONE = -1  # the group of vectors that have no direction or another length: they are always scored


class Groups:
    """The vectors of `embeddings` (chunk_id, embedding) as a table with a folder for each pivot.

    A third of all rows in one group is a folder of several files, no single task; the driver has the pivots and four numbers for each.
    """

    def __init__(self, embeddings: DataFrame, pivots: int = PIVOTS):
        import numpy as np

        spark = embeddings.sparkSession
        self.scratch = Scratch(spark, "pivots")
        whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
        usual = embeddings.where(whole).groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
        self.dim = usual["dim"] if usual else 0
        fit = embeddings.where(whole & (F.size("embedding") == self.dim)).orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(pivots).collect() if usual else []
        unit = np.array([r.embedding for r in fit], dtype=np.float64).reshape(len(fit), self.dim)
        self.pivots = unit / np.linalg.norm(unit, axis=1, keepdims=True) if len(fit) else unit
        held, dim = spark.sparkContext.broadcast(self.pivots), self.dim

        def run(frames):
            import numpy as np

            p = held.value
            for pdf in frames:
                group, far = np.full(len(pdf), _NONE), np.zeros(len(pdf))
                fits = [i for i, v in enumerate(pdf["embedding"]) if v is not None and len(v) == dim and dim]
                if fits:
                    x = np.array([np.asarray(pdf["embedding"].iloc[i], dtype=np.float64) for i in fits])
                    norm = np.linalg.norm(x, axis=1)
                    good = np.isfinite(norm) & (norm > 0)
                    fits, x = np.array(fits)[good], x[good] / norm[good, None]
                    near = x @ p.T
                    group[fits] = near.argmax(axis=1)
                    far[fits] = np.linalg.norm(x - p[near.argmax(axis=1)], axis=1)
                yield pdf.assign(pivot=group.astype("int32"), far=far)

        kind = embeddings.select("embedding").schema[0].dataType.simpleString()
        grouped = embeddings.select("chunk_id", "embedding").mapInPandas(run, f"chunk_id long, embedding {kind}, pivot int, far double")
        self.rows = self.scratch.cut(grouped, "rows", by="pivot")
        stats = self.rows.groupBy("pivot").agg(F.count("*").alias("n"), F.min("far").alias("least"), F.max("far").alias("most")).collect()
        self.stats = {r.pivot: r for r in stats}

    def _within(self, away: dict[int, float], most: float) -> DataFrame:
        """Rows that may be within `most` of the query; `away`: its distance from each pivot."""
        near = [g for g, d in away.items() if d - most <= self.stats[g].most and self.stats[g].least <= d + most]
        bounds = self.rows.sparkSession.createDataFrame([(g, away[g] - most, away[g] + most) for g in near] + [(_NONE, -1.0, 1.0)], "pivot int, low double, high double")
        rows = self.rows.where(F.col("pivot").isin(*near, _NONE)).join(F.broadcast(bounds), "pivot")  # at most PIVOTS + 1 rows
        return rows.where("far BETWEEN low AND high").select("chunk_id", "embedding")

    def candidates(self, chunks: DataFrame, vector: Sequence[float], top: int) -> DataFrame:
        """chunk_id, embedding: a superset of the `top` of `chunks` nearest to the query."""
        import numpy as np

        q = np.asarray(vector, dtype=np.float64)
        norm = np.linalg.norm(q)
        if len(q) != self.dim or not np.isfinite(norm) or norm == 0:
            return self.rows.select("chunk_id", "embedding")
        away = {g: float(np.linalg.norm(q / norm - self.pivots[g])) for g in self.stats if g != _NONE}
        first, n = [], 0
        for g in sorted(away, key=lambda g: (away[g], g)):
            first, n = [*first, g], n + self.stats[g].n
            if n >= 4 * top:
                break
        scores = self.rows.where(F.col("pivot").isin(first)).join(chunks.select("chunk_id"), "chunk_id", "left_semi")
        scores = [r[0] for r in scores.select(S.cosine(F.col("embedding"), F.array(*[F.lit(float(v)) for v in vector])).alias("s")).orderBy(F.desc("s")).limit(top).collect()]
        if len(scores) < top or not top:
            return self.rows.select("chunk_id", "embedding")
        return self._within(away, math.sqrt(max(0.0, 2 - 2 * scores[-1])) + SLACK)

    def search(self, chunks: DataFrame, vector: Sequence[float], top: int = 5, kind: str | None = None) -> DataFrame:
        """What `search.search_semantic` finds over all vectors."""
        rows = search.only(chunks, search.chosen_type(kind))
        return search.search_semantic(rows, self.candidates(rows, vector, top), vector, top, among=rows.join(self.rows.select("chunk_id"), "chunk_id", "left_semi"))
