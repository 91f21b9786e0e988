"""Embedding whitening: principal components of centred rows, scaled to variance 1.

Entries become whole numbers x = floor(SCALE * c) + SHIFT, so that counts, sums and deviations are exact. Rows are
centred by exact sums, (n * x - S) / n, and MLlib's `RowMatrix.computeSVD` gives the axes of the centred
rows: a singular value s stands for the eigenvalue s * s / n of their covariance (divisor n). It is asked for more than half of the
axes, as it then solves the Gramian, which tasks sum up, by LAPACK and not by iteration: axes are exact to double precision.
The total variance does not come from the singular values, but from the sum of the exact deviations.

What meets on the driver is the Gramian of a dimension d, d * (d + 1) / 2 doubles, whatever the number of rows.

Defined results
---------------
- vectors null, or with null or non-finite entries, or with entries whose x is no long (|c| >= 2^52), take no part;
- vectors of another dimension than the most frequent one (of several, the largest) take no part; nor do empty ones;
- no rows, one row or equal rows only: no component has variance, so there is no row; components beyond the rank
  (an eigenvalue below RANK times the largest) are not returned either;
- a deviation beyond a long is null; equal eigenvalues: any axes of their space; either sign, the same for all rows;
- rows with one vec_id, or with null: each for itself, and each counts in the fit; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

COMPONENTS = 8
# How an entry becomes a whole number.
SCALE, SHIFT = 1024, 100_000
LIMIT = float(1 << 52)
RANK = 1e-12


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vec (array of doubles) of the rows whose entries are all numbers."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    return rows.where((F.size("vec") > 0) & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LIMIT)))


def _whole(column: pa.ListArray, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(SCALE * flat).astype(np.int64).reshape(-1, dim) + SHIFT


def _totals(rows: DataFrame, dim: int) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each dimension."""

    def run(batches):
        n, total = 0, np.zeros(dim, object)
        for batch in batches:
            x = _whole(batch.column("vec"), dim)
            n += len(x)
            for i in range(0, len(x), 1 << 9):  # so many entries below 2^53 sum up to a long
                total += x[i : i + (1 << 9)].sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dim), pa.int32()), pa.array([n, *map(int, total)], pa.decimal128(38, 0))], ["i", "total"])

    found = rows.select("vec").mapInArrow(run, "i int, total decimal(38,0)").groupBy("i").agg(F.sum("total").alias("total")).collect()
    by = {r.i: int(r.total) for r in found}
    return by.get(-1, 0), [by.get(i, 0) for i in range(dim)]


@dataclass
class Whitening:
    dim: int
    n: int
    sums: list[int]
    variance: float = 0.0
    values: np.ndarray | None = None
    axes: np.ndarray | None = None

    def _deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: as longs where all fit and their squares' sums do, else as Python's integers."""
        fits = self.n * (int(np.abs(x).max(initial=0)) + 1) + max(map(abs, self.sums)) < 1 << 63
        d = x.astype(np.int64 if fits else object) * self.n - np.array(self.sums, np.int64 if fits else object)
        return d if int(np.abs(d).max(initial=0)) ** 2 * self.dim < 1 << 63 else d.astype(object)

    def _map(self, rows: DataFrame, give, schema: str) -> DataFrame:
        """give(batch, n * x - S) for each batch."""

        def run(batches):
            for batch in batches:
                yield give(batch, self._deviations(_whole(batch.column("vec"), self.dim)))

        return rows.where(F.size("vec") == self.dim).mapInArrow(run, schema)

    def centred(self, rows: DataFrame) -> DataFrame:
        """x - S / n as `centred`."""

        def give(batch, d):
            flat = pa.array((d.astype(np.float64) / self.n).ravel())
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1, dtype=np.int32) * self.dim), flat)], ["centred"])

        return self._map(rows, give, "centred array<double>")

    def project(self, rows: DataFrame) -> DataFrame:
        """vec_id, deviation and `whitened` (an entry for each component) of usable rows."""
        axes, n = self.axes / np.sqrt(self.values), self.n

        def give(batch, d):
            square = (d * d).sum(axis=1)
            square = [int(s) if s < 1 << 63 else None for s in square] if square.dtype == object else square
            w = (d.astype(np.float64) / n) @ axes
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
            return pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(square, pa.int64()), flat], ["vec_id", "deviation", "whitened"])

        return self._map(rows, give, "vec_id long, deviation long, whitened array<double>")

    def identity_error(self, rows: DataFrame) -> float:
        """How far the covariance of the whitened rows is from the identity; their mean is 0, as the rows are centred by exact sums."""
        k = len(self.values)
        axes, n = self.axes / np.sqrt(self.values), self.n

        def give(batch, d):
            w = (d.astype(np.float64) / n) @ axes
            return pa.RecordBatch.from_arrays([pa.array(np.arange(k * k, dtype=np.int32)), pa.array((w.T @ w).ravel())], ["at", "s"])

        found = self._map(rows, give, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()
        covariance = np.zeros(k * k)
        for r in found:
            covariance[r.at] = r.s / n
        return float(np.abs(covariance.reshape(k, k) - np.eye(k)).max())


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of usable rows; None if nothing varies."""
    most = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if most is None:
        return None
    dim = most["dim"]
    rows = rows.where(F.size("vec") == dim)
    fitted = Whitening(dim, *_totals(rows, dim))

    def give(batch, d):
        return pa.RecordBatch.from_arrays([pa.array([int(sum(map(int, (d * d).sum(axis=1))))], pa.decimal128(38, 0))], ["total"])

    total = fitted._map(rows, give, "total decimal(38,0)").agg(F.sum("total")).first()[0]
    if not total:
        return None
    fitted.variance = int(total) / fitted.n**3
    vectors = fitted.centred(rows).select(array_to_vector("centred").alias("v"))
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v"), fitted.n, dim)
    svd = matrix.computeSVD(min(dim, max(components, dim // 2 + 1)), computeU=False, rCond=RANK**0.5)
    values = svd.s.toArray() ** 2 / fitted.n
    keep = min(components, int((values > RANK * values[0]).sum()))
    fitted.values, fitted.axes = values[:keep], svd.V.toArray()[:, :keep]
    return fitted


def digest(vectors: DataFrame) -> DataFrame:
    """A row for each usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = usable(vectors)
    fitted = fit(rows)
    if fitted is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    explained = F.array(*[F.lit(float(e / fitted.variance)) for e in fitted.values])
    out = fitted.project(rows).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(fitted.identity_error(rows)).alias("identity_error"),
    )
