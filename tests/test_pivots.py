import random

import pytest
from pyspark.sql import functions as F

from loomspark.operators import pivots, search


def chunks_of(df):
    return df.select("chunk_id", F.when(F.col("chunk_id") % 2 == 0, "code").otherwise("doc").alias("chunk_type"), F.concat(F.lit("n"), (F.col("chunk_id") % 50).cast("string")).alias("name"), F.lit("x").alias("content"))


def found(df):
    return [tuple(r) for r in df.select("rank", "chunk_id", "score", "unique").orderBy("rank").collect()]


@pytest.fixture(scope="module")
def clustered(spark):
    """40 directions of 32 dimensions, one with a third of all rows; copies, zero vectors, nulls, and other lengths."""
    r = random.Random(3)
    centres = [[r.gauss(0, 1) for _ in range(32)] for _ in range(40)]
    rows = [(i, [x + r.gauss(0, 0.05) for x in centres[0 if i % 3 == 0 else r.randrange(40)]]) for i in range(3000)]
    rows += [(3000 + i, rows[7][1]) for i in range(20)]
    rows += [(4000, [0.0] * 32), (4001, None), (4002, [1.0, 2.0]), (4003, [float("nan")] * 32), (4004, [])]
    return spark.createDataFrame(rows, "chunk_id long, embedding array<double>").cache(), rows


def test_same_as_a_scan(spark, clustered):
    df, rows = clustered
    groups, chunks = pivots.Groups(df, 64), chunks_of(df)
    good = df.where("chunk_id <> 4003")  # a scan of a vector that is no number is no number
    for q, top, kind in ((rows[7][1], 12, None), (rows[3][1], 10, "doc"), ([1.0] * 32, 5, None)):
        assert found(groups.search(chunks.where("chunk_id <> 4003"), q, top, kind)) == found(search.search_semantic(chunks, good, q, top, kind))
    assert found(groups.search(chunks, [1.0, 2.0], 1))[0][1] in (4002,)
    assert found(groups.search(chunks, rows[3][1], 0)) == []


def test_few_rows_are_scored(spark, clustered):
    df, rows = clustered
    groups = pivots.Groups(df, 64)
    q = next(v for i, v in rows if i % 3)
    assert groups.candidates(chunks_of(df), q, 10).count() < 0.1 * len(rows)


def test_empty(spark, clustered):
    df, rows = clustered
    assert found(pivots.Groups(df.limit(0)).search(chunks_of(df), rows[0][1], 5)) == []
