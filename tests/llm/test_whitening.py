import numpy as np
import pytest

from loomspark.llm import queries, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>"


def brute(vectors, k=8):
    """Per row the exact deviation, and the covariance's eigenvalues and axes, by plain arithmetic."""
    x = [[int(np.floor(1024 * c)) + 100000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    d = [[n * c - s for c, s in zip(r, sums)] for r in x]
    deviation = [sum(c * c for c in r) for r in d]
    centred = np.array(d, float) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    return deviation, e[::-1][:k], v[:, ::-1][:, :k], centred, sum(deviation) / n**3


def test_against_plain_arithmetic(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    ids, vectors = zip(*[(r.vec_id, r.embedding) for r in rows.collect()])
    deviation, e, v, centred, trace = brute(vectors)
    got = queries.QUERIES["op11_embedding_whitening"](spark, SF).collect()
    assert len(got) == 8 * len(ids) and {r.n for r in got} == {len(ids)}
    at = {i: k for k, i in enumerate(ids)}
    w = np.zeros((len(ids), 8))
    for r in got:
        w[at[r.vec_id], r.component - 1] = r.whitened
        assert r.deviation == deviation[at[r.vec_id]]
        assert r.explained == pytest.approx(e[r.component - 1] / trace, rel=1e-9)
        assert r.identity_error < 1e-9
    want = centred @ v / np.sqrt(e)
    signs = np.sign((w * want).sum(axis=0))
    assert np.abs(w - want * signs).max() < 1e-6
    assert np.abs(w.T @ w / len(ids) - np.eye(8)).max() < 1e-9


def test_rows_that_take_no_part_and_clashing_columns(spark):
    rnd = np.random.default_rng(1)
    good = [[float(c) for c in r] for r in rnd.normal(size=(30, 3))]
    rows = [(k, v) for k, v in enumerate(good)] + [(None, good[0]), (0, good[0])]
    odd = [(90, None), (91, [1.0, None, 2.0]), (92, [1.0, float("nan"), 2.0]), (93, [float("inf"), 0.0, 0.0]), (94, [1.0, 2.0]), (95, []), (96, [2.0**53, 0.0, 0.0])]
    frame = spark.createDataFrame(rows + odd, SCHEMA).selectExpr("*", "1 AS n", "'x' AS whitened", "2 AS component").repartition(5)
    got = whitening.digest(frame).collect()
    deviation, *_ = brute(good + [good[0], good[0]])
    assert len(got) == 3 * 32  # a row for each axis of three dimensions
    assert sorted({(r.vec_id, r.deviation) for r in got}, key=str) == sorted(set(zip([*range(30), None, 0], deviation)), key=str)


def test_what_does_not_vary_gives_nothing(spark):
    assert whitening.digest(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitening.digest(spark.createDataFrame([(1, [1.0, 2.0])], SCHEMA)).collect() == []
    assert whitening.digest(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)).collect() == []
    flat = [(k, [float(k), 2.0 * k, 1.0]) for k in range(9)]  # one axis varies
    assert {r.component for r in whitening.digest(spark.createDataFrame(flat, SCHEMA)).collect()} == {1}


def test_deviations_beyond_a_long(spark):
    rows = [(1, [2.0**40, 0.0]), (2, [-(2.0**40), 1.0]), (3, [5.0, 2.0])]
    got = {r.vec_id: r.deviation for r in whitening.digest(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1] is None and got[2] is None and got[3] == brute([v for _, v in rows])[0][2]


def test_more_dimensions_than_a_hundred(spark):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(200, 130)) * np.linspace(3, 1, 130)
    got = whitening.digest(spark.createDataFrame([(k, list(map(float, r))) for k, r in enumerate(x)], SCHEMA)).collect()
    _, e, _, _, trace = brute(x)
    assert [g for g in sorted({(r.component, r.explained) for r in got})] == [(k + 1, pytest.approx(e[k] / trace, rel=1e-9)) for k in range(8)]
