import random

import numpy as np
import pyarrow as pa

from loomspark.llm import quality_knn as op


def corpus():
    rnd = random.Random(4)
    words = [f"{a}{b}" for a in ("ta", "ri", "mo", "nel") for b in ("ner", "sil", "o", "ath")]
    docs, labels = [], []
    for i in range(300):
        good = i % 4 != 0
        w = [rnd.choice(words) for _ in range(rnd.randint(30, 80))]
        text = " ".join(w) + "." if good else " ".join(x + "###" for x in w)
        docs.append((i, text, "x"))
        labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    docs += [(900, None, "x"), (901, "", "x"), (None, docs[1][1], "x"), (1, docs[1][1], "y"), (902, "word ### " * 200_000, "x")]
    labels += [(5000, 1, 0), (3, None, 0), (None, 1, 0)]
    d, l = spark.createDataFrame(docs, "doc_id long, text string, quality string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = op.score(d, l).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert sum(r.predicted == (r.doc_id % 4 != 0) for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    base = {r.score for r in got if r.doc_id in (900, 901)}
    assert len(base) == 1 and 0.6 < base.pop() < 0.9


def test_exact_votes():
    rnd = np.random.default_rng(1)
    x = op.features(pa.array(["".join(chr(97 + c) for c in rnd.integers(0, 20, 50)) for _ in range(200)]))
    y = rnd.integers(0, 2, 200)
    m = op.Model(x, y)
    z = m._weighed(x) @ m.axes
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    for i in range(0, 200, 17):
        sims = np.array([float(z[i] @ v) for v in m.vectors])
        near = np.argsort(-sims)[: op.NEIGHBOURS]
        w = np.clip(sims[near], 0, 1) ** op.SHARPNESS
        assert abs(m.scores(x[i : i + 1])[0] - (w * y[near]).sum() / w.sum()) < 1e-3


def test_no_labels_and_no_documents(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert op.score(d, none).first().score == 0.5
    assert op.score(d.limit(0), none).collect() == []


def test_long_text_is_read_whole():
    a, b = op.features(pa.array(["ab " * 500_000, "ab " * 500_000 + "zz%"]))
    assert (a != b).any()


def test_ties_go_to_the_first_and_heights_do_not_matter(monkeypatch):
    monkeypatch.setattr(op, "NEIGHBOURS", 3)
    texts = ["one two three four"] * 6 + ["alpha beta gamma delta"] * 4
    m = op.Model(op.features(pa.array(texts)), np.array([1, 0, 1, 0, 0, 0, 1, 1, 0, 0]))
    assert abs(m.scores(op.features(pa.array(texts[:1])))[0] - 2 / 3) < 1e-6  # the first three of six equals: 1, 0, 1
    rnd = np.random.default_rng(3)
    x = op.features(pa.array(["".join(chr(97 + c) for c in rnd.integers(0, 9, 60)) for _ in range(120)]))
    m = op.Model(x, rnd.integers(0, 2, 120))
    whole = m.scores(x)
    assert all((m.scores(x[i : i + n]) == whole[i : i + n]).all() for n in (1, 7, 64) for i in range(0, 120, 31))
