import random
import re

from loomspark.llm import quality_rules as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    seen, lines = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    hit = set()
    for i, x in enumerate(windows):
        if windows.count(x) > 1:
            hit |= set(range(i, i + 8))
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(hit), failed


def texts():
    rnd = random.Random(2)
    out = [None, "", " \n\t", "a", "ç\x1cé #", "x " * 30, "l1 l2\nl1 l2\n\nl1 l2 \nl1 l2", "a\n" * 9, "\\ ' \" $1 ### 😀 😀"]
    for _ in range(60):
        base = [rnd.choice(["der", "é😀", "w#", "x|y", "Z", "q1", "\x85", "u"]) for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 2)):
            a = rnd.randint(0, 40)
            base += base[a : a + rnd.randint(0, 20)]
        out.append("".join(b + rnd.choice(" \n\t\x0b") for b in base))
    return out


def test_counts(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(None, "a b", "x"), (3, "other words", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = op.judge(df, labels).collect()
    assert len(got) == len(rows)
    want = sorted(((i, *plain(t)) for i, t, _ in rows), key=str)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=str) == want
    assert all(r.kept == (not r.base_failed) for r in got)


def test_exact_bound():
    from math import comb

    for n, k, p in ((10, 0, 0.1), (30, 4, 0.2), (100, 7, 0.05), (5, 5, 0.5)):
        assert abs(op.below(n, k, p) - sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))) < 1e-12
    assert op.below(3_000_000, 20_000, 0.01) < 1e-100


def corpus(n):
    docs, labels = [], []
    for i in range(n):
        words = [f"w{i}x{k}" for k in range(40)]
        good = i % 3 != 0
        docs.append((i, " ".join(words) if good else " ".join(w + "###" for w in words), "a"))
        labels.append((i, int(good)))
    return docs, labels


def test_rules_reject_bad_documents_only(spark):
    docs, labels = corpus(2400)
    d, l = spark.createDataFrame(docs, "doc_id long, text string, n_words string"), spark.createDataFrame(labels + [(1, 0), (None, 1), (9, None)], "doc_id long, quality int")
    found = op.thresholds(op._with_counts(d), l)
    assert found[1, "symbols"] == 0.01 and not any(s == 2 for s, _ in found)
    kept = op.kept_rows(d, l)
    assert kept.schema == d.schema and {r.doc_id for r in kept.collect()} == {i for i, g in labels if g}


def test_too_few_labels_reject_nothing(spark):
    docs, labels = corpus(300)
    d, l = spark.createDataFrame(docs, "doc_id long, text string, s string"), spark.createDataFrame(labels, "doc_id long, quality int")
    assert op.thresholds(op._with_counts(d), l) == {}
    assert op.kept_rows(d, l).count() == 300 and op.judge(d.limit(0), l).collect() == []


def test_cutoffs_decide_as_in_sql(spark, tmp_path):
    import duckdb

    rnd = random.Random(6)
    docs, labels = [], []
    for i in range(5000):
        bad = rnd.random() < 0.2
        words = [f"w{i}x{k}" + ("###" if bad and rnd.random() < 0.7 else "") for k in range(rnd.choice([15, 40, 120, 420]))]
        if rnd.random() < 0.01:
            words = [w + "%" for w in words]
        docs.append((i, " ".join(words).upper() if bad and i % 2 else " ".join(words)))
        if rnd.random() < 0.9:
            labels.append((i, int(not bad)))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents"))
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels"))
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    got = op.judge(*(spark.read.parquet(str(tmp_path / x)) for x in ("documents", "labels")))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({op.oracle()})").fetchall()
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows) == sorted(want)
    by = {(r[-2], r[-1]) for r in rows}
    assert by == {(True, False), (False, True), (False, False)}
