import random
import sys
from collections import Counter
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parents[2])]
import corpus_pipeline
import test_ngram_join as near
import test_quality_rules as rules
import test_substring_dedup as sub

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rnd = random.Random(9)
    vocab = {"en": [f"the{k}ing" for k in range(60)], "de": [f"der{k}ung" for k in range(60)]}
    passage = " ".join(f"shared{k}" for k in range(40))
    rows = []
    for i in range(120):
        lang = rnd.choice(["en", "de"])
        words = [rnd.choice(vocab[lang]) for _ in range(rnd.randint(5, 80))]
        if i % 9 == 0:
            words[3:3] = passage.split()
        rows.append((i, " ".join(words), lang))
        if i % 7 == 0:
            rows.append((200 + i, rows[-1][1] + " end", lang))
        if i % 10 == 0:
            rows.append((400 + i, rows[-1][1], lang))
    rows += [(900, None, "en"), (901, "123 456 " * 20, "en"), (902, "spam spam " * 40, "en")]
    return [(i, t, lang, "s", len(t or "")) for i, t, lang in rows]


def test_same_as_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    want = {i: t for i, t, *_ in rows}
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        got = stage(spark, docs, str(tmp_path))
        assert got.dtypes == docs.dtypes
        if n == 0:
            want = {i: t for i, t in want.items() if t and any(c.isalpha() for c in t)}
        elif n == 1:
            want = {i: t for i, t in want.items() if not rules.plain(t)[-1]}
        elif n == 2:
            want = {i: want[i] for i, _, c in near.brute(sorted(want.items()), 5, 80) if c == i}
        else:
            kept = {r[0]: (r[1], r[2]) for r in sub.brute(sorted(want.items()))}
            want = {i: kept[i] for i in want if not kept[i][0] == kept[i][1] > 0}
        got.write.parquet(str(tmp_path / f"stage{n}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{n}"))
        have = {r.doc_id: r.text for r in docs.collect()}
        if n == 3:
            have = {i: len(sub.WORD.findall(t)) for i, t in have.items()}
            assert all(r.n_chars == len(r.text) for r in docs.collect())
            want = {i: a - b for i, (a, b) in want.items()}
        assert have == want, n
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in out) == Counter((i, n + 1) for i, n in want.items())


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_nulls_repeats_and_clashing_columns(spark, tmp_path):
    text = " ".join(f"the{k}ing" for k in range(40))
    other = " ".join(f"der{k}ung" for k in range(50))
    rows = [(1, text, "en"), (1, text, "en"), (2, text + " end", "en"), (3, None, None), (3, other, "de"), (None, other, "de"), (None, text, None), (4, "", "en"), (5, "7 " * 30, None)]
    more = ["upto", "share", "count", "tile", "row", "n_words", "kept", "whole", "__d", "c0", "bucket", "batch"]
    df = spark.createDataFrame([(i, t, lang, None, None, *range(len(more))) for i, t, lang in rows], ", ".join([COLUMNS, *[f"{c} int" for c in more]]))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, None), (None, 0, None), (2, None, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        got = stage(spark, docs, str(tmp_path))
        assert got.dtypes == df.dtypes
        got.write.parquet(str(tmp_path / f"stage{n}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{n}"))
        seen.append(sorted(((r.doc_id, len((r.text or "").split())) for r in docs.collect()), key=str))
    named = sorted([(1, 40), (1, 40), (2, 41), (3, 50), (None, 50), (None, 40)], key=str)
    assert seen[0] == seen[1] == named
    # one row of 1, which 2 is a near copy of; rows without an id are copies of rows with one only in their texts
    assert seen[2] == seen[3] == sorted([(1, 40), (3, 50), (None, 50), (None, 40)], key=str)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in out), key=str) == sorted([(1, 41), (3, 51), (None, 51), (None, 41)], key=str)
