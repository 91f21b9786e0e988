import math
import random
import re
import zlib
from collections import Counter, defaultdict

from loomspark.llm import language_id as op

VOCAB = {"en": "the and of to in house water people", "de": "der und die das haus wasser leute über", "fr": "le et les des maison eau gens été"}


def corpus():
    rnd = random.Random(3)
    rows = []
    for i in range(150):
        lang = rnd.choice(list(VOCAB))
        rows.append((i, " ".join(rnd.choice(VOCAB[lang].split()) for _ in range(rnd.randint(5, 40))), lang, "s", 1))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, held_out int")


def test_held_out_accuracy_and_edges(spark):
    rows = corpus() + [(900, None, "en", None, 0), (901, "12 ... ²", "en", None, 0), (None, "the house", None, None, 0), (902, "wasserhaus", None, "s", 0), (903, "DER " * 5000, None, "s", 0), (1, rows_text(1), "xx", "s", 0)]
    got = [tuple(r) for r in op.predict(frame(spark, rows)).collect()]
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows[:150]}
    by = {r[0]: r for r in got}
    for i, held, lang, score in got:
        assert held == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= score <= 1
    right = [by[i][2] == truth[i] for i in truth if by[i][1]]
    assert sum(right) / len(right) > 0.97
    assert by[900][2:] == ("und", 0.0) and by[901][2:] == ("und", 0.0)
    assert by[None][2] == "en" and by[902][2] == "de" and by[903][2] == "de"


def rows_text(i):
    return corpus()[i][1]


def brute(rows):
    """(doc_id, held_out, lang, score) by the definition, in plain Python; every document is learned from that may be."""
    words_of = lambda text: re.findall(r"[^\W\d_]+", (text or "").lower())
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    count = {0: defaultdict(Counter), **{n: defaultdict(Counter) for n in range(1, 6)}}  # 0: words
    for i, text, lang, *_ in rows:
        if i is None or lang is None or text is None or held(i):
            continue
        for w in words_of(text):
            count[0][w][lang] += 1
            for n in range(1, 6):
                for g in {f"<{w}>"[k : k + n] for k in range(len(w) + 3 - n)}:
                    count[n][g][lang] += 1
    langs = sorted({x for c in count[0].values() for x in c})
    total = {n: {x: sum(c[x] for c in t.values()) + 0.5 * len(t) for x in langs} for n, t in count.items()}
    log = lambda n, key, x: round((math.log(count[n][key][x] + 0.5) - math.log(0.5)) * op.UNIT) if count[n][key][x] else 0
    base = {n: {x: round((math.log(0.5) - math.log(total[n][x])) * op.UNIT) for x in langs} for n in total}

    def word(w, x):
        if w in count[0]:
            return base[0][x] + log(0, w, x)
        for n in range(5, 0, -1):
            grams = [f"<{w}>"[k : k + n] for k in range(len(w) + 3 - n)]
            if known := [g for g in grams if g in count[n]]:
                return base[n][x] + sum(log(n, g, x) for g in known) // len(known)
        return 0

    out = []
    for i, text, *_ in rows:
        ws = Counter(words_of(text))
        if not langs or not any(c.isalpha() for w in ws for c in w):
            out.append((i, held(i), "und", 0.0))
            continue
        sums = {x: sum(n * word(w, x) for w, n in ws.items()) for x in langs}
        best = max(sums.values())
        share = sum(math.exp((s - best) / op.UNIT / sum(ws.values()) * min(sum(ws.values()), op.EVIDENCE)) for s in sums.values())
        out.append((i, held(i), min(x for x in langs if sums[x] == best), 1 / share))
    return out


def same(got, want):
    got, want = sorted(got, key=str), sorted(want, key=str)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-9 for g, w in zip(got, want))


def test_same_as_brute_force_on_a_table(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    want = brute(rows)
    same([tuple(r) for r in op.predict(docs).collect()], want)
    model = op.Model(op.training_words(docs))
    monkeypatch.setattr(op, "CELLS", 0)  # the sparse form
    scores = op._Scores(model)
    assert scores.table is None
    same([(i, h, *op.classify(scores, t)) for (i, t, _), (_, h, _, _) in zip(rows, want)], want)


def test_three_hundred_languages_and_ties(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(1500):  # every language has words of its own and shares some
        lang = i % 300
        rows.append((i, " ".join([f"w{chr(97 + lang % 26)}{chr(97 + lang // 26)}{chr(97 + k)}" for k in range(3)] + rnd.choices(["all", "some", "new" + chr(97 + i % 7)], k=4)), f"l{lang:03d}", "s", 0))
    one, two = [i for i in range(2000, 2100) if zlib.crc32(str(i).encode()) % 3 != 1][:2]
    rows += [(one, "same words", "b", "s", 0), (two, "same words", "a", "s", 0), (3000, "same words", None, "s", 0), (3001, "zzzz", None, "s", 0)]
    got = [tuple(r) for r in op.predict(frame(spark, rows)).collect()]
    same(got, brute(rows))
    learned = {r[2] for r in rows if r[2] and zlib.crc32(str(r[0]).encode()) % 3 != 1}
    assert len(learned) > 290 and {"a", "b"} <= learned
    (tie,) = [g for g in got if g[0] == 3000]
    assert tie[2] == "a" and tie[3] <= 0.5


def test_sums_do_not_depend_on_what_is_remembered(spark, monkeypatch):
    model = op.Model([("a", "haus", 3), ("b", "house", 2), ("b", "mouse", 1)])
    text = " ".join(f"ho{chr(97 + i % 26)}us{chr(97 + i // 26)}" for i in range(400)) + " haus house"
    want = op.classify(op._Scores(model), text)
    for cells in (0, 1 << 23):
        monkeypatch.setattr(op, "CELLS", cells)
        for n in (1, 7, 100):
            monkeypatch.setattr(op, "REMEMBERED", n)
            assert op.classify(op._Scores(model), text) == want


def test_longest_known_gram_decides():
    m = op.Model([("a", "abcdef", 3), ("b", "abxyz", 1)])
    size, langs, values = m.unseen("zzcde")
    t = m.grams[3]
    row = slice(t.start[t.index["cde"]], t.start[t.index["cde"] + 1])
    assert size == 3 and langs.tolist() == t.lang[row].tolist() == [0] and values.tolist() == t.value[row].tolist()
    assert m.unseen("zzz")[0] == 2 and m.unseen("ÿ")[0] == 1


def test_sample_is_bounded_for_each_language(spark, monkeypatch):
    monkeypatch.setattr(op, "DOCS_PER_LANG", 5)
    rows = [(i, f"{'xy'[i % 2] * (i % 9 + 1)}", "ab"[i % 2], "s", 0) for i in range(3000)]
    got = op.training_words(frame(spark, rows))
    assert {lang: sum(n for x, _, n in got if x == lang) for lang in "ab"} == {"a": 5, "b": 5}


def test_nothing_to_learn_from(spark):
    assert op.predict(frame(spark, [])).collect() == []
    assert tuple(op.predict(frame(spark, [(5, "the", None, None, 0)])).first())[2:] == ("und", 0.0)


def test_accepted_keeps_columns(spark):
    df = frame(spark, corpus() + [(900, None, "en", None, 0), (901, "--", "en", None, 0)])
    got = op.accepted(df)
    assert got.schema == df.schema and {r.doc_id for r in got.collect()} == set(range(150))
