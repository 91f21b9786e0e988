import hashlib
import random
import re

from loomspark.llm import substring_dedup as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, length=13):
    first = {}
    for i, text in rows:
        words = WORD.findall(text or "")
        for k in range(len(words) - length + 1):
            w = tuple(words[k : k + length])
            if i is not None:
                first[w] = min(first.get(w, i), i)
    out = []
    for i, text in rows:
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for k in range(len(words) - length + 1):
            if i is not None and first[tuple(words[k : k + length])] < i:
                gone[k : k + length] = [True] * length
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def corpus(seed=1, n=60):
    rnd = random.Random(seed)
    vocab = ["a", "b", "çé", "the", "of", "x y", "w1", "w2", "ß", "\x1c"] + [f"v{k}" for k in range(30)]
    passages = [[rnd.choice(vocab) for _ in range(rnd.randint(10, 60))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rnd.randint(0, 4)):
            if rnd.random() < 0.6:
                p = rnd.choice(passages)
                a = rnd.randint(0, 10)
                words += p[a : a + rnd.randint(5, 60)]
            else:
                words += [rnd.choice(vocab) for _ in range(rnd.randint(0, 20))]
        rows.append((i * 3 % n * 7, "".join(w + rnd.choice([" ", "\n", "\t ", "\x0b"]) for w in words)))
    rows += [(3, None), (4, ""), (5, "  \n "), (6, "one"), (None, rows[0][1]), (rows[5][0], rows[5][1]), (8, "z " * 40), (9, "z " * 50)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_same_as_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        got = sorted(map(tuple, op.repeats(frame(spark, rows)).collect()), key=str)
        assert got == sorted(brute(rows), key=str)


def test_empty_table(spark):
    assert op.repeats(frame(spark, [])).collect() == []


def test_text_is_cut_and_columns_stay(spark):
    p = " ".join(f"p{k}" for k in range(20))
    rows = [(1, f"alpha  {p}\nomega", 5), (2, f"beta\n\n{p}  gamma,\tdelta ", 6), (3, p, 7), (4, None, 8), (None, p, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, whole int")
    got = {(r.doc_id, r.whole): r.text for r in op.dedup_text(df).collect()}
    assert got == {(1, 5): rows[0][1], (2, 6): "beta\n\ngamma,\tdelta ", (4, 8): None, (None, 9): p}
