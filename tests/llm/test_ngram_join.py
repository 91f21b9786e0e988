import random
import re

import numpy as np
import pyarrow as pa

from loomspark.llm import ngram_join as op
from loomspark.llm.textkernel import Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k, t):
    sets = []
    for _, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = WORD.findall(low)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    boss = {i: i for i, _ in rows if i is not None}

    def top(x):
        while boss[x] != x:
            x = boss[x]
        return x

    for x, (i, _) in enumerate(rows):
        for y, (j, _) in enumerate(rows[:x]):
            if i is None or j is None or not sets[x] or not sets[y]:
                continue
            both = len(sets[x] & sets[y])
            if 100 * both >= t * len(sets[x] | sets[y]):
                a, b = top(i), top(j)
                boss[max(a, b)] = min(a, b)
    return sorted(((i, len(s), top(i) if i is not None else None) for (i, _), s in zip(rows, sets)), key=str)


def corpus(seed):
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(200)] + ["The", "the", "É"]
    rows = []
    for n in (1, 2, 3, 4, 9, 11, 12, 13, 20, 30, 60, 120, 300):
        base = [rnd.choice(vocab) for _ in range(n)]
        for _ in range(7):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
                at = rnd.randrange(len(w))
                if rnd.random() < 0.5:
                    w[at] = rnd.choice(vocab)
                else:
                    w.insert(at, rnd.choice(vocab))
            rows.append(" ".join(w))
            base = w if rnd.random() < 0.4 else base
    rnd.shuffle(rows)
    rows = [(k * 7 % 1000, x) for k, x in enumerate(rows)]
    return rows + [(2000, None), (2001, ""), (2002, " \n"), (None, rows[0][1]), (1999, rows[3][1].upper()), (3, "a b c d"), (3, "e f g h")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_same_as_brute_force(spark):
    for seed, k, t in ((1, 3, 90), (2, 5, 80), (3, 2, 70)):
        rows = corpus(seed)
        got = sorted(map(tuple, op.graph(frame(spark, rows), k, t).collect()), key=str)
        assert got == brute(rows, k, t)


def test_chain_within_blocks(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_ROWS", 4)
    rnd = random.Random(5)
    base = [f"x{k}" for k in range(150)]
    rows = []
    for i in range(40):  # each links with the next ones only
        base = list(base)
        for _ in range(2):
            base[rnd.randrange(150)] = f"y{rnd.random()}"
        rows.append((i * 17 % 41, " ".join(base)))
    got = sorted(map(tuple, op.graph(frame(spark, rows), 3, 90).collect()), key=str)
    assert got == brute(rows, 3, 90)


def near_copies(seed, copies, words, edits):
    """Texts that are one base with some words replaced by words of their own, and the components of the links by the places of those words."""
    rnd = np.random.default_rng(seed)
    k, t, texts = 5, 80, []
    shingles = words - k + 1
    hit = np.zeros((copies, shingles), bool)
    for i in range(copies):
        w = [f"b{j}" for j in range(words)]
        for p in rnd.choice(words, rnd.choice(edits), replace=False):
            w[p] = f"e{i}x{p}"
            hit[i, max(0, p - k + 1) : p + 1] = True
        texts.append(" ".join(w))
    label = np.arange(copies)
    free = (~hit).astype(np.float32)
    for i in range(copies):
        both = free[i] @ free[i + 1 :].T
        for j in (np.flatnonzero(100 * both >= t * (2 * shingles - both)) + i + 1).tolist():
            if label[j] != label[i]:
                a, b = sorted((label[i], label[j]))
                label[label == b] = a
    return texts, label


def test_thousands_of_near_copies_about_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_ROWS", 256)
    texts, label = near_copies(3, 5000, 60, (1, 2, 2, 2, 3))
    made = []
    monkeypatch.setattr(op.Scratch, "cut", lambda self, df, name, cut=op.Scratch.cut: (made.append((name, out := cut(self, df, name))), out)[1])
    got = {r.doc_id: r.component_id for r in op.graph(frame(spark, list(enumerate(texts))), 5, 80).collect()}
    assert [got[i] for i in range(5000)] == label.tolist()
    assert 10 < len(set(label.tolist())) < 4990
    # a spanning forest, not all pairs: some links are found by several blocks
    found = [spark.read.parquet(f.inputFiles()[0].rsplit("/", 1)[0]).count() for name, f in made if "_links" in name]
    assert found and sum(found) < 4 * 5000


def test_hubs_meet_the_tiles_in_one_join(spark, monkeypatch):
    texts, label = near_copies(5, 900, 60, (2, 3, 3, 4))
    made, cut = {}, op.Scratch.cut

    def counted(self, df, name):
        out = cut(self, df, name)
        if {"tile", "node"} <= set(out.columns):
            made[name] = out.count()
        return out

    monkeypatch.setattr(op.Scratch, "cut", counted)
    got = {r.doc_id: r.component_id for r in op.graph(frame(spark, list(enumerate(texts))), 5, 80).collect()}
    assert [got[i] for i in range(900)] == label.tolist()
    # places in open tiles, of which there are many for a node, are joined by node once for all hubs, and again if no hub is done with them
    assert made["rest"] > 2000 and sum(n for name, n in made.items() if name not in ("members", "rest")) <= 2 * made["rest"]


def test_block_is_a_spanning_forest():
    rnd = np.random.default_rng(2)
    base = np.unique(rnd.integers(0, 2**63, 60).astype(np.uint64))
    sets = [np.unique(np.concatenate([rnd.permutation(base)[:50], rnd.integers(0, 2**63, rnd.integers(0, 12)).astype(np.uint64)])) for _ in range(300)]
    zero = np.zeros((300, 3), np.int64)
    links = op.Block(op.Bands(75), sets, np.arange(300), np.full(300, 2), zero).forest()
    label = list(range(300))
    for pairs, keep in (([(x, y) for x in range(300) for y in range(x) if op._linked(sets[x], sets[y], 75)], False), (links, True)):
        label = list(range(300))
        for x, y in pairs:
            a, b = sorted((label[x], label[y]))
            assert not keep or a != b
            label = [a if v == b else v for v in label]
        if not keep:
            want = label
    assert label == want and len(set(label)) < 300
    # nodes of one side, of one component, or with a label in common are not compared
    assert op.Block(op.Bands(75), sets, np.arange(300), np.zeros(300, int), zero).forest() == []
    assert op.Block(op.Bands(75), sets, np.zeros(300, int), np.full(300, 2), zero).forest() == []
    assert op.Block(op.Bands(75), sets, np.arange(300), np.full(300, 2), zero + [0, 7, 0]).forest() == []
    wide = [base, np.unique(np.concatenate([base, rnd.integers(0, 2**63, 15).astype(np.uint64)]))]
    assert len(op.Block(op.Bands(75), wide, np.arange(2), np.full(2, 2), zero[:2]).forest()) == 1


def kept(s, bands):
    """Tiles that a set stays in; each tile's count is a hash of it."""
    out = set()
    tiles, notes = op.signatures(s, bands)
    for parity in (0, 1):
        own = sorted((-(n // 2 % 2), -(int(x) * 7919 % 5), int(x), n // 4) for x, n in zip(tiles, notes.tolist()) if n % 2 == parity)
        out |= {x for i, (_, _, x, left) in enumerate(own) if i >= left}
    return out


def test_linked_sets_share_a_tile():
    rnd = np.random.default_rng(1)
    for t in (90, 80):
        bands = op.Bands(t)
        for n in list(range(1, 60)) + [100, 333, 1000]:
            s = np.unique(rnd.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
            for m in range(max(1, n * t // 100 - 1), n + 1):
                u = np.sort(rnd.permutation(s)[:m])
                if op._linked(s, u, t) and m < n:
                    assert kept(s, bands) & kept(u, bands), (t, n, m)
                assert op.differ(op.bitmap(s), op.bitmap(u)) <= n - m


def test_linked_sets_on_both_sides_of_spare(spark):
    rnd = np.random.default_rng(7)
    bands, mixed = op.Bands(90), 0
    for _ in range(1500):
        a = np.unique(rnd.integers(0, 2**63, 21).astype(np.uint64) * np.uint64(2))
        one, two = a[rnd.permutation(21) != 0], a[rnd.permutation(21) != 0]
        (x, nx), (y, ny) = op.signatures(one, bands), op.signatures(two, bands)
        if not op._linked(one, two, 90):
            continue
        both = set(x.tolist()) & set(y.tolist())  # as the join has it: tiles of one set only are gone before tiles are ranked
        left = []
        for tiles, notes in ((x, nx), (y, ny)):
            for parity in (0, 1):
                own = sorted((-(n // 2 % 2), t, n // 4) for t, n in zip(tiles.tolist(), notes.tolist()) if n % 2 == parity and t in both)
                left.append({t for i, (_, t, n) in enumerate(own) if i >= n})
        mixed += bool({n // 2 % 2 for n in nx.tolist()} != {n // 2 % 2 for n in ny.tolist()})
        assert (left[0] | left[1]) & (left[2] | left[3])
    assert mixed
    rows = []
    for i in range(3000):
        words = [f"p{i}w{k}" for k in range(22)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:-1], "last"]))]
    got = {r.doc_id: r.component_id for r in op.graph(frame(spark, rows), 3, 90).collect()}
    assert [i for i, c in got.items() if c != i - i % 2] == []


def test_empty_table_and_representatives(spark):
    assert op.graph(frame(spark, [])).collect() == []
    text = " ".join(f"w{k}" for k in range(40))
    df = spark.createDataFrame([(1, text, 0), (2, text, 1), (3, None, 2), (None, text, 3)], "doc_id long, text string, tile int")
    assert sorted(r.tile for r in op.representatives(df).collect()) == [0, 2, 3]


def test_representatives_of_repeated_rows(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    rows = [(1, a, 0), (1, a, 1), (1, None, 2), (2, a, 3), (2, a, 4), (3, b, 5), (None, a, 6), (None, a.upper(), 7), (None, a, 8), (None, b, 9), (None, None, 10), (None, "", 11), (4, None, 12), (4, None, 13)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tile int")
    got = op.representatives(df)
    assert got.columns == df.columns and got.dtypes == df.dtypes
    assert sorted(r.tile for r in got.collect()) == [0, 5, 7, 9, 10, 11, 12]


def test_shingles_of_short_texts():
    w = Words(pa.array(["a b", "a  b", "b a", "a", None]), lower=True)
    s = op.shingles(w, 3)
    assert [len(x) for x in s] == [1, 1, 1, 1, 0]
    assert s[0] == s[1] != s[2]
