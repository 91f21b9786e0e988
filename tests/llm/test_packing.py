import random
from collections import Counter, defaultdict
from itertools import combinations

from loomspark.llm import packing as op


def padding(lengths, ends):
    return sum(min(e for e in ends if e >= n) - n for n in lengths)


def test_ends_are_optimal():
    rnd = random.Random(1)
    for _ in range(60):
        lengths = [rnd.choice([1, 2, 3, 5, 8, 9, 20, 21, 40]) for _ in range(rnd.randint(1, 30))]
        c = Counter(lengths)
        sizes = sorted(c)
        for k in (1, 2, 3, 4):
            got = op.best_ends(sizes, [c[s] for s in sizes], k)
            assert len(got) <= k and got[-1] == sizes[-1]
            best = min(padding(lengths, [*x, sizes[-1]]) for x in combinations(sizes[:-1], min(k, len(sizes)) - 1))
            assert padding(lengths, got) == best


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, batch string")


def test_batches(spark, monkeypatch):
    monkeypatch.setattr(op, "SHARD", 7)
    rnd = random.Random(2)
    rows = [(i, " ".join(["w"] * rnd.choice([3, 4, 30, 31, 200])), "x") for i in range(200)]
    rows += [(900, None, "x"), (901, "", "x"), (None, "a b", "x"), (5, rows[5][1], "x"), (902, "w\t" * 5000, "x")]
    got = op.pack(frame(spark, rows), budget=400, buckets=4).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    length = {r[0]: len((r[1] or "").split()) + 1 for r in rows}
    batches = defaultdict(list)
    for r in got:
        assert r.n_tokens == length[r.doc_id] <= r.bucket_len and r.padding == r.bucket_len - r.n_tokens
        batches[r.bucket, r.batch].append(r)
    for (b, n), members in batches.items():
        assert sorted(m.slot for m in members) == list(range(len(members)))
        assert len(members) == 1 or len(members) * members[0].bucket_len <= 400
    for b in {b for b, _ in batches}:  # full but for the last
        sizes = [len(batches[b, n]) for n in range(sum(x == b for x, _ in batches))]
        assert len(set(sizes[:-1])) <= 1 and sizes[-1] <= sizes[0]
    assert sum(r.padding for r in got) == padding([length[r[0]] for r in rows], sorted({r.bucket_len for r in got}))


def test_ends_of_many_long_lengths_are_optimal():
    rnd = random.Random(4)
    for m, k in ((300, 6), (40, 12), (7, 12)):
        c = {rnd.randrange(1, 200_000): rnd.randrange(1, 1000) for _ in range(m)}
        sizes = sorted(c)
        pad = lambda i, j: sum((sizes[j - 1] - sizes[x]) * c[sizes[x]] for x in range(i, j))
        cost = [[pad(i, j) if i < j else 0 for j in range(len(sizes) + 1)] for i in range(len(sizes))]
        best = [0, *[cost[0][j] for j in range(1, len(sizes) + 1)]]  # plain dynamic programming
        for _ in range(k - 1):
            best = [0, *[min([best[j]] + [best[i] + cost[i][j] for i in range(j)]) for j in range(1, len(sizes) + 1)]]
        got = op.best_ends(sizes, [c[s] for s in sizes], k)
        assert len(got) <= k and sum(min(e for e in got if e >= s) * n - s * n for s, n in c.items()) == best[-1]


def test_many_lengths_take_no_square():
    sizes = list(range(1, 200_001))
    assert len(op.best_ends(sizes, [1] * len(sizes), 12)) == 12


def test_rows_without_id_are_spread(spark, monkeypatch):
    monkeypatch.setattr(op, "SHARD", 10)
    got = op.pack(frame(spark, [(None, f"a{i} b", "x") for i in range(300)]), budget=30, buckets=2).collect()
    assert sorted((r.batch, r.slot) for r in got) == [(i // 10, i % 10) for i in range(300)]


def test_empty_table(spark):
    assert op.pack(frame(spark, [])).collect() == []
