import random

from loomspark.operators import containment
from loomspark.operators.containment import WIDTHS, contained


def brute(rows, needles):
    return sorted((i, n) for i, t in rows for n in {n for n in needles if n} if t is not None and n in t)


def got(spark, rows, needles, **sizes):
    df = spark.createDataFrame(rows, "i int, text string").repartition(3)
    names = spark.createDataFrame([(n,) for n in needles], "name string")
    return sorted((r.i, r.name) for r in contained(df, names, "text", "name", **sizes).collect())


def samples(n, seed, letters):
    r = random.Random(seed)
    word = lambda most: "".join(r.choice(letters) for _ in range(r.randint(0, most)))
    texts = [word(60) for _ in range(n)]
    cut = [t[a : a + r.randint(1, 20)] for t in texts for a in [r.randint(0, max(0, len(t) - 1))]]
    return [(i, t) for i, t in enumerate(texts)], cut + [word(14) for _ in range(n)]


def test_equals_plain_search(spark):
    rows, needles = samples(120, 3, "abÉ𝒳\x00")
    rows += [(1000, None), (1001, ""), *((2000 + i, rows[7][1]) for i in range(60)), rows[5], rows[5]]  # copies of one text, a repeated row
    needles += [None, "", needles[0], needles[0], "not there at all"]
    want = brute(rows, needles)
    assert len(want) > 1000
    assert got(spark, rows, needles) == want
    # a full bitmap leaves nothing out, and texts are hashed in pieces: same rows
    assert got(spark, rows, needles, slots=1 << 8, block=16) == want
    assert got(spark, rows, needles, held=0) == want


def test_every_width_and_its_neighbours(spark):
    text = "".join(chr(0x4E00 + 7 * i % 900) for i in range(4000))
    sizes = sorted({w + d for w in WIDTHS for d in (-1, 0, 1)} - {0})
    needles = [text[a : a + n] for n in sizes for a in (0, 17, 250, 1990, 4000 - n)]
    rows = [(0, text), (1, text[:2000]), (2, text[2000:])]
    assert got(spark, rows, needles, block=256) == brute(rows, needles)


def test_needles_that_share_a_gram(spark):
    """A third of all texts hold the one gram that all needles have."""
    needles = ["a" * n for n in range(1, 40)]
    rows = [(i, "a" * (i % 50) if i % 3 == 0 else f"b{i}") for i in range(150)]
    assert got(spark, rows, needles) == brute(rows, needles)


def test_a_clash_of_hashes_adds_nothing(spark, monkeypatch):
    """Where all grams are equal, all that meets is tested by the text."""
    same = lambda codes: {w: codes[: max(0, len(codes) - w + 1)] * 0 for w in WIDTHS}
    monkeypatch.setattr(containment, "_windows", same)
    assert containment.needle_grams("abc").tolist() == [0]
    bits = containment.Bits([(3, 1, b"\x01" + bytes(31))], 1 << 8)
    assert bits.tester(8)("abcabc").tolist() == [0] and bits.tester(8)("ab").tolist() == []


def test_empty_tables_and_columns(spark):
    none = spark.createDataFrame([], "i int, text string")
    some = spark.createDataFrame([(1, "find me")], "i int, text string")
    names = spark.createDataFrame([("me",)], "name string")
    assert contained(none, names, "text", "name").collect() == []
    assert contained(some, names.where("name = ''"), "text", "name").collect() == []
    clash = some.selectExpr("i", "text", "'old' AS name", "1 AS id", "2 AS gram", "3 AS n", "4 AS needle")
    assert [tuple(r) for r in contained(clash, names, "text", "name").collect()] == [(1, "find me", 1, 2, 3, 4, "me")]


def test_how_texts_meet_candidates(spark):
    """Few candidates are broadcast, by their counted size; texts are shuffled, once, for more."""
    rows, needles = samples(50, 9, "abcd")
    df, names = spark.createDataFrame(rows, "i int, text string"), spark.createDataFrame([(n,) for n in needles], "name string")
    plan = lambda **sizes: contained(df, names, "text", "name", **sizes)._jdf.queryExecution().executedPlan().toString()
    few, many = plan(), plan(held=0)
    assert "BroadcastHashJoin" in few and "hashpartitioning" not in few
    assert "SortMergeJoin" in many and many.count("hashpartitioning") == 2 and "Broadcast" not in many
