import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomspark.llm import lexical
from loomspark.llm.common import Scratch

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return _TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=50):
    counted = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    n, total = len(counted), sum(x[2] for x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for d, c, size in counted:
            m = 50 + (50 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item_id, k + 1, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def made(seed, n, words):
    rnd = random.Random(seed)
    return [" ".join(words[min(len(words) - 1, int(rnd.expovariate(6 / len(words))))] for _ in range(rnd.randrange(1, 40))) for _ in range(n)]


def rows(frame):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in frame.collect()), key=str)


@pytest.mark.parametrize("sizes, candidates, block", [((8, 64), 20, 100), ((4,), 5, 3), ((), 10, 100), ((100, 100_000), 1000, 7)])
def test_same_as_every_document_scored(spark, sizes, candidates, block):
    words = [f"w{k}" for k in range(60)]
    docs = list(enumerate(made(1, 400, words)))
    items = list(enumerate(made(2, 9, words) + ["rare"])) + [(77, "")]
    docs += [(1000 + k, "rare w5") for k in range(5)]
    got = lexical.search(spark.createDataFrame(docs, DOCS).repartition(7), spark.createDataFrame(items, ITEMS), top=5, sizes=sizes, candidates=candidates, block=block)
    assert rows(got) == brute(docs, items, 5)


def test_tiers_settle_what_they_can(spark):
    """A passage that six documents share is settled above; one of common words falls through."""
    docs = [(k, "alpha beta gamma delta filler") for k in range(6)] + [(10 + k, f"common word x{k % 7} " + "pad " * (k % 5)) for k in range(300)]
    items = [(1, "alpha beta gamma delta"), (2, "common word")]
    got = lexical.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), top=5, sizes=(10,), candidates=50)
    assert {(r.item_id, r.tier) for r in got.collect()} == {(1, 0), (2, 1)}
    assert rows(got) == brute(docs, items, 5)


def test_nulls_ties_repeats_long_texts_and_clashing_columns(spark):
    long = "needle " + "hay " * 400_000 + "Ünï needle9"
    docs = [(3, "a needle"), (3, "a needle"), (None, "a needle"), (1, "a needle"), (2, None), (4, ""), (5, "?!"), (6, long), (7, "NEEDLE b"), (8, "ünï")] + [(20 + k, f"z{k} y") for k in range(20)]
    items = [(1, "Needle, needle; Ünï"), (1, "needle"), (None, "y"), (2, None), (3, "nothing here"), (4, "")]
    frame = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS row", "2 AS n", "'x' AS terms")
    asked = spark.createDataFrame(items, ITEMS).selectExpr("*", "1 AS at", "'x' AS term", "3 AS doc_id")
    assert rows(lexical.search(frame, asked)) == brute(docs, items)


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b")], DOCS)
    assert lexical.search(none, spark.createDataFrame([(1, "a")], ITEMS)).collect() == []
    assert lexical.search(one, spark.createDataFrame([], ITEMS)).collect() == []


def test_vocabulary_that_is_joined(spark):
    docs = spark.createDataFrame(list(enumerate(made(3, 80, [f"w{k}" for k in range(30)]))), DOCS)
    scratch = Scratch(spark, "test-lexical")
    wanted = docs.where("doc_id < 3").select("text").mapInArrow(lambda bs: lexical._item_terms(b.append_column("item_id", b.column("text")) for b in bs), "item_id string, terms array<long>")
    wanted = wanted.select(F.explode("terms").alias("term")).distinct()
    seen = []
    for k, limit in enumerate((10**6, 1)):
        index, n = lexical.indexed(Scratch(spark, f"test-lexical{k}"), docs, wanted, limit)
        seen.append((n, sorted((r.doc_id, sorted(zip(r.terms, r.impacts))) for r in index.collect())))
    assert seen[0] == seen[1] and scratch.root
