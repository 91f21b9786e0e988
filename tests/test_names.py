import random

import pytest
from pyspark.sql import functions as F

from loomspark.operators import names, search
from loomspark.operators.index import Index
from loomspark.sources import schemas

COLUMNS = [c.split()[0] for c in schemas.RAW.split(", ")]


def rows(spark, items):
    """items: (file, name, content)."""
    seq = {}
    out = []
    for file, name, content in items:
        seq[file] = seq.get(file, -1) + 1
        held = {"chunk_type": "code" if len(out) % 2 else "doc", "name": name, "file": file, "seq": seq[file], "content": content}
        out.append(tuple(held.get(c) for c in COLUMNS))
    return spark.createDataFrame(out, schemas.RAW)


def found(df):
    return [tuple(r) for r in df.select("rank", "chunk_id", "name", "score", "unique", "preview").orderBy("rank").collect()]


def items(n, seed=5):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeÉß𝒳") for _ in range(r.randint(1, 6)))
    return [(f"f{r.randint(0, 40):02}", None if i % 31 == 0 else "" if i % 29 == 0 else word() if i % 3 else "Parser", " ".join(word() for _ in range(r.randint(0, 12)))) for i in range(n)]


def test_candidates_lose_nothing(spark, tmp_path):
    given = items(600)
    index = Index(spark, str(tmp_path), bucket_bytes=1500)
    index.save(chunks=rows(spark, given))
    assert len(index.store.manifest().buckets) > 5
    assert index.index_names() > 5 and index.index_names() == 0
    for q in ("my parser here", "abcÉd", "𝒳aß", "ab c", "bad éab cde", "nothing-like-it"):
        assert found(index.search_by_name(q, 12)) == found(search.search_by_name(index.chunks, q, 12)), q
    assert found(index.search_by_name("parser", 7, "code")) == found(search.search_by_name(index.chunks, "parser", 7, "code"))
    assert found(index.search_by_name("parser", 0)) == []


def test_few_rows_are_scored(spark, tmp_path):
    given = [(f"f{i:04}", f"name{i}", f"common words and number{i} of text") for i in range(2000)]
    index = Index(spark, str(tmp_path), bucket_bytes=8000)
    index.save(chunks=rows(spark, given))
    index.index_names()
    assert index.named("number1234").count() < 100
    assert index.named("look for name77 please").count() < 20
    assert "FileScan" in index.named("number1234")._jdf.queryExecution().toString()


def test_lists_go_with_their_buckets(spark, tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    for i in range(12):
        (root / f"m{i:02}.md").write_text(f"# Heading {i}\n" + f"zebra{i} text " * 10)
    index = Index(spark, str(tmp_path / "index"), bucket_bytes=300)
    index.refresh(str(root))
    assert found(index.search_by_name("zebra3 text", 5)) == found(search.search_by_name(index.chunks, "zebra3 text", 5))  # no lists yet
    all_of_it = index.index_names()
    (root / "m05.md").write_text("# Heading 5\nquagga\n")
    (root / "m03.md").unlink()
    index.refresh(str(root))
    for q in ("quagga", "zebra4"):
        assert found(index.search_by_name(q, 20)) == found(search.search_by_name(index.chunks, q, 20)), q  # some buckets have no lists
    assert 0 < index.index_names() < all_of_it
    for q in ("zebra3", "heading"):
        assert found(index.search_by_name(q, 20)) == found(search.search_by_name(index.chunks, q, 20)), q
    assert [r[2] for r in found(index.search_by_name("quagga", 20))] == ["m05.md", "Heading 5"]


@pytest.mark.parametrize("query", ["ab", "", "   ", "abc d", "y" * 65])
def test_what_lists_cannot_answer(query):
    assert names.asked(query) is None


def test_lists_of_empty_and_null(spark):
    df = spark.createDataFrame([(0, 0, None, None), (0, 1, "", ""), (0, 2, "ab", None), (0, 3, None, "ABCD")], "at int, pos long, name string, content string")
    got = {r.token: r.places for r in names.lists(df).collect()}
    assert got == {"^": [1], "^ab": [2], "abc": [3], "bcd": [3]}
    assert names.lists(df.limit(0)).count() == 0
    long = spark.range(1).select(F.lit(0).alias("at"), F.col("id").alias("pos"), F.lit("n").alias("name"), F.expr("repeat('abcdefghij', 100000)").alias("content"))
    assert names.lists(long).count() == 11


def test_lists_are_made_by_blocks(spark, monkeypatch):
    given = [(k % 3, k // 3, name, content) for k, (_, name, content) in enumerate(items(90))]
    df = spark.createDataFrame(given, "at int, pos long, name string, content string")
    want = set()
    for at, pos, name, content in given:
        low = [(x or "").lower() for x in (name, content)]
        want |= {(at, t[i : i + 3], pos) for t in low for i in range(len(t) - 2)} | ({(at, "^" + low[0][:8], pos)} if name is not None else set())
    got = names.lists(df)
    assert "Generate" not in got._jdf.queryExecution().toString()  # no row for each place of a token
    assert {(r.at, r.token, p) for r in got.collect() for p in r.places} == want
    parts = {}
    monkeypatch.setattr(names, "BLOCK", 100)
    for b in names._lists(df.select("at", "pos", names.start(F.col("name")).alias("start"), F.lower(F.coalesce("name", F.lit(""))).alias("name"), F.lower(F.coalesce("content", F.lit(""))).alias("content")).orderBy("at", "pos").toArrow().to_batches()):
        for r in b.to_pylist():
            parts.setdefault((r["at"], r["token"]), []).append(r["places"])
    assert {(*k, p) for k, v in parts.items() for places in v for p in places} == want and max(map(len, parts.values())) > 2
