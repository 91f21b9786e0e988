"""Call graphs and summaries of parsed files: texts are read and written as few times as can be, and results are those of plain code."""

import random

from loomspark.operators import callgraph, connectors, summaries
from loomspark.operators.containment import mentioned
from loomspark.scratch import Scratch
from loomspark.sources import code


def test_names_are_looked_for_in_words(spark):
    """What `mentioned` gives is what the texts say, however few common words and bits are known; repeated rows stay."""
    r = random.Random(11)
    bits = ["get", "get1_", "xget1_y", "$a", "abc", "ab", "a", "é", "éabc", "a b", "zzz", "\u0000", "99", "\n", "-", "𝔸abc𝔸"]
    rows = [(i % 40, "".join(r.choice(bits) + r.choice(("", " ", ".")) for _ in range(r.randint(0, 12)))) for i in range(60)] + [(7, None), (8, "")] + [(9, "get1_ get get1_")] * 2
    names = ["get1_", "get", "abc", "ab", "a", "$a", "a b", "éabc", "nowhere", "t1_", "", None, "get", "99\n"]
    df, wanted = spark.createDataFrame(rows, "i int, text string"), spark.createDataFrame([(n,) for n in names], "name string")
    want = sorted((i, n) for i, t in rows for n in {n for n in names if n} if t is not None and n in t)
    for sizes in ({}, {"common": 0, "slots": 32}, {"common": 2, "held": 0}):
        got = mentioned(df, wanted, "text", "name", **sizes)
        assert got.columns == ["i", "name"] and sorted(tuple(x) for x in got.collect()) == want
    some = wanted.where("name IN ('get1_', 'abc')")
    got = mentioned(df, some, "text", "name", held=0)
    assert sorted(tuple(x) for x in got.collect()) == [w for w in want if w[1] in ("get1_", "abc")]
    assert "text" not in "".join(x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x)
    for none in (wanted.where("name = ''"), wanted.where("name = 'nowhere'")):
        assert mentioned(df, none, "text", "name").collect() == [] == mentioned(df.limit(0), wanted, "text", "name").collect()


def test_only_wanted_kinds_leave_the_parser():
    text = "class A { run_() { return g_(`" + "x " * 99 + "`); } }\nfunction g_(x) { return 'type y'; }\nconst z = 1\n" + "// " + "c" * 200 + "\n" + "type T = 'class B { }'; enum E { A }\n"
    for ext in ("ts", "js"):
        every = code.parse(f"a.{ext}", text)
        assert {c["kind"] for c in every} >= {"class", "method", "function"} and len(every) == (6 if ext == "ts" else 3)
        assert code.parse(f"a.{ext}", text, frozenset(callgraph.KINDS)) == [c for c in every if c["kind"] in callgraph.KINDS]


def test_words_after_long_strings_are_found():
    """Long insides of strings and comments are gone around, and what stands right behind them is not."""
    for n in (0, 1, 63, 64, 65, 500):
        x = "class no {" * n
        found = code.parse("a.rs", f'fn a() {{ "{x}" }}/*{x}*/fn b() {{ b"{x}"; }} // {x}\nconst C: &str = r#"{x}"#; impl D {{ fn e() {{}} }}')
        assert [(c["name"], c["kind"]) for c in found] == [("a", "function"), ("b", "function"), ("C", "constant"), ("D", "impl"), ("e", "method")]
        found = code.parse("a.ts", f"function a() {{ return `{x}`; }}/*{x}*/function b() {{}}\nclass C {{ d(){{ return '{x}'+f('{x}') }} /*{x}*/e(){{}} }}")
        assert [c["name"] for c in found] == ["a", "b", "C", "d", "e"]


def tables(monkeypatch):
    """The names and columns of tables as they are written."""
    written, cut = [], Scratch.cut

    def kept(self, df, name, by=None):
        written.append((name, df.columns))
        return cut(self, df, name, by)

    monkeypatch.setattr(Scratch, "cut", kept)
    return written


def test_names_alone_are_not_numbered(spark, monkeypatch):
    """Of many functions few call; only those and what they call go over rounds, and levels close up all the same."""
    numbered, was = [], Scratch.numbered
    monkeypatch.setattr(Scratch, "numbered", lambda self, df, *a, **k: numbered.append(df.count()) or was(self, df, *a, **k))
    names = [f"f{i}" for i in range(50)]
    v = spark.createDataFrame([(n,) for n in [*names, *names, ""]] + [(None,)], "name string")
    edges = lambda pairs: spark.createDataFrame(pairs, "caller string, callee string")
    levels = lambda v, pairs: {r.name: r.level for r in callgraph.levels(v, edges(pairs)).collect()}
    flat = {n: 0 for n in [*names, "", None]}
    assert levels(v, [("f3", "f4"), ("f4", "f5"), ("f3", "gone"), ("gone", "f1"), ("f3", "f4")]) == flat | {"f3": 2, "f4": 1}
    assert numbered == [4]  # f1 is called by none of them, but named
    assert levels(v, [("f1", "f1")]) == flat | {"f1": 1}  # above the names that call nothing
    one = v.where("name = 'f1'")
    assert levels(one, [("f1", "f1")]) == {"f1": 0} and levels(one, []) == {"f1": 0}


ROWS = [(1, "leaf_", "fn leaf_() {}"), (2, "mid_", "fn mid_() { leaf_() }"), (3, "top_", "fn top_() { mid_() leaf_() }"), (4, "leaf_", "fn leaf_() { last }"), (5, "alone_", "fn alone_() {}")]


def chunks(spark, rows):
    return spark.createDataFrame([(i, "code", "function", n, c) for i, n, c in rows], "chunk_id long, chunk_type string, kind string, name string, content string")


def test_bodies_are_written_once_beside_the_functions(spark, monkeypatch):
    written = tables(monkeypatch)
    cache, stats = summaries.generate_functions(chunks(spark, ROWS), spark.createDataFrame([], summaries.SCHEMA), connectors.FirstSentence())
    assert stats == {"total_functions": 4, "levels": 4, "cached": 0, "generated": 4}
    assert {r.key: r.summary for r in cache.collect()} == {"leaf_": "fn leaf_() { last }", "mid_": "fn mid_() { leaf_() }", "top_": "fn top_() { mid_() leaf_() }", "alone_": "fn alone_() {}"}
    assert [name for name, columns in written if "body" in columns] == ["bodies"]
    assert [name for name, columns in written if "summary" in columns] == [f"told/level={k}/new=1" for k in range(4)]  # the second leaf_ is another function of that name


def test_a_cache_is_read_and_kept(spark):
    say = connectors.FirstSentence()
    cache, _ = summaries.generate_functions(chunks(spark, ROWS), spark.createDataFrame([], summaries.SCHEMA), say)
    cache = cache.unionByName(spark.createDataFrame([("gone_", "b", "c", "old")], summaries.SCHEMA))
    again, stats = summaries.generate_functions(chunks(spark, ROWS), cache, say)
    assert stats == {"total_functions": 4, "levels": 4, "cached": 4, "generated": 0} and sorted(again.collect()) == sorted(cache.collect())
    changed = [r if r[1] != "mid_" else (2, "mid_", "fn mid_() { new leaf_() }") for r in ROWS]
    after, stats = summaries.generate_functions(chunks(spark, changed), cache, say)
    assert stats["cached"] == 2 and stats["generated"] == 2  # itself and what calls it
    assert {r.key: r.summary for r in after.collect()} == {r.key: r.summary for r in cache.collect()} | {"mid_": "fn mid_() { new leaf_() }"}
    same, stats = summaries.generate_functions(chunks(spark, []), cache, say)
    assert stats == {"total_functions": 0, "levels": 0, "cached": 0, "generated": 0} and sorted(same.collect()) == sorted(cache.collect())
