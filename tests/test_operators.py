import io
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from loomspark import cli
from loomspark.operators import callgraph, connectors, containment, hierarchy, search, summaries
from loomspark.operators.index import Index
from loomspark.plans import render, samples
from loomspark.sources import code, schemas
from loomspark.streaming import refresh


def chunk(i, name, kind="function", file="src/a.rs", content="", context=None, chunk_type="code", signature=None, doc=None, visibility="public"):
    return (i, chunk_type, name, kind, file, i, i + 1, i + 2, 0, 0, content, context, signature, doc, visibility)


def frame(spark, rows):
    return spark.createDataFrame(rows, schemas.CHUNKS)


# --- search ---


def test_name_scores_and_ties(spark):
    df = frame(spark, [chunk(5, "parse"), chunk(2, "parse"), chunk(3, "Parse_File", content="parse file"), chunk(4, "", content="x"), chunk(6, "pa", chunk_type="doc"), chunk(7, "zzz")])
    got = [(r.chunk_id, r.score, r.unique) for r in search.search_by_name(df, "parse", 10).orderBy("rank").collect()]
    assert got == [(2, 1.3, False), (5, 1.3, False), (3, 1.2, True), (4, 0.6, True), (6, 0.6, True)]
    assert search.search_by_name(df, "parse parse", 1).first().score == 0.6 + 0.6  # repeated words count again
    assert [r.chunk_id for r in search.search_by_name(df, "parse", 10, "DOCS").collect()] == [6]
    assert search.search_by_name(df, "parse", 0).count() == 0


def test_dispatch(spark):
    df = frame(spark, [chunk(1, "a", content="x"), chunk(2, "b", content="y")])
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8])], schemas.EMBEDDINGS)
    found, why = search.search(df, "  ", embeddings=vec)
    assert found.count() == 0 and why == search.NO_QUERY
    calls = []
    embed = lambda q: calls.append(q) or [0.0, 1.0]
    for _ in range(2):
        found, why = search.search(df, "anything", 5, None, vec, embed)
        assert [(r.chunk_id, round(r.score, 6)) for r in found.orderBy("rank").collect()] == [(2, 0.8), (1, 0.0)] and why is None
    assert calls == ["anything"]
    found, why = search.search(df, "a", 5, None, vec.limit(1), embed)
    assert "1 chunks pending" in why and found.first().chunk_id == 1
    assert [r.score for r in search.search_semantic(df, vec, [1.0, 2.0, 3.0]).collect()] == [0.0, 0.0]
    assert search.search_semantic(df, vec, []).count() == 0


def test_filters():
    assert [search.chosen_type(x) for x in (None, "code", "CODE", "doc", "Docs")] == [None, "code", "code", "doc", "doc"]
    with pytest.raises(ValueError):
        search.chosen_type("other")
    assert [search.type_of_flags(*x) for x in ((0, 0), (1, 1), (1, 0), (0, 1))] == [None, None, "code", "doc"]


def test_lookup(spark):
    df = frame(spark, [chunk(1, "new", context="A"), chunk(2, "new", context="B"), chunk(3, "one"), chunk(4, "md", context="README")])
    assert search.lookup_output(df, "none")["suggestion"] == search.NOT_FOUND
    one = search.lookup_output(df, "one")
    assert (one["match_type"], one["confidence"], len(one["definitions"])) == ("exact", "high", 1)
    many = search.lookup_output(df, "new")
    assert many["confidence"] == "low" and many["suggestion"].startswith("2 homonyms") and [d["context"] for d in many["definitions"]] == ["A", "B"]
    assert search.lookup(df, "B.new").first().chunk_id == 2 and search.lookup(df, "README.md").first().chunk_id == 4
    assert search.lookup(df, "b.new").count() == 0 and search.lookup_fuzzy(df, "b.NE").first().candidate == "B.new"


def test_dependencies(spark):
    df = frame(spark, [chunk(1, "a", content="fn a() {\n  b(1);\n c (2)\n}"), chunk(2, "b", content="fn b() { x }", file="src/b.rs"), chunk(3, "t", content="uses b here", chunk_type="doc")])
    got = {(r.direction, r.name, r.line) for r in search.dependencies(df, "b").collect()}
    assert got == {("called_by", "a", 2), ("called_by", "t", 4)}
    assert {(r.name, r.line) for r in search.dependencies(df, "a", "calls").collect()} == {("b", 3), ("c", 4)}
    assert [r.name for r in search.outline(df, "src/b.rs").collect()] == ["b"]


# --- hierarchy and maps ---


def plain_collapse(dirs):
    """The tree as nested nodes, merged from the top."""
    nodes = {}
    for d, f, s in dirs:
        parts = d.split("/")
        for i in range(1, len(parts) + 1):
            n = nodes.setdefault("/".join(parts[:i]), [0, 0])
            n[0] += f
            n[1] += s
    kids = {n: sorted(k for k in nodes if k.rpartition("/")[0] == n and "/" in k) for n in nodes}
    out = []

    def walk(n, depth):
        label, end = n.rpartition("/")[2], n
        while len(kids[end]) == 1 and nodes[kids[end][0]][0] >= nodes[end][0]:
            end = kids[end][0]
            label += "/" + end.rpartition("/")[2]
        out.append((n, label, depth, *nodes[n]))
        for k in kids[end]:
            walk(k, depth + 1)

    for n in sorted(nodes):
        if "/" not in n:
            walk(n, 0)
    return sorted(out)


def test_collapse_on_random_trees(spark):
    rnd = random.Random(1)
    for _ in range(6):
        paths = {"/".join(rnd.choice("abc") for _ in range(rnd.randint(1, 6))) for _ in range(rnd.randint(1, 12))}
        dirs = [(p, rnd.randint(1, 3), rnd.randint(1, 9)) for p in paths]
        tree = hierarchy.rollup(spark.createDataFrame(dirs, "dir string, n_files long, n_symbols long"))
        got = [(r.node, r.label, r.shown_depth, r.n_files, r.n_symbols) for r in hierarchy.collapsed(tree).collect()]
        assert sorted(got) == plain_collapse(dirs)


def sample_chunks(spark):
    return code.definitions(samples.frame(spark)).withColumn("chunk_id", F.lit(0).cast("long"))


def text(df):
    return [r.line for r in df.collect()]


def test_flat_maps(spark):
    m = render.Map(sample_chunks(spark), "demo", dir_summaries=spark.createDataFrame([("src", "the source")], "dir string, summary string"))
    assert text(m.flat(0)) == ["// Project: demo (Rust, 28 symbols)", "//", "// src/  — 4 files, 24 symbols (the source)", "// tools/  — 1 files, 4 symbols"]
    assert text(m.flat(1))[3:] == [
        "//   Shop.cs  — 5 (Basket, Price, Value)", "//   app.ts  — 8 (Store, Id, Props, Mode, Button, greet, Button)", "//   old.js  — 3 (Old, helper)",
        "//   shapes.rs  — 8 (Figure, Draw, Side, main, LIMIT)", "// tools/  — 1 files, 4 symbols", "//   stats.py  — 4 (Mean, _hidden, helper)",
    ]
    deep = text(m.flat(3))
    at = deep.index("//   shapes.rs  (8 symbols)")
    assert deep[at + 1 : at + 9] == [
        "//     struct Figure — A flat figure.", "//       (priv) fn area", "//       fn named — Makes one.", "//     pub trait Draw { fn draw(&self); }".replace("pub ", ""), "//       (priv) fn draw",
        "//     (priv) enum Side { Left, Right }", "//     (priv) " + 'fn main() { let f = Figure::named("x"); f.area(); }', "//     (priv) const LIMIT: usize = 8",
    ]
    assert "//     fn greet — Greets." in deep


def test_budgets(spark):
    m = render.Map(sample_chunks(spark), "demo")
    costs = m.costs()
    assert costs["t0"] < costs["t1"] < costs["t2"] < costs["t3"]
    assert hierarchy.auto_depth(costs, 10_000) == 3 and hierarchy.auto_depth(costs, 30) == 0 and hierarchy.auto_depth(costs, costs["t2"]) == 2
    assert len(text(m.render(30))) == 4  # the tree: its header and two directories
    many = frame(spark, [chunk(i, f"s{i}", file=f"base/x/d{i % 120}/e/f{i}.rs") for i in range(400)])
    lines = text(render.Map(many, "big").tree(500))
    assert lines[2].startswith("// base/x/  — 400 files") and sum(len((x + "\n").encode()) for x in lines) / 4 <= 550


def test_areas(spark):
    m = render.Map(sample_chunks(spark), "demo")
    assert [m.zoom(a) for a in ("src/", "src/app.ts", "none", "src/none.rs")] == ["directory", "file", "project", "project"]
    area = text(m.area("tools"))
    assert area[0].endswith("[area: tools]") and "//     class Mean — Keeps a mean." in area and "// --- other directories (top by size) ---" in area
    assert area[-1] == "// Suggested: tools/stats.py (4 symbols)"
    one = text(m.area("src/old.js"))
    assert one[2:4] == ["// src/", "//   old.js  (3 symbols)"] and one[-1].startswith("// [zoom: file]")
    assert "// Area 'nope' not found in index" in text(m.area("nope"))


# --- call graph, summaries ---


def graph(spark, edges, extra=()):
    names = sorted({x for e in edges for x in e} | set(extra))
    v, e = spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(edges, "caller string, callee string")
    return {r.name: r.level for r in callgraph.levels(v, e).collect()}


def test_levels(spark):
    assert graph(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], ["x"]) == {"d": 0, "x": 0, "b": 1, "c": 1, "a": 2}
    cyclic = graph(spark, [("a", "b"), ("b", "a"), ("t", "a"), ("b", "leaf")])
    assert cyclic["leaf"] == 0 and sorted(cyclic.values()) == [0, 1, 2, 3]
    assert graph(spark, [("s", "s")]) == {"s": 0}  # levels close up


def test_levels_by_rounds(spark):
    assert graph(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("a", "d")], ["x"]) == {"d": 0, "x": 0, "b": 1, "c": 1, "a": 2}
    assert graph(spark, [("a", "b"), ("b", "a"), ("t", "a"), ("b", "leaf")]) == {"leaf": 0, "b": 1, "a": 2, "t": 3}


def test_edges_are_substrings(spark):
    df = frame(spark, [chunk(1, "get", content="fn get() { }"), chunk(2, "get_name", content="fn get_name() { get() }"), chunk(3, "get", content="other get"), chunk(4, "", content="get_name")])
    got = {(r.caller, r.callee): r.n for r in callgraph.edges(df).collect()}
    assert got == {("get", "get"): 2, ("get_name", "get"): 2, ("", "get"): 2, ("", "get_name"): 1}
    held = containment.contained(df.select("chunk_id", "content"), df, "content", "name")
    assert {(r.chunk_id, r.name) for r in held.collect()} == {(1, "get"), (2, "get"), (2, "get_name"), (3, "get"), (4, "get"), (4, "get_name")}
    assert {(r.caller, r.callee) for r in callgraph.token_edges(df).collect()} == {("get_name", "get"), ("", "get_name")}


def test_function_summaries_are_cached(spark):
    df = frame(spark, [chunk(1, "leaf_", content="fn leaf_() {}"), chunk(2, "top_", content="fn top_() { leaf_() }")])
    none = spark.createDataFrame([], summaries.SCHEMA)
    cache, stats = summaries.generate_functions(df, none, connectors.FirstSentence())
    assert stats == {"total_functions": 2, "levels": 2, "cached": 0, "generated": 2} and cache.count() == 2
    assert summaries.generate_functions(df, cache, connectors.FirstSentence())[1]["cached"] == 2
    changed = frame(spark, [chunk(1, "leaf_", content="fn leaf_() { new }"), chunk(2, "top_", content="fn top_() { leaf_() }")])
    assert summaries.generate_functions(changed, cache, connectors.FirstSentence())[1]["generated"] == 2  # the caller's context changed
    assert summaries.dry_run(df)["api_calls"] == 1


def test_entries_are_asked_for_once(spark):
    s = hierarchy.symbols(sample_chunks(spark))
    wanted = summaries.wanted_entries(s)
    cache = summaries.generate(wanted, spark.createDataFrame([], summaries.SCHEMA), connectors.FirstSentence())
    assert cache.count() == 7 and summaries.misses(wanted, cache).count() == 0
    assert summaries.in_area(wanted, "tools").count() == 2
    assert {r.key for r in summaries.wanted_trees(s).collect()} == {"tree::src", "tree::tools"}
    assert max(r.n for r in summaries.batched(wanted, "key", 2).groupBy("batch").agg(F.count("*").alias("n")).collect()) <= 2


def test_connectors():
    e = connectors.HashEmbedder(32)
    assert e(["a b", "a b"])[0] == e.one("a b") and abs(sum(x * x for x in e.one("some words")) - 1) < 1e-9 and e.one("") == [0.0] * 32
    send = lambda part: [(i, [float(len(t))]) for i, t in reversed(list(enumerate(part)))]
    assert connectors.in_requests(["a", "bb", "ccc"], send, 2) == [[1.0], [2.0], [3.0]]
    with pytest.raises(ValueError):
        connectors.in_requests(["a", "b"], lambda p: [(0, [1.0])])
    waits, tries = [], []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("429")
        return "done"

    assert connectors.with_retries(call, lambda e: "429" in str(e), sleep=waits.append) == "done" and waits == [1.0, 2.0]
    assert [connectors.concurrency(*x) for x in ((500, 200_000), (3500, 2_000_000), (10_000, 10_000_000))] == [5, 25, 50]
    assert [connectors.batch_size(c) for c in (5, 50, 200)] == [500, 1000, 2000]
    assert connectors.parse_reply('x ```[{"name": "a", "summary": "b"}]``` y') == [("a", "b")]
    assert "1. f (1 lines)\nCalls:\n  - g: does\nfn f" in connectors.function_prompt([{"name": "f", "body": "fn f", "calls": {"g": "does"}}])
    assert "1. [file] a/b: x, y" in connectors.entry_prompt([{"kind": "file", "path": "a/b", "symbols": ["x", "y"]}])


# --- index ---


def write(root, files):
    for path, content in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(content)


def dump(index):
    return sorted(map(tuple, index.chunks.collect()))


def test_refresh(spark, tmp_path):
    root = tmp_path / "tree"
    write(root, samples.FILES)
    index = Index(spark, str(tmp_path / "index"))
    first = index.refresh(str(root))
    assert first.added == len(samples.FILES) and first.pending == index.chunks.count() > 0
    again = index.refresh(str(root))
    assert not again.any and again.pending == first.pending
    assert [r.chunk_id for r in index.chunks.orderBy("file", "seq").collect()] == list(range(first.pending))
    assert index.embed(connectors.HashEmbedder(8), 3) == first.pending and index.pending() == 0 and index.embed(connectors.HashEmbedder(8)) == 0
    with pytest.raises(ValueError):
        index.embed(connectors.HashEmbedder(8), 0)
    time.sleep(1.1)
    write(root, {"src/shapes.rs": "fn only() {}", "new.md": "# New\n", "docs/set.toml": samples.FILES["docs/set.toml"]})
    (root / "src/old.js").unlink()
    changes = index.refresh(str(root))
    assert (changes.added, changes.updated, changes.removed) == (1, 1, 1)  # a touched file is no change
    assert changes.pending == 3 and index.embeddings.count() == index.chunks.count() - 3
    assert not index.refresh(str(root)).any
    rebuilt = Index(spark, str(tmp_path / "other"))
    rebuilt.refresh(str(root))
    assert dump(rebuilt) == dump(index)
    index.reindex(str(root))
    assert dump(rebuilt) == dump(index) and index.pending() == index.chunks.count()
    assert index.status()["n_errors"] == 0


def test_embedding_goes_on_after_a_failure(spark, tmp_path, monkeypatch):
    class Failing(connectors.HashEmbedder):
        """Works for some calls, then fails, as a service may."""

        def __init__(self, left):
            super().__init__(8)
            self.left = left

        def one(self, text):
            if "Two" in text and self.left:
                raise RuntimeError("no service")
            return super().one(text)

    root = tmp_path / "tree"
    write(root, samples.FILES)
    index = Index(spark, str(tmp_path / "index"))
    n = index.refresh(str(root)).pending
    monkeypatch.setattr("loomspark.operators.index.EMBED_ROUND", 5)
    with pytest.raises(Exception, match="no service"):
        index.embed(Failing(True))
    left = index.pending()
    assert 0 < left <= n
    assert index.embed(Failing(False)) == left and index.pending() == 0 and index.embeddings.count() == n
    kept = set((tmp_path / "index").glob("v=*/chunks"))
    index.save(chunks=index.chunks.limit(0))
    index.save(chunks=index.chunks.limit(0))
    assert kept - set((tmp_path / "index").glob("v=*/*"))  # what no reader needs any more is gone
    assert index.table("vectors").count() == n


def test_lock_and_dirty(spark, tmp_path):
    index = Index(spark, str(tmp_path))
    (tmp_path / "tree").mkdir()
    assert index.acquire() and not index.acquire() and index.holder()
    assert index.try_refresh(str(tmp_path / "tree")) is None and (tmp_path / "dirty").exists()
    index.release()
    assert index.clear_dirty() and not index.clear_dirty()
    (tmp_path / "lock").write_text("999999999")
    assert index.holder() is None and not (tmp_path / "lock").exists()
    (tmp_path / "_CURRENT").write_text(json.dumps({"version": 99, "table": 1}))
    assert index.chunks.count() == 0


def test_stream(spark, tmp_path):
    root = tmp_path / "tree"
    write(root, {"a.md": "# A\n"})
    index = Index(spark, str(tmp_path / "index"))
    for n, files in enumerate(({}, {"b.md": "# B\n"})):
        write(root, files)
        q = refresh.watch(spark, str(root), index, str(tmp_path / "checkpoint"))
        q.awaitTermination(120)
        assert q.exception() is None and index.files.count() == n + 1


def test_command_line(spark, tmp_path, monkeypatch):
    root = tmp_path / "tree"
    write(root, {k: samples.FILES[k] for k in ("src/shapes.rs", "docs/guide.md")})

    def run(*args):
        out = io.StringIO()
        assert cli.main(["--root", str(root), "--index", str(tmp_path / "index"), *args], out) == 0
        return out.getvalue()

    assert json.loads(run("lookup", "Figure.named"))["confidence"] == "high"
    assert json.loads(run("search", "named", "--top", "1"))["results"][0]["name"] == "named"
    assert run("map").splitlines()[0].startswith("// Project: tree (Rust")
    assert json.loads(run("embed", "--dim", "16"))["pending"] == 0
    assert json.loads(run("search", "a flat figure"))["suggestion"] is None
    assert json.loads(run("status"))["n_code"] > 0
    assert json.loads(run("summarize", "--dry-run"))["total_functions"] == 4
    assert json.loads(run("summarize"))["generated"] == 4 and "(Figure, Draw, Side, main, LIMIT)" in run("map")
    write(root, {"src/more.rs": "fn more() {}"})
    started = []
    monkeypatch.setattr(cli.subprocess, "Popen", lambda args, **how: started.append((args, how["start_new_session"])))
    assert json.loads(run("refresh", "--background-embed"))["pending"] == 1 and started[0][0][-1] == "embed" and started[0][1]
    run("refresh", "--background-embed")
    assert len(started) == 2  # as long as vectors are missing
    assert json.loads(run("deps", "main", "--direction", "calls"))


def test_tree_hashes_are_equal_where_the_trees_are(spark):
    def hashes(dirs):
        rows = hierarchy.tree_hashes(spark.createDataFrame(dirs, "dir string, n_symbols long")).collect()
        assert len({r.node for r in rows}) == len(rows)
        return {r.node: r.body_hash for r in rows}

    here = hashes([("a/x/q", 2), ("a/x", 1), ("a/y/q/r", 2), ("b/x/q", 2), ("b/x", 1), ("b/y/q/r", 2), ("c", 5), (None, 4)])
    assert set(here) == {"a", "a/x", "a/x/q", "a/y", "a/y/q", "a/y/q/r", "b", "b/x", "b/x/q", "b/y", "b/y/q", "b/y/q/r", "c"}
    assert here["a"] == here["b"] and here["a/x"] == here["b/x"] and here["a/x"] != here["a/y"] and here["a/y"] != here["a/y/q"]
    for other in ([("a/x/q", 3), ("a/x", 1), ("a/y/q/r", 2)], [("a/x/q", 2), ("a/y/q/r", 2)], [("a/x/q", 2), ("a/x", 1), ("a/y/q/s", 2)], [("a/x/q", 2), ("a/x", 1), ("a/y/q/r", 2), ("a", 0)]):
        assert hashes(other)["a"] != here["a"]
    assert hashes([]) == {}
    deep = "/".join("d" * 12)
    assert len(hashes([(deep, 1), ("", 2)])) == 13
