import json

import pytest

from loomspark.functions import scalars as S
from loomspark.plans import samples
from loomspark.sources import code, docs, scan
from pyspark.sql import functions as F


def lines(text):
    out = text.split("\n")
    return [x.removesuffix("\r") for x in (out[:-1] if out[-1] == "" else out)]


def sections(spark, **files):
    df = spark.createDataFrame([(k.replace("__", "."), v) for k, v in files.items()], "path string, text string")
    return sorted(((r.file, r.seq, r.name, r.kind, r.line_start, r.line_end, r.content) for r in docs.sections(df).collect()))


def test_markdown(spark):
    text = "pre\n# One\nx\n```\n# no\n```\n## Two ##\n#tag\n#\nend"
    got = sections(spark, a__md=text)
    assert [g[2:6] for g in got] == [("a.md", "document", 1, 10), ("One", "section", 2, 6), ("Two ##", "section", 7, 7), ("tag", "section", 8, 8), ("Untitled Section", "section", 9, 10)]
    assert got[1][6] == "# One\nx\n```\n# no\n```" and got[4][6] == "#\nend"
    assert sections(spark, b__md="# a\n~~~\n# hidden") == [("b.md", 0, "b.md", "document", 1, 3, "# a\n~~~\n# hidden"), ("b.md", 1, "a", "section", 1, 3, "# a\n~~~\n# hidden")]
    assert [g[3] for g in sections(spark, c__md="")] == ["document"]


def test_markdown_bytes(spark):
    text = "é\n# Ü\nx\n# b\nlast"
    rows = docs.sections(spark.createDataFrame([("a.md", text)], "path string, text string")).orderBy("seq").collect()
    raw = text.encode()
    assert [raw[r.byte_start : r.byte_end].decode().rstrip("\n") for r in rows] == [r.content for r in rows]


def test_yaml_and_toml(spark):
    assert [g[2:] for g in sections(spark, a__yaml="# c\nname: x\nlist:\n  - a\n---\nlast: 1\n")] == [("name", "section", 1, 2, "# c\nname: x"), ("list", "section", 3, 5, "list:\n  - a\n---"), ("last", "section", 6, 6, "last: 1")]
    assert [g[2:5] for g in sections(spark, a__toml="x = 1\n[tool.a]\ny = 2\n[[bin]]\nz = 3\n[[bin]]\n")] == [("root", "section", 1), ("tool.a", "section", 2), ("bin", "section", 4), ("bin", "section", 6)]
    assert [g[2:4] + g[6:] for g in sections(spark, a__toml="\n[t]\nx = [\n  [1],\n]\n")] == [("root", "section", ""), ("t", "section", "[t]\nx = ["), ("1],", "section", "[1],\n]")]
    assert [g[3] for g in sections(spark, a__yaml="", b__toml="", c__json="", d__yml="  - x\n")] == ["document"] * 4


def test_json(spark):
    got = sections(spark, a__json=samples.FILES["docs/data.json"], b__json="[1]", c__json="{}", d__json="{bad")
    assert got[0][2:] == ("a", "section", 1, 2, "a:\nnull")
    assert got[1][2] == "b" and json.loads(got[1][6].split(":\n", 1)[1]) == {"x": [1, "é"], "y": 1}
    assert [g[3] for g in got[2:]] == ["document"] * 3


@pytest.mark.parametrize("n", [0, 3, 500, 501, 900, 901, 1000, 4321])
def test_windows(spark, n):
    text = "".join(chr(0xAC00 + i % 50) if i % 7 else "\n" for i in range(1, n + 1))
    got = sections(spark, a__txt=text)
    want = [text] if n <= 500 else [text[i : i + 500] for i in range(0, n - 100, 400) if i == 0 or i + 100 < n]
    assert [g[6] for g in got] == want
    if n > 500:
        assert [g[4] for g in got] == [len(lines(text[: 400 * i])) + 1 for i in range(len(want))]
        assert [g[2] for g in got] == [f"a.txt (part {k + 1})" for k in range(len(want))]


def found(path, text):
    return [(c["name"], c["kind"], c["context"], c["visibility"], c["doc_summary"]) for c in code.parse(path, text)]


def test_rust():
    assert found("a.rs", samples.FILES["src/shapes.rs"]) == [
        ("Figure", "struct", None, "public", "A flat figure."), ("Figure", "impl", None, "private", None), ("named", "method", "Figure", "public", "Makes one."),
        ("area", "method", "Figure", "private", None), ("Draw", "interface", None, "public", None), ("draw", "method", "Draw", "private", None),
        ("LIMIT", "constant", None, "private", None), ("Side", "enum", None, "private", None), ("main", "function", None, "private", None),
    ]


def test_masks_hide_definitions():
    assert found("a.rs", 'fn a() { let x = r#"fn b() {"#; /* fn c() { /* } */ */ let l: &\'static str = "}"; }\n// fn d() {}\n') == [("a", "function", None, "private", None)]
    assert [x[0] for x in found("a.js", "function a() { return `${ {x: 1} } function b() {}` }\n// function c() {}\nfunction d() { return /[}\"]/.test(x) }")] == ["a", "d"]
    assert [x[0] for x in found("a.cs", 'class A { string S = @"class B { ""}"; }')] == ["A"]


def test_typescript():
    assert found("a.ts", samples.FILES["src/app.ts"]) == [
        ("greet", "function", None, "public", "Greets."), ("Button", "function", None, "public", None), ("Button", "constant", None, "public", None), ("Store", "class", None, "private", None),
        ("load", "method", "Store", "private", None), ("Props", "interface", None, "private", None), ("Id", "interface", None, "private", None), ("Mode", "enum", None, "private", None),
    ]
    assert [x[:3] for x in found("a.js", samples.FILES["src/old.js"])] == [("Old", "class", None), ("run", "method", "Old"), ("helper", "function", None)]


def test_csharp_and_python():
    assert found("a.cs", samples.FILES["src/Shop.cs"]) == [
        ("Basket", "class", None, "public", "A basket of goods."), ("Count", "field", "Basket", "public", None), ("Add", "method", "Basket", "public", None),
        ("Price", "struct", None, "public", None), ("Value", "field", None, "public", None),
    ]
    assert found("a.py", samples.FILES["tools/stats.py"]) == [
        ("Mean", "class", None, "public", "Keeps a mean."), ("add", "method", "Mean", "public", None), ("helper", "function", None, "public", None), ("_hidden", "function", None, "private", None),
    ]
    assert found("a.PY", "def f(): pass") == [] and found("a.xyz", "def f(): pass") == [] and found("a.py", "def (") == []


def test_spans_and_signatures():
    text = "// ü\nfn long(\n    a: u8,\n) -> u8 {\n    a\n}\n"
    (c,) = code.parse("a.rs", text)
    assert (c["line_start"], c["line_end"]) == (2, 6) and c["signature"] == "fn long( a: u8, ) -> u8 {"
    assert text.encode()[c["byte_start"] : c["byte_end"]].decode() == c["content"]


def test_scan(spark, tmp_path):
    for path, size in {"a/x.rs": 3, "a/b/y.md": 4, "z.PY": 2, "node_modules/n.js": 2, "a/target/t.rs": 1, "big.txt": scan.MAX_BYTES, "over.txt": scan.MAX_BYTES + 1, "no.bin": 1, "a b+c.txt": 5}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(b"x" * size)
    (tmp_path / "bad.rs").write_bytes(b"\xff\xfe")
    got = {r.path: r for r in scan.texts(scan.scan(spark, str(tmp_path))).collect()}
    assert {p: r.chunk_type for p, r in got.items()} == {"a/x.rs": "code", "a/b/y.md": "doc", "z.PY": "code", "big.txt": "doc", "a b+c.txt": "doc", "bad.rs": "code"}
    assert got["bad.rs"].error and got["bad.rs"].text is None and got["a/x.rs"].text == "xxx"


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(S.preview(F.lit("a\nb\nc\nd\ne\nf\n"))) == "a\nb\nc\nd\ne\n..." and one(S.preview(F.lit("a\r\nb"))) == "a\nb"
    assert one(S.short_signature(F.lit("pub pub async fn x() {"))) == "fn x()" and one(S.short_signature(F.lit("é" * 50), 20)) == "é" * 8 + "..."
    assert one(S.names_preview(F.array(F.lit("aaaa"), F.lit("bbbb"), F.lit("cc")), 10)) == "aaaa, bbbb, ..."
    vec = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert [one(S.cosine(a, b)) for a, b in ((vec(1, 0), vec(2, 0)), (vec(1, 0), vec(0, 1)), (vec(1, 0), vec(-1, 0)), (vec(1), vec(1, 2)), (vec(0, 0), vec(1, 1)), (vec(float("nan"), 1), vec(1, 1)))] == [1, 0, -1, 0, 0, 0]
    assert S.qualified("A.b.c") == ("A.b", "c") and S.qualified(".x") == (None, ".x") and S.qualified("README.") == (None, "README.")
    assert one(S.xml_summary(F.lit("x <summary> A <b>b</b>\n c </summary>"))) == "A b c" and one(S.xml_summary(F.lit("<a>"))) is None
    assert one(S.snippet(F.lit("a\n  the name here \n name"), "name")) == "the name here"


def test_scan_finds_hidden_and_empty_files(spark, tmp_path):
    wanted = {"pkg/__init__.py": b"", "pkg/_private/c.py": b"c = 1", ".github/workflows/ci.yml": b"on: push", "_x.md": b"# x", ".hidden.rs": b"", "a/b/c/d/e/f.txt": b"deep", "a%20b+c.md": b"x"}
    for path, content in (wanted | {".git/x.md": b"x", ".loom/v=1/x.md": b"x", "a/build/x.rs": b"x", "_x.bin": b"x"}).items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(content)
    (tmp_path / "link.md").symlink_to(tmp_path / "_x.md")
    (tmp_path / "dead.md").symlink_to(tmp_path / "nothing")
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        got = {r.path: bytes(r.content) for r in scan.scan(spark, root).collect()}
        assert got == wanted | {"link.md": b"# x"}
    assert scan.scan(spark, str(tmp_path / "a/b/c/d/e")).count() == 1


def test_scan_shares_out_many_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scan, "FOLDERS", 4)
    for i in range(40):
        (tmp_path / f"d{i % 7}/e{i}").mkdir(parents=True)
        (tmp_path / f"d{i % 7}/e{i}/_f.py").write_text(str(i))
    got = scan.scan(spark, str(tmp_path)).collect()
    assert sorted(int(r.content) for r in got) == list(range(40)) and {r.length for r in got} == {1, 2}


def test_python_lines_and_deep_expressions():
    (c,) = code.parse("a.py", "x = 1\n\x0c\ndef a():\n    s = '\u2028'\n    return s\n")
    assert (c["line_start"], c["line_end"]) == (3, 5) and c["content"].startswith("def a():")
    assert [x["name"] for x in code.parse("a.py", "a = 1\rdef b(): pass\r\ndef c(): pass")] == ["b", "c"]
    for deep in ("x = " + "1+" * 5000 + "1", "x = " + "-" * 5000 + "1", "x = " + "(" * 3000 + ")" * 3000):
        assert [c["name"] for c in code.parse("a.py", f"def first(): pass\n{deep}\ndef last():\n    return 1\n")] == ["first", "last"]


def test_python_with_a_syntax_error_keeps_its_definitions():
    text = 'class A(B):\n    """Says a."""\n    x = (1 +\n2)\n    def m(self,\n          y):\n        return "def no(): # (" + (\n\n    async def n(self): pass\n# def hidden():\ndef _p():\n    oops oops\n\nclass __Q__: pass\n'
    got = code.parse("a.py", text)
    assert [(c["name"], c["kind"], c["context"], c["visibility"], c["line_start"], c["line_end"], c["doc_summary"]) for c in got] == [
        ("A", "class", None, "public", 1, 9, "Says a."), ("m", "method", "A", "public", 5, 7, None), ("n", "method", "A", "public", 9, 9, None),
        ("_p", "function", None, "private", 11, 12, None), ("__Q__", "class", None, "public", 14, 14, None),
    ]


def test_sections_take_linear_time(spark):
    import time

    text = "\n".join("```" if i % 8 == 0 else f"# head {i}" for i in range(20_000))
    files = spark.createDataFrame([("a.md", text), ("b.yaml", "\n".join(f"k{i}: 1" for i in range(20_000))), ("c.toml", "[t]\n" * 20_000)], "path string, text string")
    docs.sections(files.where("path = 'x'")).collect()
    began = time.perf_counter()
    got = docs.sections(files).groupBy("file").count().collect()
    assert {r.file: r["count"] for r in got} == {"a.md": 1 + 8750, "b.yaml": 20_000, "c.toml": 20_000}
    assert time.perf_counter() - began < 30
