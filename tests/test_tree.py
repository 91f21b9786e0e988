import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import object_store

from loomspark.sources import scan, stores, tree

FILES = {
    "pkg/__init__.py": b"", "pkg/_private/c.py": b"c = 1", ".github/ci.yml": b"on: push", "_x.md": b"# x", "a/b/c/.hidden.RS": b"fn f() {}", "a b+c%20.txt": b"x", "ü/ö.md": "ü".encode(), "big.txt": b"x" * scan.MAX_BYTES,
}
UNWANTED = {"node_modules/a.js": b"x", "a/target/t.rs": b"x", ".git/x.md": b"x", ".loom/v=1/x.md": b"x", "over.txt": b"x" * (scan.MAX_BYTES + 1), "no.bin": b"x", ".rs": b"x", "name.": b"x"}


def test_another_scheme_keeps_hidden_names(spark):
    """An object store is no mounted tree: tasks list and read it by its client."""
    inside = {f"some/root/{path}": content for path, content in (FILES | UNWANTED).items()}
    with object_store.served("bucket", inside | {"some/other.md": b"x"}) as uri:
        root = uri.replace("bucket?", "bucket/some/root?")
        found = scan.texts(scan.scan(spark, root))
        got = {r.path: r for r in found.collect()}
    assert {p: bytes(r.content) for p, r in got.items()} == FILES
    assert {r.mtime for r in got.values()} == {1_000_000_000} and got["a/b/c/.hidden.RS"].chunk_type == "code"


def test_a_scheme_that_nothing_opens_is_an_error(spark):
    with pytest.raises(Exception, match="nowhere"):
        scan.scan(spark, "nowhere://host/root").collect()


@pytest.fixture
def root(tmp_path):
    for path, content in (FILES | UNWANTED).items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(content)
    return str(tmp_path)


def test_filters_are_tested_where_folders_are_listed(spark, root, capfd):
    wanted = scan.listing(spark, root)
    wanted.explain("formatted")
    plan = capfd.readouterr().out
    assert f"PushedFilters: [LessThanOrEqual(length,{scan.MAX_BYTES}), In(extension, [" in plan
    reader = tree.TreeReader({"root": root})
    left = list(reader.pushFilters([tree.LessThanOrEqual(("length",), 5), tree.In(("extension",), ("md", "py")), tree.EqualTo(("path",), "x")]))
    assert left == [tree.EqualTo(("path",), "x")]
    rows = [r for p in reader.partitions() for r in reader.files(p)]
    assert sorted(r[0] for r in rows) == ["_x.md", "pkg/__init__.py", "pkg/_private/c.py", "ü/ö.md"]


@pytest.mark.parametrize("folders", [1, 2, 4, 1000])
def test_each_file_is_in_one_partition(spark, root, folders):
    spark.dataSource.register(tree.Tree)
    rows = spark.read.format("loom_tree").option("root", root).option("folders", folders).load()
    got = [r.path for r in rows.where(F.col("length") <= scan.MAX_BYTES).collect()]
    assert sorted(got) == sorted([*FILES, "no.bin", ".rs", "name."])


def test_time_and_length_are_pushed_as_they_compare(spark, root):
    spark.dataSource.register(tree.Tree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = spark.read.format("loom_tree").option("root", root).load()
    for test in ("length > 4 AND length < 9", "length = 1", "mtime >= 0", "mtime > 99999999999", "extension = 'md' OR length = 0", "extension IN ('rs', 'yml') AND path LIKE 'a%'"):
        plain = rows.withColumns({c: F.expr(f"coalesce({c}, {c})") for c in ("length", "mtime", "extension")})  # no filter on an expression is pushed
        assert sorted(map(tuple, rows.where(test).collect())) == sorted(map(tuple, plain.where(test).collect()))


def test_names_that_are_no_utf8(spark, tmp_path):
    (tmp_path / "x").mkdir()
    with open(bytes(tmp_path) + b"/x/\xff.md", "wb") as f:
        f.write(b"odd")
    assert [(r.path, bytes(r.content)) for r in scan.scan(spark, str(tmp_path)).collect()] == [("x/?.md", b"odd")]


def test_stores():
    assert stores.store("/a//b/").base == b"/a/b" == stores.store("file:///a/b").base == stores.store("file:/a/b").base
    assert tree.extension("a/b.TAR.Gz") == "gz" and tree.extension("a.b/c") == tree.extension(".rs") == tree.extension("x.") == ""
