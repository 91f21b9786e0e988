import os
import random

import pytest

from loomspark.operators import connectors
from loomspark.operators.buckets import Bucket, Manifest, Store, bucket_of, holder
from loomspark.operators.index import Index


def content(n: int, k: int) -> str:
    return "".join(f"# part {k}.{i}\ntext {n}\n" for i in range(n % 5 + 1))


def write(root, path, text, when):
    p = root / path
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)
    os.utime(p, (when, when))


def dump(index):
    return sorted(map(tuple, index.chunks.collect()))


def test_changes_give_the_index_that_a_rebuild_gives(spark, tmp_path):
    """Files that come, go, change and move through buckets that are cut, against an index without any cut."""
    rnd, root = random.Random(3), tmp_path / "tree"
    index = Index(spark, str(tmp_path / "index"), bucket_bytes=150)
    paths = [f"{d}/{f}{k}.md" for k in range(8) for d in ("a", "Z", "ü/x") for f in "pq"]
    held: set[str] = set()
    for step in range(3):
        for p in rnd.sample(paths, 20):
            if p in held and rnd.random() < 0.4:
                (root / p).unlink()
                held.discard(p)
            else:
                write(root, p, content(rnd.randrange(20), step), 1_000_000 + step)
                held.add(p)
        index.refresh(str(root))
        if step == 0:
            index.embed(connectors.HashEmbedder(4), round_size=10)
    whole = Index(spark, str(tmp_path / "whole"))
    whole.refresh(str(root))
    assert {r.path for r in index.files.collect()} == held
    assert len(index.store.manifest().buckets) > 4 and len(whole.store.manifest().buckets) == 1
    got = dump(index)
    assert got == dump(whole)
    assert [r.chunk_id for r in index.chunks.orderBy("file", "seq").collect()] == list(range(len(got)))
    vectors = index.table("vectors")
    assert vectors.join(index.chunks, ["file", "seq"], "left_anti").count() == 0 and index.pending() == len(got) - vectors.count()
    assert index.embed(connectors.HashEmbedder(4)) > 0 and index.pending() == 0 and index.embeddings.select("chunk_id").distinct().count() == len(got)


def test_one_changed_file_writes_one_bucket(spark, tmp_path):
    root = tmp_path / "tree"
    for k in range(30):
        write(root, f"d{k % 3}/f{k:02}.md", content(k, 0), 1_000_000)
    index = Index(spark, str(tmp_path / "index"), bucket_bytes=200)
    index.refresh(str(root))
    index.embed(connectors.HashEmbedder(4))
    before, rows = index.store.manifest(), dump(index)
    assert len(before.buckets) >= 5
    write(root, "d1/f10.md", "# new\n", 2_000_000)
    assert index.refresh(str(root)).updated == 1
    now = index.store.manifest()
    owner = holder(before.buckets, "d1/f10.md")
    new = now.parts() - before.parts()
    assert {p.split("/")[1:2][0] for p in new} == {"files", "chunks", "vectors"} and {p.split("=")[-1] for p in new} == {str(owner.id)}
    assert len(list((tmp_path / "index").glob("v=3/*/bucket=*/*.parquet"))) == 3  # a file for each table
    untouched = [b for b in now.buckets if b.id != owner.id]
    assert untouched == [b for b in before.buckets if b.id != owner.id]
    assert {r[1:] for r in dump(index) if r[4] != "d1/f10.md"} == {r[1:] for r in rows if r[4] != "d1/f10.md"}


def test_a_bucket_that_grows_is_cut_and_one_that_empties_stays(spark, tmp_path):
    root = tmp_path / "tree"
    write(root, "m.md", "# m\n", 1_000_000)
    index = Index(spark, str(tmp_path / "index"), bucket_bytes=100)
    index.refresh(str(root))
    assert [b.first for b in index.store.manifest().buckets] == [""]
    for k in range(20):
        write(root, f"{'az'[k % 2]}{k:02}.md", "# x\n" + "y" * 40, 1_000_000)
    index.refresh(str(root))
    cut = index.store.manifest().buckets
    assert len(cut) > 4 and cut[0].first == "" and sum(b.rows["files"] for b in cut) == 21
    for p in root.glob("*.md"):
        p.unlink()
    assert index.refresh(str(root)).removed == 21 and index.chunks.count() == index.files.count() == 0
    write(root, "b.md", "# b\n", 1_000_000)
    assert index.refresh(str(root)).added == 1 and [r.chunk_id for r in index.chunks.orderBy("file", "seq").collect()] == [0, 1]


def test_a_write_that_fails_leaves_the_manifest(spark, tmp_path, monkeypatch):
    root = tmp_path / "tree"
    write(root, "a.md", "# a\n", 1_000_000)
    index = Index(spark, str(tmp_path / "index"))
    index.refresh(str(root))
    rows = dump(index)
    write(root, "b.md", "# b\n", 1_000_000)
    with monkeypatch.context() as m:
        m.setattr(Store, "commit", lambda *_: (_ for _ in ()).throw(OSError("full")))
        with pytest.raises(OSError, match="full"):
            index.refresh(str(root))
    assert dump(index) == rows
    assert index.refresh(str(root)).added == 1 and len(dump(index)) == 2 * len(rows)


def test_ranges(spark):
    buckets = [Bucket(7, ""), Bucket(3, "b/"), Bucket(9, "ü")]
    rows = [("", 7), ("a", 7), ("b/", 3), ("b/x", 3), ("b", 7), ("z", 3), ("ü", 9), ("ｚ", 9), ("😀", 9)]
    frame = spark.createDataFrame(rows, "path string, want int")
    assert frame.withColumn("got", bucket_of(buckets, frame.path)).where("got <> want").count() == 0
    assert all(holder(buckets, p).id == b for p, b in rows)
    assert Manifest(buckets).total("chunks") == 0 and Manifest().parts() == set()


def test_small_buckets_share_folders(spark, tmp_path):
    """Folders don't grow with buckets; one whose buckets are mostly out of date is written anew."""
    root = tmp_path / "tree"
    for k in range(40):
        write(root, f"f{k:02}.md", content(k, 0), 1_000_000)
    index = Index(spark, str(tmp_path / "index"), bucket_bytes=100)
    index.refresh(str(root))
    assert len(index.store.manifest().buckets) > 8
    assert len(list((tmp_path / "index").glob("v=*/chunks/bucket=*"))) == 1
    for k in range(32):
        write(root, f"f{k:02}.md", content(k, 1), 2_000_000)
    index.refresh(str(root))
    now = index.store.manifest()
    assert len({v for b in now.buckets for v in b.versions["chunks"]}) == 1 and len({p for p in now.places() if "/chunks/" in p}) == 1
    whole = Index(spark, str(tmp_path / "whole"))
    whole.refresh(str(root))
    assert dump(index) == dump(whole)
