import os
import shutil
import time

from loomspark.operators.index import Index
from loomspark.streaming import changes, refresh


def write(root, path, text, when=1_000_000):
    p = root / path
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)
    os.utime(p, (when, when))


def test_states_of_a_tree(spark, tmp_path):
    """Each run goes on from the state that the checkpoint holds: files, hidden ones included, come, change and go, and whole folders."""
    root = tmp_path / "tree"
    steps = []

    def run():
        got = []
        q = changes.changes(spark, str(root), parts=3).writeStream.foreachBatch(lambda batch, _: got.extend(batch.collect())).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        steps.append(sorted((r.path, r.status) for r in got))

    for path in ("a.md", "_x/b.md", "_x/.c.rs", "d/e.py", "d/f.bin", "node_modules/g.md"):
        write(root, path, "x")
    run()
    write(root, "a.md", "x", 2_000_000)
    write(root, ".new.md", "y")
    (root / "_x/.c.rs").unlink()
    run()
    run()
    shutil.rmtree(root / "_x")
    write(root, "d/e.py", "longer")
    run()
    for p in root.rglob("*.*"):
        if p.is_file():
            p.unlink()
    run()
    assert steps == [
        [("_x/.c.rs", "added"), ("_x/b.md", "added"), ("a.md", "added"), ("d/e.py", "added")],
        [(".new.md", "added"), ("_x/.c.rs", "removed"), ("a.md", "updated")],
        [],
        [("_x/b.md", "removed"), ("d/e.py", "updated")],
        [(".new.md", "removed"), ("a.md", "removed"), ("d/e.py", "removed")],
    ]


def test_deletions_and_hidden_names_refresh_the_index_by_themselves(spark, tmp_path):
    root = tmp_path / "tree"
    write(root, "a.md", "# A\n")
    write(root, "b.md", "# B\n")
    index = Index(spark, str(tmp_path / "index"))
    q = refresh.watch(spark, str(root), index, str(tmp_path / "checkpoint"), once=False, every="1 second", parts=2)

    def until(want):
        for _ in range(120):
            if {r.path for r in index.files.collect()} == want:
                return True
            assert q.exception() is None
            time.sleep(0.5)
        return False

    try:
        assert until({"a.md", "b.md"})
        (root / "a.md").unlink()
        assert until({"b.md"})
        write(root, "_hidden.md", "# C\n")
        assert until({"_hidden.md", "b.md"})
    finally:
        q.stop()


def test_compare():
    assert changes.compare({}, {}) == []
    assert changes.compare({"a": [1, 2], "b": [1, 1]}, {"b": [2, 1], "c": [0, 0]}) == [("a", "removed", 1, 2), ("b", "updated", 2, 1), ("c", "added", 0, 0)]
