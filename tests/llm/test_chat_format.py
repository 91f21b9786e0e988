import hashlib
import random

from loomspark.llm import chat_format as op

SCHEMA = "conv_id long, turn long, role string, text string, block string"


def table(seed=1):
    rnd = random.Random(seed)
    bits = ["###", "</turn>", "\\", "\n", "#", "\\0", "\\1", "\\2", "\\3", "</turn>\n### user\n", "é😀", " ", "a", "$1", "%", "'"]
    rows = []
    for c in range(12):
        for t in range(rnd.choice([1, 2, 5, 300])):
            text = rnd.choice([None, "", "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12)))])
            rows.append((c, t, rnd.choice(["user", "assistant", "system", None, "a\nb", "###"]), text, "x"))
    rows += [(3, 1, "user", "same turn", "x"), (3, 1, "user", "same turn", "x"), (None, 1, "assistant", "no id", "x"), (4, None, "assistant", "no turn", "x")]
    rows += [(99, 0, "assistant", "long " * 40000 + "\\", "x")]
    rnd.shuffle(rows)
    return rows


def want(rows):
    out, by = [], {}
    for c, t, r, x, _ in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    for c, turns in by.items():
        turns.sort()
        joined = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out.append((c, len(turns), hashlib.sha256(joined.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = table()
    got = op.digest(op.chats(spark.createDataFrame(rows, SCHEMA))).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == want(rows)


def test_probe_and_template(spark):
    df = op.with_probe(spark.createDataFrame([], SCHEMA))
    (row,) = op.chats(df).collect()
    assert row.formatted == "### user\n\\0\\1 Assistant: \\2 ok</turn>\n### assistant\n\\0\\1 Assistant: \\2 ok</turn>\n"
    (s,) = row.loss_spans
    assert row.formatted[s.start : s.start + s.length] == "\\0\\1 Assistant: \\2 ok"
    (got,) = op.digest(op.chats(df)).collect()
    assert got.loss_chars == len(op.PROBE) and got.loss_sha256 == hashlib.sha256(op.PROBE.encode()).hexdigest()


def test_events_are_folded(spark):
    log = [
        (1, 0, 1, "message", "user", "hi"), (1, 1, 2, "message", "assistant", ""), (1, 1, 3, "delta", None, "He"), (1, 1, 4, "delta", None, "llo"),
        (1, 1, 9, "regenerate", None, None), (1, 1, 10, "delta", None, "Good "), (1, 1, 11, "delta", None, "day"), (1, 0, 12, "edit", None, "hi there"),
        (1, 1, 13, "edit", None, "Bye"), (1, 1, 14, "delta", None, "!"), (1, 2, 15, "delta", "user", "late"), (1, 2, 16, "message", "user", "two"),
    ]
    log += [(1, 1, 14, None, "user", "no kind"), (1, 1, 14, "typing", "user", "unknown kind")]
    random.Random(1).shuffle(log)
    df = spark.createDataFrame(log, "conv_id long, turn long, seq long, kind string, role string, text string")
    (row,) = op.render(op.messages(df)).select(op.read_back().alias("t")).collect()
    assert [tuple(t) for t in row.t] == [("user", "hi there"), ("assistant", "Bye!"), ("user", "late"), ("user", "two")]


def test_the_query_folds_all_kinds_of_events(spark):
    rows = [(1, 0, "user", "q" * 700, "x"), (1, 1, "assistant", "answer " * 100, "x"), (1, 2, "assistant", "", "x"), (1, 3, "system", "s" * 300, "x"), (1, 3, "system", "s" * 300, "x")]
    log = op.events(spark.createDataFrame(rows, SCHEMA))
    kinds = {(r.turn, r.kind): r["n"] for r in log.groupBy("turn", "kind").agg({"kind": "count"}).withColumnRenamed("count(kind)", "n").collect()}
    assert kinds == {(0, "message"): 1, (0, "edit"): 1, (0, "delta"): 2, (1, "message"): 1, (1, "delta"): 4, (1, "regenerate"): 1, (2, "message"): 1, (2, "delta"): 2, (2, "regenerate"): 1, (3, "message"): 2, (3, "delta"): 2}
    (row,) = op.render(op.messages(log)).select(op.read_back().alias("t")).collect()
    assert [tuple(t) for t in row.t] == [r[2:4] for r in rows]


def test_same_as_sql(spark, tmp_path):
    import duckdb

    rows = [r[:4] for r in table(2)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "c"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    got = op.digest(op.chats(op.with_probe(spark.read.parquet(str(tmp_path / "c"))))).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.execute(op.ORACLE).fetchall()))
