import hashlib
import random
from pathlib import Path

import numpy as np
import pytest

from loomspark.llm import sentencepiece_codec as op

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def codec():
    return op.Codec.load(MODEL)


def texts():
    rnd = random.Random(1)
    bits = ["the", "ing", " ", "  ", "\n", "tion", "é", "Über", "日本語", "😀", "▁", "x", "www.", "0123", "\t", "aaaa", "{", "\x00", "ß", "naïve", "ñ"]
    out = ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 60))) for _ in range(150)]
    return [*out, "a", " ", "   ", "\n", "a" * 700, "abc" * 400, " " * 90, "Donaudampfschifffahrtsgesellschaft" * 20, "<0x0A> <s> </s> <unk>"]


def test_same_ids_as_the_library(codec, library):
    for t in texts():
        ids = np.frombuffer(codec.encode(t), "<i4").tolist()
        assert ids == library.encode(t), t
        assert codec.decode(codec.encode(t)) == t.replace("▁", " ")
        assert codec.decode(codec.encode(t)) == library.decode(ids)


def test_scan_is_merging(codec):
    rnd = random.Random(2)
    for _ in range(300):
        w = "".join(rnd.choice("abcdeinrst▁") for _ in range(rnd.randint(1, 14)))
        assert codec._scan(w, 0, len(w), "", 0) == codec.merged(w)


def test_stable_pairs_are_those_that_merging_keeps(codec):
    rnd = random.Random(3)
    pieces = [p for p in codec.kind if codec.kind[p]]
    near = [p for p in pieces if len(p) <= 3]
    for _ in range(6000):
        a, b = rnd.choice(rnd.choice([pieces, near])), rnd.choice(rnd.choice([pieces, near]))
        assert codec._compatible(a, b) == (codec.merged(a + b) == [a, b]), (a, b)


def test_bytes_that_are_no_utf8(codec, library):
    ids = [codec.byte[0xE6], codec.byte[0x97], codec.id["the"], codec.byte[0xC3], codec.byte[0xA9], codec.byte[0xFF]]
    assert codec.decode(np.array(ids, "<i4").tobytes()) == library.decode(ids)


def test_products_are_associative_and_equal_the_whole(codec):
    t = op.mark("unbelievablyinternationalization" * 3)
    cuts = [0, 7, 8, 30, 61, 97]
    m = [codec.transfer(t, a, b) for a, b in zip(cuts, cuts[1:])]
    left = m[0]
    for x in m[1:]:
        left = op.combine(left, x)
    right = m[-1]
    for x in reversed(m[:-1]):
        right = op.combine(x, right)
    assert (left == right).all() and (left == codec.transfer(t, 0, len(t))).all() and (left == 0).sum() == 1


def test_documents_over_several_parts(spark, codec, library, monkeypatch):
    monkeypatch.setattr(op, "CHARS", 150)
    rows = [(i, t * 5) for i, t in enumerate(texts())] + [(900, None), (901, ""), (None, "word " * 100), (0, texts()[0] * 5), (903, "z" * 1500), (904, "ab " * 50 + "q" * 149 + " c" * 90)]
    got = op.digest(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS row"), MODEL).collect()
    want = []
    for i, t in rows:
        ids = np.array(library.encode(t or ""), "<i4")
        back = (t or "").replace("▁", " ")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), True))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_giant_documents_without_spaces(spark, library):
    rnd = random.Random(4)
    run = lambda alphabet, n: "".join(rnd.choice(alphabet) for _ in range(n))
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    rows = [
        (1, run("日本語中文的一是不了人在有我他这", 2 * op.CHARS + 500)),
        (2, run(base64, op.CHARS + 2000)),
        (3, "some words " * ((op.CHARS - 3000) // 11) + run("กขคงจฉชซญดตถทธน", 6000) + " and words" * 50),
        (4, "short"),
    ]
    got = {r.doc_id: r for r in op.digest(spark.createDataFrame(rows, "doc_id long, text string"), MODEL).collect()}
    for i, t in rows:
        ids = np.array(library.encode(t), "<i4")
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest() and got[i].exact, i


def test_empty_table(spark):
    assert op.digest(spark.createDataFrame([], "doc_id long, text string"), MODEL).collect() == []
    assert Path(MODEL).exists()
