import itertools
import re

import pyarrow as pa
import pytest

from loomspark.llm import license_scan as L
from loomspark.llm import queries

SF = "/root/testdata/sf0.001"
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    """n_words, n_base, first and last place, base labels, labels of base phrases and notices."""
    words = _WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))

    def places(phrase):
        p = phrase.split()
        return [k for k in range(len(words)) if words[k : k + len(p)] == p]

    base = {label: places(phrase) for phrase, label in L.BASE.items()}
    at = sorted(k for x in base.values() for k in x)
    labels = {label for label, x in base.items() if x}
    more = {label for phrase, label in L.NOTICES.items() if places(phrase)}
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | more))


def base(r):
    return r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels


def test_same_as_plain_scan_of_the_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op13_license_scan"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert sum(r.n_base for r in got) > 0
    for r in got:
        assert (*base(r), r.labels) == brute(docs[r.doc_id])
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_texts_of_every_kind(spark):
    long = "mit license " * 150_000 + "ü" * 300_000 + " general\npublic-license"
    texts = [
        None, "", "  ", "MIT License", "mit-license; MIT\n\nLICENSE mit licenses", "general public", "license apache license mit", long, "GNU Lesser General Public License version 3",
        "mit licenseé", "x SPDX-License-Identifier: (MIT OR Apache-2.0) AND ISC, and more", "SPDX-License-Identifier: nonsense", "spdx license identifier mit", "Creative Commons Attribution CC BY-NC-SA 4.0",
    ]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "MIT License"), (3, "MIT License")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_words", "'x' AS labels", "2 AS score")
    got = L.licenses(frame).collect()
    assert sorted(((r.doc_id, *base(r)) for r in got), key=str) == sorted(((k, *brute(t)[:5]) for k, t in rows), key=str)
    by = {r.doc_id: r for r in got if r.doc_id not in (None, 3)}
    assert by[10].labels == "apache-2.0,isc,mit" and by[10].expressions == ["mit apache-2.0 or isc and"] and by[10].permitted
    assert by[11].labels == by[12].labels == "" and by[11].permitted is None and by[11].score == 0
    assert by[8].labels == "gpl,gpl-3.0,lgpl" and by[13].labels == "cc-by,cc-by-nc,cc-by-nc-sa"
    assert L.licenses(frame.limit(0)).collect() == []


def test_phrases_do_not_cross_rows():
    n, found = L.scan(pa.array(["the mit", "license of the apache", None, "license"]))
    assert n.tolist() == [2, 4, 0, 1] and not found


@pytest.mark.parametrize(
    "text, operands, postfix",
    [
        (b"MIT", ["mit"], "mit"),
        (b"mit or ISC and zlib", ["mit", "isc", "zlib"], "mit isc zlib and or"),
        (b"(mit or isc) and zlib", ["mit", "isc", "zlib"], "mit isc or zlib and"),
        (b"GPL-2.0-only WITH Classpath-exception-2.0 OR mit", ["gpl-2.0-only", "classpath-exception-2.0", "mit"], "gpl-2.0-only classpath-exception-2.0 with mit or"),
        (b"Apache-2.0. And so on", ["apache-2.0"], "apache-2.0"),
        (b"((MIT)) */", ["mit"], "mit"),
        (b"GPL-2.0+ AND LicenseRef-own", ["gpl-2.0+", "licenseref-own"], "gpl-2.0+ licenseref-own and"),
        (b"mit)", ["mit"], "mit"),
    ],
)
def test_expressions(text, operands, postfix):
    assert L.parse(text) == (operands, postfix.split())


@pytest.mark.parametrize("text", [b"", b"see LICENSE", b"(mit", b"mit or", b"mit with isc", b"(mit or isc) with llvm-exception", b"or mit", b"mit and (", b"llvm-exception"])
def test_what_is_no_expression(text):
    assert L.parse(text) is None


def test_values_are_those_of_logic():
    names = {"a": "mit", "b": "gpl-3.0", "c": "isc", "d": "agpl-3.0"}
    for x, y, z in itertools.product(["and", "or"], repeat=3):
        for form in (f"a {x} b {y} c {z} d", f"(a {x} b) {y} (c {z} d)", f"a {x} (b {y} c {z} d)"):
            text = re.sub(r"\b[abcd]\b", lambda m: names[m[0]], form)
            assert L.permitted(L.parse(text.encode())[1]) == eval(form, {"a": True, "b": False, "c": True, "d": False})
    assert not L.permitted(L.parse(b"gpl-3.0 with llvm-exception")[1]) and L.permitted(L.parse(b"apache-2.0 with llvm-exception")[1])
