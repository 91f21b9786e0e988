"""License scans: tags and notices by Aho-Corasick, license expressions by a shunting-yard parser.

One automaton looks for all phrases at once in a text's words, joined by single spaces: phrases of licenses, which give
labels as they stand, and tags, after which an expression is read from the raw text. An expression has operands (known
identifiers and references), `with` before an exception, which binds closest, then `and`, then `or`, and brackets; it ends where
the grammar does not go on. Its operands become labels, and it is evaluated: an operand is permitted if its license is,
`and` needs both sides, `or` one; an exception leaves its license as it is.

The score is the chance that one of the independent signs is right: an expression counts `SURE`, a notice `NOTICE`.

Defined results
---------------
- null or empty text: no words, no label ('' for both), score 0;
- phrases stand in consecutive words, whatever is between these; places that overlap all count; words of other
  documents never belong to one;
- an expression that is not valid as far as it goes (an operand that is not known, an open bracket, an operator
  without operand) gives no label;
- very long texts: read whole, in batches of about `slices` bytes of documents; repeated rows and null doc_id: each for itself;
- other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .terms import LOWER, TERM, bounds
from .textkernel import slices, text_buffer

# Phrases whose places are counted, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Other phrases of licenses and notices, and their labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "general public license version 2": "gpl-2.0",
    "general public license version 3": "gpl-3.0",
    "lesser general public license": "lgpl",
    "library general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "common development and distribution license": "cddl",
    "boost software license": "bsl-1.0",
    "isc license": "isc",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "creative commons attribution": "cc-by",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0": "cc0-1.0",
    "public domain dedication": "cc0-1.0",
    "python software foundation license": "psf-2.0",
    "all rights reserved": "all-rights-reserved",
}
TAGS = ("spdx license identifier", "license expression")
# Identifiers of licenses that expressions know, by whether they are permitted, and of exceptions.
PERMITTED = (
    "0bsd", "afl-3.0", "apache-1.1", "apache-2.0", "artistic-2.0", "blueoak-1.0.0", "bsd-1-clause", "bsd-2-clause", "bsd-3-clause", "bsl-1.0", "cc-by-3.0", "cc-by-4.0", "cc0-1.0",
    "isc", "mit", "mit-0", "ncsa", "openssl", "postgresql", "psf-2.0", "python-2.0", "unicode-3.0", "unlicense", "upl-1.0", "wtfpl", "x11", "zlib",
)
OTHERS = (
    "agpl-3.0", "agpl-3.0-only", "agpl-3.0-or-later", "busl-1.1", "cc-by-nc-4.0", "cc-by-nc-nd-4.0", "cc-by-nc-sa-4.0", "cc-by-nd-4.0", "cc-by-sa-3.0", "cc-by-sa-4.0", "cddl-1.0", "cddl-1.1",
    "epl-1.0", "epl-2.0", "eupl-1.2", "gpl-1.0-only", "gpl-1.0-or-later", "gpl-2.0", "gpl-2.0-only", "gpl-2.0-or-later", "gpl-3.0", "gpl-3.0-only", "gpl-3.0-or-later",
    "lgpl-2.0-only", "lgpl-2.0-or-later", "lgpl-2.1", "lgpl-2.1-only", "lgpl-2.1-or-later", "lgpl-3.0", "lgpl-3.0-only", "lgpl-3.0-or-later", "mpl-1.1", "mpl-2.0", "ms-rl", "osl-3.0", "sspl-1.0",
)
EXCEPTIONS = ("autoconf-exception-3.0", "bison-exception-2.2", "classpath-exception-2.0", "font-exception-2.0", "gcc-exception-3.1", "linux-syscall-note", "llvm-exception", "openjdk-assembly-exception-1.0")
#: How far a sign of either kind is trusted.
SURE, NOTICE = 0.95, 0.7
_RANK = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(rb"[ \t]*([()]|[A-Za-z0-9+-]+(?:[.:][A-Za-z0-9+-]+)*)")
_LEAD = re.compile(rb"[ \t]*[:=][ \t]*[\"'\[]?")


def _operand(token: str) -> bool | None:
    """Whether the license of an operand is permitted; None if it is not known."""
    plain = token.removesuffix("+")
    if plain.startswith(("licenseref-", "documentref-")):
        return False
    return plain in PERMITTED if plain in PERMITTED or plain in OTHERS else None


def parse(raw, at: int = 0) -> tuple[list[str], list[str]] | None:
    """(operands, in postfix order with operators) of the expression that starts there; None if there is no valid one."""
    out, held, operands, want = [], [], [], True  # want: an operand is next
    while m := _TOKEN.match(raw, at):
        token = m[1].decode().lower()
        if want:
            if token == "(" and held[-1:] != ["with"]:
                held.append(token)
            elif token in EXCEPTIONS if held[-1:] == ["with"] else _operand(token) is not None:
                out.append(token)
                operands.append(token)
                want = False
            else:
                return None
        elif token == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:  # closes a bracket of the text around
                break
            held.pop()
        elif token in _RANK:
            if token == "with" and out[-1] in _RANK:  # an exception belongs to one license
                return None
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[token]:
                out.append(held.pop())
            held.append(token)
            want = True
        else:
            break
        at = m.end()
    while held and held[-1] != "(":
        out.append(held.pop())
    return None if want or held else (operands, out)


def permitted(postfix: list[str]) -> bool:
    """The value of an expression."""
    stack: list[bool] = []
    for token in postfix:
        if token in _RANK:
            b, a = stack.pop(), stack.pop()
            stack.append(a if token == "with" else a and b if token == "and" else a or b)
        else:
            stack.append(bool(_operand(token)))
    return stack[0]


@lru_cache(1)
def _machine():
    """The automaton over words with single spaces around; values: (kind, label or tag, words)."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    known: dict[str, list] = {}
    for kind, phrases in (("base", BASE.items()), ("notice", NOTICES.items()), ("tag", zip(TAGS, TAGS))):
        for phrase, label in phrases:
            known.setdefault(phrase, []).append((kind, label))
    for phrase, signs in known.items():
        machine.add_word(f" {phrase} ", (signs, phrase.count(" ") + 1))
    machine.make_automaton()
    return machine


class Found:
    """What stands in one document."""

    def __init__(self):
        self.base, self.base_labels, self.notices, self.expressions, self.operands = [], set(), set(), [], set()


def scan(column: pa.Array) -> tuple[np.ndarray, dict[int, Found]]:
    """The number of words of each text, and what was found in those that have anything."""
    raw, offsets = text_buffer(column)
    term = TERM[raw]
    start, end, first = bounds(term, offsets)
    # all words with one space between: one string for the automaton, a character a byte
    size = end - start
    at = np.concatenate([[0], np.cumsum(size + 1)])[:-1] + 1
    flat = np.full(int(size.sum()) + len(size) + 1, 32, np.uint8)
    place = np.repeat(at - start, size) + np.flatnonzero(term)
    flat[place] = LOWER[raw[term]]
    found: dict[int, Found] = {}
    row_of = np.repeat(np.arange(len(column)), np.diff(first))
    for last, (signs, words) in _machine().iter(flat.tobytes().decode("latin-1")):
        word = int(np.searchsorted(at, last)) - words  # of the phrase's first word: `last` is the space after its last one
        row = int(row_of[word])
        if row_of[word + words - 1] != row:
            continue
        doc = found.setdefault(row, Found())
        for kind, label in signs:
            if kind == "base":
                doc.base.append(word - int(first[row]))
                doc.base_labels.add(label)
            elif kind == "notice":
                doc.notices.add(label)
            else:
                stop = int(end[word + words - 1])
                after = memoryview(raw[stop : int(offsets[row + 1])])
                lead = _LEAD.match(after)
                got = parse(after, lead.end()) if lead else None
                if got:
                    doc.operands.update(got[0])
                    doc.expressions.append((" ".join(got[1]), permitted(got[1])))
    return np.diff(first), found


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, permitted boolean"


def _rows(doc_id: pa.Array, column: pa.Array) -> pa.RecordBatch:
    n_words, found = scan(column)
    none = Found()
    docs = [found.get(r, none) for r in range(len(column))]
    joined = lambda labels: ",".join(sorted(labels))
    return pa.RecordBatch.from_arrays(
        [
            doc_id, pa.array(n_words.astype(np.int64)), pa.array([len(d.base) for d in docs], pa.int64()),
            pa.array([min(d.base, default=None) for d in docs], pa.int64()), pa.array([max(d.base, default=None) for d in docs], pa.int64()),
            pa.array([joined(d.base_labels) for d in docs]), pa.array([joined(d.base_labels | d.notices | d.operands) for d in docs]),
            pa.array([1 - (1 - SURE) ** len(d.expressions) * (1 - NOTICE) ** len(d.base_labels | d.notices) for d in docs]),
            pa.array([[x for x, _ in d.expressions] for d in docs], pa.list_(pa.string())), pa.array([all(p for _, p in d.expressions) if d.expressions else None for d in docs], pa.bool_()),
        ],
        [c.split()[0] for c in _SCHEMA.split(", ")],
    )


def licenses(docs: DataFrame) -> DataFrame:
    """Words, base places and labels of each document, all labels, the score, expressions in postfix order and whether all are permitted (null: none)."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for i, j in slices(batch.column("text")):
                yield _rows(batch.column("doc_id").slice(i, j - i), batch.column("text").slice(i, j - i))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCHEMA)
