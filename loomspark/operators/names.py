"""Posting lists of chunks by what their names and contents hold: candidates of a search by name, a proven superset.

A chunk has a token for each three letters in a row of its lower-cased name and content, and one, marked by `^`, for the first
START letters of its name (fewer, if it is shorter). A chunk scores only if a word of the query is in its name or
content, so that it has all the word's tokens, or if its name is a part of the query, so that letters of the query begin it.
Tokens of both kinds may be equal, which adds candidates and loses none. Lists are kept by buckets (`at`), as places in these;
a token has a list for each block of a bucket's rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LISTS = "at int, token string, places array<long>"
START = 8
#: Letters of a query that is looked up; longer ones are rare, and scan. Tokens of a query are at most START + 1 times as many.
LETTERS = 64
#: Characters of a block, about.
BLOCK = 1 << 20
_IN = 10  # values of one `IN` that reach the pages of a file as they are


def start(name: Column) -> Column:
    return F.concat(F.lit("^"), F.substring(F.lower(name), 1, START))


def _threes(texts: list[str], owner: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The three letters in a row that texts hold, and for each the owners, sorted and once each, from bounds[k] to bounds[k + 1]."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    inside = np.flatnonzero(of[2:] == of[:-2])
    if not len(inside):
        return [], np.zeros(1, np.int64), np.zeros(0, np.int64)
    # letters are numbered densely, so that three of them and an owner are one number
    seen = np.zeros(int(codes.max()) + 1, bool)
    seen[codes] = True
    letters, rank = np.flatnonzero(seen), np.cumsum(seen) - 1
    n, owners = len(letters), int(owner.max()) + 1
    dense = rank[codes]
    three = ((dense[:-2] * n + dense[1:-1]) * n + dense[2:])[inside]
    if n**3 * owners >= 1 << 63:
        kinds, three = np.unique(three, return_inverse=True)
    else:
        kinds = None
    both = np.sort(three * owners + owner[of[inside]])  # many times faster than np.unique, which hashes
    both = both[np.concatenate([[True], both[1:] != both[:-1]])]
    three, found = both // owners, both % owners
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(three)) + 1, [len(three)]])
    three = three[bounds[:-1]] if kinds is None else kinds[three[bounds[:-1]]]
    said = letters[np.stack([three // n // n, three // n % n, three % n], axis=1)].astype("<u4").tobytes().decode("utf-32-le")
    return [said[i : i + 3] for i in range(0, len(said), 3)], bounds, found


def _listed(at: int, rows: list[tuple]) -> pa.RecordBatch:
    """The lists of rows (pos, start, name, content) of one bucket."""
    pos = np.array([r[0] for r in rows], dtype=np.int64)
    tokens, bounds, found = _threes([t for r in rows for t in r[2:]], np.repeat(np.arange(len(rows)), 2))
    starts: dict[str, list[int]] = {}
    for k, r in enumerate(rows):
        if r[1] is not None:
            starts.setdefault(r[1], []).append(k)
    ends = np.cumsum([len(v) for v in starts.values()], dtype=np.int64) + bounds[-1]
    found = np.concatenate([found, *[np.array(v, dtype=np.int64) for v in starts.values()]])
    places = pa.ListArray.from_arrays(pa.array(np.concatenate([bounds, ends]), pa.int32()), pa.array(pos[found]))
    tokens += starts
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(tokens), at), pa.int32()), pa.array(tokens, pa.string()), places], ["at", "token", "places"])


def _lists(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, held, size = None, [], 0
    for batch in batches:
        for a, *row in zip(*(batch.column(c).to_pylist() for c in ("at", "pos", "start", "name", "content"))):
            if held and (a != at or size >= BLOCK):
                yield _listed(at, held)
                held, size = [], 0
            at, size = a, size + len(row[2]) + len(row[3])
            held.append(row)
    if held:
        yield _listed(at, held)


def lists(rows: DataFrame) -> DataFrame:
    """at, token, places, of rows (at, pos, name, content): a task has whole buckets, and texts are shuffled, not tokens.

    Lists are made a block of rows at a time, as numbers: no row comes of a token's place.
    """
    low = lambda c: F.make_valid_utf8(F.lower(F.coalesce(F.col(c), F.lit(""))))
    rows = rows.select("at", "pos", F.make_valid_utf8(start(F.col("name"))).alias("start"), low("name").alias("name"), low("content").alias("content"))
    return rows.repartition("at").sortWithinPartitions("at", "pos").mapInArrow(_lists, LISTS).sortWithinPartitions("at", "token")


def asked(query: str) -> tuple[list[set[str]], set[str]] | None:
    """(tokens of each word, starts of names), or None if lists can't answer: no word, a word of fewer than three letters, or a long query."""
    q = query.lower()
    words = sorted(set(q.split()))
    if not words or min(map(len, words)) < 3 or len(q) > LETTERS:
        return None
    starts = {"^"} | {"^" + q[i : i + n] for n in range(1, START + 1) for i in range(len(q) - n + 1)}
    return [{w[i : i + 3] for i in range(len(w) - 2)} for w in words], starts


def _held(held: DataFrame, tokens: Iterable[str]) -> DataFrame:
    """at, held: the lists of some tokens, a map for each bucket."""
    wanted = sorted(tokens)
    hit = F.lit(False)
    for i in range(0, len(wanted), _IN):
        hit = hit | F.col("token").isin(wanted[i : i + _IN])
    held = held.where(hit).repartition("at").groupBy("at", "token").agg(F.flatten(F.collect_list("places")).alias("places"))
    return held.groupBy("at").agg(F.map_from_entries(F.collect_list(F.struct("token", "places"))).alias("held"))


def _places(token: str) -> Column:
    return F.coalesce(F.col("held")[token], F.array().cast("array<long>"))


def candidates(held: DataFrame, words: list[set[str]], starts: Iterable[str]) -> DataFrame:
    """at, pos, once each: rows that have all tokens of a word, or one of the starts. A bucket's lists meet in one row, bounded by the bucket."""
    starts = sorted(starts)
    found = F.flatten(F.transform(F.array(*map(F.lit, starts)), lambda s: F.coalesce(F.col("held")[s], F.array().cast("array<long>"))))
    for tokens in words:
        first, *rest = sorted(tokens)
        places = _places(first)
        for t in rest:
            places = F.array_intersect(places, _places(t))
        found = F.concat(found, places)
    return _held(held, {*starts, *(t for w in words for t in w)}).select("at", F.explode(F.array_distinct(found)).alias("pos"))
