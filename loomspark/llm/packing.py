"""Packing: optimal length buckets, then token-budget batches.

The global histogram of lengths is an aggregate with a row for each length that occurs, so it
grows with the longest texts and not with their number. Dynamic programming over it chooses
the upper ends of `buckets` buckets that minimise the padding summed over all documents; the ends
are lengths that occur. Inside a bucket, a batch takes as many documents as the token budget
holds at the bucket's length. Documents are numbered inside shards of a bucket (a hash of
doc_id), and a running sum over the shards' counts makes the numbers those of the bucket: a
bucket that holds most rows is many tasks, and it has one partly filled batch, not one for each shard.

Defined results
---------------
- length: the words `[^\\x20\\x09-\\x0D]+` of the text, and one for its end; null or blank text: 1;
- a document longer than the budget is a batch of its own;
- order inside a shard: by hash of doc_id, doc_id, length, so equal rows are interchangeable;
- null doc_id: packed like any other, spread over shards by text; empty table: no rows;
- of several choices with the least padding: the smallest last ends;
- other columns are ignored by `pack`.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

BUDGET = 65_536
BUCKETS = 12
#: Rows of a shard, about.
SHARD = 4096


def lengths(text: str = "text"):
    """Words and one end mark."""
    t = F.coalesce(F.col(text), F.lit(""))
    return (F.size(F.regexp_extract_all(t, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))) + 1).cast("long")


def best_ends(sizes: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper ends of at most `buckets` buckets with the least padding, for `counts` documents of each of the ascending `sizes`.

    The last bucket of the first j sizes starts no earlier than that of the first j - 1 (its cost is
    convex: a longer size costs more for each more document), so for all j at once, middle ones first, only
    the range between the neighbours' starts is searched: sizes times their logarithm in all, not their square.
    """
    m = len(sizes)
    if not m:
        return []
    size = np.array(sizes, dtype=np.int64)
    n = np.concatenate([[0], np.cumsum(np.array(counts, dtype=np.int64))])
    t = np.concatenate([[0], np.cumsum(size * np.array(counts, dtype=np.int64))])
    # best[j]: least padding of the first j sizes; sizes i..j-1 in one bucket cost size[j-1] * documents - tokens
    best = np.concatenate([[0], size * n[1:] - t[1:]])
    back = []
    for _ in range(min(buckets, m) - 1):
        cut = np.zeros(m + 1, dtype=np.int64)
        new = best.copy()
        low, high = np.array([1]), np.array([m + 1])  # ranges of j whose middles are next
        first, last = np.array([0]), np.array([m - 1])  # and of their starts
        while len(low):
            j = (low + high) // 2
            upto = np.minimum(last, j - 1)
            width = upto - first + 1
            at = np.cumsum(width) - width
            i = np.arange(width.sum()) - np.repeat(at - first, width)
            to = np.repeat(j, width)
            cost = best[i] + size[to - 1] * (n[to] - n[i]) - (t[to] - t[i])
            least = np.minimum.reduceat(cost, at)
            hit = np.flatnonzero(cost == np.repeat(least, width))
            found = i[hit[np.searchsorted(hit, at)]]
            new[j], cut[j] = least, found
            low, high, first, last = (np.concatenate(x) for x in ((low, j + 1), (j, high), (first, found), (found, last)))
            some = low < high
            low, high, first, last = low[some], high[some], first[some], last[some]
        better = new < best
        cut[~better] = -1
        best = np.minimum(new, best)
        back.append(cut)
    ends, j = [], m
    for cut in reversed(back):
        if j and cut[j] >= 0:
            ends.append(sizes[j - 1])
            j = int(cut[j])
    if j:
        ends.append(sizes[j - 1])
    return ends[::-1]


def pack(docs: DataFrame, budget: int = BUDGET, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_len, batch, slot, padding of every row of `docs` (doc_id, text).

    `batch` counts from 0 in each bucket, `slot` from 0 in each batch.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    own = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(0).alias("own")
    rows = scratch.cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), lengths().alias("n_tokens"), own), "lengths")
    found = rows.groupBy(F.col("n_tokens").alias("size")).agg(F.count("*").alias("n")).orderBy("size").collect()  # bounded by the lengths that occur
    ends = best_ends([c["size"] for c in found], [c["n"] for c in found], buckets)
    held = [0] * len(ends)
    for c in found:
        held[bisect_left(ends, c["size"])] += c["n"]

    bucket = sum(((F.col("n_tokens") > e).cast("int") for e in ends[:-1]), F.lit(0))
    table = lambda values: F.get(F.array(*map(F.lit, values or [1])), F.col("bucket"))
    rows = rows.withColumn("bucket", bucket)
    rows = rows.withColumn("bucket_len", table(ends).cast("long"))
    shards = table([max(1, -(-n // SHARD)) for n in held])
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n_tokens", "own"), shards).cast("int"))
    before = rows.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    run = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("bucket", "shard", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("before"))
    own = Window.partitionBy("bucket", "shard").orderBy(F.xxhash64("doc_id"), "doc_id", "n_tokens")
    rows = rows.withColumn("nth", F.row_number().over(own) - 1).join(before, ["bucket", "shard"])
    nth, fit = F.col("nth") + F.col("before"), F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_len")))
    return rows.select(
        "doc_id", "n_tokens", "bucket", "bucket_len", F.floor(nth / fit).cast("long").alias("batch"), (nth % fit).cast("int").alias("slot"),
        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
    )
