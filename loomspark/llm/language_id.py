"""Language ID by word-first backoff.

A known word scores its smoothed log frequency in each language. An unseen word falls back to
its character n-grams, the longest ones of which any is known (5 down to 1 characters, the
word's ends marked), and scores their mean log frequency. A text gets the language of the
largest sum; `score` is that language's share after the mean score of a word, taken at most
`EVIDENCE` times, is turned into probabilities.

The model is fitted on a bounded sample: of each language, `DOCS_PER_LANG` documents (of the
smallest hashes of doc_id), with their whole texts and all their words. Prediction reads every text whole. Logarithms are
whole multiples of 1 / `UNIT`, so that sums are exact: no result depends on the order or the
grouping in which words are added. A word or n-gram holds a number only for the languages that have it, so the model
grows with the words of the sample, not with words times languages.

Defined results
---------------
- null text, or no letter in it: lang_pred `und`, score 0;
- nothing to learn from (empty table, or no lang): lang_pred `und`, score 0;
- ties between languages: the smaller name;
- null doc_id: predicted, held_out false, never learned from;
- rows with the same doc_id: each gets its own row;
- empty and very long texts: nothing special, a text of any length is scored whole;
- other columns of the input are ignored by `predict` and carried by `accepted`.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches

DOCS_PER_LANG = 400
#: Words of a text that count as independent evidence for `score`.
EVIDENCE = 20
ORDERS = (5, 4, 3, 2, 1)
#: Logarithms are multiples of 1 / UNIT; sums are exact up to 2^53, some 400 million words of a text.
UNIT = 1 << 20
#: Unseen words whose scores a task remembers.
REMEMBERED = 200_000
#: Languages whose sample sizes are broadcast; more are joined.
BROADCAST = 100_000
#: Numbers of the tables of words and n-grams times languages; larger ones keep only those that differ from their column's base. Sums are the same.
CELLS = 1 << 23

_LETTERS = re.compile(r"[^\W\d_]+")


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def training_words(docs: DataFrame) -> list[tuple[str, str, int]]:
    """(lang, word, count) of the bounded sample."""
    rows = docs.select("doc_id", "lang", "text").where("doc_id is not null and lang is not null and text is not null").where(~held_out())
    langs = rows.groupBy("lang").count()
    # a row for each language; texts stay where they are as long as there are at most BROADCAST of them
    small = (lambda df: F.broadcast(df)) if langs.limit(BROADCAST + 1).count() <= BROADCAST else (lambda df: df)
    # hashes up to twice the share that is needed: the order is over a bounded number of rows, however many a language has
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) / float(1 << 31)
    near = rows.select("doc_id", "lang").join(small(langs), "lang").where(share * F.col("count") <= 2 * DOCS_PER_LANG)
    order = Window.partitionBy("lang").orderBy("share")
    near = near.select("lang", share.alias("share")).distinct().withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= DOCS_PER_LANG)
    upto = small(near.groupBy("lang").agg(F.max("share").alias("upto")))
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word")
    sample = rows.join(upto, "lang").where(share <= F.col("upto")).select("lang", words)
    # grows with DOCS_PER_LANG and the number of languages only
    return [tuple(r) for r in sample.groupBy("lang", "word").count().collect()]


def _fixed(x) -> np.ndarray:
    return np.round(np.asarray(x, dtype=np.float64) * UNIT).astype(np.int64)


class Table:
    """Log frequencies of keys: key k has `base` plus, for the languages lang[start[k] : start[k + 1]], value[...]."""

    def __init__(self, counts: dict[str, dict[int, int]], n_langs: int):
        self.index = {key: k for k, key in enumerate(counts)}
        self.start = np.cumsum([0, *[len(x) for x in counts.values()]])
        self.lang = np.array([lang for x in counts.values() for lang in sorted(x)], dtype=np.int32)
        n = np.array([x[lang] for x in counts.values() for lang in sorted(x)], dtype=np.float64)
        # half a count more for each key and language
        total = np.bincount(self.lang, weights=n, minlength=n_langs) + 0.5 * len(counts)
        self.base = _fixed(np.log(0.5) - np.log(np.maximum(total, 0.5)))
        self.value = _fixed(np.log(n + 0.5) - np.log(0.5))


class Model:
    def __init__(self, counts: list[tuple[str, str, int]]):
        self.langs = sorted({lang for lang, _, _ in counts})
        at = {lang: k for k, lang in enumerate(self.langs)}
        words: dict = defaultdict(Counter)
        grams: dict = {n: defaultdict(Counter) for n in ORDERS}
        for lang, word, n in sorted(counts):
            words[word][at[lang]] += n
            for size in ORDERS:
                table = grams[size]
                for g in sorted(self.split(word, size)):
                    table[g][at[lang]] += n
        self.words = Table(words, len(at))
        self.grams = {n: Table(t, len(at)) for n, t in grams.items()}

    @staticmethod
    def split(word: str, size: int) -> set[str]:
        marked = f"<{word}>"
        return {marked[i : i + size] for i in range(len(marked) - size + 1)}

    def unseen(self, word: str) -> tuple[int, np.ndarray, np.ndarray]:
        """(size of the grams that decide or 0, languages, their values): the mean over the known grams, each as often as the word has it."""
        marked = f"<{word}>"
        for size in ORDERS:
            t = self.grams[size]
            found = [t.index[g] for g in (marked[i : i + size] for i in range(len(marked) - size + 1)) if g in t.index]
            if found:
                lang = np.concatenate([t.lang[t.start[k] : t.start[k + 1]] for k in found])
                value = np.concatenate([t.value[t.start[k] : t.start[k + 1]] for k in found])
                each, place = np.unique(lang, return_inverse=True)
                return size, each, np.bincount(place, weights=value).astype(np.int64) // len(found)
        return 0, np.zeros(0, np.int32), np.zeros(0, np.int64)


class _Scores(dict):
    """Word -> row; rows of unseen words are made once and remembered, up to a bound."""

    def __init__(self, model: Model):
        super().__init__(model.words.index)
        self.model, self.known, self.more = model, len(model.words.index), []
        self.base = np.stack([np.zeros_like(model.words.base), *[model.grams[n].base for n in sorted(ORDERS)], model.words.base])
        self.table = None
        if (self.known + REMEMBERED + sum(len(t.index) for t in model.grams.values())) * len(model.langs) <= CELLS:
            self.table = np.zeros((self.known + REMEMBERED, len(model.langs)))
            self.table[: self.known] = self._dense(model.words) + model.words.base
            self.grams = [(size, model.grams[size].index, model.grams[size].base, self._dense(model.grams[size])) for size in ORDERS]

    def _dense(self, t: Table) -> np.ndarray:
        out = np.zeros((len(t.index), len(self.model.langs)), np.int64)
        out[np.repeat(np.arange(len(t.index)), np.diff(t.start)), t.lang] = t.value
        return out

    def __missing__(self, word: str) -> int:
        self[word] = row = self.known + len(self.more)
        if self.table is None:
            self.more.append(self.model.unseen(word))
            return row
        self.more.append(None)
        self.table[row] = 0
        marked = f"<{word}>"
        for size, index, base, values in self.grams:  # as Model.unseen has it
            found = [index[g] for g in [marked[i : i + size] for i in range(len(marked) - size + 1)] if g in index]
            if found:
                self.table[row] = base + values[found].sum(axis=0) // len(found)
                break
        return row

    def of(self, counts: Counter) -> np.ndarray:
        """The sum over words of count times log frequency, for each language."""
        t, total = self.model.words, np.zeros(len(self.model.langs))
        words, times = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
        for i in range(0, len(words), REMEMBERED):
            part, n = words[i : i + REMEMBERED], times[i : i + REMEMBERED]
            if len(self.more) + len(part) > REMEMBERED:
                self.clear()
                self.update(t.index)
                self.more = []
            rows = np.fromiter(map(self.__getitem__, part), np.int64, len(part))
            if self.table is not None:
                total += n.astype(np.float64) @ self.table[rows]
                continue
            seen = rows < self.known
            r, c = rows[seen], n[seen]
            size = t.start[r + 1] - t.start[r]
            flat = np.repeat(t.start[r] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            # whole numbers below 2^53: sums of doubles are exact
            total += np.bincount(t.lang[flat], weights=t.value[flat] * np.repeat(c, size), minlength=len(total)) + self.base[-1] * c.sum()
            if len(r) < len(rows):
                unseen = [self.more[x] for x in (rows[~seen] - self.known).tolist()]
                c = n[~seen]
                size = np.array([len(lang) for _, lang, _ in unseen])
                total += np.bincount(np.concatenate([x for _, x, _ in unseen]), weights=np.concatenate([x for _, _, x in unseen]) * np.repeat(c, size), minlength=len(total))
                total += np.bincount([k for k, _, _ in unseen], weights=c, minlength=len(self.base)) @ self.base
        return total


def classify(scores: _Scores, text: str | None) -> tuple[str, float]:
    counts = Counter(_LETTERS.findall(text.lower())) if text else Counter()
    if not scores.model.langs or not any(c.isalpha() for w in counts for c in w):
        return "und", 0.0
    total = scores.of(counts)
    n = sum(counts.values())
    best = int(np.argmax(total))
    share = np.exp((total - total[best]) / UNIT / n * min(n, EVIDENCE))
    return scores.model.langs[best], float(1 / share.sum())


def predict(docs: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of `docs` (doc_id, text); learns from `train` (doc_id, text, lang)."""
    spark = docs.sparkSession
    small_batches(spark)
    counts = training_words(docs if train is None else train)
    model = spark.sparkContext.broadcast(Model(counts))

    def run(batches):
        scores = _Scores(model.value)
        for batch in batches:
            found = [classify(scores, text.as_py()) for text in batch.column("text")]
            lang, score = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of `docs` that have a language, with a score of `least` or more."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(Model(training_words(docs)))
    at = docs.columns.index("text")

    def run(batches):
        scores = _Scores(model.value)
        for batch in batches:
            found = [classify(scores, text.as_py()) for text in batch.column(at)]
            yield batch.filter(pa.array([lang != "und" and score >= least for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
