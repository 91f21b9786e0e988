"""A corpus pipeline: language ID, quality rules, near duplicates, shared passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last
return the columns of `documents`, and others of whatever name if `docs` has any.

Defined results
---------------
- null or blank text, or no letter: the document goes in the first stage; an empty table gives an empty one;
- null lang or source: nothing special; null doc_id: judged like others, never learned from; one row stays for each
  text among them, beside a row with a doc_id, and no passage of theirs is cut or cuts others;
- rows with one doc_id: one of them stays, the one with the smallest text;
- ties: of near copies the smallest doc_id stays; of languages the smaller name wins;
- very long texts are read whole in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspark.llm import language_id, ngram_join, packing, quality_rules, substring_dedup
from loomspark.llm.common import Scratch


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go."""
    return language_id.accepted(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a risk-controlled rule or the base rejects go."""
    return quality_rules.kept_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more."""
    return ngram_join.representatives(docs, k=5, threshold=80)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that earlier documents have are cut out of `text`; `n_chars` follows. Documents of which no word is left go, even if several documents hold their words."""
    return substring_dedup.with_lengths(substring_dedup.dedup_text(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and token-budget batches."""
    return packing.pack(docs)


STAGES = [
    ("language ID", languages),
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", passages),
    ("packing", packed),
]

#: Language ID is no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for n, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.cut(stage(spark, docs, sf_dir), f"stage{n}")
    return STAGES[-1][1](spark, docs, sf_dir)
