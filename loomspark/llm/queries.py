"""The queries op1 to op13 over the tables of a folder, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (
    ann,
    chat_format,
    language_id,
    lexical,
    license_scan,
    ngram_join,
    packing,
    quality_knn,
    quality_rules,
    sentencepiece_codec,
    substring_dedup,
    url_filter,
    whitening,
)

#: The public SentencePiece vocabulary; every node has it.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(_table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digest(_table(spark, sf_dir, "documents"), PIECES)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(_table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digest(chat_format.chats(chat_format.with_probe(_table(spark, sf_dir, "conversations"))))


def op8_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.graph(_table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digest(_table(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("tier")


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_sentencepiece, op3_language_id, op4_url_filter, op5_quality_rules, op6_quality_knn,
        op7_chat_format, op8_approximate_nearest_neighbours, op9_packing, op10_ngram_jaccard_join, op11_embedding_whitening,
        op12_lexical_search, op13_license_scan,
    )
}
_WORDS = r"[^\x20\x09-\x0D]+"

_OP1 = f"""
WITH n AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM n, unnest(range(1, len(ws) - 11)) AS t(i)),
first AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
hit AS (SELECT doc_id, i FROM win JOIN first USING (s) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM hit),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM n),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY k) AS t, count(*) AS c FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT n.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(c, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM n LEFT JOIN kept USING (doc_id)
"""

_OP10 = f"""
WITH RECURSIVE n AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS sh FROM n, unnest(range(1, greatest(len(ws) - 1, least(len(ws), 1) + 1))) AS t(i)),
c AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN c a ON a.doc_id = x JOIN c b ON b.doc_id = y WHERE 100 * shared >= 90 * (a.k + b.k - shared)),
r AS (SELECT y AS doc_id, x AS low FROM e UNION SELECT x, y FROM e UNION SELECT r.doc_id, f.y FROM r JOIN (SELECT x, y FROM e UNION ALL SELECT y, x FROM e) f ON f.x = r.low)
SELECT n.doc_id, coalesce(k, 0)::BIGINT AS n_shingles, least(n.doc_id, coalesce(m, n.doc_id)) AS component_id
FROM n LEFT JOIN c USING (doc_id) LEFT JOIN (SELECT doc_id, min(low) AS m FROM r GROUP BY 1) USING (doc_id)
"""

_OP12 = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, ws, len(ws)::HUGEINT AS n FROM t WHERE len(ws) > 0),
s AS (SELECT count(*)::HUGEINT AS n_docs, sum(n) AS n_terms FROM d),
p AS (SELECT doc_id, n, w, count(*) AS tf FROM (SELECT doc_id, n, unnest(ws) AS w FROM d) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark),
f AS (SELECT w, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM p, s GROUP BY w, n_docs),
r AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score FROM q JOIN p USING (w) JOIN f USING (w), s GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= 50
"""

ORACLE_SQL: dict[str, str] = {"op1_substring_dedup": _OP1, "op5_quality_rules": quality_rules.oracle(), "op7_chat_format": chat_format.ORACLE, "op10_ngram_jaccard_join": _OP10, "op12_lexical_search": _OP12}
