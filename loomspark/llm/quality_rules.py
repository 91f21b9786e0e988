"""Quality rules with risk-controlled thresholds, in SQL functions only.

A rule is a rate (higher is worse) and a fixed, ordered list of cutoffs, loosest first. Labelled
documents of quality 1 are the holdout: per stratum (a band of text lengths) and rule, the cutoffs
are tested in order with the exact binomial bound, and the strictest one before the first
failure is taken. A test passes if P(Binomial(n, risk) <= false rejections) <= level. The order
of tests is fixed, so within a rule no correction is due; over rules and strata it is Bonferroni's:
level = (1 - CONFIDENCE) / (strata * rules). Each rule has an equal share of RISK, so together they falsely
reject at most RISK of a stratum's good documents, with the confidence CONFIDENCE over all strata.
A rule that has too few labels in a stratum rejects nothing there.

Counts come from all labelled documents; what comes to the driver is one row for each stratum.

Defined results
---------------
- null or blank text: all counts 0, base_failed (fewer than 20 words), not kept;
- fewer than 8 words: n_repeat_words 0;
- labels: null doc_id or quality are ignored; a doc_id labelled twice is good if any label is 1;
- no labels: no rule rejects, kept is the base's verdict;
- null doc_id: judged, never in the holdout; rows with the same doc_id each get their own row;
- other columns of the input are ignored by `judge` and carried by `kept_rows`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

WINDOW = 8
MIN_WORDS = 20
RISK = 0.05
CONFIDENCE = 0.95
#: Lower ends of the strata, in words.
STRATA = (20, 100, 400)
#: Rule -> (rate, cutoffs from loose to strict).
RULES = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", (0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01)),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", (0.28, 0.25, 0.22, 0.2, 0.17, 0.15, 0.12, 0.1)),
    "lines": ("n_dup_lines / greatest(n_lines, 1)", (0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2)),
    "capitals": ("n_capitals / greatest(word_chars, 1)", (0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2)),
    "vocabulary": ("1 - n_distinct_words / greatest(n_words, 1)", (0.98, 0.96, 0.94, 0.92, 0.9, 0.88, 0.85)),
}


def _let(name: str, value: str, body: str) -> str:
    """SQL for `body` in which `name` is `value`, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _repeated(words: str) -> str:
    """SQL for the number of words in windows that occur twice or more."""
    k = WINDOW
    windows = f"transform(sequence(1, size({words}) - {k - 1}), i -> xxhash64(slice({words}, i, {k})))"
    order = "sort_array(transform(h, (v, i) -> struct(v AS v, i AS i)))"
    twice = "get(s, k - 1).v <=> s[k].v OR get(s, k + 1).v <=> s[k].v"
    places = f"sort_array(transform(filter(sequence(0, size(s) - 1), k -> {twice}), k -> s[k].i))"
    covered = f"aggregate(sequence(1, size(p) - 1), {k}L, (n, k) -> n + least({k}, p[k] - p[k - 1]))"
    some = _let("s", order, _let("p", places, covered))
    return f"if(size({words}) < {k}, 0L, {_let('h', windows, f'if(size(array_distinct(h)) = size(h), 0L, {some})')})"


def counts(text: str = "text") -> Column:
    """struct of the counts of a text."""
    space = r"\\x20\\x09-\\x0D"
    t = f"coalesce({text}, '')"
    return F.expr(
        _let("t", t, _let("w", f"regexp_extract_all(t, '[^{space}]+', 0)", _let("l", f"filter(split(t, '\\n'), x -> x rlike '[^{space}]')", f"""struct(
            cast(size(w) AS bigint) AS n_words,
            cast(length(array_join(w, '')) AS bigint) AS word_chars,
            cast(size(split(t, '[#*$%&|<>]')) - 1 AS bigint) AS n_symbols,
            cast(size(l) - size(array_distinct(l)) AS bigint) AS n_dup_lines,
            {_repeated("w")} AS n_repeat_words,
            cast(size(l) AS bigint) AS n_lines,
            cast(length(t) - length(regexp_replace(t, '\\\\p{{Lu}}+', '')) AS bigint) AS n_capitals,
            cast(size(array_distinct(w)) AS bigint) AS n_distinct_words)""")))
    )


def _with_counts(docs: DataFrame) -> DataFrame:
    failed = F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > 30 * n_words").alias("base_failed")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), counts().alias("c"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_distinct_words")
    return rows.select("doc_id", *[f"c.{n}" for n in names]).select("doc_id", *names, failed)


def below(n: int, k: int, p: float) -> float:
    """P(Binomial(n, p) <= k), summed from exact terms."""
    if k >= n:
        return 1.0
    terms, log_term = [], n * math.log1p(-p)
    odds = math.log(p) - math.log1p(-p)
    for i in range(k + 1):
        terms.append(math.exp(log_term))
        log_term += math.log(n - i) - math.log(i + 1) + odds
    return min(1.0, math.fsum(terms))


def _stratum(n_words: Column) -> Column:
    return sum(((n_words >= low).cast("int") for low in STRATA), F.lit(0))


def thresholds(rows: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE) -> dict[tuple[int, str], float]:
    """(stratum, rule) -> cutoff, for those that pass; from `rows` with counts and `labels` (doc_id, quality)."""
    good = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    good = good.agg(F.max((F.col("quality") == 1).cast("int")).alias("good")).where("good = 1").select("doc_id")
    held = rows.where("NOT base_failed").join(good, "doc_id").withColumn("stratum", _stratum(F.col("n_words")))
    false = [F.sum(F.expr(f"int({rate} > {c}D)")).alias(f"{name}_{i}") for name, (rate, cutoffs) in RULES.items() for i, c in enumerate(cutoffs)]
    level = (1 - confidence) / (len(STRATA) * len(RULES))
    found = {}
    for row in held.groupBy("stratum").agg(F.count("*").alias("n"), *false).collect():
        for name, (_, cutoffs) in RULES.items():
            for i, c in enumerate(cutoffs):
                if below(row["n"], row[f"{name}_{i}"], risk / len(RULES)) > level:
                    break
                found[row["stratum"], name] = c
    return found


def _rejected(found: dict[tuple[int, str], float]) -> Column:
    tests = [(_stratum(F.col("n_words")) == s) & (F.expr(RULES[name][0]) > F.lit(c)) for (s, name), c in sorted(found.items())]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every row of `docs` (doc_id, text)."""
    rows = Scratch(docs.sparkSession, "rules").cut(_with_counts(docs), "counts")
    found = thresholds(rows, labels)
    return rows.withColumn("kept", ~F.col("base_failed") & ~F.when(F.col("base_failed"), False).otherwise(_rejected(found)))


def kept_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that neither the base nor a rule rejects."""
    found = thresholds(Scratch(docs.sparkSession, "rules").cut(_with_counts(docs), "counts"), labels)
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    rows = plain.withColumn("__c", counts(f"c{docs.columns.index('text')}")).select(*plain.columns, "__c.*")
    rows = rows.where(f"n_words >= {MIN_WORDS} AND 100 * n_repeat_words <= 30 * n_words").where(~_rejected(found))
    return rows.select(*plain.columns).toDF(*docs.columns)


def oracle() -> str:
    """The whole operator in DuckDB's SQL, from the same rules."""
    word = r"[^\x20\x09-\x0D]"
    stratum = " + ".join(f"(n_words >= {low})::INTEGER" for low in STRATA)
    tests = ", ".join(f"('{name}', {i}, {c})" for name, (_, cutoffs) in RULES.items() for i, c in enumerate(cutoffs))
    rates = " ".join(f"WHEN '{name}' THEN {rate}" for name, (rate, _) in RULES.items())
    risk, level = RISK / len(RULES), (1 - CONFIDENCE) / (len(STRATA) * len(RULES))
    term = f"exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk!r}) + (n - i) * ln(1 - {risk!r}))"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM t, unnest(range(1, len(w) - {WINDOW - 2})) AS x(i)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
again AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS k FROM twice) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS l FROM t),
c AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
  (length(t) - length(regexp_replace(t, '\\p{{Lu}}', '', 'g')))::BIGINT AS n_capitals, len(list_distinct(w))::BIGINT AS n_distinct_words FROM t JOIN l USING (doc_id) LEFT JOIN again USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 30 * n_words AS base_failed, {stratum} AS stratum FROM c),
rules(rule, i, cutoff) AS (VALUES {tests}),
r AS (SELECT doc_id, stratum, rule, CASE rule {rates} END AS rate FROM b, (SELECT DISTINCT rule FROM rules) WHERE NOT base_failed),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING max((quality = 1)::INTEGER) = 1),
k AS (SELECT stratum, rule, i, cutoff, count(*) AS n, count(*) FILTER (rate > cutoff) AS k FROM r SEMI JOIN good USING (doc_id) JOIN rules USING (rule) GROUP BY ALL),
p AS (SELECT stratum, rule, i, cutoff, CASE WHEN k >= n THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i: {term})) END <= {level!r} AS passed FROM k),
q AS (SELECT *, bool_and(passed) OVER (PARTITION BY stratum, rule ORDER BY i) AS held FROM p),
chosen AS (SELECT stratum, rule, max_by(cutoff, i) AS cutoff FROM q WHERE held GROUP BY ALL),
bad AS (SELECT DISTINCT doc_id FROM r JOIN chosen USING (stratum, rule) WHERE rate > cutoff)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, n_distinct_words, base_failed, NOT base_failed AND bad.doc_id IS NULL AS kept FROM b LEFT JOIN bad USING (doc_id)
"""
