"""Search and lookup over a table of chunks (schema: loomspark.sources.schemas.CHUNKS)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..scratch import Scratch

NO_QUERY = "Please provide a search query"
NOT_FOUND = "Symbol not found"


def chosen_type(value: str | None) -> str | None:
    """code, doc (or docs), in any case; None for no filter."""
    if value is None:
        return None
    low = value.lower()
    if low == "code":
        return "code"
    if low in ("doc", "docs"):
        return "doc"
    raise ValueError(f"unknown type {value!r}: code, doc or docs")


def type_of_flags(code_only: bool, docs_only: bool) -> str | None:
    """One flag chooses a type; both or neither choose none."""
    return None if code_only == docs_only else "code" if code_only else "doc"


def only(chunks: DataFrame, kind: str | None) -> DataFrame:
    return chunks if kind is None else chunks.where(F.col("chunk_type") == kind)


def name_points(query: str, name: Column, content: Column) -> Column:
    """Tenths of a name score, as whole numbers, so that equal sums are equal."""
    q, low, body = query.lower(), F.lower(name), F.lower(content)
    points = F.when(low == q, 10).when(low.contains(q), 8).when(F.lit(q).contains(low), 6).otherwise(0)
    for word in q.split():  # a word that is twice in the query counts twice
        points = points + F.when(low.contains(word), 3).otherwise(0) + F.when(body.contains(word), 1).otherwise(0)
    return points


def _top(scored: DataFrame, score: str, k: int) -> DataFrame:
    """The k best, ties to the smaller chunk_id; only they are numbered."""
    best = scored.orderBy(F.desc(score), "chunk_id").limit(k)
    # k rows: the one window without a partition is over them
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), "chunk_id")))


def ranked_by_name(chunks: DataFrame, query: str, top: int = 5, kind: str | None = None) -> DataFrame:
    rows = only(chunks, chosen_type(kind)).withColumn("points", name_points(query, F.col("name"), F.col("content"))).where("points > 0")
    return _top(rows, "points", max(0, top))


def shown_by_name(best: DataFrame, among: DataFrame) -> DataFrame:
    return _with_unique(best, among).withColumn("score", F.col("points") / F.lit(10.0)).withColumn("preview", S.preview(F.col("content")))


def search_by_name(chunks: DataFrame, query: str, top: int = 5, kind: str | None = None) -> DataFrame:
    """Ranked chunks; `unique`: no other chunk of the whole table has the name."""
    return shown_by_name(ranked_by_name(chunks, query, top, kind), chunks)


def _with_unique(best: DataFrame, among: DataFrame) -> DataFrame:
    """Counts the names of the k found rows only: their names, broadcast (k rows), reduce the scan to its matches."""
    names = best.select("name").distinct()
    counts = among.select("name").join(F.broadcast(names), "name", "left_semi").groupBy("name").count()
    return best.join(F.broadcast(counts), "name", "left").withColumn("unique", F.col("count") == 1).drop("count")


def search_semantic(chunks: DataFrame, embeddings: DataFrame, vector: Sequence[float], top: int = 5, kind: str | None = None, among: DataFrame | None = None) -> DataFrame:
    """Ranked chunks by cosine; `unique` is judged after the filter. Vectors of other lengths than the query's score 0.

    `among`: the chunks whose names count, if `embeddings` holds candidates only; else those that have vectors.
    """
    rows = only(chunks, chosen_type(kind)).join(embeddings.select("chunk_id", "embedding"), "chunk_id")
    q = F.array(*[F.lit(float(v)) for v in vector]) if vector else F.array().cast("array<double>")
    best = _top(rows.withColumn("score", S.cosine(F.col("embedding"), q)), "score", max(0, top) if vector else 0)
    return _with_unique(best.drop("embedding"), rows if among is None else among).withColumn("preview", S.preview(F.col("content")))


def search(
    chunks: DataFrame, query: str, top: int = 5, kind: str | None = None, embeddings: DataFrame | None = None, embed: Callable[[str], Sequence[float]] | None = None,
    by_name: Callable[..., DataFrame] | None = None,
) -> tuple[DataFrame, str | None]:
    """(result, suggestion): by meaning if there is an embedder and every chunk has a vector, else by name.

    `by_name` (query, top, kind) searches an index with lists; else all chunks are scored.
    """
    by_name = by_name or (lambda *asked: search_by_name(chunks, *asked))
    if not query.strip():
        return search_by_name(chunks.limit(0), "-", 0), NO_QUERY
    if embed is None or embeddings is None:
        return by_name(query, top, kind), "Using name-based search (no embedder)."
    pending = chunks.join(embeddings.select("chunk_id"), "chunk_id", "left_anti").count()
    if pending:
        return by_name(query, top, kind), f"Using name-based search ({pending} chunks pending embeddings). Embed them for semantic search."
    try:
        vector = cached(embed)(query)
    except Exception as e:  # noqa: BLE001  a connector's failure is no failure of the search
        return by_name(query, top, kind), f"Using name-based search ({e})."
    return search_semantic(chunks, embeddings, vector, top, kind), None


_CACHES: dict = {}


def cached(embed: Callable[[str], Sequence[float]]):
    """Vectors of the last 100 queries of an embedder."""
    return _CACHES.setdefault(embed, lru_cache(maxsize=100)(lambda q: tuple(embed(q))))


def cache_size(embed: Callable[[str], Sequence[float]] | None) -> int:
    """How many query vectors are kept of an embedder."""
    return cached(embed).cache_info().currsize if embed in _CACHES else 0


def lookup(chunks: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    """Definitions of a symbol, `Context.member` or plain, in the order of chunk_id, with match_type, confidence and suggestion."""
    context, member = S.qualified(name)
    found = only(chunks, chosen_type(kind)).where(F.col("name") == member)
    if context is not None:
        found = found.where(F.col("context") == context)
    return _judged(found)


def _judged(found: DataFrame) -> DataFrame:
    n = F.broadcast(found.agg(F.count("*").alias("n")))
    one = F.col("n") == 1
    return found.join(n, F.lit(True)).select(
        "chunk_id", "chunk_type", "kind", "file", "line_start", "line_end", "signature", "context", S.preview(F.col("content")).alias("preview"),
        F.when(one, "exact").otherwise("name_only").alias("match_type"), F.when(one, "high").otherwise("low").alias("confidence"),
        F.when(~one, F.concat(F.col("n").cast("string"), F.lit(" homonyms found, use Class.Method to qualify"))).alias("suggestion"),
    ).orderBy("chunk_id")


def lookup_output(chunks: DataFrame, name: str, kind: str | None = None) -> dict:
    """The answer as one object: no definition is an answer, too."""
    rows = [r.asDict() for r in lookup(chunks, name, kind).collect()]
    if not rows:
        return {"definitions": [], "match_type": "name_only", "confidence": "low", "suggestion": NOT_FOUND}
    head = {k: rows[0][k] for k in ("match_type", "confidence", "suggestion")}
    return {"definitions": [{k: v for k, v in r.items() if k not in head} for r in rows], **head}


def lookup_fuzzy(chunks: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    """Names that hold the member, in any case; the context too, if given, in any case; candidates as `Context.name`."""
    context, member = S.qualified(name)
    found = only(chunks, chosen_type(kind)).where(F.lower("name").contains(member.lower()))
    if context is not None:
        found = found.where(F.lower("context") == context.lower())
    return found.withColumn("candidate", F.concat_ws(".", "context", "name")).orderBy("chunk_id")


def references(chunks: DataFrame, name: str) -> DataFrame:
    """Chunks that mention a name and do not define it, with the first such line."""
    defined = chunks.where(F.col("name") == name).select("file", "line_start")
    return chunks.where(F.col("content").contains(name)).join(defined, ["file", "line_start"], "left_anti").withColumn("snippet", S.snippet(F.col("content"), name))


def dependencies(chunks: DataFrame, name: str, direction: str = "both") -> DataFrame:
    """(direction, name, file, line): what a symbol calls, and what mentions it."""
    called = chunks.where(F.col("name") == name).select("file", "line_start", F.posexplode(S.lines(F.col("content"))).alias("at", "line"))
    called = called.select("file", (F.col("line_start") + F.col("at")).alias("line_no"), F.explode(S.calls(F.col("line"))).alias("callee"))
    called = called.where(F.col("callee") != name).select(F.lit("calls").alias("direction"), F.col("callee").alias("name"), "file", F.col("line_no").cast("long").alias("line"))
    by = references(chunks, name).select(F.lit("called_by").alias("direction"), "name", "file", F.col("line_start").cast("long").alias("line"))
    return {"calls": called, "called_by": by, "both": called.unionByName(by)}[direction]


def outline(chunks: DataFrame, file: str) -> DataFrame:
    """Sections or symbols of a file, with their spans."""
    return chunks.where(F.col("file") == file).select("kind", "name", "context", "line_start", "line_end", "chunk_id").orderBy("chunk_id")


def duplicate_names(chunks: DataFrame) -> DataFrame:
    """Names of more than one chunk, with their counts."""
    return chunks.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")


def uniqueness(chunks: DataFrame) -> DataFrame:
    """How many chunks have the same name: counted before they are joined, so that a name that most have is no single task."""
    n = chunks.groupBy(F.col("name").alias("__name")).agg(F.count("*").alias("n_same"))
    return chunks.join(n, F.col("name").eqNullSafe(F.col("__name"))).drop("__name").withColumn("unique", F.col("n_same") == 1)


def interned(rows: DataFrame, value: str, order: str) -> DataFrame:
    """(value, id): ids from 0 in the order of first sight."""
    first = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(order).alias("first"))
    return Scratch(rows.sparkSession, "interned").numbered(first, "id", "first", value).select(value, "id")
