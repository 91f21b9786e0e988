"""Queries that parse source files made of the tables' values, with their SQL.

A page gives a TypeScript, a JavaScript and a C# file, a document a Rust file; what they say stands in strings,
comments and template literals of these. A file is a list of pieces, a definition a run of pieces: so SQL has all spans.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import callgraph, connectors, hierarchy, summaries
from ..scratch import spread
from ..sources import code
from .queries import _query, table

#: By extension: the table, pieces with values in guillemets, and definitions: name, kind, first and last piece, context, visibility, doc.
FILES = {
    "ts": (
        "pages",
        ("/** Page «id».\n * About «id».\n * @see «url»\n */\n", "export ", "class C«id» extends Base {\n  items = [1];\n  ", "async load«id»_(key: string): Promise<void> {\n    return get(`«html»`);\n  }", "\n}", "\n", "export ",
         "const f«id»_ = (a: number) => {\n  return 'class no {';\n};", "\n", "interface I«id» { url: string }", "\n", "type T«id» = string | number;", "\n", "enum E«id» { A, B }", "\n"),
        (("C«id»", "class", 3, 5, None, "public", "Page «id». About «id»."), ("load«id»_", "method", 4, 4, "C«id»", "private", None), ("f«id»_", "function", 7, 8, None, "public", None), ("f«id»_", "constant", 8, 8, None, "public", None),
         ("I«id»", "interface", 10, 10, None, "private", None), ("T«id»", "interface", 12, 12, None, "private", None), ("E«id»", "enum", 14, 14, None, "private", None)),
    ),
    "js": (
        "pages",
        ("function g«id»_(x) {\n  // class no { «url»\n  return /[{]/.test(x);\n}", "\n", "class D«id» {\n  ", "run«id»_() { return g«id»_(`«html»`); }", "\n}", "\nconst no«id» = 1\n"),
        (("g«id»_", "function", 1, 1, None, "private", None), ("D«id»", "class", 3, 5, None, "private", None), ("run«id»_", "method", 4, 4, "D«id»", "private", None)),
    ),
    "cs": (
        "pages",
        ("namespace N«id» {\n/// <summary>\n/// About <b>«id»</b>.\n/// </summary>\n", "public class K«id» {\n    ", "public int P«id» { get; set; } = «id»;", "\n    ", "internal string M«id»_(int n) { return @\"«quoted»\"; }", "\n}", "\n", "struct V«id» { }", "\n}\n"),
        (("K«id»", "class", 2, 6, None, "public", "About «id»."), ("P«id»", "field", 3, 3, "K«id»", "public", None), ("M«id»_", "method", 5, 5, "K«id»", "public", None), ("V«id»", "struct", 8, 8, None, "private", None)),
    ),
    "rs": (
        "documents",
        ("/// Text «id».\n/// More.\n///\n/// # Rest\n#[derive(Clone)]\n", "pub struct S«id» { a: u8 }", "\n", "impl S«id» {\n    ", "fn get«id»_(&self) -> &str { r##\"«plain»\"## }", "\n}", "\n", "pub trait W«id» { ", "fn draw«id»_(&self);", " }", "\n",
         "const N«id»: u64 = «id»;", "\n", "enum Z«id» { A }", "\n"),
        (("S«id»", "struct", 2, 2, None, "public", "Text «id». More."), ("S«id»", "impl", 4, 6, None, "private", None), ("get«id»_", "method", 5, 5, "S«id»", "private", None), ("W«id»", "interface", 8, 10, None, "public", None),
         ("draw«id»_", "method", 9, 9, "W«id»", "private", None), ("N«id»", "constant", 12, 12, None, "private", None), ("Z«id»", "enum", 14, 14, None, "private", None)),
    ),
}
_VALUES = {
    "pages": {"id": "CAST(page_id AS STRING)", "url": "replace(coalesce(url, ''), '*', '')", "html": "replace(replace(replace(coalesce(html, ''), '`', ''), '$', ''), BACKSLASH, '')", "quoted": "replace(coalesce(html, ''), '\"', '\"\"')"},
    "documents": {"id": "CAST(doc_id AS STRING)", "plain": "replace(coalesce(text, ''), '\"', '')"},
}


def _value(source: str, name: str, spark: bool) -> str:
    """A value in the SQL of either engine, which is the same but for the backslash."""
    return _VALUES[source][name].replace("BACKSLASH", r"'\\'" if spark else r"'\'").replace("STRING", "STRING" if spark else "VARCHAR")


def _concat(source: str, piece: str) -> Column:
    parts = re.split("«(\\w+)»", piece)
    return F.concat(*[F.expr(_value(source, p, True)) if k % 2 else F.lit(p) for k, p in enumerate(parts)])


def files(spark, sf_dir) -> DataFrame:
    """path, text. Values are dealt over all cores once before files are made of them, which are parsed where they are."""
    out = None
    for source, key in {"pages": "page_id", "documents": "doc_id"}.items():
        made = [
            F.struct(F.concat(F.lit(f"{source}/"), F.expr(_value(source, "id", True)), F.lit(f".{ext}")).alias("path"), F.concat(*[_concat(source, p) for p in pieces]).alias("text"))
            for ext, (of, pieces, _) in FILES.items() if of == source
        ]
        one = spread(table(spark, sf_dir, source), key).select(F.explode(F.array(*made)).alias("file")).select("file.path", "file.text")
        out = one if out is None else out.unionByName(one)
    return out


def _chunks(spark, sf_dir, kinds: tuple[str, ...] | None = None) -> DataFrame:
    return code.definitions(files(spark, sf_dir), kinds).withColumn("chunk_id", F.xxhash64("file", "seq"))


def _sql(source: str, text: str | None) -> str:
    if text is None:
        return "NULL"
    parts = re.split("«(\\w+)»", text)
    return "(" + " || ".join(_value(source, p, False) if k % 2 else "'" + p.replace("'", "''") + "'" for k, p in enumerate(parts)) + ")"


def _files_sql() -> str:
    """file, p (pieces), d (definitions in the order of their places)."""
    out = []
    for ext, (source, pieces, found) in FILES.items():
        d = ", ".join(
            f"{{'seq': {k}, 'name': {_sql(source, name)}, 'kind': '{kind}', 'a': {a}, 'b': {b}, 'context': {_sql(source, context)}, 'visibility': '{visibility}', 'doc_summary': {_sql(source, doc)}::VARCHAR}}"
            for k, (name, kind, a, b, context, visibility, doc) in enumerate(found)
        )
        out.append(f"SELECT '{source}/' || {_value(source, 'id', False)} || '.{ext}' AS file, [{', '.join(_sql(source, p) for p in pieces)}] AS p, [{d}] AS d FROM {source}")
    return " UNION ALL ".join(out)


_FOUND = f"""WITH f AS ({_files_sql()}), r AS (SELECT file, p, unnest(d) AS d FROM f),
 s AS (SELECT file, d.seq AS seq, d.name AS name, d.kind AS kind, d.context AS context, d.visibility AS visibility, d.doc_summary AS doc_summary, array_to_string(p[1:d.a - 1], '') AS before, array_to_string(p[d.a:d.b], '') AS content FROM r),
 c AS (SELECT *, (length(before) - length(replace(before, chr(10), '')) + 1)::INTEGER AS line_start, octet_length(encode(before))::BIGINT AS byte_start FROM s)"""


@_query(_FOUND + """ SELECT file, seq, name, kind, context, visibility, doc_summary, line_start, (line_start + length(content) - length(replace(content, chr(10), '')))::INTEGER AS line_end, byte_start,
 (byte_start + octet_length(encode(content)))::BIGINT AS byte_end, sha256(content) AS hash FROM c""")
def code_chunks(spark, sf_dir):
    """All definitions of TypeScript, JavaScript, C# and Rust files that hold pages and documents."""
    return _chunks(spark, sf_dir).select("file", "seq", "name", "kind", "context", "visibility", "doc_summary", "line_start", "line_end", "byte_start", "byte_end", F.sha2("content", 256).alias("hash"))


@_query(_FOUND + """, h AS (SELECT file, name AS context, max(seq) AS holder FROM c WHERE kind IN ('class', 'struct', 'interface', 'enum') GROUP BY ALL)
 SELECT file, seq, c.name, kind, CASE WHEN kind NOT IN ('class', 'struct', 'interface', 'enum') THEN holder END AS holder, regexp_extract(file, '[^/]*$') AS file_name FROM c LEFT JOIN h USING (file, context) WHERE kind <> 'impl'""")
def code_symbols(spark, sf_dir):
    """Symbols of parsed files: impl blocks are none, members have their container."""
    return hierarchy.symbols(_chunks(spark, sf_dir)).select("file", "seq", "name", "kind", "holder", "file_name")


_CALLED = """ SELECT 'run' || page_id || '_' AS caller, 'g' || page_id || '_' AS callee, 1::BIGINT AS n FROM pages"""


@_query(_CALLED)
def code_calls(spark, sf_dir):
    """Calls among parsed files: classes and impl blocks, whose contents mention names too, are no functions."""
    return callgraph.edges(callgraph.kept(_chunks(spark, sf_dir, callgraph.KINDS)))


_FUNCTIONS = _FOUND + ", u AS (SELECT name, content, split_part(content, chr(10), 1) AS said FROM c WHERE kind IN ('function', 'method'))"


def _summarized(spark, sf_dir):
    return summaries.generate_functions(_chunks(spark, sf_dir, callgraph.KINDS), spark.createDataFrame([], summaries.SCHEMA), connectors.FirstSentence())


@_query(_FUNCTIONS + """ SELECT u.name AS key, sha256(u.content) AS body_hash, sha256(coalesce(k.said, '')) AS context_hash FROM u LEFT JOIN u k ON starts_with(u.name, 'run') AND k.name = 'g' || substring(u.name, 4)""")
def code_summaries(spark, sf_dir):
    """Function summaries of parsed files, callees first: what a method's context says is what its callee's summary says."""
    return _summarized(spark, sf_dir)[0].select("key", "body_hash", "context_hash")


@_query(_FUNCTIONS + " SELECT count(*) AS total_functions, CASE WHEN (SELECT count(*) FROM pages) > 0 THEN 2 ELSE least(count(*), 1) END::INTEGER AS levels, 0::BIGINT AS cached, count(*) AS generated FROM u")
def code_summary_stats(spark, sf_dir):
    stats = _summarized(spark, sf_dir)[1]
    return spark.createDataFrame([(stats["total_functions"], stats["levels"], stats["cached"], stats["generated"])], "total_functions long, levels int, cached long, generated long")


@_query(_FUNCTIONS + " SELECT count(*) AS total_functions, CASE WHEN (SELECT count(*) FROM pages) > 0 THEN 2 ELSE least(count(*), 1) END::INTEGER AS levels, ceil(count(*) / 50)::BIGINT AS api_calls FROM u")
def code_dry_run(spark, sf_dir):
    got = summaries.dry_run(_chunks(spark, sf_dir, callgraph.KINDS))
    return spark.createDataFrame([(got["total_functions"], got["levels"], got["api_calls"])], "total_functions long, levels int, api_calls long")
