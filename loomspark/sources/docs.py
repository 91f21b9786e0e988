"""Document parsers: sections of Markdown, JSON, YAML, TOML and windows of plain text, as DataFrame operations.

A section starts at a line that a format's rule marks; sections are cut inside the row of a file with array
functions, in linear time. Their places in bytes are a running sum over a file's sections.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S

WINDOW = 500
STRIDE = 400


def windows(docs: DataFrame, text: str = "text", size: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """(…, part from 1, n_parts, window): overlapping windows of code points; a text of at most `size` is one."""
    n = F.length(text)
    parts = F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - size) / stride).cast("int") + 1)
    rows = docs.withColumn("n_parts", parts).withColumn("part", F.explode(F.sequence(F.lit(1), F.col("n_parts"))))
    return rows.withColumn("window", F.substring(F.col(text), (F.col("part") - 1) * stride + 1, F.lit(size)))


def text_sections(files: DataFrame) -> DataFrame:
    """Windows as chunks: a blank or short text is one document, else paragraphs `file (part k)`."""
    file = S.file_name(F.col("path"))
    blank = F.trim(F.regexp_replace("text", r"\s+", " ")) == ""
    cut = windows(files.withColumn("text", F.when(blank, "").otherwise(F.col("text"))))
    before = F.substring(F.col("text"), F.lit(1), (F.col("part") - 1) * STRIDE)
    many = F.col("n_parts") > 1
    start = F.size(S.lines(before)) + 1
    n = F.greatest(F.size(S.lines(F.col("window"))), F.lit(1))
    return cut.select(
        "path", (F.col("part") - 1).alias("seq"),
        F.when(many, F.concat(file, F.lit(" (part "), F.col("part").cast("string"), F.lit(")"))).otherwise(file).alias("name"),
        F.when(many, "paragraph").otherwise("document").alias("kind"),
        F.when(many, start).otherwise(1).alias("line_start"), F.when(many, F.size(S.lines(F.concat(before, F.col("window"))))).otherwise(n).alias("line_end"),
        F.octet_length(before).cast("long").alias("byte_start"), (F.octet_length(before) + F.octet_length("window")).cast("long").alias("byte_end"),
        F.col("window").alias("content"), F.when(many, file).alias("context"),
    )


def _let(value: Column, body) -> Column:
    """body(value), with `value` evaluated once: a variable of a lambda, which no rule of the optimizer copies into others."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sections(files: DataFrame, starts, name, seq: int = 0, context: bool = True, trimmed: bool = True, lead_in: bool = False) -> DataFrame:
    """Section chunks: one for each line number that `starts` (lines -> array of line numbers from 0) holds, named by `name` (its line).

    Sections are cut inside the row of a file, in time linear in its lines; only they leave it. `lead_in`: what is before the first mark joins the first section.
    """

    def cut(ls, at):
        first = F.lit(0) if lead_in else F.get(at, F.lit(0))

        def one(s, k):
            begin = F.when(k == 0, first).otherwise(s)
            end = F.coalesce(F.get(at, k + 1), F.size(ls))
            return F.struct(F.get(ls, s).alias("head"), begin.alias("begin"), end.alias("end"), F.array_join(F.slice(ls, begin + 1, end - begin), "\n").alias("raw"))

        before = F.when(first > 0, F.octet_length(F.array_join(F.slice(ls, F.lit(1), first), "\n")) + 1).otherwise(0)
        return F.struct(F.size(ls).alias("n"), before.cast("long").alias("before"), F.transform(at, one).alias("parts"))

    rows = files.select("path", F.octet_length("text").cast("long").alias("size"), _let(S.lines(F.col("text")), lambda ls: _let(starts(ls), lambda at: cut(ls, at))).alias("c"))
    rows = rows.select("path", "size", "c.n", "c.before", F.posexplode("c.parts").alias("nth", "s"))
    rows = rows.select("path", "n", "size", "before", "nth", "s.*")
    run = Window.partitionBy("path").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("through", F.col("before") + F.sum(F.octet_length("raw").cast("long") + 1).over(run))
    file = S.file_name(F.col("path"))
    return rows.select(
        "path", (F.col("nth") + seq).cast("int").alias("seq"), name(F.col("head"), file).alias("name"), F.lit("section").alias("kind"),
        (F.col("begin") + 1).cast("int").alias("line_start"), F.col("end").cast("int").alias("line_end"),
        (F.col("through") - F.octet_length("raw") - 1).alias("byte_start"), F.when(F.col("end") == F.col("n"), F.col("size")).otherwise(F.col("through")).alias("byte_end"),
        (F.regexp_replace("raw", r"^\s+|\s+\z", "") if trimmed else F.col("raw")).alias("content"), (file if context else F.lit(None).cast("string")).alias("context"), "n",
    )


def _numbers(ls: Column, test) -> Column:
    """The numbers of the lines that pass `test` (line, number)."""
    return F.filter(F.transform(ls, lambda x, i: F.when(test(x, i), i)), lambda i: i.isNotNull())


def _or(name: Column, otherwise: Column) -> Column:
    return F.when(name == "", otherwise).otherwise(name)


def markdown_sections(files: DataFrame) -> DataFrame:
    """The whole document, then a section for each line that starts with # outside of fences."""
    n = F.greatest(F.size(S.lines(F.col("text"))), F.lit(1))
    whole = files.select(
        "path", F.lit(0).alias("seq"), S.file_name(F.col("path")).alias("name"), F.lit("document").alias("kind"), F.lit(1).alias("line_start"), n.alias("line_end"),
        F.lit(0).cast("long").alias("byte_start"), F.octet_length("text").cast("long").alias("byte_end"), F.col("text").alias("content"), F.lit(None).cast("string").alias("context"),
    )
    fence = lambda x: F.ltrim(x).rlike(r"^(```|~~~)")

    def starts(ls):
        marks = _numbers(ls, lambda x, i: x.startswith("#"))
        # what lies between the first and the second fence, the third and the fourth, …; the last may be open
        pairs = lambda f: F.sequence(F.lit(0), F.floor((F.size(f) - 1) / 2).cast("int"))
        inside = lambda f: F.flatten(F.transform(pairs(f), lambda k: F.sequence(F.get(f, 2 * k), F.coalesce(F.get(f, 2 * k + 1), F.size(ls)))))
        return _let(_numbers(ls, lambda x, i: fence(x)), lambda f: F.when(F.size(f) == 0, marks).otherwise(F.array_except(marks, inside(f))))

    named = lambda head, file: _or(F.trim(F.regexp_replace(F.trim(head), "^#+", "")), F.lit("Untitled Section"))
    return whole.unionByName(_sections(files, starts, named, seq=1, context=False, trimmed=False).drop("n"))


def _key_line(x: Column) -> Column:
    return (x != "") & ~x.rlike(r"^([ \t#]|---|\.\.\.)")


def yaml_sections(files: DataFrame) -> DataFrame:
    """A section for each line that starts a top-level key; what is before the first joins it."""
    named = lambda head, file: _or(F.trim(F.substring_index(head, ":", 1)), file)
    return _sections(files, lambda ls: _numbers(ls, lambda x, i: _key_line(x)), named, lead_in=True).drop("n")


def toml_sections(files: DataFrame) -> DataFrame:
    """A section for each table line; what is before the first is `root`; a blank last section goes, a blank first one stays."""
    table = lambda x: F.trim(x).startswith("[") & ~F.trim(x).startswith("[#")
    named = lambda head, file: _or(F.when(table(head), F.trim(F.regexp_replace(F.trim(head), r"^\[+|\]+$", ""))).otherwise(F.lit("")), F.lit("root"))
    return _sections(files, lambda ls: _numbers(ls, lambda x, i: table(x) | (i == 0)), named).where("content <> '' OR line_end < n").drop("n")


@F.pandas_udf(T.StringType())
def _pretty(values):
    return values.map(lambda v: None if v is None else json.dumps(json.loads(v), indent=2, ensure_ascii=False, sort_keys=True))


def json_keys(rows: DataFrame, text: str = "text") -> DataFrame:
    """(…, pos, key, value): the top level of JSON objects, keys in order; other values give no row."""
    parsed = rows.withColumn("__v", F.try_parse_json(F.col(text))).where(F.schema_of_variant("__v").startswith("OBJECT"))
    names = ", ".join(f"`{c}`" for c in rows.columns)
    return rows.sparkSession.sql(f"SELECT {names}, pos, key, to_json(value) AS value FROM {{rows}}, LATERAL variant_explode(__v)", rows=parsed)


def json_sections(files: DataFrame) -> DataFrame:
    """A section `key:` and its pretty value for each key of an object."""
    rows = json_keys(files.select("path", "text"), "text")
    content = F.concat("key", F.lit(":\n"), _pretty("value"))
    rows = rows.withColumn("content", content)
    return rows.select(
        "path", F.col("pos").cast("int").alias("seq"), F.col("key").alias("name"), F.lit("section").alias("kind"), F.lit(1).alias("line_start"),
        F.greatest(F.size(S.lines(F.col("content"))), F.lit(1)).alias("line_end"), F.lit(0).cast("long").alias("byte_start"),
        F.octet_length("content").cast("long").alias("byte_end"), "content", S.file_name(F.col("path")).alias("context"),
    )


def sections(files: DataFrame) -> DataFrame:
    """Chunks of document files (path, text), by the lower-cased extension; what a format cannot split goes to text windows."""
    files = files.select("path", "text").where("text is not null").withColumn("ext", F.lower(S.extension(F.col("path"))))
    blank = ~F.col("text").rlike(r"\S")
    md = markdown_sections(files.where(F.col("ext").isin("md", "mdx")))
    yaml, toml = files.where(F.col("ext").isin("yaml", "yml") & ~blank), files.where((F.col("ext") == "toml") & ~blank)
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json("text")).startswith("OBJECT<") & (F.schema_of_variant(F.try_parse_json("text")) != "OBJECT<>"), F.lit(False))
    objects = files.where((F.col("ext") == "json") & is_object)
    keyed = yaml.where(F.exists(S.lines(F.col("text")), _key_line))
    plain = (
        files.where(~F.col("ext").isin("md", "mdx", "yaml", "yml", "toml", "json") | (F.col("ext").isin("yaml", "yml", "toml") & blank))
        .unionByName(files.where((F.col("ext") == "json") & ~is_object))
        .unionByName(yaml.where(~F.exists(S.lines(F.col("text")), _key_line)))
    )
    out = md
    for part in (json_sections(objects), yaml_sections(keyed), toml_sections(toml), text_sections(plain)):
        out = out.unionByName(part)
    none = F.lit(None).cast("string")
    return out.select(
        F.lit("doc").alias("chunk_type"), "name", "kind", F.col("path").alias("file"), F.col("seq").cast("int").alias("seq"), F.col("line_start").cast("int").alias("line_start"),
        F.col("line_end").cast("int").alias("line_end"), "byte_start", "byte_end", "content", "context", none.alias("signature"), none.alias("doc_summary"), F.lit("private").alias("visibility"),
    )
