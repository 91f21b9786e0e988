"""Scalar column functions: previews, names, paths, sort keys, vectors, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions by kind, the names of languages, kinds of symbols, their order and prefixes, as the data model has them.
CODE_EXTENSIONS = ("rs", "ts", "tsx", "js", "jsx", "cs", "py")
DOC_EXTENSIONS = ("md", "mdx", "txt", "json", "yaml", "yml", "toml", "xml", "rst")
LANGUAGES = {"Rust": ("rs",), "TypeScript": ("ts", "tsx"), "JavaScript": ("js", "jsx"), "Python": ("py",), "C#": ("cs",)}
KINDS = ("class", "struct", "impl", "interface", "enum", "function", "method", "constant", "field", "document", "section", "paragraph")
SORT_KEYS = {"class": 0, "struct": 0, "interface": 1, "enum": 2, "function": 3, "method": 4, "constant": 5, "field": 6}
KIND_PREFIXES = {"class": "class ", "struct": "struct ", "interface": "trait ", "enum": "enum ", "function": "fn ", "method": "fn ", "constant": "const ", "field": "field "}

PREVIEW_LINES = 5
EMBED_CHARS = 500
CHARS_PER_TOKEN = 4
HEADER_TOKENS = 50


def _choose(value: Column, table: dict, otherwise) -> Column:
    out = None
    for key, then in table.items():
        out = F.when(value == key, F.lit(then)) if out is None else out.when(value == key, F.lit(then))
    return out.otherwise(F.lit(otherwise))


def lines(text: Column) -> Column:
    """Lines without their ends; a last line feed opens no line, and one carriage return before a line feed goes."""
    cut = F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n", -1)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(cut)


def preview(text: Column, n: int = PREVIEW_LINES) -> Column:
    ls = lines(text)
    head = F.array_join(F.slice(ls, 1, n), "\n")
    return F.when(F.size(ls) > n, F.concat(head, F.lit("\n..."))).otherwise(head)


def embedding_text(chunk_type: Column, kind: Column, name: Column, content: Column) -> Column:
    """What is embedded for a chunk: its kind (code only), name and first characters."""
    head = F.substring(content, 1, EMBED_CHARS)
    return F.when(chunk_type == "code", F.concat(F.initcap(kind), F.lit(" "), name, F.lit(": "), head)).otherwise(F.concat(name, F.lit(": "), head))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; 0 for unequal or no length, a zero norm, or a result that is not finite."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, p: s + p * p))
    value = F.try_divide(dot, norm(x) * norm(y))
    fine = (F.size(a) == F.size(b)) & (F.size(a) > 0) & value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(fine, value).otherwise(F.lit(0.0))


def qualified(name: str) -> tuple[str | None, str]:
    """A looked-up name, cut at its last dot into (context, member); both sides have to be there."""
    context, dot, member = name.rpartition(".")
    return (context, member) if dot and context and member else (None, name)


def dir_path(path: Column) -> Column:
    """What is before the last slash, or a dot."""
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)).otherwise(F.lit("."))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def relative(path: Column, root: str | Column) -> Column:
    """The path below a root, which may differ by row; other paths stay."""
    prefix = F.concat(F.rtrim(F.lit(root) if isinstance(root, str) else root, F.lit("/")), F.lit("/"))
    return F.when(F.startswith(path, prefix), F.substring(path, F.length(prefix) + 1, F.length(path))).otherwise(path)


def extension(path: Column) -> Column:
    """After the last dot of the file's name, which may not start it."""
    return F.regexp_extract(file_name(path), r"(?s)^.+\.([^.]*)$", 1)


def chunk_type(path: Column) -> Column:
    """code, doc or null, by the lower-cased extension."""
    ext = F.lower(extension(path))
    return F.when(ext.isin(*CODE_EXTENSIONS), "code").when(ext.isin(*DOC_EXTENSIONS), "doc")


def language(path: Column) -> Column:
    ext = extension(path)
    out = None
    for name, exts in LANGUAGES.items():
        test = ext.isin(*exts)
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out.otherwise(F.lit("Other"))


def language_key(lang: Column) -> Column:
    return _choose(lang, {name: i for i, name in enumerate(LANGUAGES)}, len(LANGUAGES))


def symbol_key(kind: Column) -> Column:
    return _choose(kind, SORT_KEYS, 7)


def kind_prefix(kind: Column) -> Column:
    return _choose(kind, KIND_PREFIXES, "")


def recommendation(pending: Column) -> Column:
    # fixed values: the numbers and names of the steps
    return F.when(pending == 0, "none").when(pending <= 100, "sync").when(pending <= 500, "sync_acceptable").otherwise("background")


def clip_bytes(text: Column, most: int) -> Column:
    """The longest prefix of whole characters of at most `most` bytes."""
    fits = F.filter(F.sequence(F.lit(most), F.lit(max(0, most - 3)), F.lit(-1)), lambda n: F.is_valid_utf8(F.substring(F.encode(text, "UTF-8"), F.lit(1), n).cast("string")))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.substring(F.encode(text, "UTF-8"), F.lit(1), F.get(fits, F.lit(0))).cast("string"))


def short_signature(signature: Column, most: int = 70) -> Column:
    """A signature without leading modifiers and its last brace or semicolon, cut by bytes."""
    out = F.trim(signature)
    for word in ("pub", "async", "export", "function"):
        out = F.regexp_replace(out, f"^(?:{word} )+", "")
    out = F.trim(F.regexp_replace(F.regexp_replace(out, r"\{+$", ""), r";+$", ""))
    return F.when(F.octet_length(out) <= most, out).otherwise(F.concat(clip_bytes(out, most - 3), F.lit("...")))


def names_preview(names: Column, most: int = 60) -> Column:
    """A comma list of names up to `most` bytes, then dots."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("size"), F.lit(False).alias("full"))

    def step(acc, name):
        more = F.octet_length(name) + F.when(F.size(acc["out"]) == 0, 0).otherwise(2)
        over = acc["full"] | (acc["size"] + more > most)
        added = F.when(acc["full"], acc["out"]).when(over, F.concat(acc["out"], F.array(F.lit("...")))).otherwise(F.concat(acc["out"], F.array(name)))
        return F.struct(added.alias("out"), F.when(over, acc["size"]).otherwise(acc["size"] + more).alias("size"), over.alias("full"))

    return F.array_join(F.aggregate(names, start, step, lambda acc: acc["out"]), ", ")


def symbol_cost(name: Column, signature: Column) -> Column:
    """Bytes of a symbol's line in a map, about."""
    return F.octet_length(name) + 10 + F.coalesce(F.least(F.lit(80), F.octet_length(signature)), F.lit(0))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def set_hash(parts: Column, separator: str) -> Column:
    """Hash of a set of strings, whatever their order."""
    return F.sha2(F.array_join(F.array_sort(parts), separator), 256)


def first_paragraph(text: Column) -> Column:
    """Lines up to the first blank one, trimmed and joined by spaces."""
    trimmed = F.transform(lines(text), lambda x: F.trim(x))
    head = F.aggregate(
        trimmed, F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("end")),
        lambda a, x: F.when(a["end"] | ((x == "") & (F.size(a["out"]) > 0)), F.struct(a["out"].alias("out"), F.lit(True).alias("end")))
        .when(x == "", a).otherwise(F.struct(F.concat(a["out"], F.array(x)).alias("out"), F.lit(False).alias("end"))),
        lambda a: a["out"],
    )
    return F.array_join(head, " ")


def without_tags(xml: Column) -> Column:
    """Text of a piece of XML, white space normalised."""
    return F.trim(F.regexp_replace(F.regexp_replace(xml, r"<[^>]*>", ""), r"\s+", " "))


def xml_summary(xml: Column) -> Column:
    body = without_tags(F.regexp_extract(xml, r"(?s)<summary>(.*?)</summary>", 1))
    return F.when(body == "", None).otherwise(body)


def calls(text: Column) -> Column:
    """Names that stand before an opening bracket, in order."""
    return F.regexp_extract_all(text, F.lit(r"(\w+)\s*\("), F.lit(1))


def snippet(text: Column, name: str) -> Column:
    """The first line that holds a name, trimmed."""
    return F.trim(F.get(F.filter(lines(text), lambda x: x.contains(name)), F.lit(0)))
