"""Queries that write the pages as a tree of files and keep an index of it, with their SQL.

A tree has two states: of each five pages, the first file stays, the second is touched, the third gets another
content, the fourth goes and the fifth comes. Names start with a letter, an underscore or a point.
"""

from __future__ import annotations

import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import connectors, index, search
from ..scratch import shared_folder, spread
from ..sources import scan, schemas
from ..streaming import changes
from .queries import _WINDOWS, _query, table, window_chunks

_KINDS = (".md", ".RS", ".py", ".bin", ".json", ".toml", ".txt", "", ".rs")
_EXTRA = {
    "node_modules/a.js": b"x", "src/target/t.rs": b"x", ".git/config.txt": b"x", ".github/ci.yml": b"on: push\n", "pkg/__init__.py": b"", "pkg/_private/c.py": b"c = 1\n", "_x.md": b"# x\n",
    "exact.txt": b"x" * scan.MAX_BYTES, "over.txt": b"x" * (scan.MAX_BYTES + 1), "bad.rs": b"\xff\xfe", "a b+c%20.txt": b"x",
}


def _content(page_id: int, kind: str, more: str) -> str:
    n = str(page_id)
    return {
        ".md": f"intro {n}\n# Title {n}\nbody{more}\n", ".RS": f"fn f{n}() {{}}\n{more}", ".rs": f"/// Says {n}.\npub fn f{n}(a: u8) {{ g(a) }}\n{more}",
        ".py": f'class C{n}:\n    """Holds {n}."""\n    def _m(self):\n        return 1{more}\n', ".json": f'{{"b": {n}, "a": "{more}"}}', ".toml": f"x = {n}\n[t{n}]\ny = 1\n{more}",
    }.get(kind, f"text {n}{more}")


def _write(pages: DataFrame, root: str, state: int) -> None:
    """The files of one state, each written by the task that holds its page; a task that is run again writes the same."""

    def run(frames):
        for pdf in frames:
            for n in pdf["page_id"]:
                path = os.path.join(root, f"s{n % 13}", f"{('', '_', '.')[n % 3]}p{n}{_KINDS[n % 9]}")
                part = n % 5
                if part == (3 if state else 4):
                    if os.path.exists(path):
                        os.remove(path)
                    continue
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "w") as f:
                    f.write(_content(n, _KINDS[n % 9], "+" if state and part == 2 else ""))
                when = 2_000_000 if state and part in (1, 2, 4) else 1_000_000
                os.utime(path, (when, when))
            yield pdf[["page_id"]]

    spread(pages.select("page_id"), "page_id").mapInPandas(run, "page_id long").agg(F.count("*")).collect()


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """The pages, and the root of their tree in its first state; it is in the folder that all nodes share."""
    shared = shared_folder(spark).removeprefix("file://").removeprefix("file:")
    if "://" in shared:
        raise ValueError("a tree needs a folder that is mounted on all nodes")
    root, pages = f"{shared}/tree-{uuid.uuid4().hex}/root", table(spark, sf_dir, "pages")
    os.makedirs(root)
    _write(pages, root, 0)
    return pages, root


_TREE = """WITH p AS (SELECT page_id AS n, page_id::VARCHAR AS s, page_id % 5 AS part, ['.md', '.RS', '.py', '.bin', '.json', '.toml', '.txt', '', '.rs'][page_id % 9 + 1] AS kind FROM pages),
 t AS (SELECT *, 's' || n % 13 || '/' || ['', '_', '.'][n % 3 + 1] || 'p' || s || kind AS path, CASE WHEN kind IN ('.RS', '.rs', '.py') THEN 'code' WHEN kind IN ('.md', '.json', '.toml', '.txt') THEN 'doc' END AS chunk_type FROM p),
 x AS (SELECT *, unnest(['', CASE WHEN part = 2 THEN '+' ELSE '' END]) AS more, unnest([0, 1]) AS state FROM t WHERE chunk_type IS NOT NULL),
 files AS (SELECT *, CASE kind WHEN '.md' THEN 'intro ' || s || chr(10) || '# Title ' || s || chr(10) || 'body' || more || chr(10) WHEN '.RS' THEN 'fn f' || s || '() {}' || chr(10) || more
  WHEN '.rs' THEN '/// Says ' || s || '.' || chr(10) || 'pub fn f' || s || '(a: u8) { g(a) }' || chr(10) || more
  WHEN '.py' THEN 'class C' || s || ':' || chr(10) || '    \"\"\"Holds ' || s || '.\"\"\"' || chr(10) || '    def _m(self):' || chr(10) || '        return 1' || more || chr(10)
  WHEN '.json' THEN '{"b": ' || s || ', "a": "' || more || '"}' WHEN '.toml' THEN 'x = ' || s || chr(10) || '[t' || s || ']' || chr(10) || 'y = 1' || chr(10) || more ELSE 'text ' || s || more END AS text,
  CASE WHEN state = 1 AND part IN (1, 2, 4) THEN 2000000 ELSE 1000000 END::BIGINT AS mtime FROM x WHERE part <> CASE state WHEN 0 THEN 4 ELSE 3 END)"""


@_query(_TREE + """ SELECT path, chunk_type, octet_length(encode(text))::BIGINT AS length, sha256(text) AS hash, true AS valid FROM files WHERE state = 0 UNION ALL
 SELECT * FROM (VALUES ('.github/ci.yml', 'doc', 9, sha256('on: push' || chr(10)), true), ('pkg/__init__.py', 'code', 0, sha256(''), true), ('pkg/_private/c.py', 'code', 6, sha256('c = 1' || chr(10)), true), ('_x.md', 'doc', 4, sha256('# x' || chr(10)), true),
 ('exact.txt', 'doc', 1048576, sha256(repeat('x', 1048576)), true), ('bad.rs', 'code', 2, sha256('\\xff\\xfe'::BLOB), false), ('a b+c%20.txt', 'doc', 1, sha256('x'), true))""")
def scan_tree(spark, sf_dir):
    """All files of a tree with hidden, empty, excluded, too large and invalid ones."""
    _, root = _tree(spark, sf_dir)
    for path, content in _EXTRA.items():
        os.makedirs(os.path.dirname(os.path.join(root, path)), exist_ok=True)
        with open(os.path.join(root, path), "wb") as f:
            f.write(content)
    return scan.texts(scan.scan(spark, root)).select("path", "chunk_type", "length", "hash", F.col("error").isNull().alias("valid"))


def _indexed(spark, sf_dir) -> tuple[index.Index, str, list[index.Changes]]:
    """An index that was made of the first state and refreshed to the second."""
    pages, root = _tree(spark, sf_dir)
    ix = index.Index(spark, os.path.dirname(root) + "/index")
    one = ix.refresh(root)
    _write(pages, root, 1)
    return ix, root, [one, ix.refresh(root), ix.refresh(root)]


@_query(_TREE + " SELECT path, mtime, sha256(text) AS hash, chunk_type FROM files WHERE state = 1")
def index_files(spark, sf_dir):
    """The index after two states: what was touched has its new time, what has another content its new hash."""
    return _indexed(spark, sf_dir)[0].files.select("path", "mtime", "hash", "chunk_type")


_CHUNKS = _TREE + """, f AS (SELECT *, regexp_extract(path, '[^/]*$') AS file_name FROM files WHERE state = 1), c(file, seq, name, kind, line_start, line_end, context, visibility, doc_summary, signature) AS (
 SELECT path, 0, file_name, 'document', 1, 3, NULL, 'private', NULL, NULL FROM f WHERE kind = '.md' UNION ALL SELECT path, 1, 'Title ' || s, 'section', 2, 3, NULL, 'private', NULL, NULL FROM f WHERE kind = '.md' UNION ALL
 SELECT path, 0, 'f' || s, 'function', 2, 2, NULL, 'public', 'Says ' || s || '.', 'pub fn f' || s || '(a: u8) { g(a) }' FROM f WHERE kind = '.rs' UNION ALL
 SELECT path, 0, 'C' || s, 'class', 1, 4, NULL, 'public', 'Holds ' || s || '.', 'class C' || s || ': \"\"\"Holds ' || s || '.\"\"\" def _m(self): return 1' || more FROM f WHERE kind = '.py' UNION ALL
 SELECT path, 1, '_m', 'method', 3, 4, 'C' || s, 'private', NULL, 'def _m(self): return 1' || more FROM f WHERE kind = '.py' UNION ALL
 SELECT path, 0, 'a', 'section', 1, 2, file_name, 'private', NULL, NULL FROM f WHERE kind = '.json' UNION ALL SELECT path, 1, 'b', 'section', 1, 2, file_name, 'private', NULL, NULL FROM f WHERE kind = '.json' UNION ALL
 SELECT path, 0, 'root', 'section', 1, 1, file_name, 'private', NULL, NULL FROM f WHERE kind = '.toml' UNION ALL SELECT path, 1, 't' || s, 'section', 2, 3 + (more <> '')::INTEGER, file_name, 'private', NULL, NULL FROM f WHERE kind = '.toml' UNION ALL
 SELECT path, 0, file_name, 'document', 1, 1, NULL, 'private', NULL, NULL FROM f WHERE kind = '.txt')"""


@_query(_CHUNKS + " SELECT row_number() OVER (ORDER BY file, seq) - 1 AS chunk_id, file, seq, name, kind, line_start, line_end, context, visibility, doc_summary, signature FROM c")
def index_chunks(spark, sf_dir):
    """All chunks, densely numbered; a Python file that does not parse (`1+`) keeps its definitions."""
    got = _indexed(spark, sf_dir)[0].chunks
    return got.select("chunk_id", "file", "seq", "name", "kind", "line_start", "line_end", "context", "visibility", "doc_summary", "signature")


@_query(_CHUNKS + """, a AS (SELECT path, state, chunk_type FROM files), n AS (SELECT count(*) AS n FROM c),
 m AS (SELECT sum(CASE kind WHEN '.md' THEN 2 WHEN '.rs' THEN 1 WHEN '.py' THEN 2 WHEN '.json' THEN 2 WHEN '.toml' THEN 2 WHEN '.txt' THEN 1 ELSE 0 END) AS n FROM files WHERE state = 0)
 SELECT 0 AS step, (SELECT count(*) FROM a WHERE state = 0) AS added, 0::BIGINT AS updated, 0::BIGINT AS removed, (SELECT n FROM m)::BIGINT AS pending UNION ALL
 SELECT 1, (SELECT count(*) FROM t WHERE part = 4 AND chunk_type IS NOT NULL), (SELECT count(*) FROM t WHERE part = 2 AND chunk_type IS NOT NULL), (SELECT count(*) FROM t WHERE part = 3 AND chunk_type IS NOT NULL), (SELECT n FROM n) UNION ALL
 SELECT 2, 0, 0, 0, (SELECT n FROM n)""")
def refresh_stats(spark, sf_dir):
    """What three refreshes found: a new tree, another state, no change."""
    steps = _indexed(spark, sf_dir)[2]
    return spark.createDataFrame([(k, c.added, c.updated, c.removed, c.pending) for k, c in enumerate(steps)], "step int, added long, updated long, removed long, pending long")


@_query(_CHUNKS + """ SELECT 'before' AS step, 0::BIGINT AS embedded, count(*) AS pending FROM c UNION ALL SELECT 'first', count(*), 0 FROM c UNION ALL SELECT 'again', 0, 0 FROM c HAVING count(*) > 0 UNION ALL
 SELECT 'reindexed', 0, count(*) FROM c UNION ALL SELECT 'vectors', count(*), count(*) FROM c""")
def embed_rounds(spark, sf_dir):
    """Vectors in several rounds, none twice; a rebuilt index has none."""
    ix, root, _ = _indexed(spark, sf_dir)
    rows, e = [("before", 0, ix.pending())], connectors.HashEmbedder(8)
    third = max(1, ix.pending() // 3)
    rows += [("first", ix.embed(e, round_size=third), ix.pending()), ("again", ix.embed(e, round_size=third), ix.pending())]
    vectors = ix.embeddings
    rows.append(("vectors", vectors.select("chunk_id").distinct().count(), vectors.count()))
    ix.reindex(root)
    rows.append(("reindexed", 0, ix.pending()))
    return spark.createDataFrame(rows, "step string, embedded long, pending long")


_WATCHED = _TREE + """, a AS (SELECT path, mtime, octet_length(encode(text))::BIGINT AS length FROM files WHERE state = 0), b AS (SELECT path, mtime, octet_length(encode(text))::BIGINT AS length FROM files WHERE state = 1)
 SELECT 0 AS step, path, 'added' AS status, mtime, length FROM a UNION ALL SELECT 1, b.path, CASE WHEN a.path IS NULL THEN 'added' ELSE 'updated' END, b.mtime, b.length FROM b LEFT JOIN a USING (path) WHERE a.path IS NULL OR a.mtime <> b.mtime OR a.length <> b.length
 UNION ALL SELECT 1, path, 'removed', mtime, length FROM a ANTI JOIN b USING (path) UNION ALL SELECT 2, path, 'removed', mtime, length FROM b WHERE path LIKE 's5/%'"""


@_query(_WATCHED)
def watch_changes(spark, sf_dir):
    """What a stream over the pages' tree tells of three states: a new tree, another one, and one without a folder."""
    pages, root = _tree(spark, sf_dir)
    told = os.path.dirname(root) + "/told"
    for step in range(3):
        if step == 1:
            _write(pages, root, 1)
        elif step == 2:
            shutil.rmtree(os.path.join(root, "s5"), ignore_errors=True)
        out = changes.changes(spark, root, parts=64).withColumn("step", F.lit(step))
        q = out.writeStream.format("parquet").option("path", f"{told}/{step}").option("checkpointLocation", f"{told}-state").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema("step int, " + changes.SCHEMA).parquet(*[f"{told}/{step}" for step in range(3)])


@_query(_CHUNKS + """, d AS (SELECT name FROM c GROUP BY name HAVING count(*) > 1), n AS (SELECT count(*) AS n FROM c)
 SELECT 2 AS version, 'tree' AS root, true AS dated, count(*) AS file_count, count(*) FILTER (chunk_type = 'code') AS code_files, count(*) FILTER (chunk_type = 'doc') AS doc_files, (SELECT n FROM n) AS chunk_count, (SELECT n FROM n) AS embedding_count,
 'HashEmbedder' AS embedding_model, (SELECT n > 0 FROM n) AS has_embeddings, 0::BIGINT AS pending_embeddings, 'none' AS embed_recommendation, (SELECT count(*) FROM d) AS duplicate_names, true AS embedder_available, 1 AS query_cache_size FROM f""")
def index_status(spark, sf_dir):
    """All fields of an index's status, with vectors and one query's vector kept; the time only as whether there is one."""
    ix, _, _ = _indexed(spark, sf_dir)
    embedder = connectors.HashEmbedder(8)
    ix.embed(embedder)
    one = embedder.one
    search.search(ix.chunks, "title", 1, None, ix.embeddings, one)
    row = ix.report("tree", one)
    return row.withColumn("dated", F.col("last_indexed").rlike("^20.*Z$")).drop("last_indexed", "string_table_size")


_BUCKETS = """SELECT t.* FROM (SELECT count(*) AS n FROM pages) p, (VALUES ('one file changed', 'files', 1), ('one file changed', 'chunks', 1), ('one file changed', 'vectors', 1), ('one file touched', 'files', 1),
 ('one file touched', 'chunks', 0), ('one file touched', 'vectors', 0), ('one file gone', 'files', 1), ('one file gone', 'chunks', 1), ('one file gone', 'vectors', 1)) t(step, tbl, buckets) WHERE n > 8"""


@_query(_BUCKETS)
def index_buckets(spark, sf_dir):
    """How many of an index's many buckets a change of one file of the pages' tree rewrites."""
    _, root = _tree(spark, sf_dir)
    ix = index.Index(spark, os.path.dirname(root) + "/index", bucket_bytes=512)
    ix.refresh(root)
    ix.embed(connectors.HashEmbedder(8))
    path = os.path.join(root, ix.files.where("chunk_type = 'code' AND length > 0").agg(F.max("path")).first()[0])
    rows = []
    for step in ("one file changed", "one file touched", "one file gone"):
        before = ix.store.manifest()
        if step == "one file gone":
            os.remove(path)
        else:
            with open(path, "a") as f:
                f.write("\n" * (step == "one file changed"))
            os.utime(path, (3_000_000 + len(rows), 3_000_000 + len(rows)))
        ix.refresh(root)
        written = ix.store.manifest().parts() - before.parts()
        emptied = {b.id for b in before.buckets} - {b.id for b in ix.store.manifest().buckets if b.versions.get("files")}
        rows += [(step, name, len([p for p in written if f"/{name}/" in p]) or (step == "one file gone") * len(emptied)) for name in ("files", "chunks", "vectors")]
    return spark.createDataFrame(rows, "step string, tbl string, buckets int")


@_query("""SELECT * FROM (VALUES ('free', true), ('held', false), ('dirty while held', true), ('no refresh while held', true), ('reads while held', true), ('refreshed after', true), ('clean after', true)) t(what, ok)""")
def index_lock(spark, sf_dir):
    """One writer at a time; who finds the lock taken leaves word and goes on reading."""
    _, root = _tree(spark, sf_dir)
    ix = index.Index(spark, os.path.dirname(root) + "/index")
    out = [("free", ix.acquire()), ("held", ix.acquire())]
    asked = ix.try_refresh(root)
    out += [("dirty while held", (ix.folder / "dirty").exists()), ("no refresh while held", asked is None and ix.files.count() == 0), ("reads while held", ix.chunks.count() == 0)]
    ix.release()
    out += [("refreshed after", bool(ix.try_refresh(root).added)), ("clean after", not (ix.folder / "dirty").exists() and ix.holder() is None)]
    return spark.createDataFrame(out, "what string, ok boolean")


_ASKED = ("anble innd", "see doc12", "reri doc7", "rewh")


@_query(_WINDOWS + f""", n AS (SELECT *, row_number() OVER (ORDER BY 'doc' || doc_id, part) - 1 AS id, count(*) OVER (PARTITION BY name) = 1 AS "unique" FROM chunks), a AS (SELECT unnest({list(_ASKED)}) AS q),
 s AS (SELECT q, id AS chunk_id, name, "unique", CASE WHEN name = q THEN 10 WHEN contains(name, q) THEN 8 WHEN contains(q, name) THEN 6 ELSE 0 END
  + list_sum(list_transform(string_split(q, ' '), lambda w: CASE WHEN contains(name, w) THEN 3 ELSE 0 END + CASE WHEN contains(lower(content), w) THEN 1 ELSE 0 END)) AS points FROM n, a)
 SELECT q, chunk_id, name, points / 10.0::DOUBLE AS score, "unique", row_number() OVER (PARTITION BY q ORDER BY points DESC, chunk_id) AS rank FROM s WHERE points > 0 QUALIFY rank <= 10""")
def indexed_name_search(spark, sf_dir):
    """Searches by name in an index of all documents' windows: posting lists give the candidates."""
    chunks = window_chunks(spark, sf_dir)
    none = {c.split()[0]: F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in schemas.RAW.split(", ")}
    has = {"chunk_type": F.col("chunk_type"), "name": F.col("name"), "file": F.col("name").alias("file"), "seq": F.col("part").cast("int").alias("seq"), "content": F.col("content")}
    folder = f"{shared_folder(spark).removeprefix('file://').removeprefix('file:')}/names-{uuid.uuid4().hex}"
    ix = index.Index(spark, folder, bucket_bytes=1 << 20)
    ix.save(chunks=chunks.select(*[has.get(k, v) for k, v in none.items()]))
    ix.index_names()
    out = None
    for q in _ASKED:
        one = ix.search_by_name(q, 10).select(F.lit(q).alias("q"), "chunk_id", "name", "score", "unique", F.col("rank").cast("long").alias("rank"))
        out = one if out is None else out.unionByName(one)
    return out
