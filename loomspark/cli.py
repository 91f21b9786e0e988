"""Command line: search, lookup, status, refresh, reindex, embed, map, summarize, deps, outline over a directory tree."""

from __future__ import annotations

import argparse
import json
import logging
import subprocess
import sys
from logging.handlers import RotatingFileHandler
from pathlib import Path

from pyspark.sql import functions as F

from .operators import hierarchy, search, summaries
from .operators.clients import EmbeddingClient, SummaryClient
from .operators.connectors import FirstSentence, HashEmbedder
from .operators.index import Index
from .plans.render import BUDGET, Map
from .session import session

LOG_BYTES = 512 * 1024


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomspark", description=__doc__)
    p.add_argument("--root", default=".", help="the tree that is indexed")
    p.add_argument("--index", default=None, help="where the index is kept (default: ROOT/.loom)")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("search", help="ranked retrieval by meaning or by name")
    s.add_argument("query")
    s.add_argument("--top", type=int, default=5)
    s.add_argument("--filter", default=None, help="code, doc or docs")
    s.add_argument("--code-only", action="store_true")
    s.add_argument("--docs-only", action="store_true")
    s = sub.add_parser("lookup", help="definitions of a symbol, Context.member or plain")
    s.add_argument("symbol")
    s.add_argument("--filter", default=None)
    s.add_argument("--fuzzy", action="store_true")
    sub.add_parser("status", help="counts of the index")
    s = sub.add_parser("refresh", help="bring the index to the state of the tree")
    s.add_argument("--quiet", action="store_true")
    s.add_argument("--background-embed", action="store_true", help="leave a process that makes the missing vectors")
    sub.add_parser("reindex", help="build the index anew")
    s = sub.add_parser("embed", help="vectors for chunks that have none")
    s.add_argument("--batch-size", type=int, default=500)
    s.add_argument("--dim", type=int, default=HashEmbedder().dim)
    s = sub.add_parser("map", help="the tree's symbols within a token budget")
    s.add_argument("--area", default=None)
    s.add_argument("--tokens", type=int, default=BUDGET)
    s = sub.add_parser("summarize", help="summaries of functions, callees first, of files, directories and subtrees")
    s.add_argument("--area", default=None)
    s.add_argument("--batch-size", type=int, default=summaries.SUMMARY_BATCH)
    s.add_argument("--force", action="store_true")
    s.add_argument("--dry-run", action="store_true")
    s = sub.add_parser("deps", help="what a symbol calls, and what mentions it")
    s.add_argument("symbol")
    s.add_argument("--direction", choices=("both", "calls", "called_by"), default="both")
    for name in ("search", "embed", "summarize"):
        s = sub.choices[name]
        s.add_argument("--service", default=None, help="address of a service; without, vectors are hashed features and summaries first sentences")
        s.add_argument("--model", default="", help="the service's model")
        s.add_argument("--key-variable", default=None, help="the environment variable that holds its key")
    s = sub.add_parser("outline", help="sections or symbols of a file")
    s.add_argument("file")
    return p


def _log(folder: Path) -> logging.Logger:
    log = logging.getLogger("loomspark")
    if not log.handlers:
        folder.mkdir(parents=True, exist_ok=True)
        log.addHandler(RotatingFileHandler(folder / "loom.log", maxBytes=LOG_BYTES, backupCount=1))
        log.setLevel(logging.INFO)
    return log


def _embedder(a: argparse.Namespace, dim: int):
    """The service that is asked for, under the limits that it names; else the default."""
    return EmbeddingClient(a.service, a.model, dim, key_variable=a.key_variable).probed() if a.service else HashEmbedder(dim)


def _rows(df, *drop: str) -> list[dict]:
    return [{k: v for k, v in json.loads(x).items() if k not in drop} for x in df.toJSON().collect()]


def main(args: list[str] | None = None, out=sys.stdout) -> int:
    a = parser().parse_args(args)
    root = str(Path(a.root).resolve())
    folder = Path(a.index or f"{root}/.loom")
    log = _log(folder)
    index = Index(session(), str(folder))
    say = lambda x: print(json.dumps(x, indent=2, ensure_ascii=False, default=str), file=out)
    if a.command == "reindex":
        say(vars(index.reindex(root)))
        return 0
    changes = index.try_refresh(root)
    log.info("%s: %s", a.command, changes)
    chunks = index.chunks
    if a.command == "refresh":
        if changes is not None:
            index.index_names()
        if not a.quiet:
            say(vars(changes) if changes else {"locked": True})
        if a.background_embed and changes and changes.pending:
            # the process outlives this one and takes the lock for itself
            subprocess.Popen([sys.executable, "-m", "loomspark.cli", "--root", root, "--index", str(folder), "embed"], stdin=subprocess.DEVNULL, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, start_new_session=True)
    elif a.command == "search":
        kind = a.filter or search.type_of_flags(a.code_only, a.docs_only)
        held = index.embeddings.select(F.size("embedding").alias("n")).first()
        known = a.service or index.store.manifest().model in ("", HashEmbedder.__name__)  # vectors of a service are no hashed features
        embed = _embedder(a, held.n).one if held and known else None
        found, suggestion = search.search(chunks, a.query, a.top, kind, index.embeddings, embed, index.search_by_name)
        say({"results": _rows(found.select("rank", "chunk_type", "name", "kind", "file", "line_start", "line_end", "score", "preview", "context", "unique").orderBy("rank")), "suggestion": suggestion})
    elif a.command == "lookup":
        say(_rows(search.lookup_fuzzy(chunks, a.symbol, a.filter), "content") if a.fuzzy else search.lookup_output(chunks, a.symbol, a.filter))
    elif a.command == "status":
        say(index.status() | index.report(root, HashEmbedder().one).first().asDict())
    elif a.command == "embed":
        say({"embedded": index.embed(_embedder(a, a.dim), a.batch_size), "pending": index.pending()})
    elif a.command == "map":
        if not chunks.where("chunk_type = 'code'").take(1):
            print("// The index has no symbols", file=out)
        else:
            said = summaries.for_map(hierarchy.symbols(chunks), index.table("summaries"))
            for row in Map(chunks, Path(root).name, **said).render(a.tokens, a.area).collect():
                print(row.line, file=out)
    elif a.command == "summarize":
        if a.dry_run:
            say(summaries.dry_run(chunks, a.batch_size))
        else:
            cache = index.table("summaries")
            summarizer = SummaryClient(a.service, a.model, a.key_variable) if a.service else FirstSentence()
            cache, stats = summaries.generate_functions(chunks, cache.limit(0) if a.force else cache, summarizer, a.batch_size)
            symbols = hierarchy.symbols(chunks)
            for wanted in (summaries.wanted_entries(symbols), summaries.wanted_trees(symbols)):
                cache = summaries.generate(wanted if a.area is None else summaries.in_area(wanted, a.area), cache, summarizer, a.batch_size)
            index.save(summaries=cache)
            say(stats)
    elif a.command == "deps":
        say(_rows(search.dependencies(chunks, a.symbol, a.direction)))
    elif a.command == "outline":
        say(_rows(search.outline(chunks, a.file)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
