"""Maps of an index as ordered lines: (sort, line), sorted by `sort`.

The texts of the lines are fixed values: what reads maps expects them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import hierarchy as H
from ..scratch import Scratch

BUDGET = 2000


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _count(name: str) -> Column:
    return F.col(name).cast("string")


def _summary(df: DataFrame) -> Column:
    return F.col("summary") if "summary" in df.columns else F.lit(None).cast("string")


class Map:
    """The tables of a map, and its renderings. Optional summaries: (dir, summary), (dir, file_name, summary), (node, summary)."""

    def __init__(self, chunks: DataFrame, project: str, root: str = "", dir_summaries: DataFrame | None = None, file_summaries: DataFrame | None = None, tree_summaries: DataFrame | None = None):
        self.project, self.spark = project, chunks.sparkSession
        scratch = Scratch(self.spark, "map")  # headers, costs and lines read the same three tables
        self.symbols = scratch.cut(H.symbols(chunks, root), "symbols")
        files = scratch.cut(H.files(self.symbols), "files")
        dirs = H.directories(files)
        self.dirs = scratch.cut(dirs if dir_summaries is None else dirs.join(dir_summaries, "dir", "left"), "dirs")
        self.files = files if file_summaries is None else scratch.cut(files.join(file_summaries, ["dir", "file_name"], "left"), "files_said")
        self.tree_summaries = tree_summaries

    def header(self, area: str | None = None) -> list[str]:
        lang = H.languages(self.files).first()
        total = self.dirs.agg(F.sum("n_symbols")).first()[0] or 0
        tail = f" [area: {area}]" if area is not None else ""
        return [f"// Project: {self.project} ({lang.lang if lang else 'Other'}, {total} symbols){tail}", "//"]

    def _dir_lines(self, dirs: DataFrame) -> DataFrame:
        s = _summary(dirs)
        line = _text("// ", F.col("dir"), "/  — ", _count("n_files"), " files, ", _count("n_symbols"), " symbols", F.when(s.isNotNull(), _text(" (", s, ")")).otherwise(""))
        return dirs.select(F.array("dir").alias("sort"), line.alias("line"))

    def _file_lines(self, files: DataFrame, depth: int) -> DataFrame:
        s, n = _summary(files), _count("n_symbols")
        if depth >= 2:
            line = _text("//   ", F.col("file_name"), "  (", n, " symbols)", F.when(s.isNotNull(), _text(" — ", s)).otherwise(""))
        else:
            names = S.names_preview(F.col("names"))
            line = _text("//   ", F.col("file_name"), "  — ", n, F.when(s.isNotNull(), _text(" — ", s)).when(names == "", " symbols").otherwise(_text(" (", names, ")")))
        return files.select(F.array("dir", "file_name").alias("sort"), line.alias("line"))

    def _symbol_lines(self, symbols: DataFrame, depth: int) -> DataFrame:
        private = F.when(F.col("visibility") == "public", "").otherwise("(priv) ")
        plain = _text(S.kind_prefix(F.col("kind")), F.col("name"))
        with_doc = _text(plain, " — ", F.col("doc_summary"))
        digits = lambda c: F.lpad(F.col(c).cast("string"), 10, "0")
        top = symbols.where("holder is null")
        body = F.when(F.col("doc_summary").isNotNull(), with_doc).when(F.col("signature").isNotNull(), S.short_signature(F.col("signature"))).otherwise(plain)
        order = lambda: F.array("dir", "file_name", digits("sort_key"), "name", digits("seq"))
        out = top.select(order().alias("sort"), _text("//     ", private, body).alias("line"))
        if depth >= 3:
            holders = top.select("file", F.col("seq").alias("holder"), order().alias("above"))
            members = symbols.where("holder is not null").join(holders, ["file", "holder"])
            body = F.when(F.col("doc_summary").isNotNull(), with_doc).otherwise(plain)
            below = F.concat("above", F.array(digits("sort_key"), F.col("name"), digits("seq")))
            out = out.unionByName(members.select(below.alias("sort"), _text("//       ", private, body).alias("line")))
        return out

    def _levels(self, depth: int, where: Column) -> DataFrame:
        out = self._dir_lines(self.dirs.where(where))
        if depth >= 1:
            out = out.unionByName(self._file_lines(self.files.where(where), depth))
        if depth >= 2:
            out = out.unionByName(self._symbol_lines(self.symbols.where(where), depth))
        return out

    def _joined(self, *parts) -> DataFrame:
        """Header lines, tables and footers, in this order; a part's own order is its `sort`."""
        out = None
        for i, part in enumerate(parts):
            if not isinstance(part, DataFrame):
                part = self.spark.createDataFrame([([f"{k:06d}"], x) for k, x in enumerate(part)], "sort array<string>, line string")
            part = part.select(F.lit(i).alias("part"), "sort", "line")
            out = part if out is None else out.unionByName(part)
        return out.orderBy("part", "sort").select("line")

    def costs(self, where: Column | None = None):
        where = F.lit(True) if where is None else where
        return H.depth_costs(self.symbols.where(where), self.files.where(where), self.dirs.where(where)).first()

    def flat(self, depth: int) -> DataFrame:
        return self._joined(self.header(), self._levels(depth, F.lit(True)))

    def shown(self) -> DataFrame:
        shown = Scratch(self.spark, "shown").cut(H.collapsed(H.rollup(self.dirs)), "shown")
        return shown.join(self.tree_summaries, "node", "left") if self.tree_summaries is not None else shown

    def tree(self, budget: int = BUDGET) -> DataFrame:
        shown, header = self.shown(), self.header()
        used = -(-len("\n".join([*header, ""]).encode()) // S.CHARS_PER_TOKEN)
        depth = H.auto_tree_depth(H.tree_costs(shown).where("depth <= 10").collect(), max(0, budget - used))
        s = _summary(shown)
        line = _text("//", F.repeat(F.lit("  "), F.col("shown_depth")), " ", F.col("label"), "/  — ", _count("n_files"), " files, ", _count("n_symbols"), " symbols", F.when(s.isNotNull(), _text(" (", s, ")")).otherwise(""))
        return self._joined(header, shown.where(F.col("shown_depth") <= depth).select(F.split("node", "/").alias("sort"), line.alias("line")))

    def render(self, budget: int = BUDGET, area: str | None = None) -> DataFrame:
        """The map within a budget: an area, else a tree if even directories alone exceed it, else the deepest flat map that fits."""
        if area is not None:
            return self.area(area, budget)
        costs = self.costs()
        return self.tree(budget) if costs["t0"] > budget else self.flat(H.auto_depth(costs, budget))

    def zoom(self, area: str) -> str:
        norm = area.rstrip("/")
        where, _, file = norm.rpartition("/")
        if "." in file and self.files.where((F.col("dir") == (where or ".")) & (F.col("file_name") == file)).take(1):
            return "file"
        return "directory" if self.dirs.where(H.in_area("dir", norm)).take(1) else "project"

    def hint(self, zoom: str, area: str) -> list[str]:
        """Where to look next: the three largest directories, child directories or files."""
        norm = area.rstrip("/")
        if zoom == "file":
            return ["//", "// [zoom: file] Use 'lookup <symbol>' for full definition"]
        if zoom == "directory":
            child = self.dirs.where(F.col("dir").startswith(norm + "/") & ~F.contains(F.substring(F.col("dir"), F.lit(len(norm) + 2), F.length("dir")), F.lit("/")))
            best = child.orderBy(F.desc("n_symbols"), "dir").limit(3).collect()
            named, what = [f"{r.dir} ({r.n_files} files, {r.n_symbols} symbols)" for r in best], "Drill deeper: map --area <path>"
            if not best:
                best = self.files.where(F.col("dir") == norm).orderBy(F.desc("n_symbols"), "file_name").limit(3).collect()
                named, what = [f"{r.dir}/{r.file_name} ({r.n_symbols} symbols)" for r in best], "Drill to file: map --area <file-path>"
        else:
            best = self.dirs.orderBy(F.desc("n_symbols"), "dir").limit(3).collect()
            named, what = [f"{r.dir} ({r.n_symbols} symbols)" for r in best], "Drill deeper: map --area <path>"
        return ["//", f"// [zoom: {zoom}] {what}", f"// Suggested: {', '.join(named)}"] if named else []

    def _others(self, where: Column) -> list[str]:
        others = self.dirs.where(where)
        n = others.count()
        if not n:
            return []
        best = others.orderBy(F.desc("n_symbols"), "dir").limit(5)
        # five rows
        named = [r.dir for r in best.collect()]
        text = {r.sort[0]: r.line for r in self._dir_lines(others.where(F.col("dir").isin(*named))).collect()}
        lines = [text[d] for d in named]
        return ["//", "// --- other directories (top by size) ---", *lines, *([f"// ... and {n - 5} more directories"] if n > 5 else [])]

    def entries(self, inside: Column) -> int:
        """Directories, files and symbols of an area."""
        return self.files.where(inside).agg(F.coalesce(F.sum(F.col("n_symbols") + 1), F.lit(0))).first()[0] + self.dirs.where(inside).count()

    def area(self, area: str, budget: int = BUDGET, whole: bool = False) -> DataFrame:
        """One directory's subtree, or one file, in detail; the largest others by name. `whole`: files and symbols are shown however many there are, beyond the budget."""
        norm, header = area.rstrip("/"), self.header(area)
        zoom = self.zoom(area)
        inside = H.in_area("dir", norm)
        hint = self.hint(zoom, area)
        if self.dirs.where(inside).take(1):
            entries = self.entries(inside)
            depth = 3 if entries < 30 else 2 if whole or entries <= 100 else max(1, H.auto_depth(self.costs(inside), max(0, budget - 100)))
            return self._joined(header, self._levels(depth, inside), self._others(~inside), hint)
        where, _, file = norm.rpartition("/")
        where = where or "."
        if self.dirs.where(F.col("dir") == where).take(1):
            one = (F.col("dir") == where) & (F.col("file_name") == file)
            if self.files.where(one).take(1):
                body = self._file_lines(self.files.where(one), 3).unionByName(self._symbol_lines(self.symbols.where(one), 3))
                return self._joined(header, [f"// {where}/"], body, self._others(F.col("dir") != where), hint)
            return self._joined(header, [f"// Area '{area}' not found in index"], self._others(F.col("dir") != where), hint)
        return self._joined(header, [f"// Area '{area}' not found in index"], self._others(F.lit(True)), hint)
