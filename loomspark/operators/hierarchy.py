"""Directory, file, symbol and member levels of an index, their costs, and directory trees, as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..scratch import Scratch

CONTAINERS = ("class", "struct", "interface", "enum")


def symbols(chunks: DataFrame, root: str = "") -> DataFrame:
    """Code symbols but impl blocks, each with dir, file_name, lang, its sort key and `holder`, the seq of the container it is a member of.

    A container is found by its name in the same file; of equal names, the last one holds the members.
    """
    rows = chunks.where("chunk_type = 'code' AND kind <> 'impl'")
    rel = S.relative(F.col("file"), root) if root else F.col("file")
    rows = rows.withColumn("rel", rel).select(
        "file", "seq", "name", "kind", "context", "signature", "doc_summary", "visibility", S.dir_path(F.col("rel")).alias("dir"),
        S.file_name(F.col("rel")).alias("file_name"), S.language(F.col("file")).alias("lang"), S.symbol_key(F.col("kind")).alias("sort_key"),
    )
    held = rows.where(F.col("kind").isin(*CONTAINERS)).groupBy("file", F.col("name").alias("context")).agg(F.max("seq").alias("holder"))
    rows = rows.join(held, ["file", "context"], "left")
    return rows.withColumn("holder", F.when(~F.col("kind").isin(*CONTAINERS), F.col("holder")))


def files(symbols: DataFrame) -> DataFrame:
    """dir, file_name, lang, n_symbols (members too), and the sorted names of top-level symbols."""
    top = F.when(F.col("holder").isNull(), F.struct("sort_key", "name", "seq"))
    return symbols.groupBy("dir", "file_name").agg(
        F.first("lang").alias("lang"), F.count("*").alias("n_symbols"), F.transform(F.sort_array(F.collect_list(top)), lambda s: s["name"]).alias("names")
    )


def directories(files: DataFrame) -> DataFrame:
    return files.groupBy("dir").agg(F.count("*").alias("n_files"), F.sum("n_symbols").alias("n_symbols"))


def languages(files: DataFrame) -> DataFrame:
    """lang and n_files, the primary language first."""
    return files.groupBy("lang").agg(F.count("*").alias("n_files")).orderBy(F.desc("n_files"), S.language_key(F.col("lang")))


def depth_costs(symbols: DataFrame, files: DataFrame, dirs: DataFrame) -> DataFrame:
    """One row: estimated tokens t0 to t3 of a map of each depth. Each level's cost is one sum; no rows come to the driver.

    `files` and `dirs` may have a column `summary`.
    """
    extra = lambda df: F.when(F.col("summary").isNotNull(), 55).otherwise(0) if "summary" in df.columns else F.lit(0)
    cost = S.symbol_cost(F.col("name"), F.col("signature"))
    parts = (
        dirs.select(F.lit(0).alias("level"), (50 + F.octet_length("dir") + extra(dirs)).alias("c"))
        .unionByName(files.select(F.lit(1).alias("level"), (44 + F.octet_length("file_name") + extra(files)).alias("c")))
        .unionByName(symbols.select(F.when(F.col("holder").isNull(), 2).otherwise(3).alias("level"), (cost + F.when(F.col("holder").isNull(), 6).otherwise(8)).alias("c")))
    )
    total = lambda d: (F.lit(S.HEADER_TOKENS) + F.ceil(F.coalesce(F.sum(F.when(F.col("level") <= d, F.col("c"))), F.lit(0)) / S.CHARS_PER_TOKEN)).cast("long")
    return parts.agg(*[total(d).alias(f"t{d}") for d in range(4)])


def depth_entries(symbols: DataFrame, files: DataFrame, dirs: DataFrame) -> DataFrame:
    """One row: how many entries a map of each depth has, n0 (directories) to n3 (members too)."""
    level = F.when(F.col("holder").isNull(), 2).otherwise(3)
    parts = dirs.select(F.lit(0).alias("level")).unionByName(files.select(F.lit(1).alias("level"))).unionByName(symbols.select(level.alias("level")))
    return parts.agg(*[F.count(F.when(F.col("level") <= d, 1)).alias(f"n{d}") for d in range(4)])


def auto_depth(costs, budget: int) -> int:
    """The deepest level whose estimate is within the budget, else 0; `costs` is the row of depth_costs."""
    return next((d for d in (3, 2, 1, 0) if costs[f"t{d}"] <= budget), 0)


def ancestors(path: F.Column | str, separator: str = "/") -> F.Column:
    """All prefixes of a path, itself included, shortest first."""
    parts = F.split(F.col(path) if isinstance(path, str) else path, separator, -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), separator))


def rollup(dirs: DataFrame) -> DataFrame:
    """node, parent, depth, n_files, n_symbols of every directory and ancestor: totals of whole subtrees.

    Ancestors are exploded and summed with a map-side aggregate: rows grow with the depth of paths only.
    """
    nodes = dirs.select(F.explode(ancestors("dir")).alias("node"), "n_files", "n_symbols")
    out = nodes.groupBy("node").agg(F.sum("n_files").alias("n_files"), F.sum("n_symbols").alias("n_symbols"))
    parent = F.when(F.instr("node", "/") > 0, F.regexp_extract("node", r"(?s)^(.*)/[^/]*$", 1))
    return out.select("node", parent.alias("parent"), (F.size(F.split("node", "/", -1)) - 1).alias("depth"), "n_files", "n_symbols")


def collapsed(tree: DataFrame) -> DataFrame:
    """Nodes as displayed: chains of only children whose totals equal their parent's are one node.

    node (the chain's top), label, shown_depth, tail (the chain's end), n_files, n_symbols. A node is
    lone if it is the only child and its parent has no files of its own; a node's chain is
    read off its ancestors' flags, so there is no recursion and no loop.
    """
    per = tree.groupBy("parent").agg(F.count("*").alias("n_children"), F.max("n_files").alias("child_files")).where("parent is not null")
    flags = tree.select("node", F.col("n_files").alias("own")).join(per, per.parent == F.col("node"), "left")
    # `merges`: the node takes its only child in
    flags = flags.select(F.col("node").alias("n"), ((F.col("n_children") == 1) & (F.col("child_files") >= F.col("own"))).alias("merges"))
    up = tree.select("node", "parent", "n_files", "n_symbols", F.explode(F.filter(ancestors("node"), lambda a: a != F.col("node"))).alias("n"))
    merging = up.join(flags.where("merges"), "n").groupBy("node").agg(F.array_sort(F.collect_list(F.length("n"))).alias("merging"))
    rows = tree.join(merging, "node", "left").withColumn("merging", F.coalesce("merging", F.array().cast("array<int>")))
    rows = rows.withColumn("lone", F.col("parent").isNotNull() & F.array_contains("merging", F.length("parent")))
    # displayed depth: ancestors that do not merge; the chain's top: above all merging ancestors next to the node
    rows = rows.withColumn("shown_depth", F.col("depth") - F.size("merging"))
    lengths = F.reverse(F.transform(F.filter(ancestors("node"), lambda a: a != F.col("node")), lambda a: F.length(a)))
    start = F.struct(F.length("node").alias("top"), F.lit(True).alias("on"))
    top = F.aggregate(lengths, start, lambda acc, n: F.struct(F.when(acc["on"] & F.array_contains("merging", n), n).otherwise(acc["top"]).alias("top"), (acc["on"] & F.array_contains("merging", n)).alias("on")), lambda acc: acc["top"])
    rows = rows.withColumn("top", F.substring("node", F.lit(1), top))
    chains = rows.groupBy("top").agg(
        F.max_by("node", F.length("node")).alias("tail"), F.min("shown_depth").alias("shown_depth"), F.first("n_files").alias("n_files"), F.max("n_symbols").alias("n_symbols")
    )
    above = F.when(F.instr("top", "/") > 0, F.length(F.regexp_extract("top", r"(?s)^(.*)/[^/]*$", 1)) + 2).otherwise(1)
    return chains.select(F.col("top").alias("node"), F.substring(F.col("tail"), above, F.length("tail")).alias("label"), "shown_depth", "tail", "n_files", "n_symbols")


def listed(shown: DataFrame) -> DataFrame:
    """path, n_files, n_symbols, place: the displayed nodes depth first, each by the path of its chain's end."""
    rows = shown.select(F.col("tail").alias("path"), "n_files", "n_symbols", F.split("node", "/").alias("sort"))
    return Scratch(shown.sparkSession, "listed").numbered(rows, "place", "sort").drop("sort")


def tree_costs(shown: DataFrame) -> DataFrame:
    """depth, chars: what a tree shown down to each depth costs; one row for each depth that occurs."""
    extra = F.when(F.col("summary").isNotNull(), 55).otherwise(0) if "summary" in shown.columns else F.lit(0)
    cost = shown.select(F.col("shown_depth").alias("depth"), (38 + 2 * F.col("shown_depth") + F.octet_length("label") + extra).alias("c"))
    per = cost.groupBy("depth").agg(F.sum("c").alias("c"))
    return per.select("depth", F.sum("c").over(Window.orderBy("depth")).alias("chars"))


def auto_tree_depth(costs: list, budget_tokens: int) -> int:
    """The deepest level of 10 to 0 whose cost is within the budget; `costs`: rows of tree_costs."""
    chars = {r["depth"]: r["chars"] for r in costs}
    for d in range(10, -1, -1):
        if max((c for depth, c in chars.items() if depth <= d), default=0) <= budget_tokens * S.CHARS_PER_TOKEN:
            return d
    return 0


def subtree_names(symbols: DataFrame, limit: int = 30) -> DataFrame:
    """node, names: the first distinct top-level names of each subtree."""
    names = symbols.where("holder is null").select(F.explode(ancestors("dir")).alias("node"), "name").distinct()
    first = names.withColumn("nth", F.row_number().over(Window.partitionBy("node").orderBy("name"))).where(F.col("nth") <= limit)
    return first.groupBy("node").agg(F.array_sort(F.collect_list("name")).alias("names"))


def dir_hashes(files: DataFrame) -> DataFrame:
    """dir, body_hash: of the files' names and top-level symbols."""
    part = F.concat("file_name", F.lit(":"), F.array_join("names", ","))
    return files.groupBy("dir").agg(S.set_hash(F.collect_list(part), "|").alias("body_hash"))


def file_hashes(files: DataFrame) -> DataFrame:
    return files.select("dir", "file_name", S.set_hash(F.col("names"), ",").alias("body_hash"))


def tree_hashes(dirs: DataFrame) -> DataFrame:
    """node, body_hash: equal where the directories below and their symbol counts are.

    A fold from the deepest level up, one aggregate a level: a node's hash is over its own count and its children's hashes and names,
    so what meets in a row is the children of one directory, and rows that are shuffled are nodes, not pairs of nodes and directories below.
    """
    scratch = Scratch(dirs.sparkSession, "tree-hashes")
    parts = F.split("dir", "/", -1)
    own = scratch.cut(dirs.where("dir IS NOT NULL").select("dir", "n_symbols", (F.size(parts) - 1).alias("depth")), "own", by="depth")
    deepest = own.agg(F.max("depth")).first()[0]
    at = F.split("node", "/", -1)
    above = F.array_join(F.slice(at, F.lit(1), F.size(at) - 1), "/")
    body = F.concat(F.coalesce(F.max("own").cast("string"), F.lit("")), F.lit("/"), F.array_join(F.sort_array(F.collect_list("part")), "/"))
    out = None
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        rows = own.where(F.col("depth") == depth).select(F.col("dir").alias("node"), F.col("n_symbols").alias("own"), F.lit(None).cast("string").alias("part"))
        if out is not None:  # `last` is the level below
            rows = rows.unionByName(last.select(above.alias("node"), F.lit(None).cast("long").alias("own"), F.concat("body_hash", F.element_at(at, -1)).alias("part")))
        last = scratch.cut(rows.groupBy("node").agg(F.sha2(body, 256).alias("body_hash")), f"level{depth}")
        out = last if out is None else out.unionByName(last)
    return dirs.sparkSession.createDataFrame([], "node string, body_hash string") if out is None else out


def in_area(column: str, area: str) -> F.Column:
    return (F.col(column) == area) | F.col(column).startswith(area + "/")


def status(chunks: DataFrame, embeddings: DataFrame | None = None) -> DataFrame:
    """One row of counts over the index."""
    n = lambda cond: F.count(F.when(cond, 1))
    rows = chunks.select("chunk_id", "chunk_type", "kind", "file", "name")
    counts = rows.agg(
        F.count("*").alias("n_chunks"), F.count_distinct("file").alias("n_files"), n(F.col("chunk_type") == "code").alias("n_code"), n(F.col("chunk_type") == "doc").alias("n_doc"),
        n(F.col("kind").isin("function", "method")).alias("n_functions"), n(F.col("kind").isin(*CONTAINERS)).alias("n_types"),
    )
    twice = rows.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("duplicate_names"))
    out = counts.join(F.broadcast(twice), F.lit(True))
    if embeddings is None:
        return out.withColumn("n_embedded", F.lit(0).cast("long")).withColumn("pending", F.col("n_chunks")).withColumn("recommendation", S.recommendation(F.col("n_chunks")))
    held = rows.join(embeddings.select("chunk_id").distinct(), "chunk_id", "left_semi").agg(F.count("*").alias("n_embedded"))
    out = out.join(F.broadcast(held), F.lit(True)).withColumn("pending", F.greatest(F.lit(0), F.col("n_chunks") - F.col("n_embedded")))
    return out.withColumn("recommendation", S.recommendation(F.col("pending")))
