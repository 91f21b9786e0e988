"""Call graph of functions: edges by containment of names, levels in the order of dependence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .containment import mentioned

#: Functions of at most so many open calls are gone over, as long as there are at most GROWTH times the calls that there were.
FEW, GROWTH = 4, 3


#: Kinds of chunks that are functions.
KINDS = ("function", "method")


def is_function() -> Column:
    return F.col("kind").isin(*KINDS) & (F.col("chunk_type") == "code")


def functions(chunks: DataFrame) -> DataFrame:
    return chunks.where(is_function()).select("chunk_id", "name", "content")


def kept(chunks: DataFrame) -> DataFrame:
    """What a call graph reads of chunks, as a table: it is read several times, and files are parsed once for it."""
    return Scratch(chunks.sparkSession, "functions").cut(chunks.where(is_function()).select("chunk_id", "chunk_type", "kind", "name", "content"), "functions")


def edges(chunks: DataFrame) -> DataFrame:
    """caller, callee, n: how many other functions of the callee's name the caller's bodies mention."""
    f = functions(chunks)
    hits = mentioned(f.select(F.col("name").alias("caller"), "content"), f, "content", "name").select("caller", F.col("name").alias("callee"))
    names = f.groupBy(F.col("name").alias("callee")).agg(F.count("*").alias("same"))
    # the function itself is no other function of its name
    hits = hits.join(names, "callee").withColumn("n", F.col("same") - (F.col("caller") == F.col("callee")).cast("int"))
    return hits.where("n > 0").groupBy("caller", "callee").agg(F.sum("n").alias("n"))


def token_edges(chunks: DataFrame) -> DataFrame:
    """A cheaper reading: names that occur as whole words. It misses names inside of longer words; an equi-join at any size."""
    f = functions(chunks)
    words = f.select(F.col("name").alias("caller"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\w+"), F.lit(0)))).alias("callee"))
    return words.join(f.select(F.col("name").alias("callee")).distinct(), "callee", "left_semi").where("caller <> callee").distinct()


def _trimmed(scratch: Scratch, calls: DataFrame, name: str) -> DataFrame:
    """`calls` without those of functions that nothing left calls, or that call nothing left: these are on no cycle.

    Each round takes a layer off either end; deeper graphs are left to what follows.
    """
    left, n = scratch.counted(calls, f"{name}0")
    for step in range(1, 2 * n.bit_length() + 4):
        if not n:
            break
        kept = left.join(left.select(F.col("caller").alias("callee")).distinct(), "callee", "left_semi")
        kept = kept.join(left.select(F.col("callee").alias("caller")).distinct(), "caller", "left_semi")
        before = n
        left, n = scratch.counted(kept.select("caller", "callee"), f"{name}{step}")
        scratch.drop(f"{name}{step - 1}")
        if n == before:
            break
    return left


def _gone_over(some: DataFrame, left: DataFrame, few: int) -> DataFrame:
    """`some` calls of `left`, each of a function that has at most `few` calls replaced by all that this one calls."""
    onward = left.groupBy("caller").agg(F.count("*").alias("n")).where(F.col("n") <= few).select("caller")
    onward = left.join(onward, "caller", "left_semi").toDF("via", "next")
    return some.withColumnRenamed("callee", "via").join(onward, "via", "left").select("caller", F.coalesce("next", "via").alias("callee"))


def _least(scratch: Scratch, calls: DataFrame, seed: int, name: str) -> DataFrame:
    """name, least: the least label (a hash of names) of what a function reaches.

    Labels go a call further each round, while calls go twice as far.
    """
    names = calls.select(F.col("caller").alias("name")).union(calls.select("callee")).distinct()
    state = scratch.cut(names.withColumn("least", F.xxhash64("name", F.lit(seed))), f"{name}s0")
    left, step, n = calls, 0, calls.count()
    most = GROWTH * n
    while True:
        told = left.join(state.select(F.col("name").alias("callee"), F.col("least").alias("said")), "callee")
        said = told.groupBy(F.col("caller").alias("name")).agg(F.min("said").alias("said"))
        state = state.join(said, "name", "left").select("name", F.least("least", "said").alias("least"), (F.col("said") < F.col("least")).alias("new"))
        state, seen = scratch.observed(state, f"{name}s{step + 1}", new=F.count_if("new"))
        if not seen["new"]:
            return state.select("name", "least")
        left, n = scratch.counted(_gone_over(left, left, FEW if n <= most else 1).where("caller <> callee").distinct(), f"{name}c{step}")
        step += 1


def cyclic(scratch: Scratch, calls: DataFrame) -> DataFrame:
    """The calls between different functions of one strongly connected component.

    Functions of a component reach the same least label and are reached from the same one. Calls between functions that differ
    in either are cut, with other labels each time, until none is: then the least of each part reaches all of it
    and is reached by all of it. Rounds grow with the logarithm of the size.
    """
    left = _trimmed(scratch, calls.where("caller <> callee").select("caller", "callee"), "trim0-")
    seed, n = 0, left.count()
    while n:
        down = _least(scratch, left, seed, f"down{seed}-")
        up = _least(scratch, left.select(F.col("callee").alias("caller"), F.col("caller").alias("callee")), seed, f"up{seed}-")
        both = down.join(up.withColumnRenamed("least", "from"), "name")
        same = left.join(both.toDF("caller", "a", "b"), "caller").join(both.toDF("callee", "c", "d"), "callee").where("a = c AND b = d")
        seed += 1
        kept = _trimmed(scratch, same.select("caller", "callee"), f"trim{seed}-")
        left, before = kept, n
        n = left.count()
        if n == before:
            break
    return left


def _longest(scratch: Scratch, state: DataFrame, calls: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """name, level: the longest way down from each function over calls (caller, callee, d), and not less than its `level`; and the functions that a cycle leaves open.

    A round takes in the callees that are settled, and calls go twice as far, so chains and branches of n take about log n rounds.
    Without a cycle, each round settles a function. A round is one job: what is told to a function and what its calls become
    come of one join. It writes the calls of open functions only, with their levels; what is settled is written once. Calls of one function meet
    in a task, sorted and not held.
    """
    spark, of, types = scratch.spark, Window.partitionBy("name"), {f.name: f.dataType.simpleString() for f in [*state.schema, *calls.schema]}
    schema = f"name {types['name']}, level int, callee {types['callee']}, d int, n long, nth int, step int, open int"

    def written(rows: DataFrame, step: int) -> tuple[DataFrame, int, int]:
        """The table, its calls and its functions that are open; one that is settled has a row without a callee."""
        rows = rows.withColumn("level", F.max("level").over(of)).withColumn("n", F.count("callee").over(of)).where("n = 0 OR callee IS NOT NULL")
        rows = rows.withColumn("nth", F.row_number().over(of.orderBy("callee"))).withColumn("open", (F.col("n") > 0).cast("int"))
        _, seen = scratch.observed(rows, f"{name}/step={step}", by="open", calls=F.count("callee"), open=F.count_if(F.expr("nth = 1 AND n > 0")))
        if step:
            scratch.drop(f"{name}/step={step - 1}/open=1")
        held = spark.read.schema(schema).parquet(f"{scratch.root}/{name}")
        return held, seen["calls"], seen["open"]

    first = state.join(calls.withColumnRenamed("caller", "name"), "name", "left").select("name", "level", "callee", "d")
    (held, n, open_), step = written(first, 0), 0
    most = GROWTH * n
    while n:
        # what a call leads to that is gone over, settled or not, is taken in by the next round; calls to what is settled have been
        onward = [c for k in range(FEW) for c in (F.max(F.when(F.col("nth") == k + 1, F.col("callee"))).alias(f"next{k}"), F.max(F.when(F.col("nth") == k + 1, F.col("d"))).alias(f"far{k}"))]
        said = held.groupBy(F.col("name").alias("callee")).agg(F.max("level").alias("said"), F.max("n").cast("int").alias("n"), *onward)
        over = F.slice(F.array(*[F.struct(F.col(f"next{k}").alias("callee"), (F.col("d") + F.col(f"far{k}")).alias("d")) for k in range(FEW)]), F.lit(1), F.col("n"))
        over = F.when(F.col("n") <= (FEW if n <= most else 1), over).otherwise(F.array(F.struct("callee", "d")))
        told = held.where("open = 1").select("name", "level", "callee", "d").join(said, "callee")
        told = told.select("name", F.greatest("level", F.col("said") + F.col("d")).alias("level"), F.explode_outer(over).alias("call"))
        # dealt by caller for what follows too
        told = told.select("name", "level", "call.callee", "call.d").repartition("name").groupBy("name", "callee").agg(F.max("level").alias("level"), F.max("d").alias("d"))
        step, before = step + 1, open_
        held, n, open_ = written(told, step)
        if open_ == before:
            break
    ends = held.where("nth = 1")
    return ends.select("name", "level"), ends.where("open = 1").select("name")


def levels(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """name, level: 0 for those that call nothing, else one more than the highest callee.

    On a cycle, which has no unique answer, a call to the function itself or to one that comes before it by name counts as level 0, if both
    are in one strongly connected component; all other calls count, and have no cycle. Then levels close up. Names that call or are called
    are numbered in their order first, and all rounds are on numbers; names alone are of level 0.
    """
    spark, scratch = vertices.sparkSession, Scratch(vertices.sparkSession, "levels")
    vertices = vertices.select("name").distinct()
    edges = scratch.cut(edges.select("caller", "callee").distinct(), "edges")
    ends = edges.select(F.explode(F.array("caller", "callee")).alias("name")).distinct().join(vertices, "name", "left_semi")
    said = scratch.numbered(ends, "number", "name", name="names")
    names, number = said.select(F.col("number").alias("name")), lambda column: said.toDF(column, f"{column}_number")
    alone, n_alone = scratch.counted(vertices.join(said, "name", "left_anti").select("name", F.lit(0).alias("level")), "alone")
    calls = edges.join(number("callee"), "callee").join(number("caller"), "caller")
    calls = scratch.cut(calls.select(F.col("caller_number").alias("caller"), F.col("callee_number").alias("callee")), "calls")
    one = lambda rows: rows.select(F.col("caller").alias("name"), F.lit(1).alias("least")).distinct()
    floor = lambda names, rows: names.join(one(rows), "name", "left").select("name", F.coalesce("least", F.lit(0)).alias("level"))
    own, others = calls.where("caller = callee"), calls.where("caller <> callee")
    done, open_ = _longest(scratch, floor(names, own), others.withColumn("d", F.lit(1)), "way")
    if open_.take(1):  # on cycles, or above
        left = others.join(open_.toDF("caller"), "caller", "left_semi")
        back = scratch.cut(cyclic(scratch, left.join(open_.toDF("callee"), "callee", "left_semi").select("caller", "callee")).where("callee < caller"), "back")
        state = done.join(open_, "name", "left_anti").unionByName(floor(open_, own.unionByName(back)))
        done, _ = _longest(scratch, state, left.select("caller", "callee").join(back, ["caller", "callee"], "left_anti").withColumn("d", F.lit(1)), "rest")
    used = sorted({r.level for r in done.select("level").distinct().collect()} | ({0} if n_alone else set()))
    done = done.join(F.broadcast(spark.createDataFrame([(level, k) for k, level in enumerate(used)], "level int, closed int")), "level")
    return done.withColumnRenamed("name", "number").join(said, "number").select("name", F.col("closed").alias("level")).unionByName(alone)


def stats(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n_functions, n_calls, n_leaves."""
    v = vertices.select("name").distinct()
    leaves = v.join(edges.select(F.col("caller").alias("name")), "name", "left_anti").agg(F.count("*").alias("n_leaves"))
    out = v.agg(F.count("*").alias("n_functions")).join(F.broadcast(edges.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_calls"))), F.lit(True))
    return out.join(F.broadcast(leaves), F.lit(True))
