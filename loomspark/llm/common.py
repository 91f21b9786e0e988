"""What the operators share: connected components, and the tables that cut lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch, small_batches

__all__ = ["Scratch", "components", "small_batches", "some"]


def some(df: DataFrame) -> bool:
    return bool(df.take(1))


def components(scratch: Scratch, links: DataFrame, name: str = "cc") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of `links` (a, b).

    Alternates the large-star and small-star contractions, each of which is an aggregate
    and an equi-join; rounds grow with the logarithm of the size, not with the diameter.
    """
    edges = scratch.cut(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}0"
    )
    state = lambda: edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    step, before = 0, state()
    while before[0]:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.cut(large.where("u <> v"), f"{name}l{step}")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        edges = scratch.cut(small, f"{name}{step + 1}")
        scratch.drop(f"{name}l{step}", f"{name}{step}")
        step += 1
        if (now := state()) == before:
            break
        before = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
