"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import cut


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One star step on pairs (a, b) with a > b. The minimum of a node's neighbours is an aggregate and comes back by a join, so no task gathers the neighbours of a node."""
    both = pairs.union(pairs.select(F.col("b"), F.col("a"))).toDF("u", "v") if large else pairs.toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
    joined = both.join(least, "u")
    out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    return out.where("a > b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (a, b); component is the least node reachable.

    Null ends and loops are ignored, repeated links count once; an empty table gives an empty one.
    """
    pairs = cut(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before, pairs = state, cut(_star(_star(pairs, True), False))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(pairs.select("b", "b").distinct())
