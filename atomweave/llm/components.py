"""Connected components by alternating large-star and small-star steps.

Both steps are a grouped minimum and a join back, so a node with very many neighbours is combined before the shuffle and its
edges are split by the skew join. The edge list is checkpointed after each round; the driver sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _stars(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs(u, v), each node u with all (large) or the smaller (small) of its neighbours v: every v (and u) is tied to the least of them."""
    least = checkpointed(pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
    tied = pairs.join(least, "u")
    if large:
        return tied.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.filter("m < u").select("u", F.col("m").alias("v"))).distinct()
    return tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of comparable ids -> (node, root): every node that has an edge, and the least node it can reach."""
    now = checkpointed(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        now = checkpointed(_stars(_stars(both, True), False))
        # a forest of stars with the same edges twice in a row is final
        seen = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == state:
            break
        state = seen
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
