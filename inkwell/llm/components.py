"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_dir, written


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(a, b) edges -> (node, root): root is the least node of its component. Loops and repeats are fine.

    Each round joins every edge with the least neighbour of its end, and is written, so that lineage stays
    short; a component's edges end as a star around its least node. Nothing is gathered by node but a
    minimum, so a node may have any number of edges.
    """
    path = shared_dir(edges.sparkSession)
    pairs = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{path}/0")
    for k in range(1, most_rounds + 1):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(low, "u")
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        small = written(small.filter("u <> v").distinct(), f"{path}/{k}")
        # done when it is a star forest: no node is both an end and a root
        done = small.join(small.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty() and small.groupBy("u").count().filter("count > 1").isEmpty()
        pairs = small
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
