"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from latencylab.llm.shared import stored

MAX_ROUNDS = 60  # rounds needed grow with the logarithm of the longest chain


def _settled(edges: DataFrame, last: DataFrame | None, n: int, n_last: int) -> bool:
    """True if two tables of distinct links hold the same links."""
    return last is not None and n == n_last and not edges.join(last, ["a", "b"], "left_anti").take(1)


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node that has a link; ``root`` is the smallest node reachable.

    ``edges`` has comparable columns ``a > b``.  Each step replaces links by links to a node's smallest
    neighbour: minima are combined before the shuffle, and the joins are plain sort-merge joins of stored
    tables, whose hot keys (the centre of a large component) adaptive execution splits.  Every step is a
    table in the shared folder, so a lost executor costs one step at most.
    """
    edges = stored(edges.select("a", "b").distinct(), "links")
    n, last, n_last = edges.count(), None, 0
    for _ in range(MAX_ROUNDS):
        if not n or _settled(edges, last, n, n_last):
            break
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a > b").distinct(), "large")
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, n_last = edges, n
        edges = stored(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        n = edges.count()
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
