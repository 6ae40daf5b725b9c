"""Connected components of a graph given as pairs, by large-star and small-star rounds of joins.

Every round rewires each node to the smallest node that it or a neighbour knows. Pairs that end as stars around
the smallest member are the fixed point; the number of rounds grows with the logarithm of a component's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantcast.llm.shared import salted_lookup, stored

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    upward = salted_lookup(both.where(F.col("v") > F.col("u")), low, "u", F.col("v"))
    return upward.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = salted_lookup(edges, low, "u", F.col("v")).where(F.col("v") != F.col("m"))
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(pairs: DataFrame) -> DataFrame:
    """Node and component (its smallest node) of every node that occurs in ``pairs`` (two long columns).

    Pairs may repeat and come in either direction; pairs of a node with itself or with null say nothing. No pairs
    give an empty table.
    """
    a, b = (F.col(c) for c in pairs.columns[:2])
    edges = stored(
        pairs.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    before = _state(edges)
    for _ in range(MAX_ROUNDS):
        if before[0] == 0:
            break
        edges = stored(_small_star(_large_star(edges)), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.union(roots)


def smallest_keys(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``node`` and ``component_id``, the least ``first`` of all nodes reachable over ``pairs``. ``nodes`` (``node``, ``first``) is a
    written table with one row per node; nulls in ``first`` lose to any value."""
    linked = stored(components(pairs), "linked").withColumnRenamed("node", "_n")
    joined = nodes.select("node", "first").join(linked, F.col("node") == F.col("_n")).drop("_n")
    lowest = joined.groupBy("component").agg(F.min("first").alias("lowest"))
    merged = salted_lookup(joined, lowest, "component", F.col("node")).select(F.col("node").alias("_n"), "lowest")
    own = F.when(F.col("_n").isNull(), F.col("first")).otherwise(F.col("lowest"))
    return nodes.select("node", "first").join(merged, F.col("node") == F.col("_n"), "left").select("node", own.alias("component_id"))
