"""Connected components of a graph of bigint nodes by alternating large-star and small-star rounds.

Every round is two aggregations with map-side minimum and two joins; no neighbourhood is ever collected, so a node with
a third of all edges costs one row per task in the aggregation and a splittable side in the join. Rounds end when no
edge changes, after a number of rounds that grows with the logarithm of the longest path. Each round is written to
the shared folder, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(low, "u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) of every node with an edge; component is the least node. edges: u, v, loops ignored."""
    current = stage(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u != v").distinct(), "edges")
    mark = _mark(current)
    for _ in range(rounds):
        current = stage(_small_star(_large_star(current)), "edges")
        last, mark = mark, _mark(current)
        if mark == last:
            break
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
