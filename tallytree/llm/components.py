"""Connected components of a graph of longs, by alternating large-star and small-star steps.

No part of the graph is collected: each step is an aggregation and a join, and each round is written
to the shared folder, so that a lost executor costs one round at most. A node with very many
neighbours (the smallest of a large component ends so) is handled by partial aggregation and by joins
that AQE splits where they are skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _star(edges: DataFrame, both: DataFrame, large: bool) -> DataFrame:
    """Links the (larger, or else the not larger) neighbours of each node u to the least one among u and its neighbours."""
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    linked = both.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.where("v <= u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v): root is the least node of its component.

    Links of a node to itself, repeated links and either direction are allowed; nulls are dropped.
    """
    edges = links.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = checkpointed(edges, small=True)
    mark = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        edges = _star(edges, both, large=True)
        edges = checkpointed(_star(edges, edges, large=False), small=True)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
