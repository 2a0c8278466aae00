"""Connected components by alternating large-star and small-star.

Kiveris et al., "Connected Components in MapReduce and Beyond".  Every round is two
aggregations and two joins on node ids; a hub is one hot key of a join, which Spark
splits.  Each round is written to the shared folder, so plans stay short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def _large_star(edges: DataFrame) -> DataFrame:
    """Neighbours larger than a node are linked to the smallest in its neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Neighbours smaller than a node, and the node, are linked to the smallest.  ``u > v`` in every row."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    digest = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(digest)).first())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node`` and ``component_id`` (its smallest reachable node) of every node with an edge.

    ``edges``: columns u and v, any order, repeated or not.  Loops and nulls link nothing.
    """
    u, v = F.greatest("u", "v"), F.least("u", "v")
    now = edges.where("u <> v").select(u.alias("u"), v.alias("v")).distinct()
    now = settle(now, name)
    mark = _mark(now)
    while mark[0]:
        now = settle(_small_star(_large_star(now)), name)
        before, mark = mark, _mark(now)
        if mark == before:
            break
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component_id"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component_id")).union(roots)
