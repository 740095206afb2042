"""Commit graphs as tables of edges (child, parent)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.lineage import cut


def ancestors(edges: DataFrame, start: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, ancestor, depth): ancestors within depth steps of start's nodes (all of them where depth
    is None), with their least depth; each node is its own at depth 0.

    One join for each step, from what the last one found, until a step finds nothing new.
    Every step is written, so the plan of a step does not hold those before it.
    """
    edges = cut(edges.select("child", "parent").where("child IS NOT NULL AND parent IS NOT NULL").distinct())
    front = cut(start.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")).where("node IS NOT NULL").distinct())
    known, d = front, 0
    while d != depth and not front.isEmpty():
        d += 1
        step = front.join(edges, front["ancestor"] == edges["child"]).select("node", F.col("parent").alias("ancestor")).distinct()
        front = cut(step.join(known.select("node", "ancestor"), ["node", "ancestor"], "left_anti").withColumn("depth", F.lit(d)))
        known = known.unionByName(front)
    return known


def filter_ancestors(edges: DataFrame, heads: DataFrame, depth: int | None = None) -> DataFrame:
    """heads (node) that no other head reaches within depth steps."""
    reached = ancestors(edges, heads, depth).where("depth > 0").select(F.col("ancestor").alias("node")).distinct()
    return heads.join(reached, "node", "left_anti")


def common_ancestor(edges: DataFrame, pairs: DataFrame, depth: int | None = None) -> DataFrame:
    """(a, b, common): for pairs (a, b) the nearest common ancestor, null where there is none: least
    of the larger of both depths, the first commit's side before the second's, then the smallest."""
    up = cut(ancestors(edges, pairs.select(F.explode(F.array("a", "b")).alias("node")), depth))
    one = pairs.distinct().join(up.select(F.col("node").alias("a"), "ancestor", F.col("depth").alias("d1")), "a")
    both = one.join(up.select(F.col("node").alias("b"), "ancestor", F.col("depth").alias("d2")), ["b", "ancestor"])
    rank = F.struct(F.greatest("d1", "d2"), F.when(F.col("d1") > F.col("d2"), 0).otherwise(1), F.col("ancestor"))
    found = both.groupBy("a", "b").agg(F.min_by("ancestor", rank).alias("common"))
    return pairs.distinct().join(found, ["a", "b"], "left")
