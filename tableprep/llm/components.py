"""Connected components of a link table by hooking and contraction, entirely as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.llm.base import stage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component) for every node that has a link; the component is its smallest node.

    Each round every node hooks to its smallest smaller neighbour, the hooks are followed to their roots by pointer
    doubling, and the links are contracted to roots. A node with a smaller neighbour disappears from the links, so the
    rounds grow with the logarithm of the nodes. Grouping is by partial minima and joins are against tables with one
    row a node, so a hub with many links is no single group. Nulls and self-links are ignored.
    """
    links = edges.select(F.least(F.col(a), F.col(b)).alias("a"), F.greatest(F.col(a), F.col(b)).alias("b"))
    links = stage(links.where(F.col("a") < F.col("b")).distinct())
    mapping = None
    while True:
        hooks = stage(links.groupBy("b").agg(F.min("a").alias("up")).withColumnRenamed("b", "node"))
        if hooks.isEmpty():
            break
        while True:  # follow the hooks to the roots
            above = hooks.select(F.col("node").alias("up"), F.col("up").alias("upper"))
            doubled = stage(hooks.join(above, "up", "left").select(
                "node", F.coalesce("upper", "up").alias("up"), F.col("upper").isNotNull().alias("moved")))
            moved = not doubled.where("moved").isEmpty()
            hooks = doubled.select("node", "up")
            if not moved:
                break
        if mapping is None:
            mapping = hooks
        else:
            step = hooks.select(F.col("node").alias("component"), F.col("up").alias("upper"))
            followed = mapping.join(step, "component", "left").select(
                "node", F.coalesce("upper", "component").alias("component"))
            mapping = stage(followed.unionByName(hooks.withColumnRenamed("up", "component"))
                            .groupBy("node").agg(F.min("component").alias("component")))
        if "up" in mapping.columns:
            mapping = mapping.withColumnRenamed("up", "component")
        low = hooks.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        high = hooks.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        moved_links = links.join(low, "a", "left").select(F.coalesce("ua", "a").alias("a"), "b")
        moved_links = moved_links.join(high, "b", "left").select("a", F.coalesce("ub", "b").alias("b"))
        links = stage(moved_links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                      .where("a < b").distinct())
    if mapping is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = mapping.select(F.col("component").alias("node"), "component").distinct()
    return mapping.unionByName(roots).distinct()
