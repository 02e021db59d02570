"""Reachability over reference edges, level by level; each level is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shalebed.operators.tables import kept


def reach(edges: DataFrame, roots: DataFrame, max_levels: int | None = None) -> DataFrame:
    """(node, depth): all nodes that roots (node) reach over edges (src, dst), until nothing is new. max_levels, if given, is a bound whose passing is an error."""
    seen = kept(roots.select("node").distinct().withColumn("depth", F.lit(0)), "reach")
    frontier, depth = seen, 0
    while True:
        depth += 1
        new = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(depth))
        frontier = kept(new, "reach")
        if not frontier.take(1):
            return seen
        if max_levels is not None and depth > max_levels:
            raise RuntimeError(f"nodes lie more than {max_levels} levels from the roots")
        seen = seen.unionByName(frontier)


def unreachable(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes that no root reaches: definitions to leave out."""
    return nodes.select("node").join(reach(edges, roots).select("node"), "node", "left_anti")


def ancestors(charts: DataFrame, path: str = "prefix") -> DataFrame:
    """(descendant, ancestor, up): every chart with each chart above it, by their prefixes as arrays; the root's is empty."""
    c = charts.select(F.col(path).alias("descendant"))
    above = c.select("descendant", F.explode(F.transform(F.sequence(F.lit(0), F.size("descendant") - 1), lambda i: F.slice("descendant", 1, i))).alias("ancestor")).where(F.size("descendant") > 0)
    return above.join(c.select(F.col("descendant").alias("ancestor")).distinct(), "ancestor").select("descendant", "ancestor", (F.size("descendant") - F.size("ancestor")).alias("up"))
