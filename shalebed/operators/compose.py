"""Layered defaults over leaf rows (path, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shalebed.functions.paths import join_path, split_path


def compose(parent: DataFrame, child: DataFrame, key: list[str], value: str) -> DataFrame:
    """The parent's value wins; a row that the parent holds as null is deleted."""
    p = parent.select(*key, F.col(value).alias("_p"), F.lit(True).alias("_in"))
    c = child.select(*key, F.col(value).alias("_c"))
    return p.join(c, key, "full").where(F.col("_in").isNull() | F.col("_p").isNotNull()).select(*key, F.coalesce("_p", "_c").alias(value))


def subtract(composed: DataFrame, declared: DataFrame, key: list[str]) -> DataFrame:
    return composed.join(declared.select(*key).distinct(), key, "left_anti")


def activation_product(*levels: DataFrame) -> DataFrame:
    """All combinations of a few alternatives of each level; levels after the first are broadcast, and any above a thousand rows is refused."""
    out = levels[0]
    if out.limit(1001).count() > 1000:
        raise ValueError("an activation level has more than 1000 alternatives")
    for level in levels[1:]:
        if level.limit(1001).count() > 1000:
            raise ValueError("an activation level has more than 1000 alternatives")
        out = out.crossJoin(F.broadcast(level))
    return out


def union_paths(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def intersect_paths(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def except_paths(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def prefix_join(paths: DataFrame, prefixes: DataFrame, path: str, prefix: str) -> DataFrame:
    """Ancestor-descendant join as an equi join: each path is exploded into its own ancestors, segment by segment (escaped dots separate none)."""
    parts = split_path(F.col(path))
    ancestors: Column = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: join_path(F.slice(parts, F.lit(1), i)))
    return paths.where(F.size(parts) > 1).withColumn("_a", F.explode(ancestors)).join(prefixes.withColumnRenamed(prefix, "_a"), "_a").withColumnRenamed("_a", prefix)


def compose_globals(parent: DataFrame, child: DataFrame, key: list[str], path: str, value: str) -> DataFrame:
    """The parent's `global` paths reach into the child and win there; all other paths stay the child's own."""
    is_global = (F.col(path) == "global") | F.col(path).startswith("global.")
    return compose(parent.where(is_global), child, key, value)


def remove_paths(rows: DataFrame, removed: DataFrame, path: str) -> DataFrame:
    """Rows without the removed paths and whatever lies below them."""
    below = prefix_join(rows.select(path).distinct(), removed.select(F.col(path).alias("_p")).distinct(), path, "_p").select(path)
    gone = removed.select(path).union(below).distinct()
    return rows.join(gone, path, "left_anti")
