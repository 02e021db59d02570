"""Contract rows: one row per use of a source path at a sink, with the condition it happens under."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shalebed.operators.tables import kept


def canonicalize(rows: DataFrame, site: list[str], condition: str) -> DataFrame:
    """One row per site: its distinct conditions, sorted."""
    return rows.groupBy(*site).agg(F.array_sort(F.collect_set(condition)).alias("conditions"))


def drop_defaulted(rows: DataFrame, site: list[str], is_default: Column) -> DataFrame:
    """Rows whose site has no defaulted row, and the defaulted rows themselves."""
    marked = rows.where(is_default).select(*site).distinct()
    return rows.where(~is_default).join(marked, site, "left_anti").unionByName(rows.where(is_default))


def drop_subsumed(rows: DataFrame, site: list[str], members: str, row_id: str) -> DataFrame:
    """Drops a row if another of its site has a strict superset of its members (of equal sets, the smallest id stays).

    The join is on site and one member of the set, the one that the fewest rows of the site have: what holds all members
    holds that one too. The empty set is below every other of its site, which counts alone tell.
    """
    empty = rows.where(F.size(members) == 0)
    full = rows.where(F.size(members) > 0)
    sets = full.select(*site, F.col(row_id).alias("_j"), F.array_distinct(members).alias("_o"))
    each = sets.select("*", F.explode("_o").alias("_k"))
    uses = each.groupBy(*site, "_k").agg(F.count("*").alias("_n"))
    rarest = each.join(uses, [*site, "_k"]).groupBy(*site, "_j").agg(F.min(F.struct("_n", "_k"))["_k"].alias("_k"))
    a = sets.join(rarest, [*site, "_j"]).select(*site, "_k", F.col("_j").alias("_i"), F.col("_o").alias("_m"))
    more = (F.size("_o") > F.size("_m")) | ((F.size("_o") == F.size("_m")) & (F.col("_j") < F.col("_i")))
    lost = a.join(each, [*site, "_k"]).where((F.size(F.array_except("_m", "_o")) == 0) & more).select(F.col("_i").alias(row_id)).distinct()
    kept = full.join(lost, row_id, "left_anti")
    first = empty.groupBy(*site).agg(F.min(row_id).alias(row_id))
    alone = empty.join(first, [*site, row_id], "left_semi").join(full.select(*site).distinct(), site, "left_anti")
    return kept.unionByName(alone)


def evidence(rows: DataFrame, path: str, facts: dict[str, Column], all_facts: dict[str, Column], sets: dict[str, str]) -> DataFrame:
    """Per path: facts joined by OR, all-facts by AND, and sets of strings."""
    return rows.groupBy(path).agg(*[F.bool_or(c).alias(n) for n, c in facts.items()], *[F.bool_and(c).alias(n) for n, c in all_facts.items()], *[F.array_join(F.array_sort(F.collect_set(c)), ",").alias(n) for n, c in sets.items()])


def overlays(rows: DataFrame, path: str, guards: Column, value: Column) -> DataFrame:
    """Two levels: by path and guards first, then the branches of each path."""
    inner = rows.groupBy(path, guards.alias("guards")).agg(F.array_sort(F.collect_set(value)).alias("values"))
    return inner.groupBy(path).agg(F.count("*").alias("branches"), F.max(F.size("values")).alias("widest"))


def first_writer(rows: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key; by min_by, so a large key needs no sorting in one task."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.min(F.struct(*[F.struct(*order).alias("_o"), *rest])).alias("_b"))
    return best.select(*key, *[F.col(f"_b.{c}").alias(c) for c in rest])


def rank_conditions(rows: DataFrame, condition: str, ranges: int = 64) -> DataFrame:
    """Dense rank over the distinct conditions only; rows get it by a join.

    Distinct conditions are cut into ranges, ranked inside each, and moved by how many the ranges before them hold.
    """
    distinct = kept(rows.select(condition).distinct().repartitionByRange(ranges, condition).withColumn("_range", F.spark_partition_id()), "conditions")
    sizes = distinct.groupBy("_range").agg(F.count("*").cast("int").alias("_n"))  # a row for each range
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    inside = distinct.withColumn("_r", F.row_number().over(Window.partitionBy("_range").orderBy(condition)))
    ranks = inside.join(F.broadcast(before.select("_range", "_before")), "_range").select(condition, (F.col("_r") + F.col("_before")).alias("rank"))
    return rows.join(ranks, condition)


def emission_report(rows: DataFrame, kind: str, origin: str) -> DataFrame:
    return rows.rollup(kind, origin).agg(F.count("*").alias("n"))


def merge_runs(rows: DataFrame, site: list[str], sets: list[str], flags: list[str]) -> DataFrame:
    """Rows equal in their site become one: sets are united (sorted, distinct), flags joined by OR. No order is needed, so no run meets whole in one task."""
    return rows.groupBy(*site).agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in sets], *[F.bool_or(c).alias(c) for c in flags])


def merge_pathless(rows: DataFrame, key: list[str], resource: str, order: list[str]) -> DataFrame:
    """Rows without a sink: one for each key, with the first resource that is known."""
    known = F.when(F.col(resource).isNotNull(), F.struct(*order))
    return rows.groupBy(*key).agg(F.min_by(resource, known).alias(resource))


def render_fold(rows: DataFrame, path: str, kinds: str, nullable: str) -> DataFrame:
    """Per path: whether all rendered uses are of one tolerant kind, and all observations admit null. Reads alone say nothing of rendering (NULL)."""
    rendered = F.col(kinds) != "read"
    return rows.groupBy(path).agg(
        F.bool_and(F.when(rendered, F.col(kinds).isin("serialized", "yaml_serialized", "templated_yaml_serialized"))).alias("all_serialized"), F.bool_and(F.when(rendered, F.col(kinds) == "partial_scalar")).alias("all_partial"), F.bool_and(nullable).alias("all_nullable")
    )


def member_access(rows: DataFrame, path: str, handled: str, condition: str) -> DataFrame:
    """By path and the kinds that a branch handles: all conditions under which members are read."""
    return rows.groupBy(path, F.array_sort(F.array_distinct(handled)).alias(handled)).agg(F.array_sort(F.collect_set(condition)).alias("conditions"))


def distinct_uses(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Each use once, where it came first."""
    return rows.groupBy(*key).agg(F.min(order).alias(order))


def mark_descendants(paths: DataFrame, path: str = "path") -> DataFrame:
    """paths with whether any path lies below, and whether any lies below as an item (`*`). Each path is exploded into its ancestors, which join by equality."""
    from shalebed.functions.paths import join_path, split_path

    p = paths.select(F.col(path)).distinct().withColumn("_s", split_path(F.col(path)))
    up = p.where(F.size("_s") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("_s") - 1), lambda i: F.struct(join_path(F.slice("_s", F.lit(1), i)).alias("a"), F.get("_s", i).alias("next")))).alias("x"))
    below = up.groupBy(F.col("x.a").alias(path)).agg(F.lit(True).alias("has_descendants"), F.bool_or(F.col("x.next") == "*").alias("has_item_descendants"))
    out = p.drop("_s").join(below, path, "left")
    return out.select(path, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("has_descendants", "has_item_descendants")])


def union_contracts(*rows: DataFrame) -> DataFrame:
    """All rows of all contracts; columns that one lacks are null there."""
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


def apply_activation(rows: DataFrame, sets: DataFrame, chart: str, guards: str, condition: str) -> DataFrame:
    """A row for each of its chart's alternative sets of guards, each added to every alternative of the row's condition; charts that are always on keep their rows as they are."""
    j = rows.join(sets.select(chart, F.col(guards).alias("_g")), chart, "left")
    more = F.transform(F.col(condition), lambda t: F.array_sort(F.array_distinct(F.concat(t, F.coalesce("_g", F.array().cast("array<string>"))))))
    return j.withColumn(condition, more).drop("_g")


def project_globals(rows: DataFrame, sources: DataFrame, chart: str, path: str, ancestors: DataFrame) -> DataFrame:
    """Uses of a chart's globals, once more for each chart above whose values set that global: (.., owner). ancestors: chart, ancestor."""
    below = rows.where(F.col(path).startswith("global.") | (F.col(path) == "global"))
    owned = below.join(ancestors, chart).join(sources.select(F.col(chart).alias("ancestor"), F.col(path)).distinct(), ["ancestor", path])
    return owned.withColumnRenamed("ancestor", "owner")


def span_attribution(points: DataFrame, spans: DataFrame, file: str, at: str, start: str, end: str, block: int = 4096) -> DataFrame:
    """Each point with the innermost span of its file that holds it (start <= at < end): an interval join by blocks of places, so that it is an equi join."""
    s = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / block), F.floor((F.greatest(F.col(end), F.col(start) + 1) - 1) / block))))
    p = points.withColumn("_b", F.floor(F.col(at) / block))
    other = [c for c in s.columns if c not in (file, "_b")]
    key = points.columns
    held = p.join(s, [file, "_b"], "left").withColumn("_in", (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end)))
    best = held.groupBy(*key).agg(F.min(F.when(F.col("_in"), F.struct((F.col(end) - F.col(start)).alias("_len"), *other))).alias("_best"))
    return best.select(*key, *[F.col(f"_best.{c}").alias(c) for c in other])
