"""Ranked catalogs of known schemas: precedence lookup, version fallback, inference of a single answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def precedence_lookup(asked: DataFrame, answers: DataFrame, key: list[str], rank: str, value: str) -> DataFrame:
    """Each asked key with the value of its lowest rank; no answer: null."""
    best = answers.groupBy(*key).agg(F.min_by(value, rank).alias(value), F.min(rank).alias(rank))
    return asked.join(best, key, "left")


def fallback(asked: DataFrame, held: DataFrame, key: list[str], version: str, window: int) -> DataFrame:
    """The newest held version at or at most `window` below the asked one, per key and asked version (a range join on an equal key)."""
    tries = asked.select(*key, version).distinct().withColumn("_try", F.explode(F.sequence(F.col(version), F.col(version) - window, F.lit(-1))))
    found = tries.join(held.select(*key, F.col(version).alias("_try")).distinct(), [*key, "_try"]).groupBy(*key, version).agg(F.max("_try").alias("found"))
    return asked.join(found, [*key, version], "left")


def resolve_unique(rows: DataFrame, key: list[str], value: Column) -> DataFrame:
    """Resolved with the one distinct value, Ambiguous, or NoMatch."""
    out = rows.groupBy(*key).agg(F.min(value).alias("v"), F.max(value).alias("w"))
    one = F.col("v") == F.col("w")
    return out.select(*key, F.when(F.col("v").isNull(), "NoMatch").when(one, "Resolved").otherwise("Ambiguous").alias("outcome"), F.when(one, F.col("v")).alias("value"))


def resolve_ranked(rows: DataFrame, key: list[str], value: Column, authority: Column) -> DataFrame:
    """resolve_unique of the most authoritative rows of each key alone: the least authority wins, and the others have no say."""
    least = rows.groupBy(*key).agg(F.min(authority).alias("_least"))
    return resolve_unique(rows.join(least, key).where(authority == F.col("_least")), key, value)


def candidates(asked: DataFrame, answers: DataFrame, key: list[str], options: str, option: str, value: str) -> DataFrame:
    """Each asked key with the value of the first of its ranked candidates that has one; NULL where none has."""
    each = asked.select(*key, F.posexplode(options).alias("_place", option))
    found = each.join(answers.select(option, value), option).groupBy(*key).agg(F.min_by(value, "_place").alias(value), F.min("_place").alias("place"))
    return asked.join(found, key, "left")


def lookup_plan(resource: DataFrame, key: list[str], branches: str, versions: str, kinds: str) -> DataFrame:
    """(key, place, api_version, kind): live branch literals if there are any, else every ranked version with every kind, in that order."""
    live = F.transform(F.coalesce(F.col(branches), F.array().cast("array<string>")), lambda b: b)
    used = F.when(F.size(live) > 0, live).otherwise(F.array_distinct(F.col(versions)))
    pairs = F.flatten(F.transform(used, lambda v: F.transform(F.array_distinct(F.col(kinds)), lambda k: F.struct(v.alias("api_version"), k.alias("kind")))))
    return resource.select(*key, F.posexplode(pairs).alias("place", "p")).select(*key, "place", "p.api_version", "p.kind")


def infer_then_lookup(asked: DataFrame, inferred: DataFrame, answers: DataFrame, key: str, api: str, value: str) -> DataFrame:
    """Resources without an apiVersion take the inferred one, if it is resolved, and are looked up with it."""
    known = asked.join(inferred.where("outcome = 'Resolved'").select(key, F.col("value").alias("_v")), key, "left").withColumn(api, F.coalesce(F.col(api), "_v")).drop("_v")
    return known.join(answers, [key, api], "left").select(*asked.columns, value)


def presence(asked: DataFrame, held: DataFrame, key: list[str], complete: bool) -> DataFrame:
    """asked with `present`: true where it is held, false where the collection is complete, NULL where nothing can be told."""
    j = asked.join(held.select(*key).distinct().withColumn("_held", F.lit(True)), key, "left")
    return j.withColumn("present", F.coalesce("_held", F.lit(False) if complete else F.lit(None).cast("boolean"))).drop("_held")


def candidate_order(source: Column, origin: Column, api_version: Column) -> Column:
    """A comparable struct: what a chart ships before a shortlist, before caches, before the network; then the newest version."""
    rank = F.when(source == "chart_local", 0).when(source == "shortlist", 1).when(source == "cache", 2).otherwise(3)
    v = version_rank(F.regexp_extract(api_version, "([^/]*)$", 1))
    return F.struct(rank.alias("source"), F.when(origin == "collection", 0).otherwise(1).alias("origin"), (-v["stage"]).alias("stage"), (-v["number"]).alias("number"), (-v["minor"]).alias("minor"), api_version.alias("api_version"))


def lookup_trace(asked: DataFrame, providers: list[int], answers: DataFrame, key: list[str], rank: str) -> DataFrame:
    """(key, rank, outcome) of every attempt up to the one that answers: later providers, by rank, are never asked."""
    tries = asked.select(*key).distinct().withColumn(rank, F.explode(F.array(*[F.lit(p) for p in providers])))
    hit = answers.select(*key, rank).distinct().withColumn("_hit", F.lit(True))
    j = tries.join(hit, [*key, rank], "left")
    first = j.where("_hit").groupBy(*key).agg(F.min(rank).alias("_first"))
    out = j.join(first, key, "left").where(F.col("_first").isNull() | (F.col(rank) <= F.col("_first")))
    return out.select(*key, rank, F.when(F.col("_hit"), "found").otherwise("missing").alias("outcome"))


def live_branches(branches: DataFrame, known: DataFrame, key: list[str], api: str) -> DataFrame:
    """The first branch whose API is there; none at all where an unknown API comes before it. known: api, present (NULL: unknown); a branch without an API always lives."""
    j = branches.join(known.select(F.col(api), "present"), api, "left")
    lives = F.when(F.col(api).isNull(), F.lit(True)).otherwise(F.col("present"))
    open_at = j.where(lives.isNull()).groupBy(*key).agg(F.min("place").alias("_open"))
    first = j.where(lives).groupBy(*key).agg(F.min_by("literal", "place").alias("literal"), F.min("place").alias("place"))
    return first.join(open_at, key, "left").where(F.col("_open").isNull() | (F.col("place") < F.col("_open"))).drop("_open")


def all_resolve(asked: DataFrame, held: DataFrame, group: list[str], key: str) -> DataFrame:
    """Groups all of whose keys are held."""
    j = asked.join(held.select(key).distinct().withColumn("_held", F.lit(1)), key, "left")
    return j.groupBy(*group).agg(F.bool_and(F.col("_held").isNotNull()).alias("all_resolved"))


def version_rank(version: Column) -> Column:
    """stable above beta above alpha, then by number: a comparable struct of names like v1, v1beta2."""
    stage = F.when(version.rlike("alpha"), 0).when(version.rlike("beta"), 1).otherwise(2)
    number = F.coalesce(F.nullif(F.regexp_extract(version, r"^v(\d+)", 1), F.lit("")).cast("int"), F.lit(0))
    minor = F.coalesce(F.nullif(F.regexp_extract(version, r"(?:alpha|beta)(\d+)$", 1), F.lit("")).cast("int"), F.lit(0))
    return F.struct(stage.alias("stage"), number.alias("number"), minor.alias("minor"))


def candidate_files(api_version: Column, kind: Column) -> Column:
    """Ordered candidate file names for (apiVersion, kind)."""
    group, version = F.regexp_extract(api_version, "^(?:([^/]*)/)?", 1), F.regexp_extract(api_version, "([^/]*)$", 1)
    low = F.lower(kind)
    return F.when(group == "", F.array(F.concat_ws("-", low, version))).otherwise(F.array(F.concat_ws("-", low, F.regexp_extract(group, r"^([^.]*)", 1), version), F.concat_ws("-", low, group, version), F.concat_ws("-", low, version)))


def crd_path(group: Column, kind: Column, version: Column) -> Column:
    return F.concat(group, F.lit("/"), F.lower(kind), F.lit("_"), version, F.lit(".json"))
