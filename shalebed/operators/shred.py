"""Documents to leaf rows, and leaf rows to a profile of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shalebed.functions import truth
from shalebed.functions.paths import append_segment
from shalebed.functions.truth import kind_of, truthy_variant
from shalebed.operators.tables import kept

_NODE = "array<struct<path:string,v:variant,fresh:boolean>>"


def shred(df: DataFrame, id_col: str, document: Column, depth: int = 8) -> DataFrame:
    """(id, path, kind, truthy): a row per node below the root; array items have the segment '*'.

    One pass over the documents: each of `depth` steps puts the members of fresh containers beside what is there. A
    document that goes deeper is an error, never cut.
    """
    nodes = df.select(F.col(id_col).alias("id"), F.lit("").alias("path"), document.alias("v"), F.lit(True).alias("fresh"))
    for level in range(depth):
        own = F.array(F.struct("path", "v", F.lit(False).alias("fresh"))) if level else F.array().cast(_NODE)
        nodes = nodes.select("id", F.inline(F.when(F.col("fresh"), F.concat(own, _kids())).otherwise(F.array(F.struct("path", "v", "fresh")))))
    deeper = F.coalesce(F.col("fresh") & (F.coalesce(F.size(truth.members(F.col("v"))), F.size(truth.items(F.col("v")))) > 0), F.lit(False))
    path = F.when(deeper, F.raise_error(F.concat(F.lit(f"below more than {depth} levels: "), F.col("path")))).otherwise(F.col("path"))
    shaped = nodes.select("id", path.alias("path"), "v", F.schema_of_variant("v").alias("shape"))
    return shaped.select("id", "path", kind_of(F.col("v"), F.col("shape")).alias("kind"), truthy_variant(F.col("v"), F.col("shape")).alias("truthy"))


def _kids() -> Column:
    fields, elements = truth.members(F.col("v")), truth.items(F.col("v"))
    star = F.when(F.col("path") == "", F.lit("*")).otherwise(F.concat(F.col("path"), F.lit(".*")))
    of_object = F.transform(F.map_entries(fields), lambda e: F.struct(append_segment(F.col("path"), e["key"]).alias("path"), e["value"].alias("v"), F.lit(True).alias("fresh")))
    of_array = F.transform(elements, lambda x: F.struct(star.alias("path"), x.alias("v"), F.lit(True).alias("fresh")))
    return F.coalesce(of_object, of_array, F.array().cast(_NODE))


def profile(leaves: DataFrame) -> DataFrame:
    """Per path: occurrences, nulls, truthy ones, and the set of kinds."""
    per = leaves.groupBy("path").agg(
        F.count("*").alias("n"), F.count_if(F.col("kind") == "null").alias("nulls"), F.count_if("truthy").alias("truthy"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds")
    )
    return per


def required_paths(per: DataFrame, documents: int) -> DataFrame:
    """profile with `required`: present in every parent object (the root has `documents` of them). The profile is written first: it is joined with itself."""
    per = kept(per, "profile")
    parent = F.regexp_replace("path", r"(^|\.)(\\.|[^.\\])*$", "")
    hosts = per.select(F.col("path").alias("parent"), F.col("n").alias("hosts"))
    return per.withColumn("parent", parent).join(hosts, "parent", "left").withColumn("required", (F.col("n") == F.coalesce("hosts", F.lit(documents))) & ~F.col("path").endswith("*")).drop("parent", "hosts")


def leaf_facts(df: DataFrame, id_col: str, document: Column, depth: int = 8) -> DataFrame:
    """(path, explicit, string_default, empty_string, empty_map, mapping): what values say of each of their paths, items aside."""
    nodes = shred(df, id_col, document, depth).where(~F.col("path").rlike(r"(^|\.)\*(\.|$)"))
    k = F.col("kind")
    return nodes.groupBy("path").agg(
        F.lit(True).alias("explicit"), F.bool_or(k == "string").alias("string_default"), F.bool_or((k == "string") & ~F.col("truthy")).alias("empty_string"),
        F.bool_and((k == "object") & ~F.col("truthy")).alias("empty_map"), F.bool_and(k == "object").alias("mapping"),
    )


def string_defaults(values: DataFrame, prefix: str, path: str = "path", value: str = "value") -> DataFrame:
    """Rows below a prefix, with the rest of their path."""
    from shalebed.functions.paths import strip_prefix

    below = strip_prefix(F.col(path), F.lit(prefix))
    return values.withColumn(path, below).where(F.col(path).isNotNull())
