"""Templates to contract rows over Spark: a chart's templates are interpreted together with the helpers that they see."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = (
    "chart string, template string, row string, source_path string, sink_path array<string>, kind string, condition array<array<string>>, exact boolean, line int, helpers array<string>, marks array<string>, "
    "api_version string, resource_kind string, api_version_candidates array<string>, resource_kind_candidates array<string>, detail string"
)


def interpret(templates: DataFrame, helpers: DataFrame, most_bytes: int = 256 << 20) -> DataFrame:
    """Rows of all templates. templates: (chart, path, source); helpers: (name, source), the define index, of at most most_bytes (it goes to every task).

    row tells uses (a path that is rendered at sink_path), reads (detail: if, with or range), aborts (detail: the message)
    and hints (detail: the kind) apart; a template that can't be parsed gives one row `error`. Every template is
    interpreted by itself, so a chart of any number of them is no one task's work.
    """
    spark = templates.sparkSession
    size = helpers.agg(F.sum(F.length("source"))).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"{size} characters of helpers; at most {most_bytes} are sent to every task")
    index = spark.sparkContext.broadcast({r["name"]: r["source"] for r in helpers.select("name", "source").collect()})

    def run(batches):
        import pandas as pd

        from shalebed.template import interpret as I
        from shalebed.template import parse as P

        parsed: dict = {}
        for name, source in index.value.items():
            try:
                parsed[name] = P.parse(source)
            except P.ParseError:
                continue
        nested: dict = {}
        for body in parsed.values():
            nested |= P.definitions(body)
        for pdf in batches:
            rows = []
            for chart, path, source in zip(pdf["chart"], pdf["path"], pdf["source"], strict=True):
                base = {"chart": chart, "template": path}
                try:
                    found = I.analyse(source, nested | parsed)
                except (P.ParseError, RecursionError) as e:
                    rows.append(base | {"row": "error", "detail": str(e)[:500]})
                    continue
                rows += [base | {"row": "use"} | r for r in found["uses"]]
                rows += [base | {"row": "read", "detail": r.pop("how")} | r for r in found["reads"]]
                rows += [base | {"row": "abort", "detail": r.pop("message")} | r for r in found["aborts"]]
                rows += [base | {"row": "hint", "detail": r.pop("type"), "marks": ["fallback"] if r.pop("fallback") else []} | r for r in found["hints"]]
            names = [c.strip().split(" ")[0] for c in ROWS.split(", ")]
            out = pd.DataFrame([[r.get(c) for c in names] for r in rows], columns=names)
            out["line"] = out["line"].astype("Int32")
            out["exact"] = out["exact"].astype("boolean")
            yield out

    return templates.select("chart", "path", "source").mapInPandas(run, ROWS)


def scoped(rows: DataFrame, charts: DataFrame) -> DataFrame:
    """Rows of a chart's templates with their paths below the chart's place in the root's values; `global` stays where it is. charts: (chart, prefix)."""
    from shalebed.functions.paths import join_path

    prefix = join_path(F.col("prefix"))
    is_global = (F.col("source_path") == "global") | F.col("source_path").startswith("global.")
    path = F.when(F.col("source_path").isNull() | is_global | (F.size("prefix") == 0), F.col("source_path")).otherwise(F.concat_ws(".", prefix, F.col("source_path")))
    return rows.join(charts.select("chart", "prefix"), "chart").withColumn("source_path", path).drop("prefix")


def evidence(rows: DataFrame) -> DataFrame:
    """Per path: the facts that decide its schema, each an OR or AND over the path's rows, and its hints and sinks as sets."""
    r, kind, marks = F.col("row"), F.col("kind"), F.col("marks")
    use = r == "use"
    own = F.exists(F.flatten("condition"), lambda c: c.contains(F.concat(F.lit(',"'), F.col("source_path"), F.lit('",'))) & ~c.startswith("!"))
    flag = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    sink = F.struct(F.coalesce("api_version", F.lit("")).alias("api_version"), F.coalesce("resource_kind", F.lit("")).alias("resource_kind"), F.array_join("sink_path", "/").alias("sink"), "kind")
    return rows.where("source_path is not null").groupBy("source_path").agg(
        F.count_if(use).alias("uses"),
        flag(use & kind.isin("serialized", "yaml_serialized", "templated_yaml_serialized")).alias("serialized"),
        flag(use & (kind == "partial_scalar")).alias("partial"),
        flag(use & (F.size("condition") == 1) & (F.size(F.get("condition", F.lit(0))) == 0)).alias("unconditional"),
        flag(use & ~F.coalesce(own, F.lit(False))).alias("rendered_unguarded"),
        flag((r == "read") & (F.col("detail") == "if") & (F.size(F.get("condition", F.lit(0))) == 0)).alias("positive_header"),
        flag((r == "hint") & F.array_contains(marks, "fallback")).alias("has_default"),
        flag(use & F.array_contains(marks, "string")).alias("has_string_contract"),
        flag(use & F.array_contains(marks, "quote")).alias("nil_omitting"),
        F.coalesce(~F.bool_or(use), F.lit(True)).alias("control_only"),
        F.coalesce(F.bool_and(F.when(use, kind.isin("serialized", "yaml_serialized", "templated_yaml_serialized"))), F.lit(False)).alias("all_serialized"),
        F.array_sort(F.collect_set(F.when((r == "hint") & ~F.array_contains(marks, "fallback"), F.col("detail")))).alias("hints"),
        F.array_sort(F.collect_set(F.when((r == "hint") & F.array_contains(marks, "fallback"), F.col("detail")))).alias("fallback_hints"),
        F.array_sort(F.collect_set(F.when(use, sink))).alias("sinks"),
    )


def literals(condition) -> list[tuple[str, str, object, bool]]:
    """(kind, path, argument, wanted) of every literal of a condition's text."""
    return [(*json.loads(x.removeprefix("!")), not x.startswith("!")) for t in condition for x in t]
