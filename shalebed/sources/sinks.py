"""What an analysis leaves: schemas as JSON with their measures, contract rows as a versioned document, diagnostics as text or JSON lines, and dumps for people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shalebed.operators.emit import metrics, render

CONTRACT_VERSION = 1


def write_schema(spark: SparkSession, schema: dict, path: str, policy: dict | None = None) -> dict:
    """One JSON text, pretty or, past the limit, compact, with the policy's mark; returns its measures. Spark's commit protocol puts it in place whole."""
    text = render(schema, policy)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)
    return metrics(schema) | {"written": len(text.encode())}


def write_contract(rows: DataFrame, path: str) -> None:
    """Normalised contract rows, with the version of their layout, in the order of their site."""
    order = [c for c in ("source_path", "sink_path", "kind", "chart", "template", "line") if c in rows.columns]
    rows.withColumn("contract_version", F.lit(CONTRACT_VERSION)).orderBy(*order).write.mode("overwrite").parquet(path)


def read_contract(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a contract document; one of another version is refused."""
    rows = spark.read.parquet(path)
    known = F.when(F.col("contract_version") != CONTRACT_VERSION, F.raise_error(F.concat(F.lit("contract version "), F.col("contract_version").cast("string")))).otherwise(F.lit(True))
    return rows.where(known).drop("contract_version")


def diagnostic_text(kind: Column, key: Column, message: Column) -> Column:
    """warning[type] key: message, on one line."""
    return F.concat(F.when(kind == "unreadable", "error").otherwise("warning"), F.lit("["), kind, F.lit("] "), key, F.lit(": "), F.regexp_replace(message, r"\s+", " "))


def write_diagnostic_text(diagnostics: DataFrame, path: str) -> None:
    diagnostics.select(diagnostic_text(F.col("type"), F.col("key"), F.col("message")).alias("value")).orderBy("value").write.mode("overwrite").text(path)


def write_diagnostics(diagnostics: DataFrame, path: str) -> None:
    """One JSON object a line, in the order of type and key."""
    diagnostics.orderBy("type", "key").write.mode("overwrite").json(path)


def dump_nodes(nodes: list, depth: int = 0) -> str:
    """A template's nodes, a line each."""
    from shalebed.template import parse as P

    out, pad = [], "  " * depth
    for n in nodes:
        if isinstance(n, P.Text):
            out.append(f"{pad}(text {n.text!r})")
        elif isinstance(n, P.Output):
            out.append(f"{pad}(output {dump_expression(n.expr)})")
        elif isinstance(n, P.Assign):
            out.append(f"{pad}({'declare' if n.declares else 'assign'} ${n.name} {dump_expression(n.expr)})")
        elif isinstance(n, P.Define):
            out += [f"{pad}(define {n.name!r}", dump_nodes(n.body, depth + 1) + ")"]
        else:
            for i, (e, body, names) in enumerate(n.arms):
                head = n.kind if i == 0 else "else"
                out += [f"{pad}({head}" + "".join(f" ${x}" for x in names) + (f" {dump_expression(e)}" if e is not None else ""), dump_nodes(body, depth + 1) + ")"]
    return "\n".join(x for x in out if x)


def dump_expression(e) -> str:
    from shalebed.template import parse as P

    if isinstance(e, P.Literal):
        return repr(e.value)
    if isinstance(e, P.Field):
        return "." + ".".join(e.parts)
    if isinstance(e, P.Variable):
        return "$" + ".".join((e.name, *e.parts))
    if isinstance(e, P.Select):
        return f"({dump_expression(e.base)}).{'.'.join(e.parts)}"
    return "(" + " ".join([e.name, *map(dump_expression, e.args)]) + ")"


def dump_uses(uses: list[dict]) -> str:
    """What analyse() found, a line for each use: sink, kind, path and condition."""
    from shalebed.template.interpret import dnf_from_text, shown

    return "\n".join(f"{'.'.join(u['sink_path'])} {u['kind']} <- {u['source_path']} when {shown(dnf_from_text(u['condition']))}" for u in uses)


def enrich(fragments: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Provider fragments with where they come from and since when; fragments of unknown sources stay."""
    return fragments.join(sources, key, "left")


def rewrite_paths(rows: DataFrame, rewrites: DataFrame, path: str = "source_path") -> DataFrame:
    """Rows whose path lies at or below a rewritten one get the new beginning; the longest match counts. rewrites: old, new."""
    from shalebed.functions.paths import join_path, split_path

    parts = split_path(F.col(path))
    p = rows.select(path).distinct().withColumn("_p", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("n"), join_path(F.slice(parts, F.lit(1), i)).alias("old")))))
    hit = p.select(path, "_p.n", "_p.old").join(rewrites, "old").groupBy(path).agg(F.max_by(F.struct("old", "new"), "n").alias("_r"))
    j = rows.join(hit, path, "left")
    return j.withColumn(path, F.when(F.col("_r").isNotNull(), F.concat(F.col("_r.new"), F.substring(F.col(path), F.length("_r.old") + 1, F.lit(2**31 - 1)))).otherwise(F.col(path))).drop("_r")
