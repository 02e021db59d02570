"""YAML, JSON and archive documents as rows; schemas and diagnostics as files. Everything goes through Spark's file sources."""

from __future__ import annotations

import io
import json
import tarfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES, MAX_ENTRIES = 64 << 20, 10_000


def read_files(spark: SparkSession, path: str, pattern: str = "*", max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, length, content), refusing files past the budget."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    checked = F.when(F.col("length") > max_bytes, F.raise_error(F.concat(F.lit("over budget: "), F.col("path")))).otherwise(F.col("content")).cast("binary")
    return df.select("path", "length", checked.alias("content"))


def role(path: Column) -> Column:
    """chart, values, crd, helper, notes, template or other."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return (
        F.when(name.rlike(r"^Chart(\.template)?\.ya?ml$|^requirements\.ya?ml$"), "chart").when(name.rlike(r"^values.*\.ya?ml$"), "values").when(path.rlike(r"/crds/"), "crd")
        .when(name == "NOTES.txt", "notes").when(path.rlike(r"/templates/.*\.tpl$") | name.startswith("_"), "helper").when(path.rlike(r"/templates/"), "template").otherwise("other")
    )


def safe_entry(path: Column) -> Column:
    """No absolute path, and no way up."""
    return ~path.rlike(r"^[/\\]|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)")


def archive_entries(files: DataFrame, max_bytes: int = MAX_BYTES, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """(archive, entry, content) of .tgz files given as (path, content); over budget or unsafe archives raise."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                total, rows = 0, []
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as t:
                    for m in t:
                        if not m.isfile():
                            continue
                        if m.name.startswith(("/", "\\")) or ".." in m.name.replace("\\", "/").split("/"):
                            raise ValueError(f"{path}: unsafe entry {m.name}")
                        total += m.size
                        if total > max_bytes or len(rows) >= max_entries:
                            raise ValueError(f"{path}: over budget")
                        rows.append((path, m.name, t.extractfile(m).read()))
                yield pd.DataFrame(rows, columns=["archive", "entry", "content"])

    return files.select("path", "content").mapInPandas(run, "archive string, entry string, content binary")


def yaml_to_json(files: DataFrame, content: str = "content") -> DataFrame:
    """A row per YAML document of each file: path, number, json (null where it doesn't parse, with the error)."""

    def run(batches):
        import pandas as pd
        import yaml

        for pdf in batches:
            rows = []
            for path, raw in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    for i, d in enumerate(yaml.safe_load_all(bytes(raw).decode())):
                        rows.append((path, i, json.dumps(d, default=str), None))
                except (yaml.YAMLError, UnicodeDecodeError) as e:
                    rows.append((path, 0, None, str(e)[:500]))
            yield pd.DataFrame(rows, columns=["path", "number", "json", "error"])

    return files.select("path", F.col(content).alias("content")).mapInPandas(run, "path string, number int, json string, error string")


def crd_schemas(documents: DataFrame) -> DataFrame:
    """(group, kind, version, schema) from documents (json) that define custom resources."""
    v = F.try_parse_json("json")
    d = documents.select(v.alias("v")).where(F.try_variant_get("v", "$.kind", "string") == "CustomResourceDefinition")
    each = d.select(F.try_variant_get("v", "$.spec.group", "string").alias("group"), F.try_variant_get("v", "$.spec.names.kind", "string").alias("kind"), F.explode(F.try_variant_get("v", "$.spec.versions", "array<variant>")).alias("x"))
    return each.select("group", "kind", F.try_variant_get("x", "$.name", "string").alias("version"), F.to_json(F.try_variant_get("x", "$.schema.openAPIV3Schema", "variant")).alias("schema"))


def value_comments(files: DataFrame) -> DataFrame:
    """(path, line, description) of `# -- text` comments of values files."""
    lines = files.select("path", F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("line", "text"))
    return lines.where(F.col("text").rlike(r"^\s*#\s*--\s")).select("path", "line", F.regexp_extract("text", r"^\s*#\s*--\s+(.*)$", 1).alias("description"))


def write_diagnostics(diagnostics: DataFrame, path: str) -> None:
    """One JSON object a line, in the order of type and message."""
    diagnostics.orderBy("type", "message").write.json(path)
