"""Charts: directories or archives of templates and values as DataFrames of files, charts, dependencies, helpers and custom resources."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shalebed.sources.documents import MAX_BYTES, archive_entries, crd_schemas, yaml_to_json

ROLES = ("manifest", "define", "crd", "files_get", "notes")
CONFIG_NAMES = (".shalebed.yaml", ".shalebed.yml")


def open_chart(spark: SparkSession, path: str, nested: int = 4) -> DataFrame:
    """(path, content) of a chart's files below its root, from a directory or a .tgz; archives among its dependencies are opened too, `nested` levels deep (deeper ones raise)."""
    if path.endswith((".tgz", ".tar.gz")):
        files = archive_entries(spark.read.format("binaryFile").load(path)).select(F.regexp_replace("entry", r"^[^/]*/", "").alias("path"), "content")
    else:
        files = folder_files(spark, path)
    for level in range(nested + 1):
        packed = files.where(F.col("path").rlike(r"(^|/)charts/[^/]+\.(tgz|tar\.gz)$"))
        if not packed.take(1):
            return files
        if level == nested:
            raise ValueError(f"archives within archives, deeper than {nested} levels")
        inner = archive_entries(packed).select(F.concat(F.regexp_replace("archive", r"[^/]*$", ""), F.col("entry")).alias("path"), "content")
        files = files.where(~F.col("path").rlike(r"(^|/)charts/[^/]+\.(tgz|tar\.gz)$")).unionByName(inner)
    return files


def folder_files(spark: SparkSession, root: str, most: int = 100_000, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path below root, content) of all files of a folder. Spark's own readers leave out names with a leading `_`, which helpers have, so the driver lists the folder (at most `most` files) and tasks read what it lists."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base, found = system.getFileStatus(at).getPath().toString().rstrip("/"), []
    listed = system.listFiles(at, True)
    while listed.hasNext():
        status = listed.next()
        found.append((status.getPath().toString(), status.getLen()))
        if status.getLen() > max_bytes or len(found) > most:
            raise ValueError(f"over budget: {found[-1][0]}")

    def run(batches):
        import pandas as pd
        from pyarrow import fs

        for pdf in batches:
            rows = []
            for uri in pdf["uri"]:
                where, name = fs.FileSystem.from_uri(uri)
                with where.open_input_stream(name, compression=None) as f:
                    rows.append((uri[len(base) + 1 :], f.read()))
            yield pd.DataFrame(rows, columns=["path", "content"])

    uris = spark.createDataFrame([(u,) for u, _ in sorted(found)], "uri string").repartition(max(1, len(found) // 64))
    return uris.mapInPandas(run, "path string, content binary")


def chart_dir(path: Column) -> Column:
    """The directory of the chart that a file belongs to: up to the last charts/<name>."""
    return F.regexp_extract(path, r"^((?:.*/)?charts/[^/]+)/", 1)


def metadata(files: DataFrame) -> DataFrame:
    """(dir, meta): each chart's Chart.yaml, or Chart.template.yaml, as VARIANT; a chart that has both takes the first."""
    own = files.where(F.col("path").rlike(r"(^|/)Chart(\.template)?\.ya?ml$")).withColumn("content", F.encode(F.regexp_replace(F.decode("content", "UTF-8"), r"\{\{[^}]*\}\}", "templated"), "UTF-8"))
    read = yaml_to_json(own).where("number = 0").withColumn("dir", F.regexp_replace("path", r"/?[^/]*$", ""))
    best = read.groupBy("dir").agg(F.min_by("json", F.struct(F.col("path").contains("template"), F.col("path"))).alias("json"))
    return best.select("dir", F.try_parse_json("json").alias("meta"))


def dependencies(files: DataFrame) -> DataFrame:
    """(dir, place, name, alias, version, condition, tags): what charts ask for, in Chart.yaml or requirements.yaml."""
    read = yaml_to_json(files.where(F.col("path").rlike(r"(^|/)(Chart|requirements)\.ya?ml$"))).where("number = 0").withColumn("dir", F.regexp_replace("path", r"/?[^/]*$", ""))
    each = read.select("dir", F.col("path").contains("requirements").alias("old"), F.posexplode(F.try_variant_get(F.try_parse_json("json"), "$.dependencies", "array<variant>")).alias("place", "d"))
    field = lambda n, kind="string": F.try_variant_get("d", f"$.{n}", kind).alias(n)
    rows = each.select("dir", "old", "place", field("name"), field("alias"), field("version"), field("condition"), field("tags", "array<string>"))
    return rows.dropDuplicates(["dir", "name", "alias"]).drop("old")


def charts(files: DataFrame) -> DataFrame:
    """(dir, name, library, prefix, depth, activation): a row per chart, once for each alias that its parent gives it.

    prefix: the segments under which the root's values hold the chart's. activation: for each level from the root down,
    the conditions' paths and the tags that switch it on. Vendored charts that no parent names are there without any.
    """
    meta = metadata(files).select("dir", F.try_variant_get("meta", "$.name", "string").alias("name"), (F.coalesce(F.try_variant_get("meta", "$.type", "string"), F.lit("application")) == "library").alias("library"))
    parent = F.regexp_replace("dir", r"/?charts/[^/]+$", "")
    asked = dependencies(files).select(F.col("dir").alias("parent"), F.col("name").alias("asked"), F.coalesce("alias", "name").alias("used_as"), "condition", "tags")
    down = meta.withColumn("parent", F.when(F.col("dir") != "", parent))
    named = down.join(asked.withColumnRenamed("asked", "name"), ["parent", "name"], "left")
    label = F.coalesce("used_as", F.regexp_extract("dir", r"([^/]*)$", 1))
    split = F.split(F.coalesce("condition", F.lit("")), r"\s*,\s*")
    step = F.struct(F.filter(split, lambda x: x != "").alias("conditions"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
    level = named.where("dir = ''").select("dir", "name", "library", F.array().cast("array<string>").alias("prefix"), F.lit(0).alias("depth"), F.array().cast("array<struct<conditions:array<string>,tags:array<string>>>").alias("activation"))
    out = level
    depth = 0
    children = named.where("dir <> ''").select(F.col("dir").alias("_dir"), F.col("name").alias("_name"), F.col("library").alias("_library"), F.col("parent").alias("_parent"), label.alias("_label"), step.alias("_step"))
    while True:  # charts lie a few directories deep; the loop ends with the deepest
        depth += 1
        level = level.join(children, F.col("dir") == F.col("_parent")).select(
            F.col("_dir").alias("dir"), F.col("_name").alias("name"), F.col("_library").alias("library"), F.array_append("prefix", F.col("_label")).alias("prefix"), F.lit(depth).alias("depth"), F.array_append("activation", F.col("_step")).alias("activation")
        )
        if not level.take(1):
            return out
        out = out.unionByName(level)


def subchart_order(all_charts: DataFrame) -> DataFrame:
    """The order in which layers of values apply: shallow charts first, then by prefix."""
    return all_charts.orderBy("depth", F.array_join("prefix", "."))


def roles(path: Column) -> Column:
    """The set of roles of a file's path: a manifest may hold helpers too, and any file that is no template can be read by templates."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    template = path.rlike(r"(^|/)templates/") & ~path.rlike(r"(^|/)templates/.*charts/")
    text = name.rlike(r"\.(ya?ml|tpl|txt|json)$")
    notes, partial = name == "NOTES.txt", name.startswith("_")
    return F.array_compact(F.array(
        F.when(template & text & ~notes & ~partial & ~name.endswith(".tpl"), "manifest"),
        F.when(template & text, "define"),
        F.when(path.rlike(r"(^|/)crds/.*\.(ya?ml|json)$"), "crd"),
        F.when(~template & ~path.rlike(r"(^|/)(Chart|values|requirements)[^/]*\.(ya?ml|lock)$") & ~path.rlike(r"(^|/)(charts|crds)/"), "files_get"),
        F.when(template & notes, "notes"),
    ))


def files_with_role(files: DataFrame, role: str, tests: bool = False) -> DataFrame:
    """Files of one role in the order of their paths, without templates/tests unless asked for."""
    if role not in ROLES:
        raise ValueError(f"no role: {role}")
    out = files.where(F.array_contains(roles(F.col("path")), role))
    return (out if tests else out.where(~F.col("path").rlike(r"(^|/)templates/tests/"))).orderBy("path")


def define_bodies(source: str) -> list[tuple[str, str]]:
    """(name, text between define and its end) of every named block of a source, in order; blocks within blocks too."""
    from shalebed.template.parse import _ACTION, _string

    out, open_blocks = [], []
    for m in _ACTION.finditer(source):
        action = m[2].strip()
        word = re.match(r"[a-z]*", action)[0]
        if word in ("define", "block"):
            name = re.match(r"(?:define|block)\s+(\"(?:\\.|[^\"\\])*\"|`[^`]*`)", action)
            open_blocks.append((_string(name[1]) if name else None, m.end()))
        elif word in ("if", "with", "range"):
            open_blocks.append((None, m.end()))
        elif action == "end" and open_blocks:
            name, start = open_blocks.pop()
            if name is not None:
                out.append((start, name, source[start : m.start()]))
    return [(name, body) for _, name, body in sorted(out)]


def define_index(files: DataFrame) -> DataFrame:
    """(name, body, path): helpers of all charts; of equal names the last loaded wins, the root's chart after its dependencies, then by path."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(path, i, name, body) for path, raw in zip(pdf["path"], pdf["content"], strict=True) for i, (name, body) in enumerate(define_bodies(bytes(raw).decode("utf-8", "replace")))]
            yield pd.DataFrame(rows, columns=["path", "place", "name", "body"])

    found = files.where(F.array_contains(roles(F.col("path")), "define")).select("path", "content").mapInPandas(run, "path string, place int, name string, body string")
    depth = F.size(F.split("path", r"(^|/)charts/")) - 1
    order = F.struct((-depth).alias("d"), "path", "place")
    return found.groupBy("name").agg(F.max_by("body", order).alias("body"), F.max_by("path", order).alias("path"))


def static_crds(files: DataFrame) -> DataFrame:
    """(group, kind, version, schema) of the custom resources below crds/."""
    return crd_schemas(yaml_to_json(files.where(F.array_contains(roles(F.col("path")), "crd"))))


def templated_crds(files: DataFrame) -> DataFrame:
    """The same of templates: documents that define a custom resource and whose schemas hold no action."""

    def run(batches):
        import pandas as pd
        import yaml

        for pdf in batches:
            rows = []
            for path, raw in zip(pdf["path"], pdf["content"], strict=True):
                for i, part in enumerate(re.split(r"(?m)^---\s*$", bytes(raw).decode("utf-8", "replace"))):
                    if "CustomResourceDefinition" not in part:
                        continue
                    kept = "\n".join(t for t in part.split("\n") if not re.match(r"^\s*\{\{.*\}\}\s*$", t))
                    try:
                        document = yaml.safe_load(re.sub(r"\{\{.*?\}\}", "TEMPLATED", kept))
                    except yaml.YAMLError:
                        continue
                    versions = (document or {}).get("spec", {}).get("versions") or []
                    if isinstance(document, dict) and "TEMPLATED" not in str(document.get("spec", {}).get("group")):
                        document["spec"]["versions"] = [v for v in versions if "TEMPLATED" not in json.dumps(v, default=str)]
                        rows.append((path, i, json.dumps(document, default=str), None))
            yield pd.DataFrame(rows, columns=["path", "number", "json", "error"])

    held = files.where(F.array_contains(roles(F.col("path")), "manifest")).select("path", "content")
    return crd_schemas(held.mapInPandas(run, "path string, number int, json string, error string"))


_COMMENT = re.compile(r"^\s*#+\s*(?:--|@param\s+(\S+)(?:\s+\[[^\]]*\])?)\s+(.*)$")
_ENTRY = re.compile(r"^(\s*)(?:#\s*)?([A-Za-z0-9_][\w.\-/]*|\"[^\"]*\"|'[^']*')\s*:(?:\s|$)")


def describe(text: str) -> dict[str, str]:
    """Descriptions by path: a `# --` comment, over as many lines as follow it, belongs to the next key; `@param path text` names its own."""
    from shalebed.functions.paths import join_segments

    out: dict[str, str] = {}
    stack: list[tuple[int, str]] = []
    pending: list[str] | None = None
    for line in text.split("\n"):
        m = _COMMENT.match(line)
        if m and m[1]:
            out[m[1]] = m[2].strip()
            continue
        if m:
            pending = [m[2].strip()]
            continue
        if pending is not None and line.strip().startswith("#"):
            pending.append(line.strip().lstrip("#").strip())
            continue
        e = _ENTRY.match(line)
        if e and not line.lstrip().startswith("#"):
            indent, key = len(e[1]), e[2].strip("\"'")
            stack = [(i, k) for i, k in stack if i < indent] + [(indent, key)]
            if pending:
                out[join_segments([k for _, k in stack])] = " ".join(x for x in pending if x)
            pending = None
        elif line.strip():
            pending = None
    return out


def descriptions(files: DataFrame) -> DataFrame:
    """(file, path, description) of the comments of values files."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame([(f, p, d) for f, raw in zip(pdf["path"], pdf["content"], strict=True) for p, d in sorted(describe(bytes(raw).decode("utf-8", "replace")).items())], columns=["file", "path", "description"])

    return files.where(F.col("path").rlike(r"(^|/)values[^/]*\.ya?ml$")).select("path", "content").mapInPandas(run, "file string, path string, description string")


def resolve_config(cli: dict, file: dict | None, presets: dict[str, dict], built_in: dict) -> dict:
    """Knobs: the command line's, then the file's, then the profile's, then the built-in ones. A profile named on the command line sets the file's knobs aside."""
    profile = cli.get("profile") or (file or {}).get("profile") or "default"
    if profile not in presets:
        raise ValueError(f"no profile: {profile}")
    from_file = {} if cli.get("profile") else {k: v for k, v in (file or {}).items() if k != "profile"}
    return built_in | presets[profile] | from_file | {k: v for k, v in cli.items() if k != "profile" and v is not None} | {"profile": profile}


def optional_helpers(index: DataFrame, uses: DataFrame) -> DataFrame:
    """(name, owner): helpers of a dependency that no chart but itself includes. index: name, dir; uses: dir, name."""
    other = uses.join(index.select("name", F.col("dir").alias("owner")), "name").where("dir <> owner").select("name").distinct()
    return index.where("dir <> ''").select("name", F.col("dir").alias("owner")).join(other, "name", "left_anti")


def load_order(files: DataFrame) -> DataFrame:
    """files with `loaded`, the place in which sources are read: dependencies first, deepest first, then by path."""
    depth = F.size(F.split("path", r"(^|/)charts/")) - 1
    chart = F.coalesce(F.nullif(chart_dir(F.col("path")), F.lit("")), F.lit(""))
    return files.withColumn("dir", chart).withColumn("loaded", F.row_number().over(Window.partitionBy("dir").orderBy("path")) - 1).withColumn("depth", depth)
