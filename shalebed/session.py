"""One chart's analysis, each step made once: files, charts, contract rows, evidence, schema, and what explains them."""

from __future__ import annotations

import functools
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shalebed.functions.paths import split_segments
from shalebed.operators import lattice as L
from shalebed.operators import refs, schema_tree
from shalebed.operators.contracts import mark_descendants
from shalebed.operators.emit import intern
from shalebed.operators.tables import kept
from shalebed.sources import charts as C
from shalebed.sources.documents import yaml_to_json
from shalebed.template import rows as T


class Session:
    """path: a chart's folder or archive. schemas: (api_version, kind, schema) of resources that sinks are looked up in, if there are any."""

    def __init__(self, spark: SparkSession, path: str, schemas: DataFrame | None = None, tests: bool = False):
        self.spark, self.path, self.schemas, self.tests = spark, path, schemas, tests

    @functools.cached_property
    def files(self) -> DataFrame:
        return kept(C.open_chart(self.spark, self.path).withColumn("dir", C.chart_dir(F.col("path"))), "files")

    @functools.cached_property
    def charts(self) -> DataFrame:
        return kept(C.charts(self.files.select("path", "content")), "charts")

    @functools.cached_property
    def helpers(self) -> DataFrame:
        return kept(C.define_index(self.files.select("path", "content")), "helpers")

    @functools.cached_property
    def contract(self) -> DataFrame:
        """Contract rows of all charts, with their paths in the root's values."""
        templates = C.files_with_role(self.files, "manifest", self.tests).unionByName(C.files_with_role(self.files, "notes", self.tests))
        found = T.interpret(templates.select(F.col("dir").alias("chart"), "path", F.decode("content", "UTF-8").alias("source")), self.helpers.select("name", F.col("body").alias("source")))
        return kept(T.scoped(found, self.charts.select(F.col("dir").alias("chart"), "prefix")), "contract")

    @functools.cached_property
    def values(self) -> dict:
        """The values that the chart ships: its own, over those of its dependencies below their names. They are one document, which the driver holds."""
        read = yaml_to_json(self.files.where(F.col("path").rlike(r"(^|/)values\.ya?ml$"))).where("number = 0").withColumn("dir", F.regexp_replace("path", r"/?[^/]*$", ""))
        layers = read.join(self.charts, "dir").select("prefix", "depth", "json").collect()
        out: dict = {}
        for r in sorted(layers, key=lambda r: (-r["depth"], r["prefix"])):
            own = json.loads(r["json"]) if r["json"] else {}
            for p in reversed(r["prefix"]):
                own = {p: own}
            out = compose(own if isinstance(own, dict) else {}, out)
        return out

    @functools.cached_property
    def evidence(self) -> DataFrame:
        found = T.evidence(self.contract)
        return kept(found.join(mark_descendants(found.select(F.col("source_path").alias("path"))).withColumnRenamed("path", "source_path"), "source_path"), "evidence")

    def explain(self, path: str) -> DataFrame:
        """Rows of a path and of what lies below it."""
        return self.contract.where((F.col("source_path") == path) | F.col("source_path").startswith(path + ".")).orderBy("source_path", "template", "line")

    def aborts(self) -> DataFrame:
        return self.contract.where("row = 'abort'").select("chart", "template", "detail", "condition", "exact")

    def diagnostics(self) -> DataFrame:
        """(type, key, message): templates that can't be read, sinks of resources without a schema, ranges over what may be a number; one for each key."""
        errors = self.contract.where("row = 'error'").select(F.lit("unreadable").alias("type"), F.col("template").alias("key"), F.col("detail").alias("message"))
        out = errors
        if self.schemas is not None:
            sinks = self.contract.where("row = 'use' and api_version is not null and resource_kind is not null").select("api_version", F.col("resource_kind").alias("kind")).distinct()
            missing = sinks.join(self.schemas.select("api_version", "kind").distinct(), ["api_version", "kind"], "left_anti")
            out = out.unionByName(missing.select(F.lit("missing_schema").alias("type"), F.concat_ws("/", "api_version", "kind").alias("key"), F.concat(F.lit("no schema for "), F.concat_ws("/", "api_version", "kind")).alias("message")))
        ranged = self.contract.where("row = 'read' and detail = 'range'").select("source_path").distinct()
        numbers = self.contract.where("row = 'hint' and detail in ('integer', 'number')").select("source_path").distinct()
        both = ranged.join(numbers, "source_path")
        out = out.unionByName(both.select(F.lit("numeric_range").alias("type"), F.col("source_path").alias("key"), F.concat(F.lit("a range over what may be a number: "), F.col("source_path")).alias("message")))
        return out.groupBy("type", "key").agg(F.min("message").alias("message"))

    def lookup(self, sinks: list) -> dict:
        """The joined preimage of a path's sinks in the resources' schemas."""
        if self.schemas is None:
            return {}
        found = []
        for s in sinks:
            root = self._resources.get((s["api_version"], s["resource_kind"]))
            if root is None:
                continue
            at = refs.descend(root, [p for p in s["sink"].split("/") if p], "", lambda name: root)  # noqa: B023
            if at is not None:
                found.append(schema_tree.preimage(refs.expand(at[0], at[1], lambda name: root), s["kind"]))  # noqa: B023
        return L.intersect([f for f in found if f])

    def required_sinks(self) -> list[dict]:
        """What resources require of the values that fill their fields: schema_tree.required_sources() of every rendered use whose sink is required."""
        if self.schemas is None:
            return []
        sinks = []
        for r in self.contract.where("row = 'use' and api_version is not null and resource_kind is not null").select("source_path", "sink_path", "kind", "condition", "api_version", "resource_kind").distinct().collect():
            root = self._resources.get((r["api_version"], r["resource_kind"]))
            at = None if root is None else refs.descend(root, list(r["sink_path"]), "", lambda name: root)  # noqa: B023
            if at is not None:
                sinks.append({"source_path": r["source_path"], "required": at[2], "kind": r["kind"], "condition": r["condition"]})
        return schema_tree.required_sources(sorted(sinks, key=L.canonical), self.values)

    @functools.cached_property
    def _resources(self) -> dict:
        """Schemas of the resources that the chart names: as many as it has kinds."""
        named = self.contract.where("row = 'use'").select("api_version", F.col("resource_kind").alias("kind")).distinct()
        return {(r["api_version"], r["kind"]): json.loads(r["schema"]) for r in self.schemas.join(named, ["api_version", "kind"]).select("api_version", "kind", "schema").collect()}

    def plan(self) -> dict[str, dict]:
        """By path, what is known of it, before any policy: a chart's paths are a document's, which the driver holds."""
        from shalebed.functions.guards import Guard, value_at

        compared: dict[str, list] = {}
        for r in self.contract.where("condition is not null").select("condition").distinct().collect():
            for kind, path, arg, wanted in T.literals(r["condition"]):
                if wanted and kind in ("eq", "type_is"):
                    compared.setdefault(path, []).append(Guard(kind, path, arg))
        out = {}
        for r in self.evidence.collect():
            path = r["source_path"]
            there, default = value_at(self.values, split_segments(path))
            hints = L.merge_all([{"type": h} for h in r["hints"]])
            out[path] = {
                "provider": self.lookup(r["sinks"]), "declared": L.infer(default) if there else {}, "guards": schema_tree.guard_schema(compared.get(path, [])), "hints": hints,
                "fallback_hints": L.merge_all([{"type": h} for h in r["fallback_hints"]]), "default_null": there and default is None, "default_empty_string": there and default == "", "explicit": there,
            } | {k: r[k] for k in ("serialized", "partial", "control_only", "unconditional", "has_descendants", "has_item_descendants", "has_string_contract", "positive_header", "has_default", "rendered_unguarded")}
        return out

    def generate(self, policy: dict[str, bool] | None = None, required: bool = False, minimize: bool = False) -> dict:
        """The schema of the chart's values: a schema for each path, aborts as conditions, declared defaults kept valid."""
        from shalebed.operators.emit import selects

        policy = policy or {}
        plan = self.plan()
        schemas = {}
        for path, e in plan.items():
            if not path or "*" in split_segments(path):
                continue
            if not selects(policy, "hint"):
                e = e | {"hints": {}, "fallback_hints": {}}
            if not selects(policy, "guard"):
                e = e | {"guards": {}}
            s = schema_tree.resolve_path(e)
            if e["explicit"] and s:
                s = schema_tree.preserve_defaults(s, self._default(path))
            schemas[path] = {} if e["has_descendants"] and "properties" not in s else s
        items = {p: schema_tree.resolve_path(e) for p, e in plan.items() if p and "*" in split_segments(p) and not e["has_descendants"]}
        root = schema_tree.build(schemas | items)
        root = schema_tree.backfill(root, self.values, set(plan))
        if required:
            root = schema_tree.infer_required(root, plan, {p for p, e in plan.items() if e["explicit"]})
        if selects(policy, "fail"):
            for r in self.aborts().collect():
                root = self._forbid(root, r["condition"])
        if selects(policy, "required"):
            for x in self.required_sinks():
                root = self._demand(root, x)
        described = {tuple(split_segments(r["path"])): r["description"] for r in C.descriptions(self.files.where(F.col("dir") == "")).collect()}
        root = L.attach_descriptions(root, described)
        return intern(root) if minimize else root

    def _default(self, path: str):
        from shalebed.functions.guards import value_at

        return value_at(self.values, split_segments(path))[1]

    def _demand(self, root: dict, x: dict) -> dict:
        """A value that a resource requires, where the use renders; uses under conditions that can't be told demand nothing."""
        from shalebed.functions.guards import lower_set

        *host, leaf = split_segments(x["path"])
        there = {"not": {"type": "null"}}
        if x["target"] == "value":
            then = {"required": [leaf], "properties": {leaf: there}}
        else:
            inner = there
            for f in reversed(x["field"]):
                inner = {"type": "object", "required": [f], "properties": {f: inner}}
            then = {"properties": {leaf: {"items": inner, "additionalProperties": inner}}}
        for term in x["condition"]:
            guards = _guards([term])
            guards = [g for g in guards if not (g.kind in ("range", "with") and g.path == x["path"])] if guards is not None else None
            low = lower_set(guards) if guards is not None else None
            if low is None:
                continue
            if low:
                root = schema_tree.append_conditional(root, ".".join(host) if all("." not in h for h in host) else "", low, then)
            else:
                at = schema_tree.at(root, ".".join(host)) if host else root
                if at is not None:
                    root = schema_tree.replace(root, host, at | {"allOf": [*at.get("allOf", []), then]})
        return root

    def _forbid(self, root: dict, condition) -> dict:
        """No document may meet a condition under which rendering aborts; conditions that can't be told forbid nothing, nor do those that the shipped values meet."""
        from shalebed.functions.guards import evaluate, terminal_clause

        for term in condition:
            guards = _guards([term])
            clause = terminal_clause(guards) if guards else None
            if clause is not None and not evaluate([clause], self.values):
                held = root.get("allOf", [])
                root = root | {"allOf": [*held, {"not": clause.schema()}]}
        return root


def _guards(condition) -> list | None:
    """One alternative's guards; None if a literal can't be told."""
    from shalebed.functions.guards import Guard

    out = []
    for kind, path, arg, wanted in T.literals(condition):
        if kind in ("unknown", "api"):
            return None
        g = Guard(kind, path, tuple(arg) if isinstance(arg, list) else arg)
        out.append(g if wanted else Guard("not", path) if kind in ("truthy", "with") else Guard("not_guard", arg=g))
    return out


def compose(parent, child):
    """Values of a parent over a child's: the parent's win, and its nulls delete."""
    if not isinstance(parent, dict) or not isinstance(child, dict):
        return parent
    out = dict(child)
    for k, v in parent.items():
        if v is None:
            out.pop(k, None) if k in child else out.__setitem__(k, None)
        else:
            out[k] = compose(v, child[k]) if k in child else v
    return out
