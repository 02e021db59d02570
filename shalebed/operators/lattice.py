"""The lattice of JSON Schemas: infer, merge (join), intersect, and the distributed fold over documents.

Merging goes through a state, in which every alternative lies under its type and its other keywords, so that states can
be combined in any order and any grouping: what must not depend on the order (which keywords agree, which enums meet)
is decided only when a state is written out as a schema again.
"""

from __future__ import annotations

import functools
import json

from pyspark.sql import DataFrame

ANNOTATIONS = ("title", "description", "default", "examples", "$comment")
SCALARS = ("boolean", "integer", "number", "string")
_DATA = ("enum", "const", "default", "required", "examples")
_MAPS = ("properties", "patternProperties", "$defs", "definitions", "dependentSchemas")
_HOST = ("type", "properties", "patternProperties", "additionalProperties", "required")


def canonical(schema) -> str:
    return json.dumps(schema, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def infer(value) -> dict:
    """Null says nothing of a type; objects are open; an array's items are merged."""
    if value is None:
        return {}
    if isinstance(value, bool):
        return {"type": "boolean"}
    if isinstance(value, int):
        return {"type": "integer"}
    if isinstance(value, float):
        return {"type": "number"}
    if isinstance(value, str):
        return {"type": "string"}
    if isinstance(value, list):
        items = merge_all([infer(x) for x in value])
        return {"type": "array"} | ({"items": items} if items else {})
    return {"type": "object", "properties": {k: infer(v) for k, v in sorted(value.items())}}


def types_of(schema: dict) -> list[str]:
    t = schema.get("type", [])
    return [t] if isinstance(t, str) else list(t)


def variants(schema: dict) -> list[dict]:
    """The alternatives of a plain anyOf and of a list of types; the null among such types keeps no other keyword."""
    if set(schema) == {"anyOf"}:
        return [v for s in schema["anyOf"] for v in variants(s)]
    t = types_of(schema)
    return [{"type": x} if x == "null" else schema | {"type": x} for x in t] if len(t) > 1 else [schema]


def subschemas(schema: dict):
    """(keyword, key or place or None, subschema) of what lies directly below, in schema positions alone: data that looks like a schema is none."""
    for k, v in schema.items():
        if k in _MAPS and isinstance(v, dict):
            for n, s in v.items():
                yield k, n, s
        elif k in ("allOf", "anyOf", "oneOf", "prefixItems") or k == "items" and isinstance(v, list):
            for n, s in enumerate(v):
                yield k, n, s
        elif k in ("items", "additionalProperties", "additionalItems", "not", "if", "then", "else", "contains", "propertyNames") and isinstance(v, dict):
            yield k, None, v


def keyword_context(keyword: str, key: str | int | None = None) -> str:
    """What a subschema below a keyword says of: the value itself, its members, its keys, or a condition."""
    if keyword in ("allOf", "anyOf", "oneOf"):
        return "value"
    if keyword in ("if", "then", "else", "not"):
        return "condition"
    if keyword in ("$defs", "definitions"):
        return "definition"
    return "keys" if keyword == "propertyNames" else "member"


def rebuilt(schema, f):
    """The schema with f applied to each direct subschema."""
    if not isinstance(schema, dict):
        return schema
    out = dict(schema)
    for k, n, s in subschemas(schema):
        if n is None:
            out[k] = f(s)
        else:
            if out[k] is schema[k]:
                out[k] = dict(schema[k]) if isinstance(schema[k], dict) else list(schema[k])
            out[k][n] = f(s)
    return out


def strip(schema):
    """Without annotations, in schema positions."""
    if not isinstance(schema, dict):
        return schema
    return rebuilt({k: v for k, v in schema.items() if k not in ANNOTATIONS}, strip)


def strip_descriptions(schema):
    if not isinstance(schema, dict):
        return schema
    return rebuilt({k: v for k, v in schema.items() if k != "description"}, strip_descriptions)


def attach_descriptions(schema: dict, described: dict[tuple[str, ...], str]) -> dict:
    """Descriptions by path (* is an array's item); one that is there already stays."""

    def at(s: dict, path: tuple[str, ...]) -> dict:
        out = dict(s)
        if path in described and "description" not in out:
            out["description"] = described[path]
        if isinstance(out.get("properties"), dict):
            out["properties"] = {k: at(v, (*path, k)) if isinstance(v, dict) else v for k, v in out["properties"].items()}
        if isinstance(out.get("items"), dict):
            out["items"] = at(out["items"], (*path, "*"))
        return out

    return at(schema, ())


def union(schemas: list[dict]) -> dict:
    """Distinct variants (annotations aside), in canonical order; open schemas give way to others."""
    found: dict[str, dict] = {}
    for s in schemas:
        for v in variants(s):
            if v:
                found.setdefault(canonical(strip(v)), v)
    out = [found[k] for k in sorted(found)]
    return {} if not out else out[0] if len(out) == 1 else {"anyOf": out}


# ---- states: {type: {canonical of rigid keywords: [rigid keywords, payload]}}


def _lift_one(s: dict) -> dict:
    t = types_of(s)
    kind = t[0] if len(t) == 1 else ""
    host = not t and s and set(s) <= set(_HOST) and ("properties" in s or "additionalProperties" in s)
    payload: dict = {"ann": {k: [s[k]] for k in ANNOTATIONS if k in s}}
    rest = {k: v for k, v in s.items() if k not in ANNOTATIONS and k != "type"}
    if kind == "object" or host:
        kind = "object"
        payload |= {"untyped": bool(host), "required": sorted(set(rest.pop("required", []))), "more": _lift_more(rest.pop("additionalProperties", None))}
        for k in ("properties", "patternProperties"):
            payload[k] = {n: lift(v) for n, v in rest.pop(k, {}).items()}
    elif kind == "array":
        items = rest.get("items")
        payload["items"] = lift(rest.pop("items")) if isinstance(items, dict) else {}
    elif kind in SCALARS:
        payload["enums"] = [sorted(rest.pop("enum"), key=canonical)] if "enum" in rest else []
        if kind == "string":
            payload["soft"] = {k: [rest.pop(k)] for k in list(rest) if k not in ("const", "not", "allOf", "anyOf", "oneOf", "$ref")}
    elif not kind and "type" in s:
        rest["type"] = s["type"]
    return {kind: {canonical(rest): [rest, payload]}}


def _lift_more(v) -> list:
    """additionalProperties by what it claims: none, true, the empty schema, false, or a schema's state."""
    return [0] if v is None else [1] if v is True else [3] if v is False else [4, lift(v)] if v else [2]


def lift(schema: dict) -> dict:
    out: dict = {}
    for v in variants(schema):
        if v:
            out = combine(out, _lift_one(v))
    return out


def _join(lists: list, more: list) -> list:
    return sorted({canonical(x): x for x in [*lists, *more]}.values(), key=canonical)


def _join_maps(a: dict, b: dict, f) -> dict:
    return {k: f(a[k], b[k]) if k in a and k in b else a.get(k, b.get(k)) for k in sorted({*a, *b})}


def _combine_payload(a: dict, b: dict) -> dict:
    out = {"ann": _join_maps(a["ann"], b["ann"], _join)}
    if "required" in a:
        out |= {"untyped": a["untyped"] or b["untyped"], "required": sorted({*a["required"], *b["required"]})}
        x, y = a["more"], b["more"]
        out["more"] = [4, combine(x[1], y[1])] if x[0] == y[0] == 4 else max(x, y, key=lambda m: m[0])
        for k in ("properties", "patternProperties"):
            out[k] = _join_maps(a[k], b[k], combine)
    if "items" in a:
        out["items"] = combine(a["items"], b["items"])
    if "enums" in a:
        out["enums"] = _join(a["enums"], b["enums"])
    if "soft" in a:
        out["soft"] = _join_maps(a["soft"], b["soft"], _join)
    return out


def combine(a: dict, b: dict) -> dict:
    """Associative, commutative and idempotent; the empty state is neutral."""
    same = lambda x, y: [x[0], _combine_payload(x[1], y[1])]
    return _join_maps(a, b, lambda x, y: _join_maps(x, y, same))


def _one_value(values: dict) -> dict:
    return {k: v[0] for k, v in values.items() if len(v) == 1}


def _fits(value, schema: dict) -> bool:
    if schema["type"] == "string":
        return isinstance(value, str) and schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)) and "pattern" not in schema
    own = types_of(infer(value))
    return own == [schema["type"]] or (own == ["integer"] and schema["type"] == "number")


def _lower_one(kind: str, rigid: dict, p: dict) -> list[dict]:
    out = ({"type": kind} if kind else {}) | rigid | _one_value(p["ann"])
    if kind == "object":
        if p["untyped"]:
            del out["type"]
        for k in ("properties", "patternProperties"):
            if p[k]:
                out[k] = {n: lower(s) for n, s in p[k].items()}
        if p["required"]:
            out["required"] = p["required"]
        more = p["more"]
        if more[0]:
            out["additionalProperties"] = {1: True, 2: {}, 3: False}.get(more[0]) if more[0] < 4 else lower(more[1])
    if kind == "array" and p["items"]:
        out["items"] = lower(p["items"])
    if "soft" in p:
        out |= _one_value(p["soft"])
    if p.get("enums"):
        common = intersect_enums(*p["enums"])
        if common is not None and all(_fits(x, out) for x in common):
            return [out | {"enum": common}]
        return [out | {"enum": e} for e in p["enums"]]
    return [out]


def lower(state: dict) -> dict:
    """The schema of a state."""
    out: list[dict] = []
    for kind in sorted(state):
        group = [state[kind][k] for k in sorted(state[kind])]
        exact_empty = [g for g in group if kind == "object" and g[0].get("maxProperties") == 0]
        rest = [g for g in group if g not in exact_empty]
        for part in (rest, *[[g] for g in exact_empty]):
            if not part:
                continue
            keywords: dict = {}
            for rigid, _ in part:
                keywords = _join_maps(keywords, {k: [v] for k, v in rigid.items()}, _join)
            if kind and all(len(v) == 1 for v in keywords.values()):  # every keyword agrees with itself: one alternative
                out += _lower_one(kind, _one_value(keywords), functools.reduce(_combine_payload, [p for _, p in part]))
            else:
                out += [v for rigid, p in part for v in _lower_one(kind, rigid, p)]
    plain = [canonical(v) for v in out]
    if canonical({"type": "number"}) in plain:  # every integer is a number
        out = [v for v in out if v != {"type": "integer"}]
    if len(out) == 2 and {"type": "null"} in out:
        other = next(v for v in out if v != {"type": "null"})
        if other.get("type") in SCALARS and not {"enum", "const"} & set(other):
            return other | {"type": sorted([other["type"], "null"])}
    found = {canonical(v): v for v in out}
    out = [found[k] for k in sorted(found)]
    return {} if not out else out[0] if len(out) == 1 else {"anyOf": out}


def merge(a: dict, b: dict) -> dict:
    """The join of two schemas: alternatives that agree in their keywords become one, others stay apart under anyOf."""
    return a if a == b else lower(combine(lift(a), lift(b)))


def merge_all(schemas: list[dict]) -> dict:
    """The join of any number of schemas, in any order; one alone stays as it is."""
    distinct = {canonical(s): s for s in schemas if s}
    return {} if not distinct else next(iter(distinct.values())) if len(distinct) == 1 else lower(functools.reduce(combine, map(lift, distinct.values())))


def intersect(schemas: list[dict]) -> dict:
    """All must hold: distinct ones under allOf, without bare types that another schema implies."""
    found: dict[str, dict] = {}
    for s in sorted(schemas, key=canonical):
        if s:
            found.setdefault(canonical(strip(s)), s)
    out = [found[k] for k in sorted(found)]
    bare = lambda s: types_of(s)[0] if set(strip(s)) == {"type"} and len(types_of(s)) == 1 else None
    out = [s for i, s in enumerate(out) if bare(s) is None or not any(only_type(o, bare(s)) for j, o in enumerate(out) if i != j)]
    return {} if not out else out[0] if len(out) == 1 else {"allOf": out}


def only_type(schema: dict, kind: str) -> bool:
    t = types_of(schema)
    if t:
        return set(t) == {kind}
    arms = schema.get("anyOf") or schema.get("oneOf") or []
    return bool(arms) and all(only_type(s, kind) for s in arms)


def intersect_enums(*enums: list) -> list | None:
    """What all of them hold, in canonical order; None if there is nothing."""
    keys = set.intersection(*[{canonical(x) for x in e} for e in enums])
    return [json.loads(k) for k in sorted(keys)] or None


def allows_type(schema: dict, kind: str) -> bool:
    """May some value of the kind be valid? True where nothing rules it out."""
    t = types_of(schema)
    if t and kind not in t and not (kind == "integer" and "number" in t):
        return False
    if "const" in schema or "enum" in schema:
        return any(_value_kind(v) == kind or kind == "number" and _value_kind(v) == "integer" for v in schema.get("enum", [schema.get("const")]))
    if "not" in schema and isinstance(schema["not"], dict) and set(strip(schema["not"])) == {"type"} and kind in types_of(schema["not"]):
        return False
    return all(any(allows_type(s, kind) for s in schema[k]) for k in ("anyOf", "oneOf") if k in schema) and all(allows_type(s, kind) for s in schema.get("allOf", []))


def _value_kind(value) -> str:
    return "null" if value is None else types_of(infer(value))[0]


def excludes_type(schema: dict, kind: str) -> bool:
    """Must every value of the kind be invalid?"""
    return not allows_type(schema, kind)


def add_null(schema: dict) -> dict:
    return schema if not schema or allows_type(schema, "null") else merge(schema, {"type": "null"})


def permits_empty_string(schema: dict) -> bool:
    """Is "" valid, as far as the keywords tell?"""
    import re

    if not allows_type(schema, "string"):
        return False
    if "enum" in schema or "const" in schema:
        return "" in schema.get("enum", [schema.get("const")])
    if schema.get("minLength", 0) > 0:
        return False
    if "pattern" in schema:
        try:
            if not re.search(schema["pattern"], ""):
                return False
        except re.error:
            return False
    return all(any(permits_empty_string(s) for s in schema[k]) for k in ("anyOf", "oneOf") if k in schema) and all(permits_empty_string(s) for s in schema.get("allOf", []))


def apply_override(base, over):
    """Recursive; a subtree with $ref and combinators replace; required lists are joined; null deletes."""
    if not isinstance(base, dict) or not isinstance(over, dict) or "$ref" in over:
        return over
    out = dict(base)
    for k, v in over.items():
        if v is None:
            out.pop(k, None)
        elif k == "required" and isinstance(v, list):
            out[k] = sorted({*base.get(k, []), *v})
        elif k in ("anyOf", "oneOf", "allOf"):
            out[k] = v
        else:
            out[k] = apply_override(base.get(k), v) if k in base else v
    return out


def fold_schemas(df: DataFrame, json_col: str, group_col: str, salts: int = 32) -> DataFrame:
    """(group, schema): the join of the inferred schemas of JSON texts, the same for any partitioning.

    The JVM finds each text's shape first, so that Python sees only distinct shapes: once for each group, and never a
    group whole in one task. A text that is no JSON is a string; null says nothing.
    """
    from pyspark.sql import functions as F

    def start(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for g, part in pdf.groupby("g", dropna=False):
                state: dict = {}
                for text in part["j"]:
                    try:
                        s = {} if text is None else infer(json.loads(text))
                    except ValueError:
                        s = {"type": "string"}
                    state = combine(state, lift(s))
                rows.append((g if g == g else None, canonical(state)))
            yield pd.DataFrame(rows, columns=["g", "state"])

    def fold(pdf):
        import pandas as pd

        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "state": [canonical(functools.reduce(combine, [json.loads(x) for x in sorted(set(pdf["state"]))]))]})

    def finish(batches):
        for pdf in batches:
            pdf["schema"] = [canonical(lower(json.loads(x))) for x in pdf["state"]]
            yield pdf[["g", "schema"]]

    shape = F.schema_of_variant(F.try_parse_json(json_col))
    texts = df.select(F.col(group_col).cast("string").alias("g"), F.col(json_col).alias("j"), F.coalesce(shape, F.lit("-")).alias("shape"))
    # Texts of one shape have one schema, unless it names arrays, nulls or decimals without fraction; of those all distinct texts go on
    flat = F.when(F.col("shape").rlike(r"ARRAY|VOID|,0\)|^-$"), F.xxhash64("j")).otherwise(F.lit(0))
    distinct = texts.groupBy("g", "shape", flat.alias("other")).agg(F.min("j").alias("j"))
    part = distinct.select("g", "j").mapInPandas(start, "g string, state string")
    part = part.withColumn("salt", F.pmod(F.xxhash64("state"), F.lit(salts))).groupBy("g", "salt").applyInPandas(fold, "g string, state string")
    out = part.groupBy("g").applyInPandas(fold, "g string, state string").mapInPandas(finish, "g string, schema string")
    return out.withColumnRenamed("g", group_col)


def descend(schema: dict, segments: list[str], root: dict | None = None) -> dict | None:
    """The subschema at a path within one document, references followed."""
    from shalebed.operators import refs

    whole = schema if root is None else root
    found = refs.descend(schema, segments, "", lambda name: None if name else whole)
    return None if found is None else refs.resolve(found[0], "", lambda name: None if name else whole)[0]
