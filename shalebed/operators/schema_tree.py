"""Building a document's schema: placing schemas at paths, conditions at their hosts, defaults, requiredness."""

from __future__ import annotations

import re

from shalebed.functions.guards import Guard, all_schema
from shalebed.functions.paths import join_segments, split_segments
from shalebed.operators import lattice as L

SCALAR_UNION = {"type": ["boolean", "integer", "number", "string"]}
PLAIN_STRING = {"type": "string", "minLength": 1}


def insert(root: dict, path: str | list[str], schema: dict, replace: bool = False) -> dict:
    """The root with the schema joined into (or put in place of) what is at a path; hosts on the way are open objects, `*` an array's items or a map's members."""
    segments = split_segments(path) if isinstance(path, str) else list(path)
    if not segments:
        return schema if replace else L.merge(root, schema)
    out, head, rest = dict(root), segments[0], segments[1:]
    if head == "*":
        keyword = "additionalProperties" if "properties" in out or out.get("type") == "object" else "items"
        out.setdefault("type", "object" if keyword == "additionalProperties" else "array")
        inner = out.get(keyword)
        out[keyword] = insert(inner if isinstance(inner, dict) else {}, rest, schema, replace)
        return out
    if L.types_of(out) and "object" not in L.types_of(out) and "properties" not in out:
        return L.merge(out, insert({}, segments, schema, replace))
    if "properties" not in out:
        out.setdefault("type", "object")
    properties = dict(out.get("properties") or {})
    properties[head] = insert(properties.get(head) or {}, rest, schema, replace)
    return out | {"properties": properties}


def replace(root: dict, path: str | list[str], schema: dict) -> dict:
    return insert(root, path, schema, replace=True)


def build(schemas: dict[str, dict]) -> dict:
    """One root from schemas by path, parents before their members."""
    root: dict = {"type": "object", "properties": {}}
    for path in sorted(schemas, key=lambda p: (len(split_segments(p)), p)):
        root = insert(root, path, schemas[path])
    return root


def append_conditional(root: dict, host: str, guards: list[Guard], then: dict) -> dict:
    """An if/then among the host's allOf, with the guards' paths taken relative to it; one that is there already is not added again."""
    prefix = split_segments(host)
    own = []
    for g in guards:
        segments = split_segments(g.path)
        if segments[: len(prefix)] != prefix:
            return append_conditional(root, "", guards, insert({}, host, then)) if host else root
        own.append(Guard(g.kind, join_segments(segments[len(prefix) :]), g.arg))
    clause = {"if": all_schema(own), "then": then}

    def at(s: dict, rest: list[str]) -> dict:
        if not rest:
            held = list(s.get("allOf", []))
            return s if any(L.canonical(c) == L.canonical(clause) for c in held) else s | {"allOf": [*held, clause]}
        properties = dict(s.get("properties") or {})
        properties[rest[0]] = at(properties.get(rest[0]) or {}, rest[1:])
        return s | {"properties": properties}

    return at(root, prefix)


def backfill(root: dict, defaults: dict, referenced: set[str], prefix: str = "") -> dict:
    """Declared keys that nothing refers to, added with the types of their defaults."""
    out = root
    for key, value in sorted(defaults.items()):
        path = join_segments([*split_segments(prefix), key])
        if isinstance(value, dict) and value:
            out = backfill(out, value, referenced, path)
        elif path not in referenced and not any(r.startswith(path + ".") for r in referenced) and at(out, path) is None:
            out = insert(out, path, L.infer(value))
    return out


def at(root: dict, path: str) -> dict | None:
    """The property's schema at a path, through properties and items alone."""
    for s in split_segments(path):
        root = (root.get("items") if s == "*" else (root.get("properties") or {}).get(s)) if isinstance(root, dict) else None
        if not isinstance(root, dict):
            return None
    return root


def infer_required(root: dict, evidence: dict[str, dict], explicit: set[str]) -> dict:
    """Paths that a header asks for without a fallback or a condition, that are rendered elsewhere too, and that no default supplies, become required in their parents, where these are objects with properties."""
    out = root
    for path in sorted(evidence):
        e = evidence[path]
        if not (e.get("positive_header") and not e.get("has_default") and not e.get("conditionally_optional") and e.get("rendered_unguarded")) or path in explicit:
            continue
        *parents, leaf = split_segments(path)
        host = at(out, join_segments(parents))
        if host is not None and isinstance(host.get("properties"), dict):
            out = insert_required(out, parents, leaf)
    return out


def insert_required(root: dict, parents: list[str], leaf: str) -> dict:
    if not parents:
        return root | {"required": sorted({*root.get("required", []), leaf})}
    properties = dict(root.get("properties") or {})
    properties[parents[0]] = insert_required(properties.get(parents[0]) or {}, parents[1:], leaf)
    return root | {"properties": properties}


def preserve_defaults(schema: dict, value) -> dict:
    """The schema, widened so that the shipped default is valid: a kind of its own joins the alternatives, an empty container is let in beside filled ones."""
    if valid(schema, value):
        return schema
    if value is None:
        return L.add_null(schema)
    own = L.infer(value)
    if value in ("", [], {}):
        own = {"": {"type": "string", "maxLength": 0}, "[]": {"type": "array", "maxItems": 0}, "{}": {"type": "object", "maxProperties": 0}}[L.canonical(value).strip('"') if value != "" else ""]
    elif not isinstance(value, (dict, list)) and L.allows_type(schema, L.types_of(own)[0]):
        own = {"const": value}
    return L.union([schema, own])


def valid(schema, value) -> bool:
    """Validation by the keywords that this package writes; unknown keywords say nothing."""
    if schema is True or schema == {}:
        return True
    if schema is False:
        return False
    kind = "null" if value is None else L.types_of(L.infer(value))[0]
    t = L.types_of(schema)
    if t and kind not in t and not (kind == "integer" and "number" in t):
        return False
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    same = lambda a, b: a == b if number(a) and number(b) else L.canonical(a) == L.canonical(b)
    if "const" in schema and not same(schema["const"], value) or "enum" in schema and not any(same(x, value) for x in schema["enum"]):
        return False
    if isinstance(value, str):
        try:
            if "pattern" in schema and not re.search(schema["pattern"], value):
                return False
        except re.error:
            pass
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
            return False
    if kind in ("integer", "number") and (value <= schema.get("exclusiveMinimum", value - 1) or value >= schema.get("exclusiveMaximum", value + 1) or value < schema.get("minimum", value) or value > schema.get("maximum", value)):
        return False
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            return False
        if isinstance(schema.get("items"), dict) and not all(valid(schema["items"], x) for x in value):
            return False
        if "contains" in schema and not any(valid(schema["contains"], x) for x in value):
            return False
    if isinstance(value, dict):
        if not schema.get("minProperties", 0) <= len(value) <= schema.get("maxProperties", len(value)) or not set(schema.get("required", [])) <= set(value):
            return False
        if "propertyNames" in schema and not all(valid(schema["propertyNames"], k) for k in value):
            return False
        for k, v in value.items():
            known = [s for p, s in (schema.get("patternProperties") or {}).items() if re.search(p, k)]
            if k in schema.get("properties", {}):
                known.append(schema["properties"][k])
            if not known and "additionalProperties" in schema:
                known.append(schema["additionalProperties"])
            if not all(valid(s, v) for s in known):
                return False
    if "not" in schema and valid(schema["not"], value):
        return False
    if "if" in schema and not valid(schema.get("then" if valid(schema["if"], value) else "else", {}), value):
        return False
    return all(valid(s, value) for s in schema.get("allOf", [])) and all(any(valid(s, value) for s in schema[k]) if k == "anyOf" else sum(valid(s, value) for s in schema[k]) == 1 for k in ("anyOf", "oneOf") if k in schema)


# ---- what a path's evidence says of its schema


def restrict(schema: dict, kinds: tuple[str, ...]) -> dict:
    """The part of a schema that describes these kinds, the open schema where nothing is left: a provider's schema seen through a scalar slot, say."""
    left = [v for v in L.variants(schema) if any(L.allows_type(v, k) for k in kinds)]
    return L.union([v | ({"type": sorted(k for k in kinds if L.allows_type(v, k))} if not L.types_of(v) and v else {}) if v else v for v in left]) if left else {}


SCALARS = ("boolean", "integer", "null", "number", "string")


def preimage(sink: dict, kind: str) -> dict:
    """What the values must be so that the sink's schema holds, by the way in which they are rendered.

    A scalar slot reads its own token: a string slot takes any scalar that prints, other slots their own kinds. Part of a
    token says nothing but that it is a scalar. A fragment is the sink's own document; a serialised value is free, unless
    its YAML is placed in the document (then its shape is the sink's). Program text and widened dependencies say nothing.
    """
    if not sink or kind in ("serialized", "widened", "read"):
        return {}
    if kind == "partial_scalar":
        return SCALAR_UNION
    if kind == "scalar":
        found = restrict(sink, SCALARS)
        return L.union([found, {"type": "null"}]) if found and not L.allows_type(found, "null") else found
    if kind in ("fragment", "yaml_serialized"):
        return sink
    if kind == "templated_yaml_serialized":
        return loosened(sink)
    raise ValueError(kind)


def loosened(schema: dict) -> dict:
    """Strings below may be programs: their patterns, lengths and enums don't bind."""
    if not isinstance(schema, dict):
        return schema
    out = {k: v for k, v in schema.items() if not ("string" in L.types_of(schema) and k in ("pattern", "minLength", "maxLength", "enum", "const", "format"))}
    return L.rebuilt(out, loosened)


def guard_schema(guards: list[Guard]) -> dict:
    """What comparisons and type tests of a path say of its values: the literals, their kind beside them, and null; or the kinds tested for."""
    found = []
    for g in guards:
        if g.kind == "eq":
            kind = L.infer(g.arg)
            found.append({"enum": [g.arg]} if not kind else kind)
            found.append({"type": "null"})
        elif g.kind == "type_is":
            found.append({"type": g.arg})
    return L.merge_all(found)


def base_owner(evidence: dict) -> str:
    """Who decides a path's base: its sinks, its members, the declared default, comparisons, or hints; `open` where none does."""
    if evidence.get("provider"):
        return "provider"
    if evidence.get("has_descendants"):
        return "members"
    if evidence.get("declared") and not evidence.get("serialized"):
        return "declared"
    return "guards" if evidence.get("guards") else "hints" if evidence.get("hints") else "open"


def resolve_path(evidence: dict) -> dict:
    """One schema for a path from all that is known of it.

    evidence: provider, declared, guards, hints, fallback_hints (schemas, {} for none); serialized, partial, control_only,
    unconditional, has_descendants, has_string_contract, default_null, default_empty_string (flags).
    """
    get = lambda k: evidence.get(k) or {}
    provider, declared, guards, hints, fallback = (get(k) for k in ("provider", "declared", "guards", "hints", "fallback_hints"))
    if evidence.get("serialized"):
        fallback = {}
    only_fallback = bool(fallback) and not (hints or provider or guards or evidence.get("has_string_contract"))
    hints = L.merge(hints, fallback)
    if evidence.get("serialized") or evidence.get("control_only") and not (provider or hints or evidence.get("has_descendants")):
        declared = {}
    elif evidence.get("partial") and declared and set(L.types_of(declared)) <= set(SCALARS):
        declared = SCALAR_UNION
    if evidence.get("unconditional"):
        guards = {}
    deferred = guards if evidence.get("serialized") else {}
    guards = {} if evidence.get("serialized") else guards
    if evidence.get("partial") and not (provider or hints or guards):
        guards = SCALAR_UNION
    if provider:
        out = provider if not declared or compatible(provider, declared) else L.union([provider, declared])
        out = L.merge(out, hints) if hints and not compatible(provider, hints) else out
    else:
        out = L.merge_all([declared, hints, guards])
    if deferred and out:
        out = L.union([out, deferred])
    if only_fallback and out:
        out = L.union([out, *[{"type": "boolean", "const": False}, {"type": "null"}, {"type": "integer", "const": 0}, {"type": "string", "maxLength": 0}, {"type": "array", "maxItems": 0}, {"type": "object", "maxProperties": 0}]])
    if evidence.get("default_null") and out:
        out = L.add_null(out)
    if evidence.get("default_empty_string") and out and not L.permits_empty_string(out):
        out = L.union([out, {"type": "string", "maxLength": 0}])
    return out


def compatible(wide: dict, narrow: dict) -> bool:
    """Does every kind of the narrow schema have a place in the wide one?"""
    kinds = [k for k in ("array", "boolean", "integer", "null", "number", "object", "string") if L.types_of(narrow) and L.allows_type(narrow, k)]
    return all(L.allows_type(wide, k) for k in kinds)


def conditional_target(evidence: dict, guards: list[Guard], path: str) -> dict:
    """What holds of a path where the guards do: its schema there, with its own truthiness, if it is among the guards, putting falsy values out."""
    out = resolve_path(evidence)
    own = any(g.kind in ("truthy", "with", "range") and g.path == path for g in guards)
    return restrict(out, tuple(k for k in ("array", "boolean", "integer", "number", "object", "string"))) if own and out else out


def split_segment_schema(separator: str, place: int, segment: dict) -> dict:
    """A string whose piece at a place, counted from 0 (or -1 for the last), matches the segment's pattern; other keywords of the segment can't be told from outside."""
    pattern = segment.get("pattern")
    if pattern is None or not separator:
        return {"type": "string"}
    sep, piece = re.escape(separator), f"(?:(?!{re.escape(separator)})[\\s\\S])*"
    inner = pattern.removeprefix("^").removesuffix("$")
    body = f"(?:{inner})" if pattern.startswith("^") and pattern.endswith("$") else f"(?={piece}(?:{inner})){piece}"
    return {"type": "string", "pattern": f"^(?:{piece}{sep}){{{place}}}{body}(?:{sep}|$)" if place >= 0 else f"(?:^|{sep}){body}$"}


def wrapper_alternatives(schema: dict, keys: tuple[str, ...]) -> dict:
    """The schema, or an object whose only member is one of the keys and holds a program's text."""
    return L.union([schema, *[{"type": "object", "properties": {k: {"type": "string"}}, "required": [k], "additionalProperties": False} for k in keys]])


def provider_definitions(schemas: dict[str, dict], min_bytes: int = 64) -> tuple[dict[str, dict], dict[str, dict]]:
    """(schemas by path, definitions): provider schemas used more than once and long enough become definitions, named p0, p1 .. in the order of their first path."""
    uses: dict[str, list[str]] = {}
    for path in sorted(schemas):
        uses.setdefault(L.canonical(schemas[path]), []).append(path)
    definitions, out = {}, dict(schemas)
    for text, paths in uses.items():
        if len(paths) > 1 and len(text) >= min_bytes:
            name = f"p{len(definitions)}"
            definitions[name] = schemas[paths[0]]
            for p in paths:
                out[p] = {"$ref": f"#/$defs/{name}"}
    return out, definitions


def project(rows: dict[str, dict]) -> list[dict]:
    """Fragment leaves to contract rows: (path, schema, required) of every property of every schema by path."""
    out = []

    def walk(path: list[str], s: dict, required: bool) -> None:
        out.append({"path": join_segments(path), "schema": s, "required": required})
        for k, v in sorted((s.get("properties") or {}).items()):
            if isinstance(v, dict):
                walk([*path, k], v, k in s.get("required", []))
        if isinstance(s.get("items"), dict):
            walk([*path, "*"], s["items"], False)

    for path in sorted(rows):
        walk(split_segments(path), rows[path], False)
    return out


def required_sources(sinks: list[dict], defaults: dict) -> list[dict]:
    """A sink that the resource requires asks its source for a value that is there and not null, unless a default supplies one. sinks: source_path, required, condition, kind."""
    from shalebed.functions.guards import value_at

    out = []
    for s in sinks:
        if not s["required"] or s["kind"] not in ("scalar", "fragment", "yaml_serialized"):
            continue
        segments = split_segments(s["source_path"])
        if "*" in segments:
            at_star = segments.index("*")
            rest = segments[at_star + 1 :]
            out.append({"path": join_segments(segments[:at_star]), "target": "members_at" if rest else "members", "field": rest, "requirement": "present", "condition": s["condition"]})
        elif value_at(defaults, segments)[1] is None:
            out.append({"path": s["source_path"], "target": "value", "field": [], "requirement": "present", "condition": s["condition"]})
    return out


def range_key_requirements(slot: dict) -> list[tuple[str, object]]:
    """What a slot for keys asks of each key: (kind, argument) of requirements."""
    out: list[tuple[str, object]] = []
    if "minLength" in slot or "maxLength" in slot:
        out.append(("length", (slot.get("minLength"), slot.get("maxLength"))))
    if "pattern" in slot:
        out.append(("matches", slot["pattern"]))
    return out
