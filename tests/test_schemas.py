"""Schemas: the lattice's laws, references, trees, conditions against columns, sources and caches."""

import functools
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from shalebed.functions import guards as G
from shalebed.functions import requirements as Q
from shalebed.functions import semver, truth
from shalebed.functions.guards import Guard
from shalebed.functions.requirements import Requirement, Target
from shalebed.operators import boolalg as B
from shalebed.operators import catalog, contracts, emit, graph, refs, shred
from shalebed.operators import lattice as L
from shalebed.operators import schema_tree as S
from shalebed.plans.shapes import SHAPES
from shalebed.sources import schemas


def some_schema(r, depth=2):
    kind = r.choice(["object", "array", "string", "integer", "number", "boolean", "null", "any", "enum"])
    if kind == "object":
        s = {"type": "object"} | ({"properties": {c: some_schema(r, depth - 1) for c in r.sample("abc", r.randint(0, 2))}} if depth else {})
        for p, k, v in ((0.3, "additionalProperties", [True, False, {}, {"type": "string"}]), (0.3, "required", [["a"], ["b"]]), (0.2, "minProperties", [1, 2])):
            if r.random() < p:
                s[k] = r.choice(v)
        return s
    if kind == "array":
        return {"type": "array"} | ({"items": some_schema(r, depth - 1)} if depth and r.random() < 0.7 else {}) | ({"minItems": r.randint(0, 2)} if r.random() < 0.3 else {})
    if kind in ("any", "enum"):
        return {} if kind == "any" else {"type": "string", "enum": r.sample("xyz", r.randint(1, 2))}
    s = {"type": kind}
    if kind == "string" and r.random() < 0.3:
        s["pattern"] = r.choice("ab")
    return s | ({"description": r.choice("pq")} if r.random() < 0.2 else {})


def test_join_is_the_same_in_any_order_and_grouping():
    r = random.Random(1)
    for _ in range(600):
        xs = [some_schema(r) for _ in range(r.randint(1, 5))]
        want = L.lower(functools.reduce(L.combine, map(L.lift, xs), {}))
        ys = r.sample(xs, len(xs))
        k = r.randint(0, len(ys))
        a, b = (functools.reduce(L.combine, map(L.lift, part), {}) for part in (ys[:k], ys[k:]))
        assert L.canonical(L.lower(L.combine(json.loads(L.canonical(a)), b))) == L.canonical(want)
        assert L.combine(a, a) == a


def test_joins():
    assert L.infer(None) == {} and L.merge({"type": "integer"}, {"type": "string"}) == {"anyOf": [{"type": "integer"}, {"type": "string"}]}
    assert L.merge_all([{"type": "integer"}, {"type": "number"}, {"type": "string"}]) == {"anyOf": [{"type": "number"}, {"type": "string"}]}
    closed = [{"type": "object", "properties": {c: {"type": "string"}}, "additionalProperties": False} for c in "ab"]
    assert L.merge(*closed) == {"type": "object", "properties": {"a": {"type": "string"}, "b": {"type": "string"}}, "additionalProperties": False}
    assert L.merge({"type": "array", "minItems": 1, "items": {"type": "string"}}, {"type": "array"}) == {"type": "array", "minItems": 1, "items": {"type": "string"}}
    assert "anyOf" in L.merge({"type": "array", "minItems": 1}, {"type": "array", "minItems": 2})
    assert L.merge({"type": "string", "enum": ["a", "b"]}, {"type": "string", "enum": ["b", "c"]}) == {"type": "string", "enum": ["b"]}
    assert "anyOf" in L.merge({"type": "string", "enum": ["a"]}, {"type": "string", "enum": ["c"]}) and "anyOf" in L.merge({"type": "string", "enum": ["a"]}, {"type": "null"})
    assert L.merge({"properties": {"a": {"type": "string"}}}, {"type": "object", "properties": {"b": {}}}) == {"properties": {"a": {"type": "string"}, "b": {}}}
    assert L.intersect([{"type": "string"}, {"type": "string", "minLength": 1}, {}]) == {"type": "string", "minLength": 1}
    assert L.excludes_type({"anyOf": [{"type": "string"}, {"type": "null"}]}, "array") and L.permits_empty_string({"type": "string"}) and not L.permits_empty_string({"type": "string", "pattern": "a"})
    tree = {"properties": {"a": {"description": "x", "const": {"description": "data"}}}, "description": "y"}
    assert L.strip_descriptions(tree) == {"properties": {"a": {"const": {"description": "data"}}}}
    assert L.attach_descriptions({"properties": {"a": {"items": {}}}}, {("a", "*"): "item", (): "root"}) == {"properties": {"a": {"items": {"description": "item"}}}, "description": "root"}
    assert L.keyword_context("anyOf") == "value" and L.keyword_context("propertyNames") == "keys" and L.keyword_context("items") == "member" and L.keyword_context("if") == "condition"


def test_fold_does_not_depend_on_partitioning(spark):
    r = random.Random(2)
    texts = [json.dumps({"k": r.choice([1, 2.5, "s", None, [1], ["a", None], {"q": True}, 12345678901234567890, 1.0])}) for _ in range(60)] + ["{", None, '{"k": 1, "k": "x"}']
    rows = [(i % 2, x) for i, x in enumerate(texts)]
    want = {}
    for g, x in rows:
        try:
            s = {} if x is None else L.infer(json.loads(x))
        except ValueError:
            s = {"type": "string"}
        want.setdefault(str(g), []).append(s)
    want = {g: L.canonical(L.merge_all(s)) for g, s in want.items()}
    for n in (1, 7):
        df = spark.createDataFrame(rows, "g int, j string").repartition(n)
        assert {x["g"]: x["schema"] for x in L.fold_schemas(df, "j", "g").collect()} == want


GUARDS = [
    Guard("truthy", "a"), Guard("not", "a"), Guard("with", "a"), Guard("eq", "a", "prod"), Guard("eq", "a", 0), Guard("ne", "a", "prod"), Guard("absent", "a"), Guard("matches", "a", "^p"), Guard("not_matches", "a", "^p"), Guard("type_is", "a", "integer"),
    Guard("type_is", "a", "number"), Guard("not_type_is", "a", "array"), Guard("int_gt", "a", 3), Guard("int_lt", "a", 3), Guard("min_members", "a", 2), Guard("has_key", "a", "k"), Guard("not_has_key", "a", "k"), Guard("range_key_prefix", "a", "key"),
    Guard("range_key_matches", "a", "[0-9]$"), Guard("contains", "a", "prod"), Guard("or", "a", ("b",)), Guard("any_of", "", ((Guard("truthy", "a"), Guard("has_key", "a", "k")), (Guard("eq", "b", 1),))), Guard("not_guard", "", Guard("has_key", "a", "k")),
]


def test_guards_agree_on_columns_values_and_schemas(spark):
    df = spark.createDataFrame([(s,) for s in SHAPES], "j string").withColumn("doc", F.parse_json("j"))
    got = df.select("j", *[g.on(F.col("doc")).alias(f"g{i}") for i, g in enumerate(GUARDS)]).collect()
    for row in got:
        document = json.loads(row["j"])
        for i, g in enumerate(GUARDS):
            assert row[f"g{i}"] == G.evaluate([g], document), (g, row["j"])
            exact = g.kind not in ("range",) and not (g.kind == "absent" and "a" not in document)
            if exact:
                assert row[f"g{i}"] == S.valid(g.schema(), document), (g, row["j"], g.schema())


REQUIREMENTS = [
    Requirement("schema_type", "string"), Requirement("schema_type_even_null", "object"), Requirement("truthy_implies_type", "string"), Requirement("truthy"), Requirement("falsy"), Requirement("field_falsy", ("k",)), Requirement("field_equals", (("k",), 1)),
    Requirement("field_present", ("k",)), Requirement("field_truthy", ("k",)), Requirement("any_of", ((Requirement("has_member", "k"),), (Requirement("schema_type_even_null", "string"), Requirement("truthy")))), Requirement("not_equals", "prod"),
    Requirement("field_not_equals", (("k",), 1)), Requirement("comparable_kind", "number"), Requirement("not_schema_type", "array"), Requirement("has_member", "k"), Requirement("matches", ("^p", False)), Requirement("matches", ("^p", True)), Requirement("not_matches", ("^p", False)),
    Requirement("length", (1, 4)), Requirement("member_host", ("string",)), Requirement("iterable", True), Requirement("indexable", 1), Requirement("split_segments", ("-", 3, False)), Requirement("split_segments", ("-", 3, True)), Requirement("printf_string"), Requirement("plain_safe", (True, False)),
]
TARGETS = [Target(), Target("members"), Target("members", None, True), Target("members_except", ("k",)), Target("members_prefix", "key"), Target("members_at", ("m",)), Target("keys")]


def test_requirements_agree_on_columns_and_schemas(spark):
    present = [s for s in SHAPES if "a" in json.loads(s)]
    df = spark.createDataFrame([(s,) for s in present], "j string").withColumn("a", truth.get(F.parse_json("j"), "a"))
    rows = df.select("j", *[q.holds(F.col("a")).alias(f"q{i}") for i, q in enumerate(REQUIREMENTS)], *[t.holds(F.col("a"), [Requirement("schema_type_even_null", "string")]).alias(f"t{i}") for i, t in enumerate(TARGETS)]).collect()
    for row in rows:
        value = json.loads(row["j"])["a"]
        for i, q in enumerate(REQUIREMENTS):
            if q.kind.startswith("field_") and not isinstance(value, dict) or q.kind == "not_matches" and not isinstance(value, str):
                continue  # schemas of fields say nothing of what has none
            assert row[f"q{i}"] == S.valid(q.schema(), value), (q, value, q.schema())
        for i, t in enumerate(TARGETS):
            assert row[f"t{i}"] == S.valid(t.schema([Requirement("schema_type_even_null", "string")]), value), (t, value)


def test_quoted_content():
    import re

    for text, single, double in (("it's", False, True), ("it''s", True, True), ('a"b', True, False), ("a\\q", True, False), ("a\\n", True, True), ("", True, True)):
        assert bool(re.search(Q.SINGLE_QUOTED, text)) == single and bool(re.search(Q.DOUBLE_QUOTED, text)) == double
    assert Q.ecma_pattern("^a(?:b)$") and not Q.ecma_pattern("(?i)a") and not Q.ecma_pattern(r"\pL") and not Q.ecma_pattern("a++") and not Q.ecma_pattern("(?P<x>a)")


def test_lowering():
    assert G.lower_set([Guard("default", "x"), Guard("truthy", "t"), Guard("eq", "a", 1)], "t") == [Guard("eq", "a", 1)]
    assert G.lower_set([Guard("range_key_prefix", "a", "x")]) is None and G.lowerable(Guard("range", "a")) == Guard("truthy", "a")
    assert G.terminal_clause([Guard("truthy", "a"), Guard("has_key", "b", "k")]).kind == "all_of"
    assert G.absent_condition("") is None and S.valid(G.absent_condition("a.b"), {"a": {"b": None}}) and S.valid(G.absent_condition("a.b"), {}) and not S.valid(G.absent_condition("a.b"), {"a": {"b": 1}})
    bad = G.negated_members(Guard("contains_member", "l", ("m", 1)))
    assert S.valid(bad, [{"m": 2}, {}]) and not S.valid(bad, [{"m": 1}]) and S.valid(bad, {"x": {"m": 2}}) and not S.valid(bad, {"x": {"m": 1}})
    import re

    for greater, bound in itertools.product((True, False), (-15, 0, 3, 99)):
        pattern = G.int_preimage(greater, bound)
        for n in (*range(-200, 200), 10**6, -(10**6)):
            assert not re.search(pattern, str(n)) or (n > bound if greater else n < bound)


def test_version_patterns_are_exact():
    import operator
    import re

    ops = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
    key = lambda v: tuple([*map(int, v.split(".")), 0, 0][:3])
    versions = [".".join(map(str, p)) for n in (1, 2, 3) for p in itertools.product((0, 1, 2, 3, 9, 10, 19, 20, 21, 100), repeat=n)]
    for op, bound in itertools.product(ops, ("0.0.0", "1.8.0", "3.0.0", "10.0.0", "1.20.3")):
        pattern = semver.pattern(op + bound)
        assert all(bool(pattern and re.search(pattern, v)) == ops[op](key(v), key(bound)) for v in versions), (op, bound)
    assert semver.pattern("^1.2") is None and semver.pattern(">=1, <2") is None and semver.pattern("<1.0.0-rc") is None and semver.parse("junk!") is None


def test_diagrams_agree_with_truth_tables():
    r = random.Random(3)
    rows = [dict(zip("abcd", v, strict=True)) for v in itertools.product([False, True], repeat=4)]
    ev = lambda d: [any(all(v[n] == w for n, w in t) for t in d) for v in rows]
    some = lambda: frozenset(frozenset((n, r.random() < 0.5) for n in r.sample("abcd", r.randint(0, 3))) for _ in range(r.randint(0, 4)))
    for _ in range(300):
        a, b = some(), some()
        assert ev(B.normalize(a)) == ev(a) and ev(B.negate(a)) == [not x for x in ev(a)] and B.implies(a, b) == all(y or not x for x, y in zip(ev(a), ev(b), strict=True))
        both = B.Truth.exact(a) & B.Truth.exact(b)
        assert ev(both.yes) == [x and y for x, y in zip(ev(a), ev(b), strict=True)] and ev(both.no) == [not (x and y) for x, y in zip(ev(a), ev(b), strict=True)]
    wide = frozenset(frozenset({(f"x{i}", True), (f"y{i}", True)}) for i in range(60))
    assert not B.implies(wide, B.literal("z"), most=50)
    with pytest.raises(B.TooLarge):
        B.negate(frozenset(frozenset({(f"x{i}", True), (f"x{(i * 7 + 3) % 60}", False)}) for i in range(60)), most=40)


STORE = {
    "a.json": {"type": "object", "properties": {"x": {"$ref": "b.json#/definitions/y"}, "l": {"type": "array", "items": {"$ref": "#/properties/x"}}, "~t/": {"const": 1}}, "required": ["x"], "allOf": [{"properties": {"via": {"type": "null"}}}], "patternProperties": {"^p": {"type": "number"}}},
    "b.json": {"definitions": {"y": {"type": "object", "properties": {"z": {"$ref": "#/definitions/y"}, "q": {"type": "string"}}, "additionalProperties": {"type": "boolean"}}}, "loop": {"$ref": "#/loop"}},
}


def test_references():
    a = STORE["a.json"]
    down = lambda path: refs.descend(a, path, "a.json", STORE.get)
    assert down(["l", "[*]", "q"])[0] == {"type": "string"} and down(["l", "*", "z", "z", "q"])[1] == "b.json" and down(["x"])[2] and not down(["l"])[2]
    assert down(["via"])[0] == {"type": "null"} and down(["p1"])[0] == {"type": "number"} and down(["x", "other"])[0] == {"type": "boolean"} and down(["none"]) is None
    assert refs.split_reference("a.json", "#/x") == ("a.json", "/x") and refs.split_reference("a.json", "./b.json#/y") == ("b.json", "/y")
    assert refs.at_pointer(a, "/properties/~0t~1/const") == 1 and refs.resolve({"$ref": "b.json#/loop"}, "a.json", STORE.get)[0] is None
    flat = refs.expand(a, "a.json", STORE.get)
    assert flat["properties"]["x"]["properties"] == {"z": {}, "q": {"type": "string"}} and not refs.references(flat)
    bundled = refs.bundle(a, "a.json", STORE.get)
    assert bundled["properties"]["x"] == {"$ref": "#/$defs/y"} and bundled["$defs"]["y"]["properties"]["z"] == {"$ref": "#/$defs/y"} and refs.reachable_definitions(bundled) == {"y"}
    assert refs.descend(bundled, ["l", "*", "z", "q"], "", lambda n: bundled)[0] == {"type": "string"}
    assert "$defs" not in refs.prune({"$defs": {"dead": {}}}) and refs.prune({"$defs": {"dead": {}, "other": {}}}, owned={"dead"}) == {"$defs": {"other": {}}}
    assert refs.bundle({"$ref": "gone.json#/x"}, "a.json", STORE.get) == {"$ref": "gone.json#/x"}


def test_trees():
    t = S.insert({}, "a.b.*.c", {"type": "string"})
    assert S.at(t, "a.b.*.c") == {"type": "string"} and S.at(S.insert(t, "a.b.*.c", {"type": "null"}), "a.b.*.c") == {"type": ["null", "string"]} and S.at(S.replace(t, "a.b", {"type": "integer"}), "a.b") == {"type": "integer"}
    host = S.append_conditional({"type": "object"}, "a", [Guard("truthy", "a.on")], {"required": ["b"]})
    assert S.valid(host, {"a": {"on": False}}) and not S.valid(host, {"a": {"on": True}}) and S.valid(host, {"a": {"on": True, "b": 1}}) and S.append_conditional(host, "a", [Guard("truthy", "a.on")], {"required": ["b"]}) == host
    other = S.append_conditional({"type": "object"}, "a", [Guard("eq", "mode", "x")], {"required": ["b"]})
    assert not S.valid(other, {"mode": "x", "a": {}}) and S.valid(other, {"mode": "y", "a": {}})
    assert S.backfill({"type": "object"}, {"u": {"v": 1}, "w": "s"}, {"w"}) == {"type": "object", "properties": {"u": {"type": "object", "properties": {"v": {"type": "integer"}}}}}
    e = {"positive_header": True, "rendered_unguarded": True}
    root = {"properties": {"a": {"properties": {"b": {}}}}}
    assert S.infer_required(root, {"a.b": e}, set())["properties"]["a"]["required"] == ["b"] and S.infer_required(root, {"a.b": e}, {"a.b"}) == root and S.infer_required(root, {"a.b": e | {"has_default": True}}, set()) == root
    for value in (None, "", [], {}, "x", 3, [1], {"k": 1}):
        for s in ({"type": "integer"}, {"type": "string", "minLength": 2}, {"type": "array", "minItems": 2}, {"type": "object", "required": ["q"]}):
            assert S.valid(S.preserve_defaults(s, value), value)


def test_resolution():
    sink = {"type": "object", "properties": {"limits": {"type": "object"}}}
    assert S.preimage(sink, "yaml_serialized") == sink and S.preimage(sink, "serialized") == {} and S.preimage({"type": "integer"}, "partial_scalar") == S.SCALAR_UNION
    assert S.valid(S.preimage({"type": "integer"}, "scalar"), None) and not S.valid(S.preimage({"type": "integer"}, "scalar"), "x") and S.preimage({"type": "string", "pattern": "^a"}, "templated_yaml_serialized") == {"type": "string"}
    assert S.resolve_path({"serialized": True, "declared": {"type": "string"}}) == {} and S.resolve_path({"partial": True, "declared": {"type": "string"}}) != {"type": "string"}
    assert S.resolve_path({"control_only": True, "declared": {"type": "boolean"}}) == {} and S.resolve_path({"provider": {"type": "integer"}, "declared": {"type": "integer"}}) == {"type": "integer"}
    both = S.resolve_path({"provider": {"type": "integer"}, "declared": {"type": "string"}})
    assert S.valid(both, "s") and S.valid(both, 1) and not S.valid(both, [])
    fallback = S.resolve_path({"fallback_hints": {"type": "string"}})
    assert S.valid(fallback, "x") and S.valid(fallback, False) and S.valid(fallback, None) and not S.valid(fallback, 7)
    assert S.guard_schema([Guard("eq", "a", "x")]) == {"type": ["null", "string"]} and S.base_owner({"provider": {}, "declared": {"type": "string"}}) == "declared" and S.base_owner({}) == "open"
    assert not S.valid(S.conditional_target({"provider": {"type": ["null", "string"]}}, [Guard("truthy", "a")], "a"), None)
    import re

    p = S.split_segment_schema(":", 1, {"pattern": "^[0-9]+$"})["pattern"]
    assert re.search(p, "a:12:c") and not re.search(p, "12:x") and re.search(S.split_segment_schema(":", -1, {"pattern": "^z$"})["pattern"], "a:z")
    out, definitions = S.provider_definitions({"a": sink | {"description": "x" * 60}, "b": sink | {"description": "x" * 60}, "c": {}})
    assert out["a"] == out["b"] == {"$ref": "#/$defs/p0"} and len(definitions) == 1 and S.valid(S.wrapper_alternatives({"type": "integer"}, ("tpl",)), {"tpl": "x"})
    assert [r["path"] for r in S.project({"r": {"properties": {"a": {"items": {}}}, "required": ["a"]}})] == ["r", "r.a", "r.a.*"]
    asked = S.required_sources([{"source_path": "p.*.q", "required": True, "kind": "scalar", "condition": []}, {"source_path": "s", "required": True, "kind": "scalar", "condition": []}, {"source_path": "t", "required": True, "kind": "scalar", "condition": []}], {"t": 1})
    assert [(x["path"], x["target"], x["field"]) for x in asked] == [("p", "members_at", ["q"]), ("s", "value", [])] and S.range_key_requirements({"maxLength": 3}) == [("length", (None, 3))]


def test_emission():
    s = {"properties": {"a": {"$ref": "#/$defs/long"}, "b": {"$ref": "#/$defs/long"}, "c": {"$ref": "#/$defs/once"}}, "$defs": {"once": {}, "long": {"$ref": "#/$defs/once"}}}
    out = emit.rename_compact(s)
    assert out["properties"]["a"] == {"$ref": "#/$defs/0"} and set(out["$defs"]) == {"0", "1"} and emit.free_name("x", {"x", "x2"}) == "x3"
    for v in ({"b": [1, 2], "a": "x"}, [], {}, "é", [None, {"k": {}}]):
        assert emit.structural(v)[1] == len(L.canonical(v))
    assert emit.structural({"a": 1, "b": 2}) == emit.structural({"b": 2, "a": 1}) != emit.structural({"a": 2, "b": 1})


def test_subtrees_and_classes(spark):
    part = {"k": "v" * 40}
    df = spark.createDataFrame([(json.dumps({"a": part, "b": [part]}), "guard"), (json.dumps(part), "fail"), (None, "x")], "j string, c string")
    got = {r["uses"] for r in emit.subtrees(df, "j").where("size < 60").collect()}
    assert 3 in got and emit.select_classes(df, "c", {"fail": False}).count() == 2


class Web:
    def __init__(self, pages, broken=()):
        self.pages, self.broken, self.asked = pages, broken, []

    def get(self, url):
        self.asked.append(url)
        if any(b in url for b in self.broken):
            raise OSError("down")
        return self.pages.get(url)


def test_schema_sources(spark, tmp_path):
    chain = schemas.mirrors("https://one/", ["https://two", "https://one"])
    assert [c[2] for c in chain] == ["https://one", "https://two"] and schemas.source_id("https://one/") == schemas.source_id("https://one")
    web = Web({"https://two/v1/a.json": "{}", "https://one/v1/b.json": "{}"})
    got = schemas.prefetch([("v1", "a.json"), ("v1", "b.json"), ("v1", "c.json"), ("v1", "a.json")], chain, web)
    assert {d[2] for d in got.documents} == {"a.json", "b.json"} and len(got.absent) == 3 and not got.uncertain and len(web.asked) == 5
    down = schemas.prefetch([("v1", "b.json")], chain, Web({}, broken=["one"]))
    assert len(down.uncertain) == 1 and len(down.absent) == 1 and not down.documents
    skipped = Web({})
    schemas.prefetch([("v1", "c.json")], chain, skipped, known_absent={(s, "v1", "c.json") for _, s, _ in chain})
    assert not skipped.asked
    with pytest.raises(OSError):
        schemas.NoFetcher().get("x")
    with pytest.raises(ValueError):
        schemas.cache_path("/c", "s", "..", "f")
    assert schemas.cache_path("/c/", "s", "v1", "f.json") == "/c/s/v1/f.json"
    assert [schemas.layout_verdict(*x) for x in ((1, True), (None, False), (None, True), (0, True), (2, True))] == ["use", "prepare", "wipe", "wipe", "refuse"]
    assert schemas.version_chain("v1.30.0", 2) == ["v1.30.0", "v1.29.0", "v1.28.0"] and schemas.version_chain("v1.1.0", 5) == ["v1.1.0", "v1.0.0"] and schemas.version_chain("master") == ["master"]
    schemas.store(spark, got, str(tmp_path / "cache"), 2, "2020-01-01")
    assert spark.read.parquet(str(tmp_path / "cache/documents")).count() == 2 and spark.read.parquet(str(tmp_path / "cache/absent")).count() == 3
    d = tmp_path / "files/src1/v1/apps"
    d.mkdir(parents=True)
    (d / "widget_v1.json").write_text("{}")
    (d / "widget_v2.json").write_text("{}")
    (tmp_path / "files/src1/v1/widget-v1.json").write_text(json.dumps({"x-kubernetes-group-version-kind": [{"group": "apps", "kind": "Widget", "version": "v1"}, {"group": "", "kind": "Widget", "version": "v2"}]}))
    held = schemas.read_cache(spark, str(tmp_path / "files"), 3)
    assert {r["api_version"] for r in schemas.catalog_scan(held, "Widget", ["src1"]).collect()} == {"apps/v1", "apps/v2"} and schemas.catalog_scan(held, "Widget", ["none"]).count() == 0
    assert {r["api_version"] for r in schemas.kind_scan(held, "Widget", versions=["v1"]).collect()} == {"apps/v1", "v2"}
    assert {(r["file"], r["other"]) for r in schemas.other_versions(held).collect()} == {("apps/widget_v1.json", "v2"), ("apps/widget_v2.json", "v1")}
    assert schemas.online_probe(["apps/v1", "v1", "gone/v1"], "Widget", "https://c", Web({"https://c/apps/widget_v1.json": "{}"})) == ["apps/v1"]
    assert schemas.read_folder(spark, str(tmp_path / "files"), "own", 0).count() == 3


def test_reach_and_depth(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(80)] + [(5, 0)], "src int, dst int")
    root = spark.createDataFrame([(0,)], "node int")
    with pytest.raises(RuntimeError):
        graph.reach(e.where("src < 6"), root, max_levels=3)
    docs = spark.createDataFrame([(1, '{"a":{"b":{"c":[1]}}}')], "id int, j string")
    with pytest.raises(Exception, match="more than 2 levels"):
        shred.shred(docs, "id", F.parse_json("j"), 2).collect()
    assert {r["path"] for r in shred.shred(docs, "id", F.parse_json("j"), 4).collect()} == {"a", "a.b", "a.b.c", "a.b.c.*"}


def test_subsumption_of_empty_sets_and_hot_members(spark):
    rows = [(1, 1, []), (2, 1, [5]), (3, 2, []), (4, 2, []), (5, 3, [9, 1]), (6, 3, [9]), (7, 3, [9, 2]), (8, 3, [1, 9, 9])]
    got = contracts.drop_subsumed(spark.createDataFrame(rows, "i int, s int, m array<int>"), ["s"], "m", "i")
    assert {r["i"] for r in got.collect()} == {2, 3, 5, 7}


def test_charts_of_charts(spark):
    c = spark.createDataFrame([([],), (["a"],), (["a", "b"],)], "prefix array<string>")
    assert {(tuple(r["descendant"]), tuple(r["ancestor"]), r["up"]) for r in graph.ancestors(c).collect()} == {(("a",), (), 1), (("a", "b"), (), 2), (("a", "b"), ("a",), 1)}
    rows = spark.createDataFrame([("x", "global.z"), ("x", "own"), ("x", "global.n")], "chart string, path string")
    up = spark.createDataFrame([("x", "root")], "chart string, ancestor string")
    sources = spark.createDataFrame([("root", "global.z")], "chart string, path string")
    assert [(r["owner"], r["path"]) for r in contracts.project_globals(rows, sources, "chart", "path", up).collect()] == [("root", "global.z")]
    order = spark.createDataFrame([("cache", "collection", "v1"), ("chart_local", "catalog", "g/v1beta1"), ("cache", "collection", "v2")], "s string, o string, v string")
    assert [r["v"] for r in order.orderBy(catalog.candidate_order(F.col("s"), F.col("o"), F.col("v"))).collect()] == ["g/v1beta1", "v2", "v1"]
