"""Templates to rows: what is rendered where, under which condition; and a chart from files to a schema."""

import json

import pytest

from shalebed.functions.guards import Guard
from shalebed.operators import boolalg as B
from shalebed.template import interpret as I
from shalebed.template import parse as P


def rows(source, helpers=""):
    found = I.analyse(source, P.definitions(P.parse(helpers)))
    return [(u["source_path"], ".".join(u["sink_path"]), u["kind"], I.shown(I.dnf_from_text(u["condition"]))) for u in found["uses"]], found


def test_branches_carry_the_negation_of_those_before():
    got, found = rows("m:\n  {{- if .Values.a }}\n  x: {{ .Values.p }}\n  {{- else if .Values.b }}\n  x: {{ .Values.q }}\n  {{- else }}\n  y: {{ .Values.r }}\n  {{- end }}\n  z: {{ .Values.s }}\n")
    assert got == [("p", "m.x", "scalar", "truthy(a)"), ("q", "m.x", "scalar", "!truthy(a) & truthy(b)"), ("r", "m.y", "scalar", "!truthy(a) & !truthy(b)"), ("s", "m.z", "scalar", "always")]
    assert [(r["source_path"], r["how"]) for r in found["reads"]] == [("a", "if"), ("b", "if")]


def test_range_splices_members_and_their_container():
    got, _ = rows("spec:\n  args:\n    {{- range .Values.args }}\n    - {{ . | quote }}\n    {{- end }}\n  env:\n    {{- range $k, $v := .Values.env }}\n    {{ $k }}: {{ $v }}\n    {{- end }}\n")
    assert got == [
        ("args", "spec.args", "scalar", "range(args)"), ("args.*", "spec.args.[*]", "scalar", "range(args)"), ("env", "spec.env", "fragment", "range(env)"),
        ("env", "spec.env", "partial_scalar", "range(env)"), ("env.*", "spec.env.{*}", "scalar", "range(env)"),
    ]


def test_helpers_are_spliced_where_they_are_included():
    helpers = '{{ define "name" }}{{ .Values.full | default (printf "%s-x" .Values.name) | trunc 63 }}{{ end }}{{ define "labels" }}\napp: {{ .Values.name }}\n{{- with .Values.extra }}\n{{ toYaml . }}\n{{- end }}\n{{ end }}'
    got, found = rows('metadata:\n  name: {{ include "name" . }}\n  labels:\n    {{- include "labels" . | nindent 4 }}\n', helpers)
    assert got == [("full", "metadata.name", "scalar", "truthy(full)"), ("name", "metadata.name", "partial_scalar", "!truthy(full)"), ("name", "metadata.labels.app", "scalar", "always"), ("extra", "metadata.labels", "yaml_serialized", "with(extra)")]
    assert ("full", "string") in {(h["source_path"], h["type"]) for h in found["hints"]}


def test_resources_of_documents_and_kind_switches():
    _, found = rows("apiVersion: apps/v1\nkind: {{ if .Values.set }}StatefulSet{{ else }}Deployment{{ end }}\nspec:\n  a: {{ .Values.a }}\n  {{- if .Values.set }}\n  b: {{ .Values.b }}\n  {{- end }}\n---\napiVersion: v1\nkind: Secret\ndata:\n  x: {{ .Values.x | b64enc }}\n")
    by = {u["source_path"]: u for u in found["uses"]}
    assert by["a"]["resource_kind"] is None and by["a"]["resource_kind_candidates"] == ["StatefulSet", "Deployment"]
    assert by["b"]["resource_kind"] == "StatefulSet" and (by["x"]["api_version"], by["x"]["resource_kind"]) == ("v1", "Secret")


def test_variables_join_after_branches():
    got, _ = rows('{{- $v := .Values.a }}{{- if .Values.c }}{{- $v = .Values.b }}{{- end }}\nx: {{ $v }}\ny: {{ ternary .Values.p "q" (eq .Values.m "on") }}\nz: {{ or .Values.f .Values.g }}\nw: {{ coalesce .Values.h "lit" }}\n')
    assert sorted(got) == sorted([("a", "x", "scalar", "!truthy(c)"), ("b", "x", "scalar", "truthy(c)"), ("p", "y", "scalar", 'eq(m,"on")'), ("f", "z", "scalar", "truthy(f)"), ("g", "z", "scalar", "!truthy(f)"), ("h", "w", "scalar", "truthy(h)")])


def test_text_around_and_block_scalars_are_partial():
    got, _ = rows('image: "{{ .Values.r }}:{{ .Values.t }}"\nfile: |\n  hello {{ .Values.n }}\n  bye\nafter: {{ .Values.x }}\nlist:\n  - name: a\n    v: {{ .Values.y }}\n  - {{ .Values.z }}\n')
    assert got == [("r", "image", "partial_scalar", "always"), ("t", "image", "partial_scalar", "always"), ("n", "file", "partial_scalar", "always"), ("x", "after", "scalar", "always"), ("y", "list.[*].v", "scalar", "always"), ("z", "list.[*]", "scalar", "always")]


def test_aborts_and_conditions():
    _, found = rows('{{ if and .Values.a (not (hasKey .Values.m "k")) }}{{ fail "no" }}{{ end }}a: {{ required "need" .Values.n }}\n{{ if gt (int .Values.i) 3 }}b: 1{{ end }}{{ if regexMatch "^x" .Values.s }}c: 1{{ end }}{{ if kindIs "map" .Values.o }}d: 1{{ end }}{{ if has "q" .Values.l }}e: 1{{ end }}')
    assert [(a["message"], I.shown(I.dnf_from_text(a["condition"]))) for a in found["aborts"]] == [("no", '!has_key(m,"k") & truthy(a)'), ("need", 'absent(n) | eq(n,"")')]
    assert {r["source_path"] for r in found["reads"]} == {"a", "m", "i", "s", "o", "l"}


def test_merged_layers_and_literal_maps():
    got, _ = rows('{{- $d := dict "a" .Values.x "b" (dict "c" .Values.y) }}\nm: {{ $d.b.c }}\nn: {{ get $d "a" }}\no:\n  {{- toYaml (merge .Values.p .Values.q) | nindent 2 }}\nr: {{ (merge .Values.p .Values.q).k }}\ns: {{ dig "u" "v" "dflt" .Values.t }}\n')
    assert ("y", "m", "scalar", "always") in got and ("x", "n", "scalar", "always") in got
    assert {("p", "o"), ("q", "o")} <= {(a, b) for a, b, _, _ in got}
    assert ("p.k", "r", "scalar", "truthy(p.k)") in got and ("q.k", "r", "scalar", "!truthy(p.k)") in got
    assert ("t.u.v", "s", "scalar", 'has_key(t.u,"v")') in got


def test_literal_ranges_unroll_and_unknowns_are_not_exact():
    got, found = rows('{{ range list "a" "b" }}\n{{ . }}: {{ index $.Values.m . }}\n{{ end }}{{ if lookup "v1" "Secret" "ns" .Values.n }}\nz: {{ .Values.z }}\n{{ end }}')
    assert {("m.a", "scalar"), ("m.b", "scalar")} <= {(a, k) for a, _, k, _ in got}
    assert not [u for u in found["uses"] if u["source_path"] == "z"][0]["exact"]


def test_parse_errors():
    for bad in ("{{ if .a }}", "{{ end }}", "{{ .a | }}", "{{ foo", "{{ if }}{{ end }}"):
        with pytest.raises(P.ParseError):
            P.parse(bad)


def test_include_closure():
    bodies = P.definitions(P.parse('{{ define "a" }}{{ include "b" . }}{{ if .x }}{{ include "c" . }}{{ end }}{{ end }}{{ define "b" }}{{ include "a" . }}{{ end }}{{ define "c" }}{{ end }}'))
    assert P.include_closure({"a"}, bodies) == {"a", "b"} and P.include_closure({"a"}, bodies, unconditional=False) == {"a", "b", "c"}


def test_dispatch_and_truth():
    p, q = B.literal("p"), B.literal("q")
    d = B.Dispatch(((p, "v1.2.0"), (B.negate(p), "")))
    assert d.truthy().yes == p and d.truthy().no == B.negate(p) and d.meets(">=1.0").yes == p and d.equals("").no == p
    assert d.default(B.Dispatch.of("z")).literals() == ["v1.2.0", "z"] and d.trimmed(prefix="v").arms[0][1] == "1.2.0" and d.split_length(".").arms[0][1] == 3
    assert d.ternary(B.Dispatch.of("n"), B.Truth.exact(q)).complete and not d.ternary(B.Dispatch.of("n"), B.Truth(q, B.FALSE)).complete
    partly = B.Dispatch(((p, "x"), (B.negate(p), ...)))
    assert partly.equals("x").yes == p and partly.equals("x").no == B.FALSE and not partly.truthy().complete and partly.literals() is None
    assert (~B.Truth(p, q)) == B.Truth(q, p) and d.printf_empty("%s").yes == B.negate(p) and d.printf_empty("a%s").no == B.TRUE


CHART = {
    "Chart.yaml": "name: app\nversion: 1.0.0\ndependencies:\n  - name: db\n    version: 1\n    condition: db.enabled, dbs.on\n    tags: [data]\n  - name: db\n    alias: db2\n    version: 1\n",
    "values.yaml": "# -- How many\n# there are\nreplicas: 1\nimage:\n  # -- Where from\n  repository: nginx\n  tag: ''\nresources: {}\nenabled: false\nextra: null\ndb:\n  size: 5\n",
    "templates/_helpers.tpl": '{{ define "name" }}{{ .Values.nameOverride | default "app" }}{{ end }}',
    "templates/d.yaml": 'apiVersion: apps/v1\nkind: Deployment\nmetadata:\n  name: {{ include "name" . }}\nspec:\n  replicas: {{ .Values.replicas }}\n  image: "{{ .Values.image.repository }}:{{ .Values.image.tag }}"\n  {{- with .Values.resources }}\n  resources:\n    {{- toYaml . | nindent 4 }}\n  {{- end }}\n  {{- if .Values.enabled }}\n  secret: {{ required "no secret" .Values.secret }}\n  {{- end }}\n',
    "templates/NOTES.txt": "{{ .Values.note }}",
    "templates/tests/t.yaml": "a: {{ .Values.onlyTest }}\n",
    "crds/c.yaml": "kind: CustomResourceDefinition\nspec:\n  group: g.example\n  names: {kind: Thing}\n  versions:\n    - name: v1\n      schema: {openAPIV3Schema: {type: object}}\n",
    "files/x.txt": "plain",
    "charts/db/Chart.yaml": "name: db\ntype: library\n",
    "charts/db/values.yaml": "size: 1\nuser: root\n",
    "charts/db/templates/s.yaml": "apiVersion: v1\nkind: Service\nspec:\n  size: {{ .Values.size | int }}\n  g: {{ .Values.global.zone }}\n",
}


@pytest.fixture(scope="module")
def chart(tmp_path_factory):
    d = tmp_path_factory.mktemp("chart")
    for name, text in CHART.items():
        (d / name).parent.mkdir(parents=True, exist_ok=True)
        (d / name).write_text(text)
    return str(d)


def test_chart_to_schema(spark, chart, tmp_path):
    from shalebed.session import Session
    from shalebed.sources import charts as C

    schema = {"type": "object", "properties": {"spec": {"type": "object", "properties": {"replicas": {"type": "integer"}, "secret": {"type": "string"}, "resources": {"$ref": "#/definitions/r"}}, "required": ["secret"]}}, "definitions": {"r": {"type": "object", "properties": {"limits": {"type": "object"}}}}}
    s = Session(spark, chart, spark.createDataFrame([("apps/v1", "Deployment", json.dumps(schema))], "api_version string, kind string, schema string"))
    found = {tuple(r["prefix"]): r for r in s.charts.collect()}
    assert set(found) == {(), ("db",), ("db2",)} and found["db",]["library"] and found["db",]["activation"][0]["conditions"] == ["db.enabled", "dbs.on"] and found["db",]["activation"][0]["tags"] == ["data"]
    assert [r["path"] for r in C.files_with_role(s.files, "manifest").collect()] == ["charts/db/templates/s.yaml", "templates/d.yaml"]
    assert {r["path"] for r in C.files_with_role(s.files, "files_get").collect()} == {"files/x.txt"} and {r["path"] for r in C.files_with_role(s.files, "crd").collect()} == {"crds/c.yaml"}
    assert (C.static_crds(s.files).first()["group"], C.static_crds(s.files).first()["kind"]) == ("g.example", "Thing")
    paths = {r["source_path"] for r in s.contract.where("row = 'use'").select("source_path").collect()}
    assert paths == {"nameOverride", "replicas", "image.repository", "image.tag", "resources", "secret", "note", "db.size", "db2.size", "global.zone"}
    assert s.values["db"] == {"size": 5, "user": "root"} and s.values["db2"] == {"size": 1, "user": "root"}
    assert [r["source_path"] for r in s.explain("image").where("row = 'use'").collect()] == ["image.repository", "image.tag"]
    assert {(r["type"], r["key"]) for r in s.diagnostics().collect()} == {("missing_schema", "v1/Service")}
    out = s.generate(required=True)
    p = out["properties"]
    assert p["replicas"]["description"] == "How many there are" and "integer" in str(p["replicas"]) and p["image"]["properties"]["repository"]["description"] == "Where from"
    assert p["db"]["properties"]["user"] == {"type": "string"}
    from shalebed.operators.schema_tree import valid

    assert valid(out, s.values) and not valid(out, s.values | {"replicas": "many"}) and not valid(out, s.values | {"enabled": True}) and valid(out, s.values | {"enabled": True, "secret": "x"})
    assert not valid(out, s.values | {"resources": {"limits": 3}})
    assert [(x["path"], x["target"]) for x in s.required_sinks()] == [("secret", "value")]
    asked = s._demand({"type": "object", "properties": {"m": {}}}, {"path": "m", "target": "members_at", "field": ["port"], "condition": [['["range","m",null]']]})
    assert valid(asked, {"m": {"a": {"port": 1}}}) and not valid(asked, {"m": {"a": {}}}) and not valid(asked, {"m": [{"port": None}]}) and valid(asked, {"m": []})


def test_charts_in_archives(spark, chart, tmp_path):
    import tarfile

    from shalebed.sources import charts as C

    with tarfile.open(tmp_path / "app.tgz", "w:gz") as t:
        t.add(chart, "app")
    got = {r["path"] for r in C.open_chart(spark, str(tmp_path / "app.tgz")).collect()}
    assert got == set(CHART)


def test_guards_of_conditions():
    c = B.both(I.test("truthy", ("a",)), B.negate(I.test("eq", ("b",), 1)))
    assert I.guards_of(c) == [[Guard("not_guard", arg=Guard("eq", "b", 1)), Guard("truthy", "a")]] and I.guards_of(I.unknown("x")) is None


def test_sinks_and_dumps(spark, tmp_path):
    from shalebed.sources import sinks

    measures = sinks.write_schema(spark, {"type": "object", "if": {}, "then": {}}, str(tmp_path / "s"), {"fail": True})
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "s")).collect())
    assert measures["ifs"] == 1 and '"x-policy"' in text
    rows = spark.createDataFrame([("b.c", "x"), ("b", "y"), ("bc", "z")], "source_path string, kind string")
    sinks.write_contract(rows, str(tmp_path / "c"))
    assert sinks.read_contract(spark, str(tmp_path / "c")).columns == ["source_path", "kind"]
    d = spark.createDataFrame([("unreadable", "t.yaml", "bad\n thing")], "type string, key string, message string")
    sinks.write_diagnostic_text(d, str(tmp_path / "d"))
    assert spark.read.text(str(tmp_path / "d")).first()[0] == "error[unreadable] t.yaml: bad thing"
    moved = sinks.rewrite_paths(rows, spark.createDataFrame([("b", "q.r"), ("b.c", "s")], "old string, new string"))
    assert {r["source_path"] for r in moved.collect()} == {"s", "q.r", "bc"}
    nodes = P.parse('{{ define "h" }}x{{ end }}{{ $a := .Values.b | default 1 }}{{ range $k, $v := $a.c }}{{ (index . 0).d }}{{ else }}e{{ end }}')
    assert sinks.dump_nodes(nodes) == "(define 'h'\n  (text 'x'))\n(declare $a (default 1 .Values.b))\n(range $k $v $a.c\n  (output ((index . 0)).d))\n(else\n  (text 'e'))"
    assert sinks.dump_uses(I.analyse("a: {{ .Values.x }}")["uses"]) == "a scalar <- x when always"


def test_functions_that_join(spark):
    from pyspark.sql import functions as F

    from shalebed.functions import collections as C

    asked = spark.createDataFrame([("v1", "a.txt"), ("x/v1", "b.txt")], "k string, f string")
    apis = spark.createDataFrame([("v1",)], "api string")
    assert {r["k"]: r["present"] for r in C.capability_has(apis, "api", asked, "k").collect()} == {"v1": True, "x/v1": False}
    assert {r["present"] for r in C.capability_has(apis.limit(0), "api", asked, "k").collect()} == {None}
    files = spark.createDataFrame([("a.txt", "hello")], "path string, text string")
    assert {r["f"]: r["file_text"] for r in C.files_get(files, "path", "text", asked, "f").collect()} == {"a.txt": "hello", "b.txt": ""}
    assert [r["v"] for r in C.lookup_objects(spark.createDataFrame([("v1", 5)], "k string, v int"), asked, ["k"], "v").orderBy("k").collect()] == [5, None]
    one = spark.createDataFrame([("", None)], "s string, n string")
    assert one.select(C.violation(F.col("s") == "", "empty").alias("v")).first()["v"] == "empty"
    for column in (C.required(F.col("s"), "string", "need s"), C.required(F.col("n"), "string", "need n"), C.fail(F.lit("stop"))):
        with pytest.raises(Exception, match="need|stop"):
            one.select(column).collect()
    with pytest.raises(Exception, match="no object"):
        one.select(C.dig(F.parse_json(F.lit('{"a":1}')), ["a", "b"], F.lit("d"))).collect()


def test_knobs():
    from shalebed.sources.charts import resolve_config

    presets, built_in = {"default": {"a": 1}, "lean": {"a": 2, "b": 2}}, {"a": 0, "b": 0, "c": 0}
    assert resolve_config({}, {"b": 5}, presets, built_in) == {"a": 1, "b": 5, "c": 0, "profile": "default"}
    assert resolve_config({"profile": "lean", "c": 9}, {"b": 5, "profile": "default"}, presets, built_in) == {"a": 2, "b": 2, "c": 9, "profile": "lean"}
    assert resolve_config({}, {"profile": "lean"}, presets, built_in)["a"] == 2
    with pytest.raises(ValueError):
        resolve_config({"profile": "none"}, None, presets, built_in)
