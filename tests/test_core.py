import glob
import os

import pytest
from pyspark.sql import functions as F

from shalebed.functions import collections, paths, text, truth
from shalebed.functions.guards import Guard, overlay
from shalebed.operators import boolalg, compose, contracts, emit, lattice
from shalebed.plans.shapes import QUERIES, SQL
from shalebed.sources import documents

SF = "/root/testdata/sf0.001"


def test_paths_round_trip(spark):
    rows = [(["a", "b.c", "d\\e"],), ([""],), (["x"],)]
    df = spark.createDataFrame(rows, "s array<string>").select("s", paths.split_path(paths.join_path(F.col("s"))).alias("b"))
    got = {tuple(r["s"]): tuple(r["b"]) for r in df.collect()}
    assert got[("a", "b.c", "d\\e")] == ("a", "b.c", "d\\e") and got[("x",)] == ("x",)


@pytest.mark.parametrize("json,want,kind", [("null", False, "null"), ("false", False, "boolean"), ("true", True, "boolean"), ("0", False, "integer"), ("7", True, "integer"), ("1.5", True, "number"), ('""', False, "string"), ('"a"', True, "string"), ("[]", False, "array"), ("[0]", True, "array"), ("{}", False, "object"), ('{"a":null}', True, "object")])
def test_truth_table(spark, json, want, kind):
    r = spark.createDataFrame([(json,)], "j string").select(F.parse_json("j").alias("v")).select(truth.truthy_variant(F.col("v")).alias("t"), truth.kind_of(F.col("v")).alias("k"), truth.absent(F.col("v")).alias("a")).first()
    assert (r["t"], r["k"], r["a"]) == (want, kind, json == "null")


def test_boolean_algebra():
    a, b, c = map(boolalg.literal, "abc")
    assert boolalg.either(boolalg.both(a, b), boolalg.both(a, boolalg.literal("b", False))) == a
    assert boolalg.negate(boolalg.negate(boolalg.both(a, b))) == boolalg.both(a, b)
    assert boolalg.implies(boolalg.both(a, b), a) and not boolalg.implies(a, b)
    assert boolalg.evaluate(boolalg.either(a, c), {"a": False}) is None and boolalg.evaluate(a, {"a": True}) is True
    assert boolalg.both(a, boolalg.literal("a", False)) == boolalg.FALSE


def test_lattice():
    assert lattice.merge({"type": "string"}, {"type": "null"}) == {"type": ["null", "string"]}
    assert lattice.merge({"type": "string"}, {}) == {"type": "string"}
    assert lattice.intersect_enums([1, 2], [2, 3]) == [2] and lattice.intersect_enums([1], [2]) is None
    s = lattice.infer({"a": [1, 2.5], "b": None})
    assert s["properties"]["a"] == {"type": "array", "items": {"type": "number"}}
    assert lattice.descend({"properties": {"x": {"$ref": "#/$defs/y"}}, "$defs": {"y": {"items": {"type": "string"}}}}, ["x", "*"]) == {"type": "string"}
    assert lattice.apply_override({"a": {"b": 1}, "required": ["x"]}, {"a": {"c": 2}, "required": ["y"]}) == {"a": {"b": 1, "c": 2}, "required": ["x", "y"]}
    assert not lattice.allows_type({"type": "string"}, "null") and lattice.allows_type(lattice.add_null({"type": "string"}), "null")


def test_emit():
    part = {"type": "object", "properties": {"limits": {"type": "string"}, "requests": {"type": "string"}}, "description": "x" * 40}
    out = emit.intern({"properties": {k: part for k in "abcd"}})
    assert out["$defs"] and all("$ref" in v for v in out["properties"].values())
    assert emit.base62(0) == "0" and emit.base62(62) == "10"
    assert emit.metrics({"if": {}, "then": {}})["ifs"] == 1


def test_guard_schema():
    s = overlay([Guard("eq", "a.b", 1)], {"required": ["c"]})
    assert s["if"]["properties"]["a"]["properties"]["b"] == {"const": 1} and s["then"] == {"required": ["c"]}


def test_compose_and_subsume(spark):
    p = spark.createDataFrame([("a", "1"), ("b", None)], "k string, v string")
    c = spark.createDataFrame([("a", "2"), ("b", "3"), ("c", "4")], "k string, v string")
    assert {tuple(r) for r in compose.compose(p, c, ["k"], "v").collect()} == {("a", "1"), ("c", "4")}
    rows = spark.createDataFrame([(1, 1, [1]), (2, 1, [1, 2]), (3, 1, [1, 2]), (4, 2, [1])], "i int, s int, m array<int>")
    assert {r["i"] for r in contracts.drop_subsumed(rows, ["s"], "m", "i").collect()} == {2, 4}


def test_text(spark):
    r = spark.createDataFrame([("v1.2.3", "1h30m", 'a"b')], "v string, d string, q string").select(text.semver_compare(">=1.2.0, <2", F.col("v")).alias("s"), text.is_duration(F.col("d")).alias("d"), text.quote(F.col("q")).alias("q"), text.adler32sum(F.col("v")).alias("a")).first()
    assert r["s"] and r["d"] and r["q"] == '"a\\"b"' and r["a"] == __import__("zlib").adler32(b"v1.2.3")


def test_documents(spark, tmp_path):
    import io
    import tarfile

    (tmp_path / "values.yaml").write_text("# -- how many\nreplicas: 1\n---\nx: [1]\n")
    with tarfile.open(tmp_path / "a.tgz", "w:gz") as t:
        info = tarfile.TarInfo("c/Chart.yaml")
        info.size = 4
        t.addfile(info, io.BytesIO(b"a: 1"))
    files = documents.read_files(spark, str(tmp_path), "*.yaml")
    assert [r["json"] for r in documents.yaml_to_json(files).orderBy("number").collect()] == ['{"replicas": 1}', '{"x": [1]}']
    assert documents.value_comments(files).first()["description"] == "how many"
    assert documents.archive_entries(documents.read_files(spark, str(tmp_path), "*.tgz")).first()["entry"] == "c/Chart.yaml"


def rows_of(df):
    df = df[sorted(df.columns)]
    clean = lambda v: None if v is None or str(v) in ("nan", "<NA>", "NaT") else round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") else v
    return sorted(str([clean(v) for v in r]) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, name):
    import duckdb

    got = QUERIES[name](spark, SF).toPandas()
    if name not in SQL:
        assert len(got)
        return
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    want = con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_stream_profile(spark, tmp_path):
    from shalebed.streaming.profile import profile_batches, total

    src = tmp_path / "in"
    spark.createDataFrame([(1, '{"a": 1}'), (2, '{"a": "x", "b": []}')], "id int, j string").write.json(str(src))
    q = profile_batches(spark.readStream.schema("id int, j string").json(str(src)), "id", "j", str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    got = {r["path"]: (r["n"], r["kinds"]) for r in total(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert got == {"a": (2, "integer,string"), "b": (1, "array")}


SCALARS = ["Brand#7", "a b", "a:b", "http://h/p?q=1", "", " a", "a ", "a: b", "a #b", "a#b", "a - b", "- a", "yes", "Y", "NULL", "off", "~", "12", "1.5", "1e3", "2020-01-01", "0x1f", "1:30", "=", "<<", "{a}", "it's", 'a"b', "a\nb", "a\tb", "\x85", "é", "😀", "_x", "/a", "x" * 3000, 0, -7, 10**18, 10**30, 1.5, True, False, None, [], {}, [1], {"a": 1}]


def test_flat_yaml_is_what_pyyaml_writes_and_reads():
    import itertools
    import json

    import pandas as pd
    import yaml

    written = lambda v: yaml.safe_dump(v, default_flow_style=False, allow_unicode=True, sort_keys=True, width=2**31).removesuffix("\n...\n").removesuffix("\n")
    documents_ = [{k: x, "m": y} for k in ("a", "z/y-x.w", "no", "N", "1", "a b", "", "k" * 100, "k" * 101, "é") for x, y in itertools.product(SCALARS, ["t", 3, "on"])] + [*SCALARS]
    texts = [json.dumps(d) for d in documents_]
    assert list(collections._to_yaml.func(pd.Series(texts))) == [written(d) for d in documents_]

    def read(t):
        try:
            return json.dumps(yaml.safe_load(t), sort_keys=True, default=str)
        except yaml.YAMLError:
            return None

    raw = [f"{k}: {x}{end}" for k in ("a", "no", "k" * 101, "- a", " a", "1") for x in [*map(str, SCALARS), "007", "-0", "1_0", "b\nc", "b\n  c", "b\nc: d", "b\na: 7", "true\nc: null", "No", "b\n- c", "b\n# c: d", "b\n\nc: d", "b\n---\nc: d"] for end in ("", "\n")]
    wants = {}
    for t in [written(d) for d in documents_] + raw + ["", "\n", "a", "a:", "a:b"]:
        try:
            wants[t] = read(t)
        except TypeError:  # keys of several kinds have no order
            assert collections._flat_mapping(t) is None
    assert len(wants) > 1000 and list(collections._from_yaml.func(pd.Series(list(wants)))) == list(wants.values())


def test_flat_yaml_needs_no_pyyaml(monkeypatch):
    import pandas as pd
    import yaml

    def slow(*_, **__):
        raise AssertionError("as slow as PyYAML")

    monkeypatch.setattr(yaml, "safe_dump", slow)
    monkeypatch.setattr(yaml, "safe_load", slow)
    assert list(collections._to_yaml.func(pd.Series(['{"size":-3,"brand":"Brand#7","on_":true,"x":null}', None]))) == ["brand: Brand#7\non_: true\nsize: -3\nx: null", None]
    assert list(collections._from_yaml.func(pd.Series(["size: -3\nbrand: Brand#7\non_: true\nx: null\n", None]))) == ['{"brand": "Brand#7", "on_": true, "size": -3, "x": null}', None]


def test_serial_functions_share_the_rows_of_one_file(spark):
    assert spark.read.parquet(f"{SF}/part.parquet").rdd.getNumPartitions() == 1
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert QUERIES["serial_functions"](spark, SF).rdd.getNumPartitions() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
