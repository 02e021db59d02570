"""Queries over values of every kind: guards, requirements, functions, lookups and templates, each with the same in DuckDB's SQL.

Values come from a list of JSON texts, dealt to the rows of `part` by p_size, so that every test meets rows that hold and
rows that don't.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from shalebed.functions import collections as C
from shalebed.functions import paths as P
from shalebed.functions import semver, truth
from shalebed.functions import text as T
from shalebed.functions.guards import Guard
from shalebed.functions.requirements import Requirement, Target
from shalebed.operators import catalog, compose, contracts, graph, lattice, refs, shred
from shalebed.plans.catalogue import QUERIES, SQL, query, t

# One JSON text for each kind and edge that a test tells apart.
SHAPES = (
    "{}", '{"a":null}', '{"a":false}', '{"a":true}', '{"a":0}', '{"a":7}', '{"a":-3}', '{"a":0.0}', '{"a":1.5}', '{"a":""}', '{"a":"prod"}', '{"a":"x: y # z"}', '{"a":[]}', '{"a":[1,"prod"]}',
    '{"a":[{"m":"on"},{"m":""}]}', '{"a":{}}', '{"a":{"k":null}}', '{"a":{"k":1,"key2":"on"}}', '{"a":{"p1":{"m":"on","n":5},"q":{"m":"off"}}}', '{"a":"a-b-c"}', '{"a":["it\'s","ok"]}',
    '{"a":[{"m":"on","n":null},{"m":"on","n":2}],"b":1}', '{"a":"{{ .x }}: y"}', '{"a":{"k":{"m":"on"}},"b":"t"}', '{"a":12345678901}',
)
_LIST = "[" + ", ".join("'" + s.replace("'", "''") + "'" for s in SHAPES) + "]"
_DOC = f"""d AS (SELECT p_partkey, p_brand, p_size, {_LIST}[p_size % {len(SHAPES)} + 1] AS j FROM part),
v AS (SELECT *, json_type(j, '$.a') AS ty, json_extract(j, '$.a') AS a, json_extract_string(j, '$.a') AS s FROM d),
k AS (SELECT *, ty IN ('UBIGINT', 'BIGINT') AS is_int, ty IN ('UBIGINT', 'BIGINT', 'DOUBLE') AS is_num, ty = 'VARCHAR' AS is_str, ty = 'ARRAY' AS is_arr, ty = 'OBJECT' AS is_obj, ty = 'BOOLEAN' AS is_bool, ty IS NULL OR ty = 'NULL' AS gone,
  CASE WHEN ty = 'ARRAY' THEN CAST(a AS JSON[]) ELSE [] END AS items, CASE WHEN ty = 'OBJECT' THEN json_keys(j, '$.a') ELSE [] END AS keys,
  CASE WHEN ty = 'OBJECT' THEN list_transform(json_keys(j, '$.a'), lambda x: json_extract(j, '$.a."' || x || '"')) WHEN ty = 'ARRAY' THEN CAST(a AS JSON[]) ELSE [] END AS members,
  CASE ty WHEN 'BOOLEAN' THEN s = 'true' WHEN 'UBIGINT' THEN TRY_CAST(s AS DOUBLE) <> 0 WHEN 'BIGINT' THEN TRY_CAST(s AS DOUBLE) <> 0 WHEN 'DOUBLE' THEN TRY_CAST(s AS DOUBLE) <> 0 WHEN 'VARCHAR' THEN s <> '' WHEN 'ARRAY' THEN json_array_length(j, '$.a') > 0
    WHEN 'OBJECT' THEN len(json_keys(j, '$.a')) > 0 ELSE false END AS truthy FROM v)"""


def truthy_sql(x: str) -> str:
    """Whether a JSON value of the oracle is truthy."""
    return f"coalesce(CASE json_type({x}) WHEN 'BOOLEAN' THEN {x} = 'true' WHEN 'VARCHAR' THEN {x} <> '\"\"' WHEN 'ARRAY' THEN {x} <> '[]' WHEN 'OBJECT' THEN {x} <> '{{}}' WHEN 'NULL' THEN false ELSE TRY_CAST({x} AS DOUBLE) <> 0 END, false)"


def shaped(spark, d):
    texts = F.array(*[F.lit(s) for s in SHAPES])
    j = F.get(texts, F.col("p_size") % len(SHAPES))
    return t(spark, d, "part").select("p_partkey", "p_brand", "p_size", j.alias("j"), F.parse_json(j).alias("doc"))


def wide(name: str, tests: dict[str, tuple], source=shaped):
    """A query of one Boolean column for each test: name -> (Column of the document, SQL)."""

    def run(spark, d):
        return source(spark, d).select("p_partkey", *[test(F.col("doc")).alias(n) for n, (test, _) in tests.items()])

    run.__name__ = name
    query(f"WITH {_DOC} SELECT p_partkey, " + ", ".join(f"coalesce({sql}, false) AS {n}" for n, (_, sql) in tests.items()) + " FROM k")(run)


def g(*a):
    return Guard(*a).on


def r(kind, arg=None):
    return lambda doc: Requirement(kind, arg).holds(truth.get(doc, "a"))


_M_ON = "list_contains(list_transform(members, lambda x: coalesce(json_extract_string(x, '$.m') = 'on', false)), true)"
_M_TRUTHY = "list_contains(list_transform(members, lambda x: coalesce(json_extract_string(x, '$.m') <> '', false)), true)"  # in these texts `m` is text where it is there

wide("guards_of_values", {
    "truthy": (g("truthy", "a"), "truthy"),
    "falsy": (g("not", "a"), "NOT truthy"),
    "with_it": (g("with", "a"), "truthy"),
    "ranged": (g("range", "a"), "CASE WHEN is_arr OR is_obj THEN truthy WHEN is_int THEN TRY_CAST(s AS BIGINT) > 0 ELSE false END"),
    "defaulted": (g("default", "a"), "true"),
    "eq_text": (g("eq", "a", "prod"), "is_str AND s = 'prod'"),
    "eq_number": (g("eq", "a", 0), "is_num AND TRY_CAST(s AS DOUBLE) = 0"),
    "eq_true": (g("eq", "a", True), "is_bool AND s = 'true'"),
    "eq_null": (g("eq", "a", None), "ty = 'NULL'"),
    "ne_text": (g("ne", "a", "prod"), "NOT coalesce(is_str AND s = 'prod', false)"),
    "absent": (g("absent", "a"), "gone"),
    "matches": (g("matches", "a", "^p.*d$"), "is_str AND regexp_matches(s, '^p.*d$')"),
    "not_matches": (g("not_matches", "a", "^p.*d$"), "is_str AND NOT regexp_matches(s, '^p.*d$')"),
    "key_prefix": (g("range_key_prefix", "a", "key"), "list_contains(list_transform(keys, lambda x: starts_with(x, 'key')), true)"),
    "key_equals": (g("range_key_equals", "a", "k"), "list_contains(keys, 'k')"),
    "key_matches": (g("range_key_matches", "a", "[0-9]$"), "list_contains(list_transform(keys, lambda x: regexp_matches(x, '[0-9]$')), true)"),
    "or_paths": (g("or", "a", ("b",)), f"truthy OR {truthy_sql("json_extract(j, '$.b')")}"),
    "any_of": (g("any_of", "", ((Guard("truthy", "a"), Guard("type_is", "a", "string")), (Guard("eq", "b", 1),))), "(truthy AND is_str) OR coalesce(json_extract_string(j, '$.b') = '1', false)"),
    "all_of": (g("all_of", "", (Guard("truthy", "a"), Guard("has_key", "a", "k"))), "truthy AND list_contains(keys, 'k')"),
    "not_guard": (g("not_guard", "", Guard("eq", "a", "prod")), "NOT coalesce(is_str AND s = 'prod', false)"),
    "is_string": (g("type_is", "a", "string"), "is_str"),
    "is_integer": (g("type_is", "a", "integer"), "is_int"),
    "is_number": (g("type_is", "a", "number"), "is_num"),
    "is_null": (g("type_is", "a", "null"), "ty = 'NULL'"),
    "not_array": (g("not_type_is", "a", "array"), "NOT coalesce(is_arr, false)"),
    "int_gt": (g("int_gt", "a", 3), "is_int AND TRY_CAST(s AS BIGINT) > 3"),
    "int_lt": (g("int_lt", "a", 3), "is_int AND TRY_CAST(s AS BIGINT) < 3"),
    "at_most_one": (g("at_most_one", "a"), "(is_arr AND len(items) <= 1) OR (is_obj AND len(keys) <= 1)"),
    "min_members": (g("min_members", "a", 2), "is_obj AND len(keys) >= 2"),
    "has_key": (g("has_key", "a", "k"), "list_contains(keys, 'k')"),
    "not_has_key": (g("not_has_key", "a", "k"), "NOT list_contains(keys, 'k')"),
    "contains": (g("contains", "a", "prod"), "list_contains(items, '\"prod\"')"),
    "contains_member": (g("contains_member", "a", ("m", "on")), _M_ON),
    "contains_truthy": (g("contains_truthy", "a", "m"), _M_TRUTHY),
})

_TEXTS = "list_concat(CASE WHEN is_str THEN [s] ELSE [] END, keys, list_transform(list_filter(items, lambda x: json_type(x) = 'VARCHAR'), lambda x: json_extract_string(x, '$')))"
wide("requirements_of_values", {
    "schema_type": (r("schema_type", "string"), "gone OR is_str"),
    "schema_type_even_null": (r("schema_type_even_null", "object"), "ty IS NULL OR is_obj"),
    "truthy_implies_type": (r("truthy_implies_type", "string"), "NOT truthy OR is_str"),
    "truthy": (r("truthy"), "truthy"),
    "falsy": (r("falsy"), "NOT truthy"),
    "field_falsy": (r("field_falsy", ("k",)), "NOT " + truthy_sql("json_extract(a, '$.k')")),
    "field_equals": (r("field_equals", (("k",), 1)), "is_obj AND json_extract_string(a, '$.k') = '1'"),
    "field_present": (r("field_present", ("k",)), "is_obj AND json_type(a, '$.k') <> 'NULL'"),
    "field_truthy": (r("field_truthy", ("k",)), truthy_sql("json_extract(a, '$.k')")),
    "any_of": (r("any_of", ((Requirement("schema_type_even_null", "string"), Requirement("truthy")), (Requirement("has_member", "k"),))), "(ty IS NULL OR is_str) AND truthy OR list_contains(keys, 'k')"),
    "not_equals": (r("not_equals", "prod"), "NOT coalesce(is_str AND s = 'prod', false)"),
    "field_not_equals": (r("field_not_equals", (("k",), 1)), "NOT coalesce(is_obj AND json_extract_string(a, '$.k') = '1', false)"),
    "comparable_kind": (r("comparable_kind", "number"), "gone OR is_num"),
    "not_schema_type": (r("not_schema_type", "array"), "NOT coalesce(is_arr, false)"),
    "has_member": (r("has_member", "k"), "list_contains(keys, 'k')"),
    "has_member_even_defaulted": (r("has_member_even_defaulted", "key2"), "list_contains(keys, 'key2')"),
    "matches": (r("matches", ("^p", False)), "is_str AND regexp_matches(s, '^p')"),
    "matches_templated": (r("matches", ("^p", True)), "is_str AND (regexp_matches(s, '^p') OR contains(s, '{{'))"),
    "not_matches": (r("not_matches", ("^p", False)), "is_str AND NOT regexp_matches(s, '^p')"),
    "length": (r("length", (1, 4)), "is_str AND length(s) BETWEEN 1 AND 4"),
    "member_host": (r("member_host", ("string",)), "is_obj OR is_str"),
    "iterable": (r("iterable", False), "gone OR is_arr OR is_obj"),
    "iterable_counts": (r("iterable", True), "gone OR is_arr OR is_obj OR is_int"),
    "indexable": (r("indexable", 1), "CASE WHEN is_arr THEN len(items) > 1 ELSE is_str END"),
    "split_segments": (r("split_segments", ("-", 3, False)), "is_str AND len(string_split(s, '-')) >= 3"),
    "split_segments_any": (r("split_segments", ("-", 3, True)), "NOT coalesce(is_str, false) OR len(string_split(s, '-')) >= 3"),
    "quoted_single": (r("quoted_safe", ("single", False)), f"NOT list_contains(list_transform({_TEXTS}, lambda x: contains(x, '''')), true)"),
    "quoted_double": (r("quoted_safe", ("double", False)), "true"),
    "printf_string": (r("printf_string"), "is_str OR is_obj"),
    "plain_safe": (r("plain_safe", (True, False)), "NOT coalesce(is_str, false) OR NOT (regexp_matches(s, ':(\\s|$)|\\s#') OR starts_with(s, '{'))"),
    "plain_safe_templated": (r("plain_safe", (True, True)), "NOT coalesce(is_str, false) OR contains(s, '{{') OR NOT regexp_matches(s, ':(\\s|$)|\\s#')"),
})


def bound(target, *requirements):
    return lambda doc: target.holds(truth.get(doc, "a"), list(requirements))


_STR, _PRESENT = Requirement("schema_type_even_null", "string"), Requirement("truthy")
_NOT_STR = "lambda x: json_type(x) <> 'VARCHAR'"
_EMPTY = "gone"
wide("targets_of_requirements", {
    "value": (bound(Target(), _STR), "ty IS NULL OR is_str"),
    "members": (bound(Target("members"), _STR), f"{_EMPTY} OR (is_arr OR is_obj) AND len(list_filter(members, {_NOT_STR})) = 0"),
    "members_or_count": (bound(Target("members", None, True), _STR), f"{_EMPTY} OR is_int OR (is_arr OR is_obj) AND len(list_filter(members, {_NOT_STR})) = 0"),
    "members_except": (bound(Target("members_except", ("k",)), _STR), f"{_EMPTY} OR is_arr AND len(list_filter(items, {_NOT_STR})) = 0 OR is_obj AND len(list_filter(keys, lambda x: x <> 'k' AND json_type(j, '$.a.' || x) <> 'VARCHAR')) = 0"),
    "members_prefix": (bound(Target("members_prefix", "key"), _STR), f"{_EMPTY} OR is_arr AND len(items) = 0 OR is_obj AND len(list_filter(keys, lambda x: starts_with(x, 'key') AND json_type(j, '$.a.' || x) <> 'VARCHAR')) = 0"),
    "members_where": (bound(Target("members_where", (("m",), "on", ("n",))), _PRESENT), f"{_EMPTY} OR (is_arr OR is_obj) AND len(list_filter(members, lambda x: coalesce(json_extract_string(x, '$.m') = 'on', false) AND coalesce(TRY_CAST(json_extract_string(x, '$.n') AS DOUBLE), 0) = 0)) = 0"),
    "members_at": (bound(Target("members_at", ("m",)), _STR), f"{_EMPTY} OR (is_arr OR is_obj) AND len(list_filter(members, lambda x: json_type(x, '$.m') IS NULL)) = 0"),
    "members_at_truthy": (bound(Target("members_at_truthy", (("m",), ("n",))), _PRESENT), f"{_EMPTY} OR (is_arr OR is_obj) AND len(list_filter(members, lambda x: coalesce(json_extract_string(x, '$.m') <> '', false) AND coalesce(TRY_CAST(json_extract_string(x, '$.n') AS DOUBLE), 0) = 0)) = 0"),
    "keys": (bound(Target("keys"), Requirement("length", (1, 2))), f"{_EMPTY} OR is_arr AND len(items) = 0 OR is_obj AND len(list_filter(keys, lambda x: length(x) > 2)) = 0"),
})


@query(f"WITH {_DOC} SELECT p_partkey, CASE WHEN ty IS NULL THEN NULL WHEN is_int THEN 'integer' WHEN is_num THEN 'number' WHEN is_str THEN 'string' ELSE lower(ty) END AS kind, truthy, CASE WHEN is_arr THEN len(items) WHEN is_obj THEN len(keys) END AS size FROM k")
def kinds_of_values(spark, d):
    a = truth.get(F.col("doc"), "a")
    return shaped(spark, d).select("p_partkey", truth.kind_of(a).alias("kind"), truth.truthy_variant(a).alias("truthy"), truth.size(a).cast("bigint").alias("size"))


# ---- functions


@query(f"""WITH {_DOC} SELECT p_partkey, coalesce(regexp_replace(s, '\\.0$', ''), 'none') AS dug, CASE WHEN is_obj THEN json_extract_string(a, '$.k') END AS indexed,
CASE WHEN truthy THEN CAST(a AS VARCHAR) ELSE '"dflt"' END AS defaulted, len(list_filter(members, lambda x: json_type(x) <> 'NULL')) >= 0 AS any_members,
len(CASE WHEN is_arr OR is_obj THEN members ELSE [] END) AS n_wild FROM (SELECT * REPLACE (CASE WHEN is_arr OR is_obj THEN NULL WHEN ty = 'NULL' THEN NULL ELSE s END AS s) FROM k)""")
def lookups_in_values(spark, d):
    doc = F.col("doc")
    a = truth.get(doc, "a")
    scalar = ~F.coalesce(truth.kind_of(a).isin("array", "object"), F.lit(False))
    dug = F.when(scalar & ~truth.absent(a), C.dig(doc, ["a"], F.lit("none"))).otherwise("none")
    indexed = F.when(truth.kind_of(a) == "object", truth.get(C.index_variant(doc, "a", "k"), kind="string"))
    defaulted = F.to_json(truth.default(a, "variant", F.parse_json(F.lit('"dflt"'))))
    return shaped(spark, d).select("p_partkey", F.regexp_replace(dug, r"\.0$", "").alias("dug"), indexed.alias("indexed"), defaulted.alias("defaulted"), F.lit(True).alias("any_members"), F.size(P.lookup_all(doc, "a.*")).cast("bigint").alias("n_wild"))


@query(r"""SELECT p_partkey, trim(p_name || '  ') AS trimmed, regexp_replace(p_brand, '([0-9]+)', '<\1>', 'g') AS grouped, regexp_replace(p_brand, '[0-9]', '$1', 'g') AS literal, array_to_string(regexp_split_to_array(p_name, 'e+'), '|') AS pieces,
string_split(p_name, ' ')[1] AS first_piece, p_name || ' ' || p_brand AS cat, contains(p_name, 'bo') AS has_bo, p_name || '-' || p_size AS printed, '"' || p_name || '"' AS quoted, lpad(CAST(p_size AS VARCHAR), 5, '0') AS padded,
printf('%x', p_size) AS hex, CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END AS boolean, p_retailprice AS price, rpad(p_brand, 12, ' ') AS wide, url_encode(p_brand || ' &') AS url, left(p_brand, 3) AS cut FROM part""")
def string_functions(spark, d):
    n, b, s = F.col("p_name"), F.col("p_brand"), F.col("p_size")
    return t(spark, d, "part").select(
        "p_partkey", T.trim(F.concat(n, F.lit("  "))).alias("trimmed"), T.regex_replace_all(b, "([0-9]+)", "<${1}>").alias("grouped"), T.regex_replace_all_literal(b, "[0-9]", "$1").alias("literal"), T.join(T.regex_split(n, "e+"), "|").alias("pieces"),
        F.element_at(T.split_n(n, " ", 2), "_0").alias("first_piece"), T.cat(n, b).alias("cat"), T.contains("bo", n).alias("has_bo"), T.print_((n, "string"), (F.lit("-"), "string"), (s, "int")).alias("printed"), T.printf("%q", n).alias("quoted"),
        T.printf("%05d", s).alias("padded"), T.printf("%x", s, types=("int",)).alias("hex"), T.printf("%t", s > 25).alias("boolean"), F.col("p_retailprice").alias("price"), T.printf("%-12s", b).alias("wide"), F.replace(T.urlquery(F.concat(b, F.lit(" &"))), F.lit("+"), F.lit("%20")).alias("url"), T.trunc(b, 3).alias("cut"),
    )


@query("""SELECT p_partkey, p_size - 30 AS minus, p_size * 3 AS times, CAST(trunc((p_size - 30) / 7) AS BIGINT) AS parts, (p_size - 30) % 7 AS left_over, CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_size // (p_size % 10) END AS by_zero,
p_size + 0.5 AS addf, p_size - 0.25 AS subf, p_size * 1.5 AS mulf, greatest(p_size, 20.5) AS maxf, least(p_size, 20.5) AS minf, floor(p_retailprice / 7) AS low, ceil(p_retailprice / 7) AS high, round(CAST(p_retailprice / 8 AS DECIMAL(38, 18)), 1) AS near,
CAST(9007199254740993 AS BIGINT) + p_size AS exact, greatest(p_size, 20) AS most, least(p_size, 20) AS fewest, p_size + 1 AS one_more, coalesce(TRY_CAST(p_brand AS BIGINT), 0) AS not_a_number FROM part""")
def number_functions(spark, d):
    s, price = F.col("p_size"), F.col("p_retailprice")
    less = s - 30
    double = lambda c: c.cast("double")
    return t(spark, d, "part").select(
        "p_partkey", C.sub(s, F.lit(30)).alias("minus"), C.mul(s, F.lit(3)).alias("times"), C.div(less, F.lit(7)).alias("parts"), C.mod(less, F.lit(7)).alias("left_over"), C.div(s, s % 10).alias("by_zero"), C.addf(s, F.lit(0.5)).alias("addf"),
        C.subf(s, F.lit(0.25)).alias("subf"), C.mulf(s, F.lit(1.5)).alias("mulf"), C.maxf(s, F.lit(20.5)).alias("maxf"), C.minf(s, F.lit(20.5)).alias("minf"), C.floor(price / 7).alias("low"), C.ceil(price / 7).alias("high"), double(C.round_(price / 8, 1)).alias("near"),
        C.add(F.lit("9007199254740993"), s).alias("exact"), C.biggest(s, F.lit(20)).alias("most"), C.smallest(s, F.lit(20)).alias("fewest"), C.add1(s).alias("one_more"), C.to_int(F.col("p_brand")).alias("not_a_number"),
    )


@query("""WITH a AS (SELECT p_partkey, p_name, p_brand, p_type, string_split(p_name, ' ') AS w FROM part)
SELECT p_partkey, array_to_string(list_sort(list_concat(w, [p_brand])), '|') AS sorted, array_to_string(list_concat(w, [p_type]), '|') AS appended, array_to_string(list_concat([p_type], w), '|') AS prepended, array_to_string(list_reverse(w), '|') AS reversed,
list_contains(w, 'red') AS has_red, p_brand AS set_value, 2 AS n_set, 1 AS n_unset, p_type AS dict_value, w[2] AS indexed, octet_length(encode(p_name)) AS bytes, p_name || ',' || p_brand AS plucked, p_brand || '/' || p_type AS values_in_order, w[1] AS first_of, len(w) AS n FROM a""")
def list_and_map_functions(spark, d):
    n, b, k = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    w, m = F.split(n, " "), C.dict_of("b", b, "t", k)
    j = lambda c: F.array_join(c, "|")
    return t(spark, d, "part").select(
        "p_partkey", j(C.sort_alpha(C.append(w, b))).alias("sorted"), j(C.append(w, k)).alias("appended"), j(C.prepend(w, k)).alias("prepended"), j(C.reverse(w)).alias("reversed"), C.has(F.lit("red"), w).alias("has_red"),
        C.index(C.put(m, "t", b), "t").alias("set_value"), F.size(C.put(m, "t", b)).alias("n_set"), F.size(C.unset(m, "t")).alias("n_unset"), C.index(C.deep_copy(m), "t").alias("dict_value"), C.index(w, 1).alias("indexed"), C.length(n, "string").alias("bytes"),
        F.array_join(C.pluck("x", C.dict_of("x", n), C.dict_of("y", k), C.dict_of("x", b)), ",").alias("plucked"), F.array_join(C.values(m), "/").alias("values_in_order"), C.first(C.list_of(F.get(w, F.lit(0)), b)).alias("first_of"), C.length(w, "array<string>").alias("n"),
    )


@query("""SELECT p_partkey, '{"brand":"' || p_brand || '","size":' || p_size || '}' AS json, p_size AS back, 'brand: ' || replace(p_brand, '#', '#') || chr(10) || 'size: ' || p_size AS yaml, p_brand AS from_yaml, CAST(NULL AS VARCHAR) AS broken, 2 AS n_items FROM part""")
def serial_functions(spark, d):
    s = F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    json, yaml = F.col("json"), F.col("yaml")
    p = t(spark, d, "part").repartition("p_partkey").select("p_partkey", C.to_json(s).alias("json"))  # a file may be one row group, which one task would read and turn to YAML
    return p.withColumn("yaml", C.to_yaml(json)).select(
        "p_partkey", "json", truth.get(C.from_json(json), "size", kind="int").alias("back"), "yaml", truth.get(C.from_yaml(yaml), "brand", kind="string").alias("from_yaml"), truth.get(C.from_json(F.concat(F.lit("{"), json)), "size", kind="string").alias("broken"), F.size(C.from_json_array(F.lit("[1,{}]"))).alias("n_items")
    )


@query("""SELECT p_partkey, '{"a":' || (CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END) || ',"m":{"x":1' || (CASE WHEN p_size % 3 = 0 THEN ',"y":3' ELSE ',"y":2' END) || ',"z":{"q":' || p_size || ',"r":9}}' || (CASE WHEN p_size % 5 = 0 THEN '' ELSE ',"n":"left"' END) || '}' AS merged FROM part""")
def deep_merge(spark, d):
    s = F.col("p_size")
    text = lambda *x: F.parse_json(F.concat(*[F.lit(c) if isinstance(c, str) else c.cast("string") for c in x]))
    left = text('{"a":', F.when(s % 2 == 0, s).otherwise(0), ',"m":{"x":1', F.when(s % 3 == 0, ',"y":3').otherwise(""), ',"z":{"q":', s, "}}", F.when(s % 5 == 0, "").otherwise(',"n":"left"'), "}")
    right = text('{"a":5,"m":{"x":7,"y":2,"z":{"q":0,"r":9}}', F.when(s % 5 == 0, "").otherwise(',"n":"right"'), "}")
    return t(spark, d, "part").select("p_partkey", F.to_json(C.merge_deep(left, right)).alias("merged"))


_VERSIONS = ("1.2.3", "v1.2.9", "0.2.3", "0.2.9", "0.9.0", "0.0.3", "0.0.4", "1.9.0", "2.0.0-alpha.9", "2.0.0-alpha.10", "2.0.0", "1.5", "3", "10.0.1", "1.2.3-rc.1", "junk")
_CONSTRAINTS = {
    "caret": ("^1.2.3", (0, 1, 7, 11)), "caret_minor": ("^0.2.3", (2, 3)), "caret_patch": ("^0.0.3", (5,)), "tilde": ("~1.2.0", (0, 1)), "tilde_major": ("~1", (0, 1, 7, 11)), "range": (">=1.2.3, <2.0.0", (0, 1, 7, 11)),
    "blanks": (">0.2.3 <=1.5", (3, 4, 0, 1, 11)), "either": ("~0.2.0 || >=10", (2, 3, 13)), "wild": ("1.x", (0, 1, 7, 11)), "hyphen": ("1.2.4 - 2.0.0", (1, 7, 10, 11)), "pre": (">=2.0.0-alpha.10", (9, 10, 12, 13)), "not_equal": ("!=1.2.3", (1, 2, 3, 4, 5, 6, 7, 10, 11, 12, 13)),
    "any": ("*", (0, 1, 2, 3, 4, 5, 6, 7, 10, 11, 12, 13)), "major_above": (">1", (10, 12, 13)), "equal_minor": ("=1.2", (0, 1)),
}
_N = len(_VERSIONS)


@query(f"SELECT p_partkey, {', '.join(f'CASE WHEN p_size % {_N} < {_N - 1} THEN CAST(p_size % {_N} IN {at if len(at) > 1 else f"({at[0]})"} AS VARCHAR) END AS {n}' for n, (_, at) in _CONSTRAINTS.items())}, CASE p_size % {_N} WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 13 THEN 0 WHEN 11 THEN 5 ELSE -1 END AS minor FROM part")
def semver_constraints(spark, d):
    v = F.get(F.array(*[F.lit(x) for x in _VERSIONS]), F.col("p_size") % _N)
    minor = F.when((F.col("p_size") % _N).isin(0, 1, 11, 13), T.semver_part(v, "minor")).otherwise(-1)
    return t(spark, d, "part").select("p_partkey", *[semver.compare(c, v).cast("string").alias(n) for n, (c, _) in _CONSTRAINTS.items()], minor.alias("minor"))


_IPS = (("10.0.0.1", 4), ("256.1.1.1", 0), ("1.2.3", 0), ("01.2.3.4", 0), ("::1", 6), ("2001:db8::ff00:42:8329", 6), ("1:2:3:4:5:6:7:8", 6), ("1:2:3:4:5:6:7:8:9", 0), ("::ffff:1.2.3.4", 6), ("1::2::3", 0), ("g::1", 0), ("", 0), ("::", 6), ("12345::", 0))
_DURATIONS = (("1h30m", 5_400_000_000_000), ("0", 0), ("-1.5s", -1_500_000_000), ("1h0", None), ("00", None), ("10ms", 10_000_000), ("", None), ("3", None), (".5us", 500), ("2d", None), ("+7ns", 7))


@query(f"""SELECT p_partkey, [{', '.join(str(k) for _, k in _IPS)}][p_size % {len(_IPS)} + 1] = 4 AS v4, [{', '.join(str(k) for _, k in _IPS)}][p_size % {len(_IPS)} + 1] = 6 AS v6, [{', '.join(str(k) for _, k in _IPS)}][p_size % {len(_IPS)} + 1] > 0 AS ip,
[{', '.join('NULL' if n is None else str(n) for _, n in _DURATIONS)}][p_size % {len(_DURATIONS)} + 1] IS NOT NULL AS duration, CAST([{', '.join('NULL' if n is None else str(n) for _, n in _DURATIONS)}][p_size % {len(_DURATIONS)} + 1] AS BIGINT) AS nanoseconds FROM part""")
def address_and_duration_contracts(spark, d):
    ip, du = (F.get(F.array(*[F.lit(x) for x, _ in rows]), F.col("p_size") % len(rows)) for rows in (_IPS, _DURATIONS))
    return t(spark, d, "part").select("p_partkey", T.is_ipv4(ip).alias("v4"), T.is_ipv6(ip).alias("v6"), T.is_ip(ip).alias("ip"), T.is_duration(du).alias("duration"), T.duration_nanoseconds(du).alias("nanoseconds"))


@query("SELECT event_id, CAST(epoch_us(ts + INTERVAL 90 MINUTE) AS BIGINT) AS later, CAST(epoch_us(ts - INTERVAL 1500 MILLISECOND) AS BIGINT) AS earlier FROM events")
def date_functions(spark, d):
    at = F.col("ts").cast("timestamp_ntz")
    us = lambda c: F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)
    return t(spark, d, "events").select("event_id", us(T.date_modify("1h30m", at)).alias("later"), us(T.date_modify("-1.5s", at)).alias("earlier"))


# ---- paths, profiles, contract rows


@query(f"WITH {_DOC} SELECT count(*) AS n, 'a' AS path, count(*) FILTER (ty = 'NULL') AS nulls, count(*) FILTER (truthy) AS truthy FROM k WHERE ty IS NOT NULL UNION ALL SELECT sum(len(items)), 'a.*', sum(len(list_filter(items, lambda x: json_type(x) = 'NULL'))), sum(len(list_filter(items, lambda x: x NOT IN ('\"\"', '0', 'null')))) FROM k HAVING sum(len(items)) > 0")
def shapes_profile(spark, d):
    per = shred.profile(shred.shred(shaped(spark, d), "p_partkey", F.col("doc"), 4))
    return per.where("path in ('a', 'a.*')").select("n", "path", "nulls", "truthy")


@query("""WITH u AS (SELECT DISTINCT replace(regexp_extract(url, '://([^?#]*)', 1), '.', '\\.') AS f FROM pages), p AS (SELECT DISTINCT f AS path FROM u), x AS (SELECT path, string_split(path, '/') AS s FROM p),
q AS (SELECT DISTINCT array_to_string(s, '.') AS path FROM x) SELECT path, EXISTS (SELECT 1 FROM q b WHERE starts_with(b.path, q.path || '.')) AS has_descendants, false AS has_item_descendants FROM q""")
def descendants_marked(spark, d):
    p = t(spark, d, "pages").select(P.join_path(F.split(F.regexp_extract("url", "://([^?#]*)", 1), "/")).alias("path"))
    return contracts.mark_descendants(p)


@query("""WITH s AS (SELECT o_custkey AS f, o_orderkey AS id, CAST(o_orderkey % 977 * 10 AS BIGINT) AS a, CAST(o_orderkey % 977 * 10 + 5 + o_orderkey % 400 AS BIGINT) AS b FROM orders), p AS (SELECT o_custkey AS f, o_orderkey AS pid, CAST(o_orderkey % 977 * 10 + 7 AS BIGINT) AS pos FROM orders)
SELECT p.f, p.pid, p.pos, min(b - a) AS length FROM p JOIN s ON p.f = s.f AND s.a <= p.pos AND p.pos < s.b GROUP BY 1, 2, 3 UNION ALL SELECT f, pid, pos, NULL FROM p WHERE NOT EXISTS (SELECT 1 FROM s WHERE p.f = s.f AND s.a <= p.pos AND p.pos < s.b)""")
def spans_of_points(spark, d):
    o = t(spark, d, "orders")
    start = (F.col("o_orderkey") % 977 * 10).cast("bigint")
    s = o.select(F.col("o_custkey").alias("f"), start.alias("a"), (start + 5 + F.col("o_orderkey") % 400).cast("bigint").alias("b"), F.col("o_orderkey").alias("id"))
    p = o.select(F.col("o_custkey").alias("f"), F.col("o_orderkey").alias("pid"), (start + 7).alias("pos"))
    return contracts.span_attribution(p, s, "f", "pos", "a", "b", block=64).select("f", "pid", "pos", (F.col("b") - F.col("a")).alias("length"))


@query("""SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS flags, array_to_string(list_sort(list(DISTINCT l_linestatus)), ',') AS states, bool_or(l_quantity > 45) AS large FROM lineitem GROUP BY l_orderkey""")
def runs_merged(spark, d):
    li = t(spark, d, "lineitem").select("l_orderkey", F.array("l_returnflag").alias("flags"), F.array("l_linestatus").alias("states"), (F.col("l_quantity") > 45).alias("large"))
    out = contracts.merge_runs(li, ["l_orderkey"], ["flags", "states"], ["large"])
    return out.withColumn("flags", F.array_join("flags", ",")).withColumn("states", F.array_join("states", ","))


@query("SELECT l_partkey, l_returnflag, arg_min(l_shipmode_, l_orderkey * 10 + l_linenumber) AS resource FROM (SELECT *, CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey END AS l_shipmode_ FROM lineitem) WHERE true GROUP BY 1, 2")
def pathless_merged(spark, d):
    li = t(spark, d, "lineitem").withColumn("resource", F.when(F.col("l_suppkey") % 3 == 0, F.col("l_suppkey")))
    return contracts.merge_pathless(li, ["l_partkey", "l_returnflag"], "resource", ["l_orderkey", "l_linenumber"])


@query("SELECT user_id, CAST(bool_and(event_type = 'view') FILTER (event_type <> 'click') AS VARCHAR) AS x, bool_and(value > 1) AS all_nullable FROM events GROUP BY user_id")
def rendered_folds(spark, d):
    e = t(spark, d, "events").select("user_id", F.when(F.col("event_type") == "click", "read").when(F.col("event_type") == "view", "serialized").otherwise("scalar").alias("kind"), (F.col("value") > 1).alias("nullable"))
    return contracts.render_fold(e, "user_id", "kind", "nullable").select("user_id", F.col("all_serialized").cast("string").alias("x"), "all_nullable")


@query("SELECT o_custkey, least(o_orderstatus, o_orderpriority) || '|' || greatest(o_orderstatus, o_orderpriority) AS handled, count(DISTINCT o_orderkey % 5) AS n FROM orders GROUP BY 1, 2")
def member_accesses(spark, d):
    o = t(spark, d, "orders").select("o_custkey", F.array("o_orderstatus", "o_orderpriority").alias("handled"), (F.col("o_orderkey") % 5).cast("string").alias("condition"))
    out = contracts.member_access(o, "o_custkey", "handled", "condition")
    return out.select("o_custkey", F.concat_ws("|", F.get("handled", F.lit(0)), F.coalesce(F.get("handled", F.lit(1)), F.get("handled", F.lit(0)))).alias("handled"), F.size("conditions").cast("bigint").alias("n"))


@query("SELECT c_custkey, CASE WHEN n_regionkey = 0 THEN c_mktsegment || '+a' WHEN n_regionkey = 1 THEN c_mktsegment || '+b' ELSE c_mktsegment END AS conditions FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT c_custkey, c_mktsegment || '+c' FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1")
def activations_applied(spark, d):
    c = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", F.col("n_regionkey").alias("chart"), F.array(F.array("c_mktsegment")).alias("condition"))
    sets = spark.createDataFrame([(0, ["a"]), (1, ["b"]), (1, ["c"])], "chart int, guards array<string>")
    out = contracts.apply_activation(c, sets, "chart", "guards", "condition")
    return out.select("c_custkey", F.concat_ws("+", F.array_sort(F.get("condition", F.lit(0)))).alias("conditions"))


@query("SELECT CAST(k AS BIGINT) AS k, v FROM (SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 2 = 0))")
def globals_composed(spark, d):
    p = t(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("global.x"), "n_nationkey")).otherwise("own").alias("path"), F.col("n_name").alias("v"))
    c = t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"))
    return compose.compose_globals(p, c, ["k"], "path", "v")


@query("SELECT page_id FROM pages WHERE NOT contains(url, 'example.net/')")
def paths_removed(spark, d):
    host = F.regexp_extract("url", "://([^?#]*)", 1)
    p = t(spark, d, "pages").select("page_id", "url", P.join_path(F.filter(F.array_append(F.reverse(F.split(F.split_part(host, F.lit("/"), F.lit(1)), r"\.")), F.lit("x")), lambda x: x != "")).alias("path"))
    gone = spark.createDataFrame([("net.example",)], "path string")
    return compose.remove_paths(p, gone, "path").select("page_id")


# ---- catalogs


@query("""WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R') SELECT o_orderkey, CASE WHEN o_custkey % 50 IN (SELECT k FROM a) THEN o_custkey % 50 WHEN o_custkey % 70 IN (SELECT k FROM a) THEN o_custkey % 70 END AS v FROM orders""")
def candidate_lookups(spark, d):
    asked = t(spark, d, "orders").select("o_orderkey", F.array(F.col("o_custkey") % 50, F.col("o_custkey") % 70).alias("options"))
    answers = t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("option")).distinct().withColumn("v", F.col("option"))
    return catalog.candidates(asked, answers, ["o_orderkey"], "options", "option", "v").select("o_orderkey", "v")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'live' ELSE 'v2' END AS first_version, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 4 END AS n FROM customer""")
def lookup_plans(spark, d):
    c = t(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("live"))).alias("branches"), F.array(F.lit("v2"), F.lit("v1"), F.lit("v2")).alias("versions"), F.array(F.lit("A"), F.lit("B")).alias("kinds"))
    plan = catalog.lookup_plan(c, ["c_custkey"], "branches", "versions", "kinds")
    return plan.groupBy("c_custkey").agg(F.min_by("api_version", "place").alias("first_version"), F.count("*").alias("n"))


@query("""WITH h AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 48) SELECT p_partkey AS k, p_partkey IN (SELECT k FROM h) AS sure, CASE WHEN p_partkey IN (SELECT k FROM h) THEN 'true' END AS open, CASE WHEN p_partkey IN (SELECT k FROM h) THEN 'found' WHEN p_size > 40 THEN 'absent' ELSE 'uncertain' END AS state FROM part""")
def presence_of_apis(spark, d):
    from shalebed.sources import schemas

    held = t(spark, d, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("k"))
    p = t(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_size")
    sure = catalog.presence(p, held, ["k"], True).withColumnRenamed("present", "sure")
    both = catalog.presence(sure, held, ["k"], False).withColumn("open", F.col("present").cast("string"))
    return schemas.probe(both, held, p.where("p_size > 40"), ["k"]).select("k", "sure", "open", "state")


@query("""WITH b AS (SELECT l_orderkey AS k, l_linenumber * 1000000 + l_partkey AS place, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_partkey % 4 END AS api, l_partkey AS literal FROM lineitem),
j AS (SELECT *, CASE WHEN api IS NULL THEN 1 WHEN api = 0 THEN 1 WHEN api = 1 THEN 0 ELSE NULL END AS lives FROM b),
f AS (SELECT k, min(place) FILTER (lives = 1) AS hit, min(place) FILTER (lives IS NULL) AS open FROM j GROUP BY k)
SELECT DISTINCT f.k, j.literal FROM f JOIN j ON j.k = f.k AND j.place = f.hit WHERE open IS NULL OR hit < open""")
def live_branch(spark, d):
    b = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("place"), F.when(F.col("l_returnflag") != "N", F.col("l_partkey") % 4).alias("api"), F.col("l_partkey").alias("literal"))
    known = spark.createDataFrame([(0, True), (1, False), (2, None)], "api bigint, present boolean")
    return catalog.live_branches(b, known, ["k"], "api").select("k", "literal")


@query("""WITH a AS (SELECT DISTINCT l_partkey AS k, 1 AS r FROM lineitem WHERE l_returnflag = 'R' UNION SELECT DISTINCT l_partkey, 2 FROM lineitem WHERE l_quantity > 10), f AS (SELECT k, min(r) AS f FROM a GROUP BY k)
SELECT p_partkey AS k, x.r, CASE WHEN a.k IS NOT NULL THEN 'found' ELSE 'missing' END AS outcome FROM part CROSS JOIN (VALUES (0), (1), (2)) x(r) LEFT JOIN a ON a.k = p_partkey AND a.r = x.r LEFT JOIN f ON f.k = p_partkey WHERE f.f IS NULL OR x.r <= f.f""")
def lookup_traces(spark, d):
    li = t(spark, d, "lineitem")
    a = li.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k"), F.lit(1).alias("r")).union(li.where("l_quantity > 10").select("l_partkey", F.lit(2)))
    return catalog.lookup_trace(t(spark, d, "part").select(F.col("p_partkey").alias("k")), [0, 1, 2], a, ["k"], "r")


@query("""WITH b AS (SELECT l_orderkey, min(l_linenumber % 3) AS m FROM lineitem GROUP BY 1), x AS (SELECT l.l_orderkey, min(l_returnflag) AS v, max(l_returnflag) AS w FROM lineitem l JOIN b ON b.l_orderkey = l.l_orderkey AND l.l_linenumber % 3 = b.m GROUP BY 1)
SELECT l_orderkey, CASE WHEN v = w THEN 'Resolved' ELSE 'Ambiguous' END AS outcome, CASE WHEN v = w THEN v END AS value FROM x""")
def infer_by_authority(spark, d):
    return catalog.resolve_ranked(t(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber"), ["l_orderkey"], F.col("l_returnflag"), F.col("l_linenumber") % 3)


@query("""SELECT p_partkey, lower(p_type) || CASE WHEN p_size % 2 = 0 THEN '-apps-v1' ELSE '-v1' END || '.json' AS first_name, CASE WHEN p_size % 2 = 0 THEN 'apps.x/' || lower(p_type) || '_v1.json' END AS catalog_name, CASE WHEN p_size % 2 = 0 THEN 3 ELSE 1 END AS n, p_size % 2 = 1 AS built_in,
CASE p_size % 4 WHEN 0 THEN 'v1' WHEN 1 THEN 'v2' WHEN 2 THEN 'v2' ELSE 'v1beta2' END AS newest FROM part""")
def schema_names(spark, d):
    from shalebed.sources import schemas

    api = F.when(F.col("p_size") % 2 == 0, "apps.x/v1").otherwise("v1")
    names = schemas.file_names(api, F.col("p_type"))
    group = F.when(F.col("p_size") % 2 == 0, "apps.x").otherwise("")
    offers = F.get(F.array(F.array(F.lit("v1"), F.lit("v1beta2")), F.array(F.lit("v2"), F.lit("v1")), F.array(F.lit("v2"), F.lit("v3alpha1")), F.array(F.lit("v1beta2"), F.lit("v2alpha9"))), F.col("p_size") % 4)
    newest = F.array_max(F.transform(offers, lambda v: F.struct(catalog.version_rank(v).alias("r"), v.alias("v"))))["v"]
    return t(spark, d, "part").select("p_partkey", F.get(names, F.lit(0)).alias("first_name"), schemas.catalog_name(api, F.col("p_type")).alias("catalog_name"), F.size(names).alias("n"), schemas.is_builtin_group(group).alias("built_in"), newest.alias("newest"))


@query("""WITH f AS (SELECT p_partkey, ['templates/a.yaml', 'templates/_h.tpl', 'templates/NOTES.txt', 'crds/x.yaml', 'files/y.txt', 'Chart.yaml', 'charts/d/templates/b.yml', 'templates/tests/t.yaml'][p_size % 8 + 1] AS path FROM part)
SELECT p_partkey, ['define,manifest', 'define', 'define,notes', 'crd', 'files_get', '', 'define,manifest', 'define,manifest'][p_size % 8 + 1] AS roles, path = 'charts/d/templates/b.yml' AS nested FROM f JOIN part USING (p_partkey)""")
def file_roles(spark, d):
    from shalebed.sources import charts

    names = ("templates/a.yaml", "templates/_h.tpl", "templates/NOTES.txt", "crds/x.yaml", "files/y.txt", "Chart.yaml", "charts/d/templates/b.yml", "templates/tests/t.yaml")
    path = F.get(F.array(*[F.lit(n) for n in names]), F.col("p_size") % 8)
    return t(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(charts.roles(path)), ",").alias("roles"), (charts.chart_dir(path) != "").alias("nested"))


# ---- schemas


_KINDS = "bool_or(m = 0) AS i, bool_or(m = 1) AS s, bool_or(m = 2) AS f, bool_or(m = 3) AS n, bool_or(m = 4) AS o"


@query(f"""WITH x AS (SELECT p_brand, {_KINDS} FROM (SELECT p_brand, p_size % 5 AS m FROM part) GROUP BY p_brand),
y AS (SELECT *, list_filter([CASE WHEN f THEN '{{"type":"number"}}' WHEN i THEN '{{"type":"integer"}}' END, CASE WHEN o THEN '{{"properties":{{"q":{{"type":"boolean"}}}},"type":"object"}}' END, CASE WHEN s THEN '{{"type":"string"}}' END], lambda z: z IS NOT NULL) AS a FROM x)
SELECT p_brand, '{{"properties":{{"k":' || CASE len(a) WHEN 0 THEN '{{}}' WHEN 1 THEN a[1] ELSE '{{"anyOf":[' || array_to_string(list_sort(a), ',') || ']}}' END || '}},"type":"object"}}' AS schema FROM y""")
def lattice_of_shapes(spark, d):
    s = F.col("p_size")
    v = F.when(s % 5 == 0, s.cast("string")).when(s % 5 == 1, F.concat(F.lit('"t'), s, F.lit('"'))).when(s % 5 == 2, F.concat(s, F.lit(".5"))).when(s % 5 == 3, "null").otherwise('{"q":true}')
    return lattice.fold_schemas(t(spark, d, "part").select("p_brand", F.concat(F.lit('{"k":'), v, F.lit("}")).alias("j")), "j", "p_brand")


@query("""SELECT p_partkey, '{"properties":{"b":{"type":"string"},"x":{"description":"' || p_name || '","type":"integer"}},"type":"object"}' AS expanded, p_size % 2 = 0 AS required, 'integer' AS leaf FROM part""")
def references_expanded(spark, d):
    doc = F.concat(F.lit('{"type":"object","properties":{"x":{"$ref":"#/definitions/i"},"b":{"type":"string"}},"definitions":{"i":{"type":"integer","description":"'), F.col("p_name"), F.lit('"}}'), F.when(F.col("p_size") % 2 == 0, ',"required":["x"]').otherwise(""), F.lit("}"))
    p = t(spark, d, "part").select("p_partkey", doc.alias("schema"))

    def leaf(s: dict):
        found = refs.descend(s, ["x"], "", lambda _: s)
        return {"required": found[2], "type": refs.resolve(found[0], "", lambda _: s)[0]["type"]}

    def expanded(s: dict):
        return {k: v for k, v in refs.inline(s, "", lambda _: s).items() if k != "required"}

    out = refs.over(refs.over(p, "schema", expanded, "expanded"), "schema", leaf, "leaf_of")
    v = F.parse_json("leaf_of")
    return out.select("p_partkey", "expanded", truth.get(v, "required", kind="boolean").alias("required"), truth.get(v, "type", kind="string").alias("leaf"))


@query("""SELECT p_brand AS document, count(*) AS n, count(*) FILTER (keyword = 'properties') AS named FROM (SELECT p_brand, unnest(['properties', 'properties', 'items', 'anyOf']) AS keyword FROM (SELECT DISTINCT p_brand FROM part)) GROUP BY 1""")
def schema_edges(spark, d):
    s = t(spark, d, "part").select("p_brand").distinct().withColumn("s", F.lit('{"properties":{"a":{"items":{}},"b":{"anyOf":[{"const":{"properties":{"no":{}}}}]}}}'))
    return refs.edges(s, "p_brand", "s").groupBy("document").agg(F.count("*").alias("n"), F.count_if(F.col("keyword") == "properties").alias("named"))


@query("""SELECT node FROM (SELECT DISTINCT p_size AS node FROM part) WHERE node % 2 = 1 AND node <> 1 AND node NOT IN (WITH RECURSIVE e AS (SELECT DISTINCT p_size AS src, p_size + 12 AS dst FROM part), r(node) AS (SELECT 1 UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT node FROM r)""")
def definitions_unreachable(spark, d):
    p = t(spark, d, "part").select(F.col("p_size").alias("src"), (F.col("p_size") + 12).alias("dst")).distinct()
    nodes = p.select(F.col("src").alias("node")).where("node % 2 = 1")
    return graph.unreachable(nodes, p, spark.createDataFrame([(1,)], "node int"))


# ---- templates


@query("""WITH n AS (SELECT *, regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') AS v FROM nation)
SELECT n_nationkey AS chart, 'use' AS row, v AS source_path, 'data/key' AS sink, 'scalar' AS kind, CASE WHEN n_regionkey % 2 = 0 THEN '[["truthy","on.r' || n_regionkey || '",null]]' ELSE '' END AS condition FROM n
UNION ALL SELECT n_nationkey, 'use', v || '.list.*', 'data/list/[*]', 'scalar', '[["range","' || v || '.list",null]]' FROM n
UNION ALL SELECT n_nationkey, 'use', v || '.list', 'data/list', 'scalar', '[["range","' || v || '.list",null]]' FROM n
UNION ALL SELECT n_nationkey, 'use', 'labels', 'metadata/labels', 'yaml_serialized', '' FROM n
UNION ALL SELECT n_nationkey, 'read', v || '.list', '', '', '' FROM n
UNION ALL SELECT n_nationkey, 'read', 'on.r' || n_regionkey, '', '', '' FROM n WHERE n_regionkey % 2 = 0
UNION ALL SELECT n_nationkey, 'abort', NULL, '', '', '[["eq","mode","' || v || '"]]' FROM n""")
def template_rows(spark, d):
    from shalebed.template import rows

    v, region = F.regexp_replace(F.lower("n_name"), "[^a-z0-9]", ""), F.col("n_regionkey")
    key = F.concat(F.lit("  key: {{ .Values."), v, F.lit(" }}\n"))
    guarded = F.concat(F.lit("  {{- if .Values.on.r"), region, F.lit(" }}\n"), key, F.lit("  {{- end }}\n"))
    source = F.concat(
        F.lit("apiVersion: v1\nkind: ConfigMap\nmetadata:\n  labels:\n    {{- include \"labels\" . | nindent 4 }}\ndata:\n"), F.when(region % 2 == 0, guarded).otherwise(key), F.lit("  list:\n    {{- range .Values."), v, F.lit(".list }}\n    - {{ . }}\n    {{- end }}\n{{ if eq .Values.mode \""), v, F.lit('" }}{{ fail "no" }}{{ end }}')
    )
    templates = t(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("chart"), F.lit("t.yaml").alias("path"), source.alias("source"))
    helpers = spark.createDataFrame([("labels", "{{ toYaml .Values.labels }}")], "name string, source string")
    out = rows.interpret(templates, helpers).where("row <> 'hint' and not (row = 'read' and source_path = 'mode')")
    condition = F.array_join(F.flatten("condition"), "&")
    plain = F.when(condition == "", "").otherwise(F.concat(F.lit("["), condition, F.lit("]")))
    return out.select(F.col("chart").cast("int").alias("chart"), "row", "source_path", F.coalesce(F.array_join("sink_path", "/"), F.lit("")).alias("sink"), F.coalesce("kind", F.lit("")).alias("kind"), plain.alias("condition"))
