"""Queries over the driver's tables, one or more for each family of operators, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from shalebed.functions import collections as C
from shalebed.functions import paths as P
from shalebed.functions import text as T
from shalebed.functions import truth
from shalebed.functions.guards import Guard, violates
from shalebed.operators import catalog, compose, contracts, emit, graph, lattice, shred

QUERIES: dict = {}
SQL: dict[str, str] = {}
FLOAT = 6  # decimals that both engines' sums agree on


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def order_documents(spark, d):
    """orders with their line items as nested documents, built without text; an order without items has no `items`."""
    items = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_returnflag")).alias("items"))
    o = t(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    bare, full = (F.to_variant_object(F.struct("o_custkey", "o_orderstatus", *more)) for more in ([], ["items"]))
    return o.select("o_orderkey", F.when(F.col("items").isNull(), bare).otherwise(full).alias("doc"))


@query("""
WITH p AS (SELECT 'o_custkey' AS path, count(*) AS n, count(*) FILTER (o_custkey <> 0) AS truthy, 'integer' AS kinds, count(*) = (SELECT count(*) FROM orders) AS required FROM orders
UNION ALL SELECT 'o_orderstatus', count(*), count(*) FILTER (o_orderstatus <> ''), 'string', true FROM orders
UNION ALL SELECT 'items', count(DISTINCT l_orderkey), count(DISTINCT l_orderkey), 'array', count(DISTINCT l_orderkey) = (SELECT count(*) FROM orders) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'items.*', count(*), count(*), 'object', false FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'items.*.l_linenumber', count(*), count(*) FILTER (l_linenumber <> 0), 'integer', true FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'items.*.l_quantity', count(*), count(*) FILTER (l_quantity <> 0), 'number', true FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'items.*.l_returnflag', count(*), count(*) FILTER (l_returnflag <> ''), 'string', true FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))
SELECT path, n, CAST(0 AS BIGINT) AS nulls, truthy, kinds, required FROM p""")
def path_profile(spark, d):
    docs = order_documents(spark, d)
    return shred.required_paths(shred.profile(shred.shred(docs, "o_orderkey", F.col("doc"), 3)), t(spark, d, "orders").count())


@query("SELECT k AS key, 'integer' AS kind, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY k")
def props_kind_profile(spark, d):
    leaves = shred.shred(t(spark, d, "events"), "event_id", F.parse_json("props"), 1)
    return leaves.groupBy(F.col("path").alias("key"), "kind").agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def props_path_lookup(spark, d):
    return t(spark, d, "events").select("event_id", P.lookup(F.parse_json("props"), "k", "bigint").alias("k"))


@query("""SELECT page_id, array_to_string(list_transform(string_split(url, '/'), lambda s: replace(replace(s, '\\', '\\\\'), '.', '\\.')), '.') AS path, len(string_split(url, '/')) AS n,
array_to_string(string_split(url, '/'), '/') = url AS back FROM pages""")
def path_scope_split(spark, d):
    p = t(spark, d, "pages").select("page_id", "url", F.split("url", "/").alias("s")).withColumn("path", P.join_path(F.col("s")))
    return p.select("page_id", "path", F.size(P.split_path(F.col("path"))).cast("bigint").alias("n"), (F.array_join(P.split_path(F.col("path")), "/") == F.col("url")).alias("back"))


@query("""SELECT 'supplier' AS t, count(*) FILTER (s_acctbal <> 0) AS n FROM supplier UNION ALL SELECT 'customer', count(*) FILTER (c_mktsegment <> '') FROM customer
UNION ALL SELECT 'events', count(*) FILTER (value <> 0) FROM events""")
def truthy_counts(spark, d):
    one = lambda n, c, k: t(spark, d, n).agg(F.count_if(truth.truthy(F.col(c), k)).alias("n")).select(F.lit(n).alias("t"), "n")
    return one("supplier", "s_acctbal", "double").union(one("customer", "c_mktsegment", "string")).union(one("events", "value", "double"))


TYPES = {"o_orderstatus": "string", "o_totalprice": "double", "o_orderpriority": "string", "o_custkey": "bigint", "l_quantity": "double", "l_linenumber": "int", "p_name": "string", "p_type": "string", "p_brand": "string", "url": "string", "props": "string", "items": "array<struct<l_linenumber:int,l_returnflag:string>>"}


def guarded(name, table, key, guard, sql):
    def run(spark, d):
        return t(spark, d, table).where(guard.column(TYPES)).select(key)

    run.__name__ = name
    query(f"SELECT {key} FROM {table} WHERE {sql}")(run)


guarded("guard_eq", "orders", "o_orderkey", Guard("eq", "o_orderstatus", "F"), "o_orderstatus = 'F'")
guarded("guard_ne", "orders", "o_orderkey", Guard("ne", "o_orderstatus", "F"), "o_orderstatus IS DISTINCT FROM 'F'")
guarded("guard_typeis", "orders", "o_orderkey", Guard("type_is", "o_totalprice", "number"), "o_totalprice IS NOT NULL")
guarded("guard_int_gt", "lineitem", "l_orderkey", Guard("int_gt", "l_linenumber", 4), "l_linenumber > 4")
guarded("guard_int_lt", "lineitem", "l_orderkey", Guard("int_lt", "l_linenumber", 3), "l_linenumber < 3")
guarded("guard_pattern", "part", "p_partkey", Guard("matches", "p_brand", "^Brand#[0-9]$"), "regexp_matches(p_brand, '^Brand#[0-9]$')")
guarded("guard_not_pattern", "pages", "page_id", Guard("not_matches", "url", "^https:"), "NOT regexp_matches(url, '^https:')")
guarded("guard_has_key", "events", "event_id", Guard("has_key", "props", "k"), "list_contains(json_keys(props), 'k')")

def with_items(spark, d):
    """Orders' items as arrays; an order has a handful."""
    return t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_returnflag")).alias("items"))


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def guard_contains_member(spark, d):
    return with_items(spark, d).where(Guard("contains_member", "items", ("l_returnflag", "R")).column(TYPES)).select("l_orderkey")


@query("SELECT l_orderkey, count(*) >= 3 AS min_3, count(*) <= 1 AS at_most_one FROM lineitem GROUP BY l_orderkey")
def guard_member_counts(spark, d):
    return with_items(spark, d).select("l_orderkey", Guard("min_members", "items", 3).column(TYPES).alias("min_3"), Guard("at_most_one", "items").column(TYPES).alias("at_most_one"))


@query("SELECT o_orderkey FROM orders WHERE coalesce(o_orderstatus = 'O', false) AND NOT coalesce(o_totalprice > 100000, false)")
def conditional_constraint(spark, d):
    return t(spark, d, "orders").where(violates([Guard("eq", "o_orderstatus", "O")], Guard("int_gt", "o_totalprice", 100000), TYPES)).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 AND l_linenumber > 5")
def terminal_clause(spark, d):
    g = Guard("int_gt", "l_quantity", 45).column(TYPES) & Guard("int_gt", "l_linenumber", 5).column(TYPES)
    return t(spark, d, "lineitem").where(g).select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey, CASE WHEN c_mktsegment <> '' THEN c_mktsegment ELSE 'none' END AS segment, CASE WHEN c_acctbal <> 0 THEN c_acctbal ELSE 1.0 END AS balance FROM customer")
def default_chain(spark, d):
    return t(spark, d, "customer").select("c_custkey", truth.default(F.col("c_mktsegment"), "string", F.lit("none")).alias("segment"), truth.default(F.col("c_acctbal"), "double", F.lit(1.0)).alias("balance"))


@query("SELECT c_custkey, CASE WHEN nullif(c_mktsegment, 'BUILDING') <> '' THEN nullif(c_mktsegment, 'BUILDING') WHEN c_name <> '' THEN c_name ELSE 'x' END AS first_of, CASE WHEN c_name IS NULL OR c_name = '' THEN c_name ELSE c_mktsegment END AS both_of FROM customer")
def coalesce_truthy(spark, d):
    seg = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))
    return t(spark, d, "customer").select("c_custkey", truth.first_truthy([(seg, "string"), (F.col("c_name"), "string"), (F.lit("x"), "string")]).alias("first_of"), truth.first_falsy([(F.col("c_name"), "string"), (F.col("c_mktsegment"), "string")]).alias("both_of"))


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS size_class FROM part")
def ternary_dispatch(spark, d):
    return t(spark, d, "part").select("p_partkey", truth.ternary(F.lit("large"), F.lit("small"), F.col("p_size") > 25).alias("size_class"))


@query("SELECT coalesce(n_nationkey, s_suppkey) AS k, coalesce(n_name, s_name) AS left_wins, coalesce(s_name, n_name) AS right_wins FROM nation FULL JOIN supplier ON n_nationkey = s_suppkey")
def layered_merge(spark, d):
    n, s = t(spark, d, "nation"), t(spark, d, "supplier")
    j = n.join(s, n["n_nationkey"] == s["s_suppkey"], "full")
    m = lambda k, c: F.when(F.col(k).isNull(), F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("name"), F.col(c)))
    a, b = m("n_nationkey", "n_name"), m("s_suppkey", "s_name")
    return j.select(F.coalesce("n_nationkey", "s_suppkey").cast("bigint").alias("k"), F.element_at(C.merge(a, b), "name").alias("left_wins"), F.element_at(C.merge_overwrite(a, b), "name").alias("right_wins"))


@query("""WITH p AS (SELECT n_nationkey AS k, CASE WHEN n_regionkey = 0 THEN NULL ELSE n_name END AS v FROM nation), c AS (SELECT s_suppkey AS k, s_name AS v FROM supplier)
SELECT CAST(coalesce(p.k, c.k) AS BIGINT) AS k, coalesce(p.v, c.v) AS v FROM p FULL JOIN c ON p.k = c.k WHERE p.k IS NULL OR p.v IS NOT NULL""")
def composed_defaults(spark, d):
    p = t(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), F.when(F.col("n_regionkey") != 0, F.col("n_name")).alias("v"))
    return compose.compose(p, t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v")), ["k"], "v")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)")
def declared_subtract(spark, d):
    return compose.subtract(t(spark, d, "part").select("p_partkey"), t(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")), ["p_partkey"])


@query("""WITH a AS (SELECT l_partkey AS k, 1 AS r, max(l_suppkey) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 UNION ALL SELECT l_partkey, 2, min(l_suppkey) FROM lineitem GROUP BY 1)
SELECT p_partkey AS k, arg_min(v, r) AS v, min(r) AS r FROM part LEFT JOIN a ON p_partkey = k GROUP BY p_partkey""")
def precedence_lookup(spark, d):
    li = t(spark, d, "lineitem")
    one = li.where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("k")).agg(F.max("l_suppkey").alias("v")).withColumn("r", F.lit(1))
    two = li.groupBy(F.col("l_partkey").alias("k")).agg(F.min("l_suppkey").alias("v")).withColumn("r", F.lit(2))
    return catalog.precedence_lookup(t(spark, d, "part").select(F.col("p_partkey").alias("k")), one.unionByName(two), ["k"], "r", "v")


@query("""WITH h AS (SELECT DISTINCT l_partkey AS k, l_linenumber AS v FROM lineitem WHERE l_returnflag = 'R'), a AS (SELECT DISTINCT l_partkey AS k, l_linenumber AS v FROM lineitem)
SELECT a.k, a.v, max(h.v) AS found FROM a LEFT JOIN h ON a.k = h.k AND h.v BETWEEN a.v - 2 AND a.v GROUP BY a.k, a.v""")
def version_fallback(spark, d):
    a = t(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_linenumber").alias("v"), "l_returnflag")
    return catalog.fallback(a.select("k", "v").distinct(), a.where("l_returnflag = 'R'").select("k", "v"), ["k"], "v", 2)


@query("""SELECT l_orderkey, CASE count(DISTINCT l_returnflag) WHEN 1 THEN 'Resolved' WHEN 0 THEN 'NoMatch' ELSE 'Ambiguous' END AS outcome,
CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS value FROM lineitem GROUP BY l_orderkey""")
def infer_unique(spark, d):
    return catalog.resolve_unique(t(spark, d, "lineitem"), ["l_orderkey"], F.col("l_returnflag"))


@query("SELECT l_orderkey, bool_and(l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 5)) AS all_resolved FROM lineitem GROUP BY l_orderkey")
def multi_kind_all(spark, d):
    return catalog.all_resolve(t(spark, d, "lineitem").select("l_orderkey", "l_partkey"), t(spark, d, "part").where("p_size > 5").select(F.col("p_partkey").alias("l_partkey")), ["l_orderkey"], "l_partkey")


@query("SELECT r_name, seg FROM region CROSS JOIN (SELECT DISTINCT c_mktsegment AS seg FROM customer)")
def activation_cross(spark, d):
    return compose.activation_product(t(spark, d, "region").select("r_name"), t(spark, d, "customer").select(F.col("c_mktsegment").alias("seg")).distinct())


@query("SELECT event_type, origin, count(*) AS n FROM (SELECT event_type, CASE WHEN value > 0 THEN 'declared' ELSE 'inferred' END AS origin FROM events) GROUP BY ROLLUP (event_type, origin)")
def evidence_rollup(spark, d):
    return contracts.emission_report(t(spark, d, "events").select("event_type", F.when(F.col("value") > 0, "declared").otherwise("inferred").alias("origin")), "event_type", "origin")


@query("SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS hints, bool_or(value > 50) AS any_high, bool_and(value > 0) AS all_positive FROM events GROUP BY user_id")
def evidence_by_path(spark, d):
    return contracts.evidence(t(spark, d, "events"), "user_id", {"any_high": F.col("value") > 50}, {"all_positive": F.col("value") > 0}, {"hints": "event_type"})


@query("SELECT l_partkey, count(*) AS branches, max(w) AS widest FROM (SELECT l_partkey, l_returnflag, count(DISTINCT l_linestatus) AS w FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def overlay_branches(spark, d):
    out = contracts.overlays(t(spark, d, "lineitem"), "l_partkey", F.col("l_returnflag"), F.col("l_linestatus"))
    return out.withColumn("widest", F.col("widest").cast("bigint"))


@query("SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS conditions FROM lineitem GROUP BY l_orderkey")
def canonical_rows(spark, d):
    return contracts.canonicalize(t(spark, d, "lineitem"), ["l_orderkey"], "l_returnflag").withColumn("conditions", F.array_join("conditions", ","))


@query("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem l WHERE l_returnflag = 'N' OR NOT EXISTS (SELECT 1 FROM lineitem m WHERE m.l_orderkey = l.l_orderkey AND m.l_returnflag = 'N')")
def render_site_antijoin(spark, d):
    return contracts.drop_defaulted(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), ["l_orderkey"], F.col("l_returnflag") == "N")


@query("""WITH s AS (SELECT o_orderkey AS i, o_custkey AS c, list_sort(list(DISTINCT l_linenumber)) AS m FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT i, c FROM s WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.c = s.c AND list_has_all(b.m, s.m) AND (len(b.m) > len(s.m) OR len(b.m) = len(s.m) AND b.i < s.i))""")
def subsumption(spark, d):
    s = t(spark, d, "orders").join(t(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_orderkey").alias("i"), F.col("o_custkey").alias("c")).agg(F.array_sort(F.collect_set("l_linenumber")).alias("m"))
    return contracts.drop_subsumed(s, ["c"], "m", "i").select("i", "c")


@query("SELECT event_id, CAST(dense_rank() OVER (ORDER BY event_type) AS INTEGER) AS rank FROM events")
def condition_rank(spark, d):
    return contracts.rank_conditions(t(spark, d, "events").select("event_id", "event_type"), "event_type").select("event_id", "rank")


@query("SELECT conv_id, role, min(turn) AS turn, arg_min(text, turn) AS text FROM conversations GROUP BY conv_id, role")
def first_writer(spark, d):
    return contracts.first_writer(t(spark, d, "conversations").select("conv_id", "role", "turn", "text"), ["conv_id", "role"], ["turn"])


@query("SELECT event_id, user_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS n FROM events")
def span_order(spark, d):
    from pyspark.sql import Window

    return t(spark, d, "events").select("event_id", "user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint").alias("n"))


@query("""WITH p AS (SELECT sha256(text) AS digest, octet_length(encode(text)) AS size, count(*) AS uses FROM documents WHERE octet_length(encode(text)) >= 32 GROUP BY 1, 2)
SELECT digest, CAST(size AS INTEGER) AS size, uses, CAST(size * uses - (size + 24 * uses + 16) AS BIGINT) AS saved FROM p WHERE uses > 1 AND size * uses - (size + 24 * uses + 16) > 0""")
def intern_repeats(spark, d):
    return emit.repeated_payloads(t(spark, d, "documents"), "text")


@query("""WITH p AS (SELECT sha256(text) AS digest, octet_length(encode(text)) AS size, count(*) AS uses FROM documents WHERE octet_length(encode(text)) >= 32 GROUP BY 1, 2),
q AS (SELECT digest, CAST(size AS INTEGER) AS size, uses, CAST(size * uses - (size + 24 * uses + 16) AS BIGINT) AS saved FROM p WHERE uses > 1 AND size * uses - (size + 24 * uses + 16) > 0)
SELECT *, CAST(row_number() OVER (ORDER BY size DESC, uses DESC, digest) AS INTEGER) AS rank FROM q ORDER BY size DESC, uses DESC, digest LIMIT 10""")
def definition_plan(spark, d):
    return emit.definition_plan(emit.repeated_payloads(t(spark, d, "documents"), "text"), 10)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT p_size AS src, (p_size * 7 + 3) % 53 AS dst FROM part), r(node, depth) AS (SELECT 1, 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 53)
SELECT node, min(depth) AS depth FROM r GROUP BY node""")
def definition_reach(spark, d):
    e = t(spark, d, "part").select(F.col("p_size").alias("src"), ((F.col("p_size") * 7 + 3) % 53).alias("dst")).distinct()
    return graph.reach(e, spark.createDataFrame([(1,)], "node int"))


@query("""SELECT p_partkey, lower(p_name) AS low, upper(p_brand) AS up, left(p_name, 5) AS t5, right(p_name, 4) AS t4, substr(p_name, 3, 4) AS mid, repeat(p_brand, 2) AS twice, '"' || replace(replace(p_name, '\\', '\\\\'), '"', '\\"') || '"' AS quoted,
'''' || p_type || '''' AS single, '  ' || replace(p_name, chr(10), chr(10) || '  ') AS indented, contains(p_name, 'a') AS has_a, starts_with(p_type, 'S') AS pre, ends_with(p_type, 'L') AS suf FROM part""")
def string_transforms(spark, d):
    n, b, k = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    return t(spark, d, "part").select("p_partkey", F.lower(n).alias("low"), F.upper(b).alias("up"), T.trunc(n, 5).alias("t5"), T.trunc(n, -4).alias("t4"), T.substr(n, 2, 6).alias("mid"), T.repeat(b, 2).alias("twice"), T.quote(n).alias("quoted"), T.squote(k).alias("single"), T.indent(n, 2).alias("indented"), n.contains("a").alias("has_a"), k.startswith("S").alias("pre"), k.endswith("L").alias("suf"))


@query("SELECT p_partkey, regexp_replace(p_brand, '^Brand#', '') AS no_prefix, regexp_replace(p_brand, '1$', '') AS no_suffix, trim(p_brand, 'B1') AS no_ends, regexp_replace(p_name, '[aeiou]+', '-', 'g') AS vowels, replace(p_type, ' ', '_') AS snake FROM part")
def affix_trim(spark, d):
    n, b, k = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    return t(spark, d, "part").select("p_partkey", T.trim_prefix(b, "Brand#").alias("no_prefix"), T.trim_suffix(b, "1").alias("no_suffix"), T.trim_all(b, "B1").alias("no_ends"), F.regexp_replace(n, "[aeiou]+", "-").alias("vowels"), F.replace(k, F.lit(" "), F.lit("_")).alias("snake"))


@query("SELECT p_partkey, string_split(p_type, ' ')[1] AS one, len(string_split(p_type, ' ')) AS n, array_to_string(string_split(p_type, ' '), '/') AS joined, string_split(p_type, ' ')[2] AS second FROM part")
def split_join(spark, d):
    k = F.col("p_type")
    parts = T.split_list(k, " ")
    return t(spark, d, "part").select("p_partkey", C.first(parts).alias("one"), F.size(parts).cast("bigint").alias("n"), F.array_join(parts, "/").alias("joined"), F.try_element_at(T.split_map(k, " "), F.lit("_1")).alias("second"))


@query("SELECT doc_id, sha1(text) AS s1, sha256(text) AS s256, base64(encode(text)) AS enc, text AS back FROM documents")
def checksums(spark, d):
    text = F.col("text")
    return t(spark, d, "documents").select("doc_id", T.sha1sum(text).alias("s1"), T.sha256sum(text).alias("s256"), T.b64enc(text).alias("enc"), T.b64dec(T.b64enc(text)).alias("back"))


@query("""WITH b AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS v FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, len(v) AS n, v FROM b)
SELECT doc_id, CAST(coalesce(list_sum(list_transform(v, lambda x, i: (n - i + 1) * x)), 0) + n AS BIGINT) % 65521 * 65536 + CAST(1 + coalesce(list_sum(v), 0) AS BIGINT) % 65521 AS a32 FROM c UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL""")
def adler32(spark, d):
    return t(spark, d, "documents").select("doc_id", T.adler32sum(F.col("text")).alias("a32"))


@query("SELECT p_partkey, printf('%s=%d', p_brand, p_size) AS line FROM part")
def printf_lines(spark, d):
    return t(spark, d, "part").select("p_partkey", T.printf("%s=%d", F.col("p_brand"), F.col("p_size")).alias("line"))


@query("""WITH a AS (SELECT vec_id, embedding AS e FROM embeddings) SELECT vec_id, e[1] AS first_of, e[-1] AS last_of, len(e[1:len(e) - 1]) AS n_initial, len(e[2:]) AS n_rest, len(list_distinct(e)) AS n_uniq, e[2:3][1] AS second_of,
len(list_concat(e, e)) AS n_both, list_contains(e, e[3]) AS has_third, list_reverse(e)[1] AS reversed_first, len(list_filter(e, lambda x: x <> 0)) AS n_compact FROM a""")
def list_ops(spark, d):
    e = F.col("e")
    a = t(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("e"))
    big = lambda c: F.size(c).cast("bigint")
    return a.select("vec_id", C.first(e).alias("first_of"), C.last(e).alias("last_of"), big(C.initial(e)).alias("n_initial"), big(C.rest(e)).alias("n_rest"), big(C.uniq(e)).alias("n_uniq"), C.first(C.slice_of(e, 1, 3)).alias("second_of"), big(C.concat(e, e)).alias("n_both"), F.array_contains(e, F.get(e, F.lit(2))).alias("has_third"), C.first(F.reverse(e)).alias("reversed_first"), big(C.compact(e, "float")).alias("n_compact"))


@query("""SELECT event_id, CAST(coalesce(json_extract_string(props, '$.k'), '') AS VARCHAR) AS got, '' AS missing, len(json_keys(props)) AS n_keys, list_contains(json_keys(props), 'k') AS has_k FROM events""")
def map_ops(spark, d):
    m = F.from_json("props", "map<string,string>")
    e = t(spark, d, "events").withColumn("m", m)
    return e.select("event_id", C.get(C.pick(F.col("m"), "k"), "k").alias("got"), C.get(C.omit(F.col("m"), "k"), "k").alias("missing"), F.size(C.keys(F.col("m"))).cast("bigint").alias("n_keys"), F.map_contains_key("m", "k").alias("has_k"))


@query("""SELECT l_orderkey, l_linenumber, coalesce(CAST(trunc(TRY_CAST(l_returnflag AS DOUBLE)) AS BIGINT), 0) AS total_int, l_linenumber + 1 AS plus, greatest(l_linenumber, 3) AS most, least(l_linenumber, 3) AS fewest, CAST(floor(l_quantity / 7) AS BIGINT) AS low, CAST(ceil(l_quantity / 7) AS BIGINT) AS high,
CAST(trunc(l_extendedprice) AS BIGINT) AS cut FROM lineitem""")
def numeric_cast(spark, d):
    n = F.col("l_linenumber")
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C.to_int(F.col("l_returnflag")).alias("total_int"), (n + 1).alias("plus"), F.greatest(n, F.lit(3)).alias("most"), F.least(n, F.lit(3)).alias("fewest"), F.floor(F.col("l_quantity") / 7).alias("low"), F.ceil(F.col("l_quantity") / 7).alias("high"), C.to_int(F.col("l_extendedprice")).alias("cut"))


@query("SELECT p_partkey, (p_size // 10, p_size % 10) >= (2, 5) AND p_size // 10 = 2 AS caret, (p_size // 10, p_size % 10) < (3, 0) AS below FROM part")
def semver_compare(spark, d):
    v = F.concat(F.lit("v"), F.floor(F.col("p_size") / 10).cast("string"), F.lit("."), (F.col("p_size") % 10).cast("string"), F.lit(".0"))
    return t(spark, d, "part").select("p_partkey", T.semver_compare("^2.5.0", v).alias("caret"), T.semver_compare("<3.0.0", v).alias("below"))


@query(r"""SELECT page_id, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:(//[^/?#]*)?[^?#]*(\?[^#]*)?(#.*)?$') AS ok, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) AS scheme, regexp_extract(url, '//([^/?#]*)', 1) AS host, false AS ip, false AS duration FROM pages""")
def url_contract(spark, d):
    u = F.col("url")
    return t(spark, d, "pages").select("page_id", T.is_url(u).alias("ok"), T.url_part(u, "scheme").alias("scheme"), T.url_part(u, "host").alias("host"), T.is_ip(u).alias("ip"), T.is_duration(u).alias("duration"))


@query("SELECT 'union' AS op, x FROM (SELECT p_brand AS x FROM part UNION SELECT s_name FROM supplier) UNION ALL SELECT 'intersect', x FROM (SELECT p_brand AS x FROM part WHERE p_size > 10 INTERSECT SELECT p_brand FROM part WHERE p_size < 5) UNION ALL SELECT 'except', x FROM (SELECT p_type AS x FROM part EXCEPT SELECT p_type FROM part WHERE p_size > 25)")
def path_sets(spark, d):
    p, s = t(spark, d, "part"), t(spark, d, "supplier")
    b = lambda df, c: df.select(F.col(c).alias("x"))
    u, i, e = compose.union_paths(b(p, "p_brand"), b(s, "s_name")), compose.intersect_paths(b(p.where("p_size > 10"), "p_brand"), b(p.where("p_size < 5"), "p_brand")), compose.except_paths(b(p, "p_type"), b(p.where("p_size > 25"), "p_type"))
    return u.select(F.lit("union").alias("op"), "x").union(i.select(F.lit("intersect"), "x")).union(e.select(F.lit("except"), "x"))


@query("""WITH a AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS path FROM pages), p AS (SELECT DISTINCT string_split(path, '.')[1] AS prefix FROM a)
SELECT page_id, path, prefix FROM a JOIN p ON starts_with(path, prefix || '.')""")
def ancestor_join(spark, d):
    a = t(spark, d, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("path"))
    return compose.prefix_join(a, a.select(F.split("path", r"\.")[0].alias("prefix")).distinct(), "path", "prefix").select("page_id", "path", "prefix")


@query("SELECT event_type, '{\"properties\":{\"k\":{\"type\":\"integer\"}},\"type\":\"object\"}' AS schema FROM events GROUP BY event_type")
def lattice_merge(spark, d):
    return lattice.fold_schemas(t(spark, d, "events"), "props", "event_type")


@query("SELECT path FROM (VALUES ('o_custkey'), ('o_orderstatus'), ('items.*.l_linenumber'), ('items.*.l_quantity'), ('items.*.l_returnflag')) v(path)")
def required_inference(spark, d):
    return path_profile(spark, d).where("required").select("path")
