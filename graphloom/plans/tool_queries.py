"""Queries of the agent tools (M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import adhoc, reads, tools, traverse
from ..operators.graph import prop
from ..sources.tables import table
from ..sources.trade_graph import SQL as TRADE
from ..sources.trade_graph import trade_graph
from .graph_queries import _ARC, _EPS, CODE, code_graph, hub
from .registry import Registry

REGISTRY = Registry()
query = REGISTRY.query

_RANK = "CASE type WHEN 'class' THEN 0 WHEN 'function' THEN 1 WHEN 'interface' THEN 2 WHEN 'type_alias' THEN 3 WHEN 'enum' THEN 4 WHEN 'entity' THEN 5 WHEN 'component' THEN 6 WHEN 'route' THEN 7 WHEN 'variable' THEN 8 ELSE 99 END"
_FOLDED = f"p AS (SELECT name, file_path, start_line, (min({{'k': {_RANK}, 'id': id, 't': type}})).id AS id, (min({{'k': {_RANK}, 'id': id, 't': type}})).t AS type, array_to_string(list_transform(list_sort(list(DISTINCT {{'k': {_RANK}, 't': type}})), lambda x: x.t), ',') AS kinds FROM n WHERE {_RANK} < 99 @@ GROUP BY name, file_path, start_line)"


@query("m01_search_symbols", f"WITH {CODE}, {_FOLDED.replace('@@', 'AND contains(lower(name), $$ledger$$) AND contains(lower(name), $$e$$)')} SELECT * FROM p ORDER BY CASE WHEN lower(name) = 'ledger e' THEN 0 ELSE 1 END, lower(name), coalesce(file_path, ''), id LIMIT 30 OFFSET 5")
def m01(spark, d):
    return tools.search_symbols(code_graph(spark, d), "ledger e", offset=5, limit=30)


@query("m02_one_per_place", f"WITH {CODE}, {_FOLDED.replace('@@', '')} SELECT * FROM p")
def m02(spark, d):
    return tools.one_per_place(code_graph(spark, d).some(*tools.KINDS, columns=reads.PLACE))


@query("m03_semantic_search", "WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 2) AS score FROM embeddings, q ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) DESC, vec_id LIMIT 25")
def m03(spark, d):
    """The vectors nearest to the one of the least id."""
    e = table(spark, d, "embeddings")
    q = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))
    return tools.semantic_search(e, "vec_id", "embedding", q, 25)


@query("m04_entrypoints_by_type", f"WITH {CODE}, {_EPS} SELECT kind, count(*) AS n, min(address) AS first FROM eps GROUP BY ALL")
def m04(spark, d):
    e = code_graph(spark, d).some("entrypoint", columns=("name", "properties")).select(F.coalesce(prop("entrypointType"), F.lit("")).alias("kind"), F.coalesce(prop("path"), prop("fullPath"), F.col("name")).alias("address"))
    return e.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("address").alias("first"))


@query("m05_describe_repositories", f"""WITH {CODE}, x AS (SELECT repo_id, count(*) FILTER (type = 'package') AS n_packages, count(*) FILTER (type = 'entrypoint') AS n_entrypoints, count(*) FILTER (json_extract_string(properties, '$.entrypointType') IN ('http', 'graphql', 'grpc')) AS web, count(*) FILTER (json_extract_string(properties, '$.entrypointType') = 'cli') AS cli FROM n WHERE type IN ('package', 'entrypoint', 'repository') GROUP BY ALL)
SELECT repo_id, CASE WHEN n_packages > 1 THEN 'monorepo' WHEN web > 0 THEN 'backend' WHEN cli > 0 THEN 'cli' ELSE 'library' END AS kind, n_packages, n_entrypoints FROM x""")
def m05(spark, d):
    return tools.describe_repositories(code_graph(spark, d))


@query("m06_describe_schema", f"WITH {CODE} SELECT id, i AS ordinal, json_extract_string(m[i], '$.name') AS member, json_extract_string(m[i], '$.value') AS value FROM (SELECT id, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT id, CAST(json_extract(properties, '$.members') AS JSON[]) AS m FROM n WHERE type = 'enum'))")
def m06(spark, d):
    """Members of every enum with their place; entities here have no fields."""
    m = F.from_json(F.get_json_object("properties", "$.members"), "array<struct<name: string, value: string>>")
    n = code_graph(spark, d).some("enum", columns=("properties",)).select("id", F.posexplode(m).alias("p", "x"))
    return n.select("id", (F.col("p") + 1).cast("long").alias("ordinal"), F.col("x.name").alias("member"), F.col("x.value").alias("value"))


@query("m07_coverage_rates", f"""WITH {TRADE}, c AS (SELECT repo AS repo_id, 'f' AS t, id IN (SELECT source_id FROM calls) AS hit FROM fn UNION ALL SELECT 'r0', 'e', id IN (SELECT target_id FROM ops) FROM ent UNION ALL SELECT repo, 'x', true FROM ext)
SELECT repo_id, round(coalesce(count(*) FILTER (t = 'f' AND hit) / nullif(count(*) FILTER (t = 'f'), 0), 0), 6) AS call_rate, round(coalesce(count(*) FILTER (t = 'e' AND hit) / nullif(count(*) FILTER (t = 'e'), 0), 0), 6) AS entity_rate, round(coalesce(count(*) FILTER (t = 'x' AND hit) / nullif(count(*) FILTER (t = 'x'), 0), 0), 6) AS external_rate, false AS low_external FROM c GROUP BY ALL""")
def m07(spark, d):
    return tools.coverage_rates(trade_graph(spark, d)[0])


@query("m08_find_callers", f"""WITH RECURSIVE {CODE}, {_ARC}, t AS (SELECT DISTINCT target_id AS id FROM e WHERE type = 'HANDLES' AND target_id IN (SELECT id FROM n WHERE type = 'function')), w AS (SELECT id AS root, id, 0 AS d FROM t UNION SELECT root, arc.a, d + 1 FROM w JOIN arc ON arc.b = w.id WHERE d < 2)
SELECT root AS target_id, id AS caller_id, min(d) AS distance FROM w GROUP BY ALL HAVING min(d) > 0""")
def m08(spark, d):
    """Callers within two hops of every function that handles an entrypoint."""
    return traverse.callers_with_interfaces(code_graph(spark, d), 2)


@query("m09_find_dependents", f"""WITH {TRADE}, u AS (SELECT 'r0:class:' || p_brand AS target_id, 'r0:class:' || p_type AS user_id, 0 AS r, 'extends' AS kind FROM part UNION ALL SELECT 'r0:interface:size-' || p_size, 'r0:class:' || p_type, 0, 'implements_interface' FROM part
  UNION ALL SELECT 'r0:interface:size-' || CAST(ent.k % 50 AS BIGINT), source_id, 1, 'parameter' FROM ops JOIN ent ON ent.id = target_id) SELECT target_id, user_id, (min({{'r': r, 'k': kind}})).k AS kind FROM u GROUP BY ALL""")
def m09(spark, d):
    return tools.dependents(trade_graph(spark, d)[0])


@query("m10_find_entity_usage", f"WITH {TRADE} SELECT e.name AS entity, operation, count(DISTINCT source_id) AS n_functions FROM ops JOIN ent e ON e.id = target_id GROUP BY ALL")
def m10(spark, d):
    g = trade_graph(spark, d)[0]
    e = g.some("entity", columns=("name",)).select(F.col("id").alias("entity_id"), F.col("name").alias("entity"))
    return reads.entity_consumers(g).join(e, "entity_id").groupBy("entity", "operation").agg(F.count_distinct("function_id").alias("n_functions"))


@query("m11_change_impact", f"""WITH RECURSIVE {CODE}, {_ARC}, t AS (SELECT DISTINCT target_id AS id FROM e WHERE type = 'HANDLES'), w AS (SELECT id AS root, id, 0 AS d FROM t UNION SELECT root, arc.a, d + 1 FROM w JOIN arc ON arc.b = w.id WHERE d < 2), s AS (SELECT root, id, min(d) AS d FROM w GROUP BY ALL),
h AS (SELECT DISTINCT source_id AS ep, target_id AS id FROM e WHERE type = 'HANDLES'), x AS (SELECT root, count(DISTINCT ep) AS k FROM s JOIN h USING (id) GROUP BY ALL),
c AS (SELECT root, count(*) FILTER (d = 1) AS n_direct, count(*) FILTER (d > 1) AS n_transitive, count(DISTINCT split_part(s.id, ':', 1)) FILTER (split_part(s.id, ':', 1) <> split_part(root, ':', 1)) AS n_repos, count(*) FILTER (d > 0 AND coalesce(regexp_matches(lower(file_path), '(?:^|/)(?:tests?|__tests__|spec)/|[._-](?:test|spec)\\.'), false)) AS n_tests FROM s LEFT JOIN n ON n.id = s.id GROUP BY ALL)
SELECT c.root AS target_id, n_direct, n_transitive, coalesce(k, 0) AS n_entrypoints, n_repos, n_tests, CASE WHEN n_direct + 3 * coalesce(k, 0) + 5 * n_repos >= 20 THEN 'high' WHEN n_direct + 3 * coalesce(k, 0) + 5 * n_repos >= 8 THEN 'medium' ELSE 'low' END AS risk FROM c LEFT JOIN x USING (root)""")
def m11(spark, d):
    """Impact of a change of every function that handles an entrypoint."""
    g = code_graph(spark, d)
    return tools.change_impact(g, g.pairs("HANDLES").select(F.col("target_id").alias("id")).distinct(), 2)


@query("m12_service_dependencies", f"WITH {TRADE} SELECT repo AS from_repo, service, count(*) AS n_calls, count(ep_repo) AS n_resolved, 'http' AS protocols, count(DISTINCT path) AS n_patterns FROM ext WHERE repo <> ep_repo GROUP BY ALL")
def m12(spark, d):
    return tools.service_dependencies(trade_graph(spark, d)[0])


_MSG = """WITH p AS (SELECT 'r' || (user_id % 5) AS repo_id, 'kafka' AS system, 'ref-' || (k % 30) AS ref FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)), c AS (SELECT 'r' || (s_nationkey % 5) AS repo_id, 'kafka' AS system, CASE WHEN s_suppkey % 2 = 0 THEN 'topic-' || (s_suppkey % 10) ELSE 'ref-' || (s_suppkey % 25) END AS ref FROM supplier),
a AS (SELECT DISTINCT 'kafka' AS system, 'ref-' || (p_partkey % 20) AS ref, 'topic-' || CASE WHEN p_partkey % 20 > 15 THEN p_size % 10 ELSE p_partkey % 20 % 10 END AS value FROM part), s AS (SELECT system, ref, min(value) AS value FROM a GROUP BY ALL HAVING count(DISTINCT value) = 1),
pp AS (SELECT p.system, coalesce(value, p.ref) AS destination, count(*) AS n, list(DISTINCT repo_id) AS r FROM p LEFT JOIN s ON p.system = s.system AND p.ref = s.ref GROUP BY ALL), cc AS (SELECT c.system, coalesce(value, c.ref) AS destination, count(*) AS n, list(DISTINCT repo_id) AS r FROM c LEFT JOIN s ON c.system = s.system AND c.ref = s.ref GROUP BY ALL)
SELECT pp.system, pp.destination, pp.n AS n_producers, cc.n AS n_consumers, len(list_distinct(list_concat(pp.r, cc.r))) > 1 AS cross FROM pp JOIN cc ON pp.system = cc.system AND pp.destination = cc.destination"""


@query("m13_message_pairs", _MSG.replace(" AS cross FROM", ' AS "cross" FROM'))
def m13(spark, d):
    k, s, p = F.get_json_object("props", "$.k").cast("long"), F.col("s_suppkey"), F.col("p_partkey")
    sys = F.lit("kafka").alias("system")
    producers = table(spark, d, "events").select(F.concat(F.lit("r"), F.col("user_id") % 5).alias("repo_id"), sys, F.concat(F.lit("ref-"), k % 30).alias("ref"))
    consumers = table(spark, d, "supplier").select(F.concat(F.lit("r"), F.col("s_nationkey") % 5).alias("repo_id"), sys, F.when(s % 2 == 0, F.concat(F.lit("topic-"), s % 10)).otherwise(F.concat(F.lit("ref-"), s % 25)).alias("ref"))
    aliases = table(spark, d, "part").select(sys, F.concat(F.lit("ref-"), p % 20).alias("ref"), F.concat(F.lit("topic-"), F.when(p % 20 > 15, (F.col("p_size") % 10).cast("long")).otherwise(p % 20 % 10)).alias("value"))
    return tools.message_pairs(producers, consumers, aliases)


@query("m15_explain", f"WITH {TRADE}, f AS (SELECT DISTINCT fn.id, name, file FROM fn JOIN handles ON target_id = fn.id), x AS (SELECT DISTINCT source_id, target_id FROM calls) SELECT id, name, file AS file_path, (SELECT count(*) FROM x WHERE target_id = f.id) AS n_callers, (SELECT count(*) FROM x WHERE source_id = f.id) AS n_callees, (SELECT count(DISTINCT target_id) FROM ops WHERE source_id = f.id) AS n_entities, (SELECT count(*) FROM ext WHERE caller = f.id) AS n_external, (SELECT count(*) FROM handles WHERE target_id = f.id) AS n_entrypoints FROM f")
def m15(spark, d):
    g = trade_graph(spark, d)[0]
    return tools.explain(g, g.pairs("HANDLES").select(F.col("target_id").alias("id")))


@query("m16_ambiguous_names", f"WITH {CODE} SELECT name, count(*) AS n, min(id) AS chosen FROM n WHERE type = 'class' GROUP BY name HAVING count(*) > 1")
def m16(spark, d):
    return tools.ambiguous_names(code_graph(spark, d), "class")


@query("m17_parse_function_names", r"""WITH x AS (SELECT DISTINCT regexp_extract(id, '[^:]*$') AS t FROM nodes WHERE type = 'function') SELECT t AS input, CASE WHEN regexp_matches(t, '^[^/\\\s(]+\.[^/\\\s(.]+$') THEN regexp_extract(t, '([^.]*)$', 1) ELSE t END AS name, CASE WHEN regexp_matches(t, '^[^/\\\s(]+\.[^/\\\s(.]+$') THEN regexp_extract(t, '^(.*)\.[^.]*$', 1) END AS class_name FROM x""")
def m17(spark, d):
    n = table(spark, d, "nodes").where("type = 'function'").select(F.regexp_extract("id", "[^:]*$", 0).alias("input")).distinct()
    name, owner = tools.parse_function_name(F.col("input"))
    return n.select("input", name.alias("name"), owner.alias("class_name"))


@query("m18_method_match", f"WITH {CODE}, {_EPS} SELECT r AS requested, count(*) AS n FROM eps, (VALUES ('get'), ('ALL'), ('PATCH'), ('')) t(r) WHERE r IN ('', 'ALL') OR upper(method) IN ('ALL', '*', 'ANY') OR upper(method) = upper(r) GROUP BY ALL")
def m18(spark, d):
    asked = spark.createDataFrame([("get",), ("ALL",), ("PATCH",), ("",)], "requested string")
    e = code_graph(spark, d).some("entrypoint", columns=("properties",)).select(F.coalesce(prop("method"), F.lit("")).alias("method"))
    return e.join(F.broadcast(asked), tools.method_matches(F.col("requested"), F.col("method"))).groupBy("requested").agg(F.count(F.lit(1)).alias("n"))


@query("m20_dynamic_boundaries", f"WITH {TRADE}, u AS (SELECT *, row_number() OVER (PARTITION BY callee_name_tail ORDER BY file_path, line, caller_id) AS r FROM un) SELECT callee_name_tail AS name, count(*) AS n_calls, string_agg(file_path || ':' || line, ' ' ORDER BY r) FILTER (r <= 5) AS sample FROM u WHERE callee_name_tail IN ('call_1', 'call_2') GROUP BY ALL")
def m20(spark, d):
    return tools.dynamic_boundaries(trade_graph(spark, d)[1], spark.createDataFrame([("call_1",), ("call_2",), ("none",)], "name string"))


@query("m21_guard_verdict", "SELECT false AS allowed")
def m21(spark, d):
    """A write is refused."""
    return adhoc.rows_or_reason(code_graph(spark, d), "insert into nodes values (1)").select("allowed")


@query("m26_node_details", f"WITH {CODE} SELECT id, json_extract_string(properties, '$.kind') AS kind, json_extract_string(properties, '$.isAsync') = 'true' AS is_async, TRY_CAST(json_extract_string(properties, '$.complexity') AS DOUBLE) AS complexity, json_extract_string(properties, '$.returnType') AS return_type FROM n WHERE type = 'function'")
def m26(spark, d):
    """The typed view of the bag of every function."""
    n = code_graph(spark, d).some("function", columns=("properties",))
    return n.select("id", prop("kind").alias("kind"), (prop("isAsync") == "true").alias("is_async"), prop("complexity").try_cast("double").alias("complexity"), prop("returnType").alias("return_type"))


@query("m25_explorer_subgraph", f"WITH {CODE} SELECT e.type, count(*) AS n FROM e, hub WHERE source_id = hub.id OR target_id = hub.id GROUP BY ALL")
def m25(spark, d):
    """Edges at the hub by type, as the explorer shows them."""
    g = code_graph(spark, d)
    h = F.broadcast(hub(g).select(F.col("id").alias("me")))
    return g.links().join(h, (F.col("source_id") == F.col("me")) | (F.col("target_id") == F.col("me"))).groupBy("type").agg(F.count(F.lit(1)).alias("n"))
