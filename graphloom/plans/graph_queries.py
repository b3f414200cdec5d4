"""Queries of the graph reads (G), over the code graph of nodes and edges and,
for kinds of nodes and edges which that lacks, over the graph of the orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import adhoc, reads, traverse
from ..operators.graph import NODE_TYPES, Graph, prop
from ..sources.tables import table
from ..sources.trade_graph import SQL as TRADE
from ..sources.trade_graph import trade_graph
from .registry import Registry

REGISTRY = Registry()
query = REGISTRY.query

#: Nodes and edges once each: n and e.
CODE = """
n AS (SELECT id, min(type) AS type, min(name) AS name, min(properties) AS properties, min(summary) AS summary, min(repo_id) AS repo_id, min(file_path) AS file_path, min(start_line) AS start_line
  FROM nodes WHERE id IS NOT NULL GROUP BY id),
e AS (SELECT id, min(source_id) AS source_id, min(target_id) AS target_id, min(type) AS type, min(confidence) AS confidence, min(created_by) AS created_by, min(properties) AS properties
  FROM edges WHERE id IS NOT NULL GROUP BY id),
hub AS (SELECT target_id AS id FROM e WHERE type = 'CALLS' AND source_id <> target_id GROUP BY 1 ORDER BY count(DISTINCT source_id) DESC, 1 LIMIT 1),
busy AS (SELECT source_id AS id FROM e WHERE type = 'CALLS' AND source_id <> target_id GROUP BY 1 ORDER BY count(DISTINCT target_id) DESC, 1 LIMIT 1)"""
_ARC = "arc AS (SELECT DISTINCT source_id AS a, target_id AS b FROM e WHERE type = 'CALLS' AND source_id <> target_id)"


def code_graph(spark, d) -> Graph:
    """The graph of the tables nodes and edges."""
    return Graph(table(spark, d, "nodes"), table(spark, d, "edges"))


def _trade(spark, d) -> Graph:
    return trade_graph(spark, d)[0]


def _most(g: Graph, end: str, other: str):
    """The node (column id) with the most distinct callers or callees."""
    p = g.pairs("CALLS").where("source_id <> target_id").groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return p.orderBy(F.desc("n"), "id").limit(1).select("id")


def hub(g: Graph):
    """The function with the most callers."""
    return _most(g, "target_id", "source_id")


def busy(g: Graph):
    """The function with the most callees."""
    return _most(g, "source_id", "target_id")


def _least_name(g: Graph, kind: str):
    return g.node_rows(kind).agg(F.min("name").alias("name")).where("name is not null")


@query("g01_find_code", f"WITH {CODE} SELECT id, type, name, repo_id, file_path, start_line FROM n WHERE lower(name) LIKE '%ledger%' AND type IN ('function', 'class', 'variable') ORDER BY lower(name), coalesce(file_path, ''), id LIMIT 200")
def g01(spark, d):
    return reads.find_code(code_graph(spark, d), "*LEDGER*", ("function", "class", "variable"), 200)


@query("g02_symbols_in_file", f"WITH {CODE} SELECT id, type, name, repo_id, file_path, start_line FROM n WHERE type <> 'file' AND (file_path = 'core.js' OR suffix(file_path, '/core.js'))")
def g02(spark, d):
    return reads.symbols_in_file(code_graph(spark, d), "core.js")


@query("g03_find_function", f"WITH {CODE} SELECT id, name, repo_id, file_path, start_line, properties, CAST(NULL AS VARCHAR) AS class_name FROM n WHERE type = 'function' AND name = (SELECT min(name) FROM nodes WHERE type = 'function')")
def g03(spark, d):
    g = code_graph(spark, d)
    return reads.find_function(g, _least_name(g, "function"))


def _register_named(name: str, kind: str) -> None:
    def run(spark, d):
        g = code_graph(spark, d)
        return reads.find_named(g, kind, _least_name(g, kind))

    REGISTRY.add(name, run, f"WITH {CODE} SELECT id, name, repo_id, file_path, start_line, properties FROM n WHERE type = '{kind}' AND name = (SELECT min(name) FROM nodes WHERE type = '{kind}')")


for _name, _kind in (("g04_find_class", "class"), ("g05_find_interface", "interface"), ("g06_find_enum", "enum"), ("g07_find_type_alias", "type_alias")):
    _register_named(_name, _kind)


@query("g08_find_entity", f"WITH {TRADE} SELECT id, 'entity' AS type, name, json_object('tableName', tbl) AS properties, CAST(NULL AS VARCHAR) AS summary, 'r0' AS repo_id, CAST(NULL AS VARCHAR) AS file_path, CAST(NULL AS BIGINT) AS start_line, CAST(NULL AS BIGINT) AS end_line FROM ent WHERE tbl = 'Brand#13' OR name = 'Brand#13'")
def g08(spark, d):
    return reads.find_entity(_trade(spark, d), "Brand#13")


@query("g09_list_entities", f"WITH {TRADE} SELECT id, name FROM ent")
def g09(spark, d):
    return _trade(spark, d).some("entity", columns=("name",)).select("id", "name").orderBy("name", "id")


_EPS = "eps AS (SELECT id, repo_id, coalesce(json_extract_string(properties, '$.entrypointType'), '') AS kind, coalesce(json_extract_string(properties, '$.method'), '') AS method, coalesce(json_extract_string(properties, '$.path'), json_extract_string(properties, '$.fullPath'), name) AS address FROM n WHERE type = 'entrypoint')"


@query("g10_list_entrypoints", f"WITH {CODE}, {_EPS} SELECT * FROM eps ORDER BY kind, address, id LIMIT 1000")
def g10(spark, d):
    return reads.list_entrypoints(code_graph(spark, d), limit=1000)


@query("g10_entrypoints_by_path", f"WITH {CODE}, {_EPS} SELECT * FROM eps WHERE kind = 'http' AND regexp_replace(lower(address), '/(\\{{[^}}]*\\}}|:[a-z_]\\w*)', '/:p', 'g') LIKE '%/:p%' ORDER BY kind, address, id LIMIT 1000")
def g10b(spark, d):
    return reads.list_entrypoints(code_graph(spark, d), "http", "/:p", 1000)


@query("g11_repo_overview", f"WITH {CODE} SELECT repo_id, {', '.join(f'''count(*) FILTER (type = '{t}') AS n_{t}''' for t in NODE_TYPES)}, coalesce(string_agg(DISTINCT CASE WHEN type = 'entrypoint' THEN json_extract_string(properties, '$.entrypointType') END, ',' ORDER BY CASE WHEN type = 'entrypoint' THEN json_extract_string(properties, '$.entrypointType') END), '') AS entrypoint_types FROM n GROUP BY repo_id")
def g11(spark, d):
    return reads.repo_overview(code_graph(spark, d))


@query("g12_coverage_counts", f"""WITH {TRADE}
SELECT repo_id, count(*) FILTER (t = 'f') AS n_function, count(*) FILTER (t = 'f' AND hit) AS n_function_covered, count(*) FILTER (t = 'e') AS n_entity, count(*) FILTER (t = 'e' AND hit) AS n_entity_covered,
  count(*) FILTER (t = 'x') AS n_external_call, count(*) FILTER (t = 'x' AND hit) AS n_external_call_covered FROM (
  SELECT repo AS repo_id, 'f' AS t, id IN (SELECT source_id FROM calls) AS hit FROM fn UNION ALL SELECT 'r0', 'e', id IN (SELECT target_id FROM ops) FROM ent UNION ALL SELECT repo, 'x', true FROM ext) GROUP BY repo_id""")
def g12(spark, d):
    return reads.coverage_counts(_trade(spark, d))


@query("g13_list_repositories", f"WITH {CODE} SELECT id, name, repo_id FROM n WHERE type = 'repository' AND lower(name) LIKE '%e%'")
def g13(spark, d):
    return reads.repositories(code_graph(spark, d), "E").orderBy("name", "id")


@query("g14_repository_names", f"WITH {CODE} SELECT repo_id, name FROM n WHERE type = 'repository'")
def g14(spark, d):
    return reads.repositories(code_graph(spark, d)).select("repo_id", "name")


@query("g15_packages", f"WITH {CODE} SELECT id, name, repo_id, json_extract_string(properties, '$.version') AS version FROM n WHERE type = 'package'")
def g15(spark, d):
    return code_graph(spark, d).some("package", columns=("name", "repo_id", "properties")).select("id", "name", "repo_id", prop("version").alias("version")).orderBy("name", "id")


@query("g16_package_linker_facts", f"WITH {CODE} SELECT repo_id, file_path, count(*) AS n_exported, string_agg(name, ',' ORDER BY name) AS exported FROM (SELECT DISTINCT repo_id, file_path, name FROM n WHERE type IN ('function', 'class', 'interface', 'variable', 'enum') AND json_extract_string(properties, '$.isExported') = 'true') GROUP BY ALL")
def g16(spark, d):
    """Exported declarations of every file."""
    n = code_graph(spark, d).some("function", "class", "interface", "variable", "enum", columns=("name", "repo_id", "file_path", "properties")).where(prop("isExported") == "true")
    return n.groupBy("repo_id", "file_path").agg(F.count_distinct("name").alias("n_exported"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("exported"))


@query("g17_embedded_nodes", "SELECT id, min(name) AS name, min(repo_id) AS repo_id, CAST(min(len(embedding)) AS INTEGER) AS width FROM nodes WHERE embedding IS NOT NULL AND id IS NOT NULL GROUP BY id")
def g17(spark, d):
    return reads.embedded_nodes(code_graph(spark, d))


_LINE = "coalesce(CAST(json_extract_string(properties, '$.line') AS BIGINT), 0)"


@query("g18_direct_callers", f"""WITH {CODE}, r AS (SELECT target_id, source_id, min({{'p': CASE WHEN type = 'CALLS' THEN 0 ELSE 1 END, 'line': {_LINE}, 'i': coalesce(json_extract_string(properties, '$.inferred'), 'false'), 't': type}}) AS r
  FROM edges WHERE type IN ('CALLS', 'REFERENCES_VARIABLE') GROUP BY ALL)
SELECT target_id, source_id AS caller_id, r.t AS via, r.line AS line, r.i = 'true' AS inferred FROM r""")
def g18(spark, d):
    """Direct callers of every function."""
    g = code_graph(spark, d)
    return reads.direct_callers(g, g.node_rows().select("id").union(g.edges.select("target_id")).distinct())


@query("g19_transitive_callers", f"""WITH RECURSIVE {CODE}, {_ARC}, w AS (SELECT id, 0 AS d FROM hub UNION SELECT arc.a, d + 1 FROM w JOIN arc ON arc.b = w.id WHERE d < 4)
SELECT (SELECT id FROM hub) AS target_id, id AS caller_id, min(d) AS distance FROM w GROUP BY id HAVING min(d) > 0 ORDER BY min(d), id LIMIT 1000""")
def g19(spark, d):
    g = code_graph(spark, d)
    return traverse.transitive_callers(g, hub(g), 4, 1000)


_HANDLE = "h AS (SELECT DISTINCT source_id AS ep, target_id AS id FROM e WHERE type = 'HANDLES')"


@query("g20_reaching_entrypoints", f"""WITH RECURSIVE {CODE}, {_ARC}, {_HANDLE}, w AS (SELECT id, 0 AS d FROM hub UNION SELECT arc.a, d + 1 FROM w JOIN arc ON arc.b = w.id WHERE d < 6)
SELECT (SELECT id FROM hub) AS target_id, ep AS entrypoint_id, min(d) AS distance FROM w JOIN h USING (id) GROUP BY ep ORDER BY min(d), ep LIMIT 1000""")
def g20(spark, d):
    g = code_graph(spark, d)
    return traverse.reaching_entrypoints(g, hub(g), 6, 1000)


def _far(g: Graph):
    """The least caller among those of the hub at the second level, or hub."""
    return hub(g)


@query("g21_shortest_path", f"""WITH RECURSIVE {CODE}, {_ARC}, back AS (SELECT id, 0 AS d FROM hub UNION SELECT arc.a, d + 1 FROM back JOIN arc ON arc.b = back.id WHERE d < 10),
dist AS (SELECT id, min(d) AS d FROM back GROUP BY id), start AS (SELECT id, d FROM dist WHERE id = (SELECT a FROM (SELECT id AS a, d FROM dist ORDER BY d DESC, id LIMIT 1))),
p AS (SELECT id, d, [id] AS path FROM start UNION ALL SELECT dist.id, dist.d, list_append(p.path, dist.id) FROM p JOIN arc ON arc.a = p.id JOIN dist ON dist.id = arc.b AND dist.d = p.d - 1),
best AS (SELECT min(path) AS path FROM p WHERE d = 0)
SELECT CAST(i - 1 AS INTEGER) AS step, path[i] AS id FROM (SELECT path, unnest(range(1, len(path) + 1)) AS i FROM best)""")
def g21(spark, d):
    """From the farthest caller of the hub (the least id of those) to the hub."""
    from ..scale import Scratch

    g = code_graph(spark, d)
    s = Scratch(spark, "far")
    target = s.keep(hub(g))
    seen = traverse.walk(traverse.arcs(g, "CALLS", direction="in"), target.select(F.col("id").alias("root"), "id"), 10, s)
    return traverse.shortest_path(g, s.keep(seen.orderBy(F.desc("distance"), "id").limit(1).select("id")), target)


@query("g22_call_tree", f"""WITH RECURSIVE {CODE}, {_ARC}, w AS (SELECT id, 0 AS d FROM busy UNION SELECT arc.b, d + 1 FROM w JOIN arc ON arc.a = w.id WHERE d < 3)
SELECT w.id, name, min(d) AS depth FROM w JOIN n USING (id) GROUP BY ALL ORDER BY min(d), name, w.id LIMIT 200""")
def g22(spark, d):
    g = code_graph(spark, d)
    return traverse.call_tree(g, busy(g), 3)


@query("g23_direct_callees", f"SELECT source_id, target_id AS callee_id, min({_LINE}) AS line FROM edges WHERE type = 'CALLS' GROUP BY ALL")
def g23(spark, d):
    g = code_graph(spark, d)
    return reads.direct_callees(g, g.edges.select(F.col("source_id").alias("id")))


@query("g24_class_extensions", "SELECT DISTINCT 'r0:class:' || p_brand AS target_id, 'r0:class:' || p_type AS child_id, p_type AS child_name FROM part")
def g24(spark, d):
    return reads.incoming(_trade(spark, d), "EXTENDS")


@query("g25_interface_implementations", "SELECT DISTINCT 'r0:interface:size-' || p_size AS target_id, 'r0:class:' || p_type AS child_id, p_type AS child_name FROM part")
def g25(spark, d):
    return reads.incoming(_trade(spark, d), "IMPLEMENTS_INTERFACE")


@query("g26_entity_consumers", f"WITH {TRADE} SELECT target_id AS entity_id, operation, source_id AS function_id, f.file AS file_path, CAST(NULL AS VARCHAR) AS class_name FROM ops JOIN fn f ON f.id = source_id WHERE operation = 'R'")
def g26(spark, d):
    return reads.entity_consumers(_trade(spark, d), operation="R")


@query("g27_type_usages", f"WITH {TRADE} SELECT DISTINCT 'r0:interface:size-' || CAST(ent.k % 50 AS BIGINT) AS target_id, source_id AS user_id, 'parameter' AS kind FROM ops JOIN ent ON ent.id = target_id")
def g27(spark, d):
    return reads.type_usages(_trade(spark, d))


@query("g28_entities_of_functions", f"WITH {TRADE} SELECT DISTINCT source_id AS function_id, target_id AS entity_id FROM ops WHERE source_id IN (SELECT target_id FROM handles)")
def g28(spark, d):
    g = _trade(spark, d)
    return reads.entities_of_functions(g, g.pairs("HANDLES").select(F.col("target_id").alias("id")))


_X = "SELECT id, repo AS repo_id, path AS name, service AS target_service, 'http' AS protocol, path, CAST(NULL AS VARCHAR) AS destination, caller AS caller_id, ep_repo AS to_repo, r_name AS resolved_name FROM ext JOIN region ON ep_repo = 'r' || r_regionkey"


@query("g29_external_calls", f"WITH {TRADE} {_X} WHERE r_name = 'ASIA'")
def g29(spark, d):
    return reads.external_calls(_trade(spark, d), "ASIA")


@query("g30_external_calls_with_messaging", f"WITH {TRADE} {_X} WHERE false")
def g30(spark, d):
    """None here: the calls of these tables are all http."""
    return reads.external_calls(_trade(spark, d)).where("destination is not null")


@query("g31_external_calls_from", f"WITH {TRADE} SELECT caller AS caller_id, id FROM ext WHERE caller IN (SELECT target_id FROM handles)")
def g31(spark, d):
    g = _trade(spark, d)
    wanted = g.pairs("HANDLES").select(F.col("target_id").alias("source_id")).distinct()
    return g.pairs("MAKES_EXTERNAL_CALL").join(wanted, "source_id", "left_semi").select(F.col("source_id").alias("caller_id"), F.col("target_id").alias("id"))


@query("g32_unresolved_by_tail", f"WITH {TRADE} SELECT * FROM un WHERE callee_name_tail = 'call_3' ORDER BY file_path, line, caller_id LIMIT 1000")
def g32(spark, d):
    return reads.unresolved_by_tail(trade_graph(spark, d)[1], "call_3", 1000)


@query("g33_unresolved_in_files", f"WITH {TRADE} SELECT * FROM un WHERE file_path IN (SELECT file FROM fn WHERE exported)")
def g33(spark, d):
    g, un = trade_graph(spark, d)
    return reads.unresolved_in_files(un, g.some("function", where=prop("isExported") == "true", columns=("file_path",)))


@query("g34_nodes_by_ids", f"WITH {CODE} SELECT id, type, name, repo_id FROM n WHERE id IN (SELECT target_id FROM e WHERE type = 'HANDLES')")
def g34(spark, d):
    g = code_graph(spark, d)
    return reads.nodes_by_ids(g, g.pairs("HANDLES").select(F.col("target_id").alias("id")))


@query("g35_neighbor_counts", f"WITH {CODE} SELECT node_id, type AS edge_type, direction, count(*) AS n FROM (SELECT source_id AS node_id, type, 'out' AS direction FROM e UNION ALL SELECT target_id, type, 'in' FROM e) GROUP BY ALL")
def g35(spark, d):
    return reads.neighbor_counts(code_graph(spark, d))


@query("g36_neighbors", f"""WITH {CODE}, m AS (SELECT e.id AS edge_id, type AS edge_type, CASE WHEN source_id = hub.id THEN target_id ELSE source_id END AS other_id FROM e, hub WHERE source_id = hub.id OR target_id = hub.id)
SELECT *, (SELECT count(*) FROM m) > 20 AS has_more FROM m ORDER BY edge_id LIMIT 20""")
def g36(spark, d):
    g = code_graph(spark, d)
    return reads.neighbors(g, hub(g), limit=20)


@query("g37_nodes_of_type", f"WITH {CODE}, m AS (SELECT id, name, repo_id FROM n WHERE type = 'class' AND id > '5') SELECT *, (SELECT count(*) FROM m) > 50 AS has_more FROM m ORDER BY id LIMIT 50")
def g37(spark, d):
    return reads.nodes_of_type(code_graph(spark, d), "class", cursor="5")


@query("g38_node_with_properties", f"WITH {CODE} SELECT id, name, json_extract_string(properties, '$.isConst') AS is_const, CASE json_type(json_extract(properties, '$.value')) WHEN 'NULL' THEN 'null' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'UBIGINT' THEN 'number' WHEN 'BIGINT' THEN 'number' WHEN 'DOUBLE' THEN 'number' ELSE 'absent' END AS value_type FROM n WHERE type = 'variable'")
def g38(spark, d):
    """The bag of every variable with the type of its value; an explicit null
    is not an absent key."""
    n = code_graph(spark, d).some("variable", columns=("name", "properties"))
    v = F.try_parse_json("properties")
    got = F.schema_of_variant(F.try_variant_get(v, "$.value", "variant"))
    kind = F.when(got == "VOID", "null").when(got == "STRING", "string").when(got == "BOOLEAN", "boolean").when(F.startswith(got, F.lit("ARRAY")), "array").when(F.startswith(got, F.lit("OBJECT")), "object").when(got.isNull(), "absent").otherwise("number")
    return n.select("id", "name", prop("isConst").alias("is_const"), kind.alias("value_type"))


@query("g39_subgraph", f"""WITH RECURSIVE {CODE}, flow AS (SELECT * FROM e WHERE type IN ('CALLS', 'HANDLES', 'MAKES_EXTERNAL_CALL', 'RESOLVES_TO', 'REFERENCES_VARIABLE')),
both_ways AS (SELECT DISTINCT source_id AS a, target_id AS b FROM flow WHERE source_id <> target_id UNION SELECT DISTINCT target_id, source_id FROM flow WHERE source_id <> target_id),
w AS (SELECT id, 0 AS d FROM hub UNION SELECT b, d + 1 FROM w JOIN both_ways ON a = id WHERE d < 2), kept AS (SELECT id FROM w GROUP BY id ORDER BY min(d), id LIMIT 101)
SELECT id AS edge_id, source_id, target_id, type FROM flow WHERE source_id IN (FROM kept) AND target_id IN (FROM kept)""")
def g39(spark, d):
    g = code_graph(spark, d)
    return traverse.subgraph(g, hub(g), 2, cap=100)


@query("g40_edges_among", f"WITH {CODE}, s AS (SELECT target_id AS id FROM e WHERE type = 'HANDLES' UNION SELECT source_id FROM e WHERE type = 'HANDLES') SELECT id AS edge_id, source_id, target_id, type FROM e WHERE source_id IN (FROM s) AND target_id IN (FROM s) ORDER BY id LIMIT 10000")
def g40(spark, d):
    g = code_graph(spark, d)
    h = g.pairs("HANDLES")
    return reads.edges_among(g, h.select(F.col("source_id").alias("id")).union(h.select("target_id")), 10000)


@query("g41_dead_nodes", f"""WITH {CODE} SELECT id, type, name, repo_id, file_path FROM n WHERE type IN ('function', 'class', 'variable') AND coalesce(json_extract_string(properties, '$.isExported'), 'false') <> 'true' AND NOT EXISTS (
  SELECT 1 FROM e WHERE e.target_id = n.id AND e.source_id <> e.target_id AND (n.type = 'function' AND e.type IN ('CALLS', 'HANDLES', 'REFERENCES_VARIABLE') OR n.type = 'class' AND e.type IN ('EXTENDS', 'USES_TYPE', 'CALLS') OR n.type = 'variable' AND e.type = 'REFERENCES_VARIABLE'))""")
def g41(spark, d):
    return reads.dead_nodes(code_graph(spark, d), ("function", "class", "variable"))


@query("g42_cross_repo_bridges", f"""WITH {TRADE} SELECT x.id || ':RESOLVES_TO:' || ep_id AS edge_id, x.id AS x_id, ep_id, x.repo AS from_repo, ep_repo AS to_repo, caller AS caller_id, h.target_id AS handler_id, 0.95 AS confidence
FROM ext x LEFT JOIN handles h ON h.source_id = ep_id WHERE x.repo <> ep_repo ORDER BY 1 LIMIT 200""")
def g42(spark, d):
    return reads.bridges(_trade(spark, d), 200)


@query("g43_package_dependency_rollup", f"""WITH {TRADE} SELECT a.repo || ':package:' || a.pkg AS source_package, b.repo || ':package:' || b.pkg AS target_package, count(*) AS n_calls, CAST(min(confidence) AS DOUBLE) AS min_confidence, bool_or(created_by <> 'parser') AS inferred
FROM calls JOIN fn a ON a.id = source_id JOIN fn b ON b.id = target_id WHERE a.pkg <> b.pkg GROUP BY ALL""")
def g43(spark, d):
    """Calls between packages: the package dependency rollup."""
    return reads.package_rollup(_trade(spark, d))


@query("g44_component_graph", "SELECT DISTINCT 'r0:class:' || p_type || ':EXTENDS:r0:class:' || p_brand AS edge_id, 'r0:class:' || p_type AS source_id, 'r0:class:' || p_brand AS target_id, 'EXTENDS' AS type FROM part")
def g44(spark, d):
    return reads.component_graph(_trade(spark, d))


@query("g45_resolves_edge", f"WITH {TRADE} SELECT id AS call_id, id || ':RESOLVES_TO:' || ep_id AS edge_id, ep_id AS target_id, 0.95 AS confidence, 'direct+http' AS via FROM ext WHERE service = 'svc-3'")
def g45(spark, d):
    g = _trade(spark, d)
    return reads.resolves_edge(g, g.some("external_call", where=prop("targetService") == "svc-3", columns=("type",)))


@query("g46_functions_with_property", f"WITH {CODE} SELECT id, name, repo_id, file_path, start_line, json_extract_string(properties, '$.returnType') AS value FROM n WHERE type = 'function' AND json_extract_string(properties, '$.returnType') IS NOT NULL")
def g46(spark, d):
    """Functions whose return type is known (monikers are absent here)."""
    return reads.functions_with(code_graph(spark, d), "returnType")


@query("g47_internal_call_edges", f"WITH {CODE} SELECT DISTINCT source_id AS caller_id, target_id AS callee_id FROM e WHERE type = 'CALLS' AND target_id IN (SELECT target_id FROM e WHERE type = 'HANDLES')")
def g47(spark, d):
    g = code_graph(spark, d)
    return reads.call_edges_to(g, g.pairs("HANDLES").select(F.col("target_id").alias("id")))


@query("g48_snapshot_receipts", """SELECT repo_id, json_extract_string(snapshot, '$.state') AS state, max(CAST(CAST(json_extract_string(snapshot, '$.snapshotNo') AS DOUBLE) AS BIGINT)) AS snapshot_no, max(coalesce(json_extract_string(snapshot, '$.appliedAt'), json_extract_string(snapshot, '$.startedAt'))) AS at
FROM graph_meta WHERE repo_id IS NOT NULL AND json_extract_string(snapshot, '$.state') IN ('applied', 'pending') AND json_extract_string(snapshot, '$.snapshotNo') IS NOT NULL GROUP BY ALL""")
def g48(spark, d):
    return reads.receipts(table(spark, d, "graph_meta"))


_NEEDLES = ("ledger", "überprüft", "Map<string, number>", "no-such-text")


@query("g49_contains_node_text", "WITH k AS (SELECT unnest(['ledger', 'überprüft', 'Map<string, number>', 'no-such-text']) AS needle), t AS (SELECT id, concat_ws(chr(1), name, summary, file_path, properties) AS x FROM nodes) SELECT needle, count(id) > 0 AS found, count(DISTINCT id) AS n_nodes FROM k LEFT JOIN t ON contains(x, needle) GROUP BY needle")
def g49(spark, d):
    return reads.contains_text(code_graph(spark, d), list(_NEEDLES))


@query("g50_expand_outbound", f"WITH {CODE} SELECT DISTINCT target_id AS id FROM e WHERE type IN ('CALLS', 'HANDLES') AND source_id IN (SELECT id FROM n WHERE type = 'entrypoint') ORDER BY 1 LIMIT 100000")
def g50(spark, d):
    g = code_graph(spark, d)
    return traverse.expand_outbound(g, g.some("entrypoint", columns=("type",)), ("CALLS", "HANDLES"), 100000)


@query("g51_select_reached", f"WITH {CODE} SELECT id FROM n WHERE type = 'function' AND name LIKE '%e' AND id IN (SELECT target_id FROM e WHERE type = 'CALLS' AND source_id IN (SELECT target_id FROM e WHERE type = 'HANDLES'))")
def g51(spark, d):
    g = code_graph(spark, d)
    return traverse.select_reached(g, g.pairs("HANDLES").select(F.col("target_id").alias("id")), g.some("function", where="name like '%e'", columns=("type",)), ("CALLS",))


@query("g52_full_text_search", f"""WITH {CODE}, w AS (SELECT id, list_filter(regexp_split_to_array(lower(concat_ws(' ', name, summary)), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ws FROM n),
c AS (SELECT id, len(ws) AS l, len(list_filter(ws, lambda x: x = 'batch')) AS t0, len(list_filter(ws, lambda x: x = 'ledger')) AS t1 FROM w),
s AS (SELECT count(*) AS n, avg(l) AS a, count(*) FILTER (t0 > 0) AS d0, count(*) FILTER (t1 > 0) AS d1 FROM c)
SELECT id, round(ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * l / a)) + ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * l / a)), 6) AS score
FROM c, s WHERE t0 > 0 OR t1 > 0 ORDER BY score DESC, id LIMIT 100""")
def g52(spark, d):
    return reads.bm25(code_graph(spark, d), "ledger batch")


@query("g53_graph_sql", f"WITH {CODE} SELECT type, count(*) AS n_nodes, count(DISTINCT repo_id) AS n_repos FROM n GROUP BY type HAVING count(*) > 1")
def g53(spark, d):
    """Guarded ad-hoc SQL over the views nodes and edges."""
    return adhoc.graph_sql(code_graph(spark, d), "select type, count(*) as n_nodes, count(distinct repo_id) as n_repos from nodes group by type having count(*) > 1")


@query("g53_graph_pattern", f"""WITH {CODE} SELECT a.name AS caller, b.name AS callee, count(*) AS n FROM e JOIN n a ON a.id = e.source_id JOIN n b ON b.id = e.target_id WHERE e.type = 'CALLS' AND a.type = 'function' AND b.type = 'function' AND b.name LIKE 'load%' GROUP BY ALL""")
def g53b(spark, d):
    """A MATCH pattern compiled to joins."""
    return adhoc.match(code_graph(spark, d), "MATCH (a:function)-[r:CALLS]->(b:function) WHERE b.name STARTS WITH $p RETURN a.name AS caller, b.name AS callee, count(*) AS n", {"p": "load"})
