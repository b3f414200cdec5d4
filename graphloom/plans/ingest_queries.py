"""Queries of transform, writes and intent (T, W, I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intent, traverse, usage, writes
from ..operators import transform as tr
from ..operators.transform import NOT_TYPES
from ..sources.tables import table
from .graph_queries import CODE, code_graph
from .registry import Registry

REGISTRY = Registry()
query = REGISTRY.query

_P = "json_extract_string(properties, '$.{}')"


@query("t01_first_wins", "SELECT id, r.type AS type, r.name AS name, r.n AS snapshot_no FROM (SELECT id, min({'n': snapshot_no, 't': taken_at, 'type': type, 'name': name}) AS r FROM node_snapshots WHERE id IS NOT NULL GROUP BY id)")
def t01(spark, d):
    """The first delivered row of every node."""
    s = table(spark, d, "node_snapshots")
    return tr.first_wins(s, "id", ["snapshot_no", "taken_at", "type", "name"], ["type", "name", "snapshot_no"])


@query("t02_containment", f"""WITH {CODE}, f AS (SELECT repo_id, file_path, min(id) AS source_id FROM nodes WHERE type = 'file' GROUP BY ALL), i AS (SELECT DISTINCT repo_id, file_path, id AS target_id, 'CONTAINS_' || upper(type) AS type FROM nodes WHERE type IN ('function', 'class', 'interface', 'enum', 'variable') AND coalesce({_P.format('kind')}, '') <> 'method')
SELECT source_id || ':' || type || ':' || target_id AS edge_id, source_id, target_id, type FROM i JOIN f USING (repo_id, file_path)""")
def t02(spark, d):
    return tr.containment(table(spark, d, "nodes"))


@query("t04_call_edges", f"SELECT DISTINCT id AS edge_id, source_id, target_id, CASE WHEN {_P.format('inferred')} = 'true' THEN 0.5 ELSE 1.0 END AS confidence, coalesce({_P.format('inferred')} = 'true', false) AS inferred FROM edges WHERE type = 'CALLS'")
def t04(spark, d):
    e = table(spark, d, "edges").where("type = 'CALLS'")
    calls = e.select("id", F.col("source_id").alias("caller_id"), F.col("target_id").alias("callee_id"), F.when(F.get_json_object("properties", "$.inferred") == "true", "iface-impl").alias("provenance")).distinct()
    return tr.call_edges(calls)


@query("t05_unresolved_calls", r"""WITH x AS (SELECT doc_id AS caller_id, trim(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g'), ' ') AS x FROM documents WHERE text IS NOT NULL)
SELECT caller_id, x[1:160] AS callee_expression, nullif(regexp_extract(x, '([A-Za-z_$][A-Za-z0-9_$]*)$', 1), '') AS callee_name_tail FROM x""")
def t05(spark, d):
    """Whole texts as callee expressions, the hardest there are."""
    c = table(spark, d, "documents").select(F.col("doc_id").alias("caller_id"), F.lit(None).cast("string").alias("callee_id"), F.col("text").alias("callee_expression"))
    return tr.unresolved_calls(c)


_WORDS = ", ".join(f"'{x}'" for x in NOT_TYPES)
_SITES = f"""sites AS (SELECT DISTINCT id, repo_id, usage, unnest(list_distinct(list_filter(regexp_extract_all(t, '\\b[A-Z][A-Za-z0-9_]*\\b'), lambda x: x NOT IN ({_WORDS})))) AS name FROM (
  SELECT id, repo_id, 'return' AS usage, {_P.format('returnType')} AS t FROM nodes WHERE type = 'function' UNION ALL SELECT id, repo_id, 'extends', upper({_P.format('extends')}[1]) || {_P.format('extends')}[2:] FROM nodes WHERE type IN ('class', 'interface')
  UNION ALL SELECT id, repo_id, 'parameter', unnest(CAST(json_extract_string(properties, '$.parameters[*].type') AS VARCHAR[])) FROM nodes WHERE type = 'function') WHERE t IS NOT NULL)"""


def _sites(spark, d):
    n = table(spark, d, "nodes")
    f = n.where("type = 'function'")
    params = F.from_json(F.get_json_object("properties", "$.parameters"), "array<struct<type: string>>")
    texts = f.select("id", "repo_id", F.lit("return").alias("usage"), F.get_json_object("properties", "$.returnType").alias("t"))
    texts = texts.unionByName(f.select("id", "repo_id", F.lit("parameter").alias("usage"), F.explode(params).alias("p")).select("id", "repo_id", "usage", F.col("p.type").alias("t")))
    up = F.get_json_object("properties", "$.extends")
    texts = texts.unionByName(n.where("type in ('class', 'interface')").select("id", "repo_id", F.lit("extends").alias("usage"), F.concat(F.upper(F.substring(up, 1, 1)), F.substring(up, 2, 10000)).alias("t")))
    return texts.where("t is not null").select("id", "repo_id", "usage", F.explode(tr.type_names(F.col("t"))).alias("name")).distinct()


@query("t08_type_references", f"WITH {_SITES} SELECT * FROM sites")
def t08(spark, d):
    return _sites(spark, d)


@query("t09_uses_type", f"""WITH {_SITES}, t AS (SELECT DISTINCT id AS type_id, repo_id, name FROM nodes WHERE type IN ('class', 'interface', 'enum') UNION SELECT DISTINCT id, repo_id, upper(name[1]) || name[2:] FROM nodes WHERE type = 'variable'), c AS (SELECT repo_id, name, count(*) AS n FROM t GROUP BY ALL)
SELECT id AS source_id, type_id AS target_id, usage, max(CASE WHEN n > 1 THEN 0.5 ELSE 1.0 END) AS confidence FROM sites JOIN t USING (repo_id, name) JOIN c USING (repo_id, name) WHERE id <> type_id GROUP BY ALL""")
def t09(spark, d):
    n = table(spark, d, "nodes")
    types = n.where("type in ('class', 'interface', 'enum')").select(F.col("id").alias("type_id"), "repo_id", "name")
    types = types.unionByName(n.where("type = 'variable'").select(F.col("id").alias("type_id"), "repo_id", F.concat(F.upper(F.substring("name", 1, 1)), F.substring("name", 2, 10000)).alias("name")))
    return tr.uses_type(_sites(spark, d), types)


@query("t11_unknown_files", f"WITH {CODE} SELECT DISTINCT repo_id, file_path, repo_id || ':file:' || file_path AS id FROM n WHERE type <> 'file' AND file_path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM n f WHERE f.type = 'file' AND f.repo_id = n.repo_id AND f.file_path = n.file_path)")
def t11(spark, d):
    """File nodes that must be made up for declarations in unknown files."""
    n = table(spark, d, "nodes")
    files = n.where("type = 'file'").select("repo_id", "file_path").distinct()
    return n.where("type <> 'file' and file_path is not null").select("repo_id", "file_path").distinct().join(files, ["repo_id", "file_path"], "left_anti").withColumn("id", F.concat("repo_id", F.lit(":file:"), "file_path"))


_VERSION = "substr(captured_versioned_id, length(node_id) + 2)"


@query("t12_merge_versions", f"""WITH v AS (SELECT id, md5(coalesce(min(name), '') || coalesce(min(file_path), '')) AS version FROM nodes WHERE id IS NOT NULL GROUP BY id), x AS (SELECT id, md5(coalesce(name, '') || coalesce(file_path, '')) AS version FROM (SELECT DISTINCT id, name, file_path FROM node_snapshots WHERE id IS NOT NULL))
SELECT count(*) FILTER (v.version = x.version) AS n_merged, count(*) FILTER (v.version IS DISTINCT FROM x.version) AS n_dropped FROM x LEFT JOIN v USING (id)""")
def t12(spark, d):
    h = lambda a, b: F.md5(F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
    nodes = table(spark, d, "nodes").where("id is not null").groupBy("id").agg(h(F.min("name"), F.min("file_path")).alias("version"))
    extra = table(spark, d, "node_snapshots").where("id is not null").select("id", "name", "file_path").distinct().select("id", h(F.col("name"), F.col("file_path")).alias("version"), F.col("name").alias("value"))
    return tr.merge_versions(nodes, extra)[1]


@query("t13_mask_secrets")
def t13(spark, d):
    """Source texts with their secrets masked (SQL lacks the lookaheads)."""
    return table(spark, d, "source_files").select("repo_id", "file_path", tr.mask_secrets(F.col("content")).alias("value")).distinct()


@query("t14_strip_source", "SELECT DISTINCT id, type, name, repo_id FROM nodes")
def t14(spark, d):
    """Nodes without text that carries source."""
    return table(spark, d, "nodes").select("id", "type", "name", "repo_id").distinct()


@query("t15_stats_by_type", f"WITH {CODE} SELECT repo_id, type, count(*) AS n FROM n GROUP BY ALL")
def t15(spark, d):
    return code_graph(spark, d).some(columns=("type", "repo_id")).groupBy("repo_id", "type").agg(F.count(F.lit(1)).alias("n"))


_FILES = "f AS (SELECT DISTINCT repo_id, file_path, language, regexp_extract(file_path, '^[^/]*') AS package FROM source_files)"


def _files(spark, d):
    return table(spark, d, "source_files").select("repo_id", "file_path", "language", F.regexp_extract("file_path", "^[^/]*", 0).alias("package")).distinct()


@query("t16_dominant_language", f"WITH {_FILES}, c AS (SELECT repo_id, package, language, count(*) AS n FROM f WHERE language IS NOT NULL GROUP BY ALL) SELECT repo_id, package, (min({{'n': -n, 'l': language}})).l AS language, CAST(sum(n) AS BIGINT) AS n_files FROM c GROUP BY ALL")
def t16(spark, d):
    return tr.dominant(_files(spark, d), ["repo_id", "package"], "language")


@query("t17_referential_integrity", """WITH x AS (SELECT DISTINCT id, type AS edge_type, 'source' AS side, source_id AS e FROM edges UNION SELECT DISTINCT id, type, 'target', target_id FROM edges), g AS (SELECT * FROM x WHERE e NOT IN (SELECT id FROM nodes WHERE id IS NOT NULL))
SELECT edge_type, side, count(*) AS n_missing, array_to_string(list_sort(list(id))[1:5], ' ') AS sample FROM g GROUP BY ALL""")
def t17(spark, d):
    return tr.dangling(table(spark, d, "edges"), table(spark, d, "nodes"))


_PKG = "p AS (SELECT DISTINCT repo_id || '/' || regexp_extract(file_path, '^[^/]*') AS package, id FROM nodes WHERE type = 'function' AND file_path IS NOT NULL), r AS (SELECT package, count(*) AS n_functions, count(*) FILTER (id IN (SELECT source_id FROM edges WHERE type = 'CALLS')) AS n_resolved FROM p GROUP BY ALL), q AS (SELECT *, round(n_resolved / n_functions, 6) AS ratio FROM r)"


def _resolution(spark, d):
    f = table(spark, d, "nodes").where("type = 'function' and file_path is not null").select(F.concat("repo_id", F.lit("/"), F.regexp_extract("file_path", "^[^/]*", 0)).alias("package"), "id")
    return tr.resolution_by_package(f, table(spark, d, "edges").where("type = 'CALLS'").select(F.col("source_id").alias("id")))


@query("t18_resolution_by_package", f"WITH {_PKG} SELECT *, n_functions >= 20 AND n_resolved = 0 AND (SELECT max(ratio) FROM q) > 0.5 AS blackout FROM q")
def t18(spark, d):
    return _resolution(spark, d)


@query("t19_scorecard", f"WITH {_PKG}, s AS (SELECT package, round(least(1.0, n_resolved / nullif(n_functions, 0)), 6) AS score FROM q) SELECT package, score, CASE WHEN score IS NULL THEN 'NONE' WHEN score >= 0.8 THEN 'PASS' WHEN score >= 0.5 THEN 'PARTIAL' ELSE 'FAIL' END AS verdict FROM s")
def t19(spark, d):
    return tr.scorecard(_resolution(spark, d), "package", "n_resolved", "n_functions", {"external": 0.5})


@query("t20_red_flags", f"WITH {_PKG} SELECT package, n_functions FROM q WHERE n_functions >= 10 AND ratio < 0.5")
def t20(spark, d):
    """Packages whose functions mostly resolve no call."""
    return _resolution(spark, d).where("n_functions >= 10 and ratio < 0.5").select("package", "n_functions")


_MODULES = "m AS (SELECT DISTINCT repo_id, file_path, unnest(regexp_extract_all(content, '(?:from|import) ([a-z_]+)\\.', 1)) AS module FROM source_files)"


@query("t21_module_tally", f"WITH {_MODULES} SELECT module, count(*) AS n FROM m GROUP BY ALL ORDER BY n DESC, module")
def t21(spark, d):
    f = table(spark, d, "source_files").select("repo_id", "file_path", F.explode(F.regexp_extract_all("content", F.lit(r"(?:from|import) ([a-z_]+)\."), F.lit(1))).alias("module")).distinct()
    return usage.tally(f, ["module"])


@query("t22_shape_clusters", r"SELECT regexp_replace(regexp_replace(regexp_replace(text, '`[^`\n]*`', 'q', 'g'), '[0-9]+', '0', 'g'), '[ \t\r\n]+', ' ', 'g') AS shape, count(*) AS n, min(text) AS example FROM documents WHERE text IS NOT NULL GROUP BY 1 ORDER BY n DESC, shape LIMIT 200")
def t22(spark, d):
    return tr.shape_clusters(table(spark, d, "documents"), "text", 200)


@query("t23_clean_edges", "SELECT source_id, target_id, type, min(id) AS id FROM edges WHERE source_id IN (SELECT id FROM nodes WHERE id IS NOT NULL) AND target_id IN (SELECT id FROM nodes WHERE id IS NOT NULL) GROUP BY ALL")
def t23(spark, d):
    return tr.clean_edges(table(spark, d, "edges"), table(spark, d, "nodes"))


@query("t24_callee_first_order")
def t24(spark, d):
    """Callee-first levels, -1 on and above cycles (tested against brute force)."""
    return traverse.callee_first_order(code_graph(spark, d))


@query("t25_reusable_vectors", f"WITH {CODE}, o AS (SELECT id, md5(min(name)) AS checksum FROM node_snapshots WHERE id IS NOT NULL GROUP BY id) SELECT n.id, coalesce(md5(n.name) = checksum, false) AS reuse FROM n LEFT JOIN o USING (id)")
def t25(spark, d):
    old = table(spark, d, "node_snapshots").where("id is not null").groupBy("id").agg(F.md5(F.min("name")).alias("checksum"))
    return tr.reusable(old, code_graph(spark, d).some(columns=("name",)).select("id", F.col("name").alias("input")))


@query("t27_relationship_diagram", """WITH e AS (SELECT DISTINCT p_brand AS name, p_type AS field, 'size-' || (p_size % 3) AS kind FROM part), r AS (SELECT DISTINCT p_brand AS name, 'Type-' || (p_size % 4) AS other FROM part)
SELECT name, 'entity ' || name || ' {' || chr(10) || (SELECT string_agg(DISTINCT '  ' || kind || ' ' || field, chr(10) ORDER BY '  ' || kind || ' ' || field) FROM e x WHERE x.name = y.name) || chr(10) || '}' || chr(10) || (SELECT string_agg(DISTINCT r.name || ' --> ' || other, chr(10) ORDER BY r.name || ' --> ' || other) FROM r WHERE r.name = y.name) AS diagram FROM (SELECT DISTINCT name FROM e) y""")
def t27(spark, d):
    p = table(spark, d, "part")
    return tr.relationship_diagram(p.select(F.col("p_brand").alias("name"), F.col("p_type").alias("field"), F.concat(F.lit("size-"), F.col("p_size") % 3).alias("kind")), p.select(F.col("p_brand").alias("name"), F.concat(F.lit("Type-"), F.col("p_size") % 4).alias("other")))


@query("t28_custom_rules", f"WITH {CODE} SELECT id, unnest(list_filter([CASE WHEN type = 'entrypoint' AND {_P.format('method')} = 'ALL' THEN 'wildcard' END, CASE WHEN type = 'function' AND TRY_CAST({_P.format('complexity')} AS DOUBLE) > 8 THEN 'complex' END, CASE WHEN type = 'function' AND {_P.format('isAsync')} = 'true' THEN 'async' END], lambda x: x IS NOT NULL)) AS rule FROM n")
def t28(spark, d):
    rules = [("wildcard", "type = 'entrypoint' and get_json_object(properties, '$.method') = 'ALL'"), ("complex", "type = 'function' and try_cast(get_json_object(properties, '$.complexity') as double) > 8"), ("async", "type = 'function' and get_json_object(properties, '$.isAsync') = 'true'")]
    return tr.apply_rules(code_graph(spark, d).some(columns=("type", "properties")), rules).select("id", "rule")


# writes

_E = "e AS (SELECT id, min(source_id) AS source_id, min(target_id) AS target_id, min(type) AS type FROM edges WHERE id IS NOT NULL GROUP BY id)"


def _edges(spark, d):
    return code_graph(spark, d).links().select("id", "source_id", "target_id", "type")


@query("w01_push_edges", f"WITH {_E}, x AS (SELECT id, source_id, CASE WHEN type = 'HANDLES' THEN 'gone' ELSE source_id END AS target_id, 'IMPORTS' AS type FROM e WHERE type IN ('CALLS', 'HANDLES')), k AS (SELECT * FROM x WHERE source_id IN (SELECT id FROM nodes) AND target_id IN (SELECT id FROM nodes)) SELECT * FROM e WHERE id NOT IN (SELECT id FROM k) UNION ALL SELECT * FROM k")
def w01(spark, d):
    e = _edges(spark, d)
    new = e.where("type in ('CALLS', 'HANDLES')").select("id", "source_id", F.when(F.col("type") == "HANDLES", "gone").otherwise(F.col("source_id")).alias("target_id"), F.lit("IMPORTS").alias("type"))
    return writes.push_edges(e, new, table(spark, d, "nodes"))


@query("w02_delete_repository", f"WITH {_E} SELECT * FROM e WHERE NOT starts_with(source_id, (SELECT min(repo_id) FROM nodes) || ':') AND NOT starts_with(target_id, (SELECT min(repo_id) FROM nodes) || ':')")
def w02(spark, d):
    repo = table(spark, d, "nodes").agg(F.min("repo_id")).first()[0] or ""
    return writes.delete_repository(_edges(spark, d), repo, ("source_id", "target_id"))


@query("w03_delete_edges", f"WITH {_E} SELECT * FROM e WHERE NOT (type = 'CALLS' AND split_part(source_id, ':', 1) IN (SELECT repo_id FROM graph_meta WHERE json_extract_string(snapshot, '$.state') = 'pending'))")
def w03(spark, d):
    pending = table(spark, d, "graph_meta").where(F.get_json_object("snapshot", "$.state") == "pending").select("repo_id")
    return writes.delete_edges(_edges(spark, d), "CALLS", pending)


@query("w04_set_resolved", f"WITH {_E} SELECT n.id, r.t AS resolved_id FROM (SELECT DISTINCT id FROM nodes WHERE type = 'entrypoint') n LEFT JOIN (SELECT source_id, arg_min(target_id, id) AS t FROM e WHERE type = 'HANDLES' GROUP BY 1) r ON r.source_id = n.id")
def w04(spark, d):
    """HANDLES edges stand for the resolving ones, which the tables lack."""
    calls = table(spark, d, "nodes").where("type = 'entrypoint'").select("id").distinct()
    return writes.set_resolved(calls, _edges(spark, d).where("type = 'HANDLES'").withColumn("type", F.lit("RESOLVES_TO")))


@query("w05_apply_changeset", f"""WITH {_E}, gone AS (SELECT DISTINCT id FROM nodes WHERE type = 'interface'), upd AS (SELECT DISTINCT id FROM nodes WHERE type = 'entrypoint'),
k AS (SELECT * FROM e WHERE source_id NOT IN (FROM gone) AND target_id NOT IN (FROM gone) AND NOT (source_id IN (FROM upd) AND type <> 'RESOLVES_TO'))
SELECT type, count(*) AS n FROM k GROUP BY ALL UNION ALL SELECT 'node:' || type, count(*) FROM (SELECT id, min(type) AS type FROM nodes WHERE id IS NOT NULL GROUP BY id) WHERE type <> 'interface' GROUP BY ALL""")
def w05(spark, d):
    g = code_graph(spark, d)
    n = g.some(columns=("type", "name"))
    n2, e2 = writes.apply_changeset(n, _edges(spark, d), n.where("type = 'entrypoint'"), n.where("type = 'interface'").select("id"), _edges(spark, d).limit(0))
    return e2.groupBy("type").agg(F.count(F.lit(1)).alias("n")).unionByName(n2.groupBy(F.concat(F.lit("node:"), "type").alias("type")).agg(F.count(F.lit(1)).alias("n")))


_CHANGES = f"WITH {CODE}, o AS (SELECT id, max(hash(type, name, file_path)) AS h, min(repo_id) AS repo_id FROM node_snapshots WHERE snapshot_no = 1 AND id IS NOT NULL GROUP BY id), w AS (SELECT id, max(hash(type, name, file_path)) AS h, min(repo_id) AS repo_id FROM nodes WHERE id IS NOT NULL GROUP BY id), c AS (SELECT coalesce(o.id, w.id) AS id, coalesce(o.repo_id, w.repo_id) AS repo_id, CASE WHEN o.id IS NULL THEN 'add' WHEN w.id IS NULL THEN 'delete' ELSE 'update' END AS change FROM o FULL JOIN w ON o.id = w.id WHERE o.h IS DISTINCT FROM w.h)"


def _changes(spark, d):
    old = table(spark, d, "node_snapshots").where("snapshot_no = 1 and id is not null")
    return old, writes.changeset(old, table(spark, d, "nodes").where("id is not null"), ["type", "name", "file_path"])


@query("w06_changeset", f"{_CHANGES} SELECT id, change FROM c")
def w06(spark, d):
    """The first deliveries against the present nodes."""
    return _changes(spark, d)[1]


@query("w06_changeset_guard", f"{_CHANGES}, g AS (SELECT split_part(id, ':', 1) AS repo_id, count(*) FILTER (change = 'delete') AS x FROM c GROUP BY ALL), t AS (SELECT repo_id, count(DISTINCT id) AS n_old FROM node_snapshots WHERE snapshot_no = 1 AND id IS NOT NULL GROUP BY ALL) SELECT t.repo_id, n_old, coalesce(x, 0) AS n_deleted, coalesce(x, 0) >= 0.8 * n_old AS refused FROM t LEFT JOIN g USING (repo_id)")
def w06b(spark, d):
    old, changes = _changes(spark, d)
    return writes.changeset_guard(changes.withColumn("repo_id", F.substring_index("id", ":", 1)), old, ["repo_id"])


@query("w07_latest_operations", "SELECT workspace_id, feed, (max({'s': started_at, 'r': run_id})).r AS run_id, max(started_at) AS started FROM sync_runs WHERE status = 'succeeded' AND finished_at IS NOT NULL GROUP BY ALL")
def w07(spark, d):
    return writes.latest_operations(table(spark, d, "sync_runs"), ["workspace_id", "feed"], "started_at", "finished_at")


# intent

_F1 = "f AS (SELECT DISTINCT id, title, statement FROM intent_features WHERE id IS NOT NULL)"


@query("i01_lexical", f"WITH {_F1}, h AS (SELECT id, contains(lower(concat_ws(chr(1), title, statement)), 'ledger') AS a, contains(lower(concat_ws(chr(1), title, statement)), 'manual') AS b FROM f) SELECT DISTINCT id, CASE WHEN (SELECT bool_or(a AND b) FROM h) THEN 'all' ELSE 'any' END AS mode FROM h WHERE a AND b OR (a OR b) AND NOT (SELECT bool_or(a AND b) FROM h)")
def i01(spark, d):
    f = table(spark, d, "intent_features").where("id is not null")
    return intent.lexical(f, "id", ["title", "statement"], "Ledger manual")


_STEM = "list_distinct(list_transform(list_filter(regexp_split_to_array(lower(regexp_replace({}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z]+'), lambda w: length(w) >= 3), lambda w: regexp_replace(w, '(?:ations?|ings?|edly|ed|es|s|ly)$', '')))"


@query("i02_task_matches", f"""WITH f AS (SELECT id, min(title) AS title, min(statement) AS statement FROM intent_features WHERE id IS NOT NULL GROUP BY id), w AS (SELECT {_STEM.format("'Rebuild the manualRelease queue when reviewers cancel duplicated batches'")} AS w),
s AS (SELECT id, {_STEM.format("coalesce(title, '')")} AS t, {_STEM.format("coalesce(statement, '')")} AS b FROM f), m AS (SELECT id, len(list_intersect(t, w)) AS x, len(list_distinct(list_concat(list_intersect(t, w), list_intersect(b, w)))) AS n FROM s, w)
SELECT id, n AS n_shared, n + x AS rank FROM m WHERE n >= 2 ORDER BY rank DESC, id LIMIT 50""")
def i02(spark, d):
    f = table(spark, d, "intent_features").where("id is not null").groupBy("id").agg(F.min("title").alias("title"), F.min("statement").alias("statement"))
    return intent.task_matches(f, "id", "title", "statement", "Rebuild the manualRelease queue when reviewers cancel duplicated batches")


@query("i03_pending_by_domain", "SELECT domain_id, count(*) AS n, min(created_at) AS oldest, count(*) FILTER (archived) AS n_archived FROM (SELECT DISTINCT domain_id, id, created_at, archived FROM intent_features) GROUP BY ALL")
def i03(spark, d):
    f = table(spark, d, "intent_features").select("domain_id", "id", "created_at", "archived").distinct()
    return f.groupBy("domain_id").agg(F.count(F.lit(1)).alias("n"), F.min("created_at").alias("oldest"), F.count_if("archived").alias("n_archived"))


_LIVE = "r AS (SELECT workspace_id, seq, max({'l': loaded_at, 'h': request_hash, 'k': kind, 'd': data}) AS r FROM intent_release_events WHERE workspace_id IS NOT NULL AND seq IS NOT NULL GROUP BY ALL), ev AS (SELECT workspace_id, seq, r.k AS kind, r.d AS data FROM r), undone AS (SELECT DISTINCT workspace_id, CAST(json_extract_string(data, '$.releaseSeq') AS INT) AS seq FROM ev WHERE kind = 'rollback'), live AS (SELECT * FROM ev WHERE kind IN ('baseline', 'release', 'plan') AND (workspace_id, seq) NOT IN (SELECT (workspace_id, seq) FROM undone)), items AS (SELECT workspace_id, seq, CASE WHEN kind = 'plan' THEN 'planned' ELSE 'delivered' END AS state, unnest(CAST(json_extract(data, '$.included') AS VARCHAR[])) AS item FROM live)"


@query("i05_release_fold", f"WITH {_LIVE} SELECT workspace_id, item, arg_max(state, seq) AS state, max(seq) AS seq FROM items GROUP BY ALL")
def i05(spark, d):
    return intent.release_fold(table(spark, d, "intent_release_events"))


_COND = """WITH f AS (SELECT DISTINCT id, applies_when FROM intent_features WHERE id IS NOT NULL), c AS (SELECT id, applies_when, unnest(CAST(applies_when AS JSON[])) AS x FROM f WHERE applies_when IS NOT NULL),
t AS (SELECT id, applies_when, CASE WHEN json_extract_string(x, '$.dimension') IS NULL THEN 'unevaluated' WHEN json_extract_string(x, '$.dimension') NOT IN ('linker', 'feature') THEN 'open' WHEN json_extract_string(x, '$.dimension') = 'linker' AND list_has_any(CAST(json_extract(x, '$.values') AS VARCHAR[]), ['noisy', 'exact']) OR json_extract_string(x, '$.dimension') = 'feature' AND list_has_any(CAST(json_extract(x, '$.values') AS VARCHAR[]), ['manual']) THEN 'match' ELSE 'excluded' END AS s FROM c),
g AS (SELECT id, applies_when, CASE WHEN bool_or(s = 'excluded') THEN 'excluded' WHEN bool_or(s = 'unevaluated') THEN 'unevaluated' WHEN bool_or(s = 'open') THEN 'open' ELSE 'match' END AS s FROM t GROUP BY ALL)
SELECT f.id, coalesce(s, 'match') AS state FROM f LEFT JOIN g ON f.id = g.id AND f.applies_when IS NOT DISTINCT FROM g.applies_when"""


@query("i06_condition_state", _COND)
def i06(spark, d):
    f = table(spark, d, "intent_features").where("id is not null").select("id", "applies_when").distinct()
    return f.select("id", intent.condition_state(F.col("applies_when"), {"linker": ["noisy", "exact"], "feature": ["manual"]}).alias("state"))


@query("i07_rollup_counts", "WITH u AS (SELECT DISTINCT workspace_id, id, archived, parent_feature_id FROM intent_features) SELECT workspace_id, count(*) AS n_features, count(*) FILTER (archived) AS n_archived, count(*) FILTER (parent_feature_id IS NULL) AS n_tops FROM u GROUP BY ALL")
def i07(spark, d):
    f = table(spark, d, "intent_features").select("workspace_id", "id", "archived", "parent_feature_id").distinct()
    return intent.rollup_counts([("features", f), ("archived", f.where("archived")), ("tops", f.where("parent_feature_id is null"))], "workspace_id")


@query("i08_prose_search", "SELECT workspace_id, domain_id, count(DISTINCT id) AS n FROM intent_features WHERE contains(lower(concat_ws(chr(10), title, statement, applies_when)), 'queue') GROUP BY ALL")
def i08(spark, d):
    f = table(spark, d, "intent_features").where(intent.words_in(["title", "statement", "applies_when"], ["queue"])[0])
    return f.groupBy("workspace_id", "domain_id").agg(F.count_distinct("id").alias("n"))


@query("i09_feature_area", f"""WITH RECURSIVE {CODE}, root AS (SELECT id FROM n WHERE type IN ('file', 'entrypoint') AND repo_id = (SELECT min(repo_id) FROM nodes)), c AS (SELECT DISTINCT source_id AS a, target_id AS b FROM e WHERE type LIKE 'CONTAINS_%' OR type = 'HAS_METHOD'),
w AS (SELECT id, 0 AS d FROM root UNION SELECT b, d + 1 FROM w JOIN c ON a = id WHERE d < 8), inside AS (SELECT DISTINCT id FROM w), h AS (SELECT target_id AS id FROM e WHERE type = 'HANDLES' AND source_id IN (FROM inside)), base AS (FROM inside UNION FROM h),
x AS (SELECT id, 0 AS r FROM inside UNION ALL SELECT id, 1 FROM h UNION ALL SELECT target_id, 2 FROM e WHERE type = 'CALLS' AND source_id IN (FROM base)), y AS (SELECT id, min(r) AS r FROM x GROUP BY id)
SELECT id, CASE r WHEN 0 THEN 'inside' WHEN 1 THEN 'handler' ELSE 'called' END AS how, (SELECT count(*) FROM y) > 5000 AS truncated FROM y ORDER BY r, id LIMIT 5000""")
def i09(spark, d):
    g = code_graph(spark, d)
    first = g.nodes.agg(F.min("repo_id").alias("repo_id"))
    roots = g.some("file", "entrypoint", columns=("repo_id",)).join(F.broadcast(first), "repo_id", "left_semi").select("id")
    return traverse.feature_area(g, roots)


_ANCHOR = "a AS (SELECT id, r.n AS node_id, r.t AS node_type, r.v AS version FROM (SELECT id, min({'n': node_id, 't': node_type, 'v': md5(coalesce(captured_versioned_id, ''))}) AS r FROM intent_anchors WHERE id IS NOT NULL AND node_id IS NOT NULL GROUP BY id))"


@query("i10_anchor_evidence", f"WITH {_ANCHOR}, v AS (SELECT id, min(type) AS type, md5(id || '@' || coalesce(min({_P.format('checksum')}), '')) AS now FROM nodes WHERE id IS NOT NULL GROUP BY id) SELECT a.id AS anchor_id, CASE WHEN type IS NULL THEN 'absent' WHEN type <> node_type THEN 'mismatch' WHEN now = version THEN 'fresh' ELSE 'stale' END AS evidence FROM a LEFT JOIN v ON v.id = a.node_id")
def i10(spark, d):
    a = table(spark, d, "intent_anchors").select("id", "node_id", "node_type", F.md5(F.coalesce("captured_versioned_id", F.lit(""))).alias("version"))
    n = table(spark, d, "nodes").where("id is not null").groupBy("id").agg(F.min("type").alias("type"), F.min(F.get_json_object("properties", "$.checksum")).alias("c"))
    return intent.anchor_evidence(a, n.select("id", "type", F.md5(F.concat("id", F.lit("@"), F.coalesce("c", F.lit("")))).alias("version")))


@query("i11_resolve_anchors", """WITH w AS (SELECT DISTINCT file_path || '#' || name AS address FROM node_snapshots WHERE type = 'function' AND file_path IS NOT NULL UNION SELECT DISTINCT file_path FROM node_snapshots WHERE type = 'file' AND file_path IS NOT NULL),
n AS (SELECT DISTINCT id, CASE WHEN type = 'file' THEN file_path ELSE file_path || '#' || name END AS address FROM nodes WHERE file_path IS NOT NULL), h AS (SELECT address, count(*) AS k, min(id) AS i FROM n GROUP BY ALL)
SELECT address, CASE WHEN k = 1 THEN i END AS node_id, CASE WHEN k IS NULL THEN 'unresolved' WHEN k = 1 THEN 'resolved' ELSE 'ambiguous' END AS state FROM w LEFT JOIN h USING (address)""")
def i11(spark, d):
    s = table(spark, d, "node_snapshots").where("file_path is not null")
    w = s.where("type = 'function'").select(F.concat("file_path", F.lit("#"), "name").alias("address")).unionByName(s.where("type = 'file'").select(F.col("file_path").alias("address")))
    return intent.resolve_anchors(w.where("address is not null"), table(spark, d, "nodes"))


@query("i12_overlapping_variants", "WITH c AS (SELECT DISTINCT workspace_id, id, unnest(CAST(applies_when AS JSON[])) AS x FROM intent_features WHERE applies_when IS NOT NULL), v AS (SELECT workspace_id, id, json_extract_string(x, '$.dimension') AS dimension, unnest(CAST(json_extract(x, '$.values') AS VARCHAR[])) AS value FROM c) SELECT workspace_id, dimension, value, count(DISTINCT id) AS n_variants, min(id) AS first, max(id) AS last FROM v GROUP BY ALL HAVING count(DISTINCT id) > 1")
def i12(spark, d):
    c = F.from_json("applies_when", "array<struct<dimension: string, values: array<string>>>")
    f = table(spark, d, "intent_features").where("applies_when is not null").select("workspace_id", "id", F.explode(c).alias("x")).select("workspace_id", "id", "x.dimension", F.explode("x.values").alias("value"))
    return intent.overlapping_variants(f, "workspace_id", "id", "dimension", "value")
