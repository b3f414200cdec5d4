"""Queries of the general problems: snapshots, ledger, orphans, hierarchies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hierarchy, ledger, orphans, snapshots
from ..sources.tables import table
from .registry import Registry

REGISTRY = Registry()
query = REGISTRY.query

#: (repo_id, snapshot_no, prev_no, next_no) of applied deliveries.
_CHAIN = """
applied AS (
  SELECT DISTINCT repo_id, CAST(json_extract_string(snapshot, '$.snapshotNo') AS INTEGER) AS no FROM graph_meta
  WHERE json_extract_string(snapshot, '$.state') = 'applied' AND repo_id IS NOT NULL),
chain AS (
  SELECT repo_id, no, lag(no) OVER w AS prev_no, lead(no) OVER w AS next_no FROM applied WINDOW w AS (PARTITION BY repo_id ORDER BY no))"""

#: JSON as the sorted list of its leaves and containers, numbers as doubles.
_CELLS = f"""
WITH {_CHAIN},
texts AS (SELECT DISTINCT properties FROM node_snapshots WHERE properties IS NOT NULL),
spelled AS (
  SELECT properties, string_agg(t.fullkey || chr(1) || CASE WHEN t.type IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'n' || CAST(CAST(json_extract_string(t.atom, '$') AS DOUBLE) AS VARCHAR)
      ELSE t.type || coalesce(json_extract_string(t.atom, '$'), '') END, chr(2) ORDER BY t.fullkey) AS j
  FROM texts, json_tree(CAST(properties AS JSON)) t GROUP BY properties),
vals AS (
  SELECT DISTINCT s.repo_id, s.snapshot_no AS no, s.id, [coalesce('=' || s.type, ''), coalesce('=' || s.name, ''), coalesce('=' || s.file_path, ''),
    coalesce('=' || CAST(s.start_line AS VARCHAR), ''), coalesce('=' || CAST(s.end_line AS VARCHAR), ''), coalesce('=' || j.j, '')] AS v
  FROM node_snapshots s LEFT JOIN spelled j USING (properties) WHERE s.id IS NOT NULL),
whole AS (SELECT repo_id, no, id, list_sort(list(v)) AS v FROM vals GROUP BY ALL),
later AS (SELECT c.repo_id, c.no, w.id, w.v FROM chain c JOIN whole w USING (repo_id, no) WHERE c.prev_no IS NOT NULL),
earlier AS (SELECT c.repo_id, c.next_no AS no, w.id, w.v FROM chain c JOIN whole w USING (repo_id, no) WHERE c.next_no IS NOT NULL),
both_sides AS (SELECT repo_id, no, id, a.v AS new_v, b.v AS old_v FROM later a FULL JOIN earlier b USING (repo_id, no, id))"""


@query(
    "p2_found",
    _CELLS
    + """
SELECT repo_id, no AS snapshot_no, id, CASE WHEN old_v IS NULL THEN 'added' WHEN new_v IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM both_sides WHERE new_v IS DISTINCT FROM old_v""",
)
def p2_found(spark, d):
    return snapshots.snapshot_changes(table(spark, d, "node_snapshots"), table(spark, d, "graph_meta")).drop("changed_fields")


@query(
    "p2_changed_fields",
    _CELLS
    + """
, cells AS (SELECT no, unnest(range(1, 7)) AS f, new_v, old_v FROM both_sides WHERE new_v IS DISTINCT FROM old_v AND new_v IS NOT NULL AND old_v IS NOT NULL)
SELECT no AS snapshot_no, ['type', 'name', 'file_path', 'start_line', 'end_line', 'properties'][f] AS field, count(*) AS n_changed
FROM cells WHERE list_sort(list_distinct(list_transform(new_v, lambda x: x[f]))) <> list_sort(list_distinct(list_transform(old_v, lambda x: x[f])))
GROUP BY ALL""",
)
def p2_changed_fields(spark, d):
    """How often each field changed, by the number of the delivery."""
    found = snapshots.snapshot_changes(table(spark, d, "node_snapshots"), table(spark, d, "graph_meta"))
    return found.select("snapshot_no", F.explode("changed_fields").alias("field")).groupBy("snapshot_no", "field").agg(F.count(F.lit(1)).alias("n_changed"))


_LEDGER = """
WITH cuts AS (SELECT workspace_id, feed, max(cut_at) AS cut FROM sync_runs WHERE status = 'succeeded' GROUP BY ALL),
items AS (
  SELECT 'release_events' AS feed, workspace_id, CAST(seq AS VARCHAR) AS record_key, loaded_at AS t, loaded_at, coalesce(request_hash, '') AS v FROM intent_release_events WHERE seq IS NOT NULL
  UNION ALL SELECT 'repo_states', workspace_id, repo_key, observed_at, loaded_at,
    coalesce(last_parse_hash, '-') || '|' || coalesce(CAST(epoch_us(CAST(last_pushed_at AS TIMESTAMPTZ)) AS VARCHAR), '-') FROM repo_states WHERE repo_key IS NOT NULL),
folded AS (
  SELECT feed, workspace_id, record_key, arg_max(v, t) AS newest, arg_max(v, t) FILTER (loaded_at <= cut) AS seen
  FROM items LEFT JOIN cuts USING (workspace_id, feed) WHERE workspace_id IS NOT NULL GROUP BY ALL)"""


def _ledger(spark, d):
    items = ledger.release_items(table(spark, d, "intent_release_events")).unionByName(ledger.repo_state_items(table(spark, d, "repo_states")))
    return ledger.replay(items, table(spark, d, "sync_runs"))


@query("p3_found", _LEDGER + " SELECT feed, workspace_id, record_key FROM folded WHERE newest IS DISTINCT FROM seen")
def p3_found(spark, d):
    return _ledger(spark, d).where("state <> 'done'").select(*ledger.KEY)


@query("p3_backlog", _LEDGER + " SELECT feed, workspace_id, count(*) AS n_records, count(*) FILTER (newest IS DISTINCT FROM seen) AS n_open FROM folded GROUP BY ALL")
def p3_backlog(spark, d):
    """Open and known records of each workspace and feed."""
    return _ledger(spark, d).groupBy("feed", "workspace_id").agg(F.count(F.lit(1)).alias("n_records"), F.count_if(F.col("state") != "done").alias("n_open"))


_ORPHANS = f"""
WITH {_CHAIN},
anchors AS (SELECT id, (min({{'c': created_at, 'n': node_id}})).c AS created_at, (min({{'c': created_at, 'n': node_id}})).n AS node_id FROM intent_anchors WHERE id IS NOT NULL GROUP BY id),
held AS (SELECT s.id AS node_id, min(taken_at) AS first FROM node_snapshots s JOIN applied a ON s.repo_id = a.repo_id AND s.snapshot_no = a.no GROUP BY s.id),
now_ids AS (SELECT DISTINCT id AS node_id FROM nodes),
causes AS (
  SELECT a.id AS anchor_id, strftime(created_at, '%Y-%m') AS period,
    CASE WHEN n.node_id IS NULL THEN CASE WHEN h.node_id IS NULL THEN 'missing' ELSE 'deleted' END WHEN h.first > created_at THEN 'late' END AS cause
  FROM anchors a LEFT JOIN now_ids n USING (node_id) LEFT JOIN held h USING (node_id) WHERE a.node_id IS NOT NULL)"""


def _orphans(spark, d):
    return orphans.orphan_references(*[table(spark, d, t) for t in ("intent_anchors", "nodes", "node_snapshots", "graph_meta")])


@query("p5_found", _ORPHANS + " SELECT * FROM causes WHERE cause IS NOT NULL")
def p5_found(spark, d):
    return _orphans(spark, d)


@query("p5_report", _ORPHANS + """, ends AS (SELECT 'edges.source_id' AS t, id, min(source_id) AS node_id FROM edges WHERE id IS NOT NULL GROUP BY id UNION ALL SELECT 'edges.target_id', id, min(target_id) FROM edges WHERE id IS NOT NULL GROUP BY id),
gone AS (SELECT t, CASE WHEN h.node_id IS NULL THEN 'missing' ELSE 'deleted' END AS cause FROM ends LEFT JOIN now_ids n USING (node_id) LEFT JOIN held h USING (node_id) WHERE ends.node_id IS NOT NULL AND n.node_id IS NULL)
SELECT 'intent_anchors' AS "table", period, cause, count(*) AS n_refs FROM causes WHERE cause IS NOT NULL GROUP BY ALL UNION ALL SELECT t, NULL, cause, count(*) FROM gone GROUP BY ALL""")
def p5_report(spark, d):
    """Orphan references by table, period and cause."""
    return orphans.reference_report(*[table(spark, d, t) for t in ("intent_anchors", "edges", "nodes", "node_snapshots", "graph_meta")])


_TREE = """
WITH RECURSIVE f AS (
  SELECT id, (max({'u': updated_at, 'p': parent_feature_id, 'd': domain_id, 'w': workspace_id})) AS r FROM intent_features WHERE id IS NOT NULL GROUP BY id),
links AS (SELECT a.id AS v, b.id AS p FROM f a JOIN f b ON a.r.p = b.id AND a.r.w = b.r.w AND a.r.d = b.r.d),
walk AS (
  SELECT id AS v, id AS root, 0 AS depth, [id] AS path FROM f WHERE id NOT IN (SELECT v FROM links)
  UNION ALL SELECT l.v, w.root, w.depth + 1, list_append(w.path, l.v) FROM walk w JOIN links l ON l.p = w.v)"""


@query("p6_found", _TREE + " SELECT f.id AS feature_id, coalesce(w.root, '') AS root_id, coalesce(w.depth, -1) AS depth FROM f LEFT JOIN walk w ON w.v = f.id")
def p6_found(spark, d):
    return hierarchy.feature_roots(table(spark, d, "intent_features"))


@query("p6_paths", _TREE + " SELECT v AS feature_id, root AS root_id, depth, array_to_string(path, '/') AS path FROM walk")
def p6_paths(spark, d):
    """Full path of every feature that reaches a root."""
    return hierarchy.feature_paths(table(spark, d, "intent_features")).withColumn("path", F.array_join("path", "/"))


@query("p6_descendants", _TREE + " SELECT path[i] AS ancestor_id, v AS descendant_id, CAST(depth + 1 - i AS INTEGER) AS distance FROM (SELECT v, depth, path, unnest(range(1, depth + 1)) AS i FROM walk)")
def p6_descendants(spark, d):
    """All descendants of every feature."""
    return hierarchy.feature_descendants(table(spark, d, "intent_features"))
