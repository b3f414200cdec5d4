"""A typed graph out of the order tables, for the reads whose kinds of nodes
and edges the code graph lacks.

region: repository. nation: package. customer: file. order: function
(exported when its priority is 1; a call chain along the orders that one
supplier serves). part: entity, with its brand as table and its type as
class. supplier: entrypoint, handled by the first order it serves. lineitem of
a supplier abroad: external call of the order that resolves to the supplier.
An order without lineitem: unresolved call."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import EDGE_COLUMNS, NODE_COLUMNS, Graph
from ..scale import scratch_dir
from .tables import table

#: The same graph in SQL: fn, calls, ops, ext, ep, ent, un as common table expressions.
SQL = """
home AS (SELECT c_custkey, 'r' || n_regionkey AS repo, n_nationkey AS pkg FROM customer JOIN nation ON c_nationkey = n_nationkey),
fn AS (SELECT h.repo || ':function:' || o_orderkey AS id, o_orderkey AS k, repo, pkg, h.repo || ':file:' || o_custkey AS file, 'order_' || o_orderkey AS name,
  o_orderpriority LIKE '1%' AS exported FROM orders JOIN home h ON o_custkey = c_custkey),
line AS (SELECT DISTINCT l_orderkey, l_suppkey, l_partkey, l_returnflag FROM lineitem),
nx AS (SELECT l_suppkey AS k, l_orderkey AS s, lead(l_orderkey) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS t FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)),
arc AS (SELECT DISTINCT CASE WHEN (s + k) % 7 = 0 THEN t ELSE s END AS a, CASE WHEN (s + k) % 7 = 0 THEN s ELSE t END AS b FROM nx WHERE t IS NOT NULL AND s <> t),
calls AS (SELECT x.id AS source_id, y.id AS target_id, CASE WHEN (a + b) % 5 = 0 THEN 0.5 ELSE 1.0 END AS confidence, CASE WHEN (a + b) % 5 = 0 THEN 'ai' ELSE 'parser' END AS created_by
  FROM arc JOIN fn x ON x.k = a JOIN fn y ON y.k = b),
ent AS (SELECT 'r0:entity:' || p_partkey AS id, p_name AS name, p_brand AS tbl, p_type AS kind, p_partkey AS k FROM part),
ops AS (SELECT DISTINCT f.id AS source_id, e.id AS target_id, l_returnflag AS operation FROM line JOIN fn f ON f.k = l_orderkey JOIN ent e ON e.k = l_partkey),
ep AS (SELECT 'r' || n_regionkey || ':entrypoint:' || s_suppkey AS id, 'r' || n_regionkey AS repo, s_suppkey AS k, s_nationkey AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey),
handles AS (SELECT ep.id AS source_id, f.id AS target_id FROM (SELECT l_suppkey, min(l_orderkey) AS k FROM line GROUP BY 1) m JOIN ep ON ep.k = l_suppkey JOIN fn f ON f.k = m.k),
ext AS (SELECT DISTINCT f.repo || ':external_call:' || f.k || '-' || ep.k AS id, f.repo, f.id AS caller, ep.id AS ep_id, ep.repo AS ep_repo, 'svc-' || ep.nation AS service, '/svc/' || ep.nation || '/supplier/' || ep.k AS path
  FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM line) JOIN fn f ON f.k = l_orderkey JOIN ep ON ep.k = l_suppkey WHERE ep.nation <> f.pkg),
un AS (SELECT f.repo AS repo_id, f.id AS caller_id, 'this.queue.call_' || (f.k % 10) AS callee_expression, 'call_' || (f.k % 10) AS callee_name_tail, f.file AS file_path, f.k % 500 AS line
  FROM fn f WHERE NOT EXISTS (SELECT 1 FROM line WHERE l_orderkey = f.k))"""


def _tag(repo: Column, kind: str, key: Column) -> Column:
    return F.concat(repo, F.lit(f":{kind}:"), key.cast("string"))


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def _nodes(df: DataFrame, kind: str, name: Column, properties: Column, file_path: Column | None = None, line: Column | None = None) -> DataFrame:
    null = F.lit(None)
    return df.select("id", F.lit(kind).alias("type"), name.alias("name"), properties.alias("properties"), null.cast("string").alias("summary"), F.col("repo").alias("repo_id"), (file_path if file_path is not None else null).cast("string").alias("file_path"), (line if line is not None else null).cast("long").alias("start_line"), null.cast("long").alias("end_line"))


def _edges(df: DataFrame, kind: str, confidence: Column | None = None, created_by: Column | None = None, properties: Column | None = None) -> DataFrame:
    extra = [F.concat(F.lit("/"), properties)] if properties is not None and kind == "OPERATES_ON" else []
    return df.select(
        F.concat("source_id", F.lit(f":{kind}:"), "target_id", *extra).alias("id"), "source_id", "target_id", F.lit(kind).alias("type"), (confidence if confidence is not None else F.lit(1.0)).alias("confidence"), (created_by if created_by is not None else F.lit("parser")).alias("created_by"), (properties if properties is not None else F.lit("{}")).alias("properties")
    )


#: Graphs built by this process: (application, folder) to where they are stored.
_STORED: dict[tuple[str, str], str] = {}


def trade_graph(spark: SparkSession, folder: str) -> tuple[Graph, DataFrame]:
    """The graph and its unresolved calls (repo_id, caller_id,
    callee_expression, callee_name_tail, file_path, line).

    It is built once for a session and folder and stored by type, so that a
    read scans the types it asks for and nothing else."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _STORED or not _exists(spark, _STORED[key]):
        g, un = build_trade_graph(spark, folder)
        root = f"{scratch_dir(spark)}/trade-{uuid.uuid4().hex}"
        g.nodes.write.partitionBy("type").parquet(f"{root}/nodes")
        g.edges.write.partitionBy("type").parquet(f"{root}/edges")
        un.write.parquet(f"{root}/unresolved")
        _STORED[key] = root
    read = lambda name, cols: spark.read.parquet(f"{_STORED[key]}/{name}").select(*cols)
    un = spark.read.parquet(f"{_STORED[key]}/unresolved")
    return Graph(read("nodes", ("id", *NODE_COLUMNS)), read("edges", ("id", *EDGE_COLUMNS))), un


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path + "/unresolved/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def build_trade_graph(spark: SparkSession, folder: str) -> tuple[Graph, DataFrame]:
    """The graph and its unresolved calls as plans over the tables."""
    t = lambda n: table(spark, folder, n)
    region, nation, part = t("region"), t("nation"), t("part")
    home = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", F.concat(F.lit("r"), "n_regionkey").alias("repo"), F.col("n_nationkey").alias("pkg"))
    fn = t("orders").join(home, F.col("o_custkey") == F.col("c_custkey")).select(_tag(F.col("repo"), "function", F.col("o_orderkey")).alias("id"), F.col("o_orderkey").alias("k"), "repo", "pkg", _tag(F.col("repo"), "file", F.col("o_custkey")).alias("file"), F.startswith("o_orderpriority", F.lit("1")).alias("exported"))
    line = t("lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_returnflag")
    served = line.select("l_orderkey", "l_suppkey").distinct()
    nx = served.select(F.col("l_suppkey").alias("k"), F.col("l_orderkey").alias("s"), F.lead("l_orderkey").over(Window.partitionBy("l_suppkey").orderBy("l_orderkey")).alias("t")).where("t is not null and s <> t")
    turn = (F.col("s") + F.col("k")) % 7 == 0
    arc = nx.select(F.when(turn, F.col("t")).otherwise(F.col("s")).alias("a"), F.when(turn, F.col("s")).otherwise(F.col("t")).alias("b")).distinct()
    f = lambda p: fn.select(F.col("id").alias(f"{p}_id"), F.col("k").alias(f"{p}_k"))
    met = arc.join(f("x"), F.col("a") == F.col("x_k")).join(f("y"), F.col("b") == F.col("y_k")).select(F.col("x_id").alias("source_id"), F.col("y_id").alias("target_id"), ((F.col("a") + F.col("b")) % 5 == 0).alias("odd"))
    calls = _edges(met, "CALLS", F.when(F.col("odd"), 0.5).otherwise(1.0), F.when(F.col("odd"), "ai").otherwise("parser"), _json(inferred=F.col("odd")))
    ent = part.select(_tag(F.lit("r0"), "entity", F.col("p_partkey")).alias("id"), F.lit("r0").alias("repo"), "p_name", "p_brand", "p_type", F.col("p_partkey").alias("k"))
    operated = line.select("l_orderkey", "l_partkey", "l_returnflag").distinct().join(f("f"), F.col("l_orderkey") == F.col("f_k")).join(ent.select(F.col("id").alias("target_id"), F.col("k").alias("e_k")), F.col("l_partkey") == F.col("e_k"))
    ops = _edges(operated.select(F.col("f_id").alias("source_id"), "target_id", "l_returnflag"), "OPERATES_ON", properties=_json(operation=F.col("l_returnflag")))
    ep = t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(_tag(F.concat(F.lit("r"), "n_regionkey"), "entrypoint", F.col("s_suppkey")).alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("repo"), F.col("s_suppkey").alias("s_k"), F.col("s_nationkey").alias("s_nation"))
    first = line.groupBy("l_suppkey").agg(F.min("l_orderkey").alias("m"))
    handles = _edges(first.join(ep.select(F.col("id").alias("source_id"), "s_k"), F.col("l_suppkey") == F.col("s_k")).join(f("f"), F.col("m") == F.col("f_k")).select("source_id", F.col("f_id").alias("target_id")), "HANDLES")
    abroad = served.join(fn.select(F.col("id").alias("caller"), "k", "repo", "pkg"), F.col("l_orderkey") == F.col("k")).join(ep.select(F.col("id").alias("ep_id"), "s_k", "s_nation"), F.col("l_suppkey") == F.col("s_k")).where(F.col("s_nation") != F.col("pkg"))
    ext = abroad.select(_tag(F.col("repo"), "external_call", F.concat(F.col("k").cast("string"), F.lit("-"), F.col("s_k").cast("string"))).alias("id"), "repo", "caller", "ep_id", F.concat(F.lit("svc-"), "s_nation").alias("service"), F.concat(F.lit("/svc/"), "s_nation", F.lit("/supplier/"), "s_k").alias("path")).distinct()
    makes = _edges(ext.select(F.col("caller").alias("source_id"), F.col("id").alias("target_id")), "MAKES_EXTERNAL_CALL")
    resolves = _edges(ext.select(F.col("id").alias("source_id"), F.col("ep_id").alias("target_id")), "RESOLVES_TO", F.lit(0.95), F.lit("linker"), F.lit('{"chain":["direct","http"]}'))
    pkg = nation.select(_tag(F.concat(F.lit("r"), "n_regionkey"), "package", F.col("n_nationkey")).alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("repo"), F.col("n_name"))
    files = home.select(_tag(F.col("repo"), "file", F.col("c_custkey")).alias("id"), "repo", "c_name", _tag(F.col("repo"), "package", F.col("pkg")).alias("package"))
    extends = _edges(part.select(F.concat(F.lit("r0:class:"), "p_type").alias("source_id"), F.concat(F.lit("r0:class:"), "p_brand").alias("target_id")).distinct(), "EXTENDS")
    implements = _edges(part.select(F.concat(F.lit("r0:class:"), "p_type").alias("source_id"), F.concat(F.lit("r0:interface:size-"), "p_size").alias("target_id")).distinct(), "IMPLEMENTS_INTERFACE")
    uses_type = _edges(operated.select(F.col("f_id").alias("source_id"), F.concat(F.lit("r0:interface:size-"), F.col("e_k") % 50).alias("target_id")).distinct(), "USES_TYPE", properties=F.lit('{"usage":"parameter"}'))
    classes = part.select(F.concat(F.lit("r0:class:"), "p_type").alias("id"), F.lit("r0").alias("repo"), F.col("p_type").alias("n")).unionByName(part.select(F.concat(F.lit("r0:class:"), "p_brand").alias("id"), F.lit("r0").alias("repo"), F.col("p_brand").alias("n"))).distinct()
    none = F.lit("{}")
    nodes = [
        _nodes(region.select(F.concat(F.lit("r"), "r_regionkey", F.lit(":repository")).alias("id"), F.concat(F.lit("r"), "r_regionkey").alias("repo"), "r_name"), "repository", F.col("r_name"), none),
        _nodes(pkg, "package", F.col("n_name"), none),
        _nodes(files, "file", F.col("c_name"), none, F.col("c_name")),
        _nodes(fn, "function", F.concat(F.lit("order_"), "k"), _json(isExported=F.col("exported"), kind=F.lit("function")), F.col("file"), F.col("k") % 500),
        _nodes(ent, "entity", F.col("p_name"), _json(tableName=F.col("p_brand"))),
        _nodes(classes, "class", F.col("n"), none),
        _nodes(ep, "entrypoint", F.concat(F.lit("supplier "), "s_k"), _json(entrypointType=F.lit("http"), method=F.lit("GET"), path=F.concat(F.lit("/svc/"), "s_nation", F.lit("/supplier/"), "s_k"))),
        _nodes(ext, "external_call", F.col("path"), _json(targetService=F.col("service"), protocol=F.lit("http"), path=F.col("path"))),
    ]
    edges = [
        calls, ops, handles, makes, resolves, extends, implements, uses_type,
        _edges(files.select(F.col("package").alias("source_id"), F.col("id").alias("target_id")), "CONTAINS_FILE"),
        _edges(fn.select(F.col("file").alias("source_id"), F.col("id").alias("target_id")), "CONTAINS_FUNCTION"),
    ]
    edges = [x.select("id", *EDGE_COLUMNS) for x in edges]
    all_nodes, all_edges = nodes[0], edges[0]
    for x in nodes[1:]:
        all_nodes = all_nodes.unionByName(x)
    for x in edges[1:]:
        all_edges = all_edges.unionByName(x)
    bare = fn.join(served.select(F.col("l_orderkey").alias("k")).distinct(), "k", "left_anti")
    un = bare.select(F.col("repo").alias("repo_id"), F.col("id").alias("caller_id"), F.concat(F.lit("this.queue.call_"), F.col("k") % 10).alias("callee_expression"), F.concat(F.lit("call_"), F.col("k") % 10).alias("callee_name_tail"), F.col("file").alias("file_path"), (F.col("k") % 500).alias("line"))
    return Graph(all_nodes, all_edges), un
