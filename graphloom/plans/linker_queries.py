"""Queries of the linker (L). Calls and entrypoints come from the order
tables: suppliers answer under routes of their nation, orders call them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.paths import param_blind, signature
from ..operators import linker
from ..scale import Scratch
from ..sources.tables import table
from .registry import Registry

REGISTRY = Registry()
query = REGISTRY.query

_SIG = "regexp_replace(regexp_replace('/' || regexp_replace(regexp_replace(regexp_replace({0}, '[?#].*$', ''), '([A-Za-z0-9_-])\\$\\{{[^}}]*\\}}$', '\\1'), '\\$\\{{[^}}]*\\}}|\\{{[^}}]*\\}}|:[A-Za-z_][A-Za-z0-9_]*', ':_', 'g'), '/+', '/', 'g'), '(.)/$', '\\1')"

_BASE = f"""WITH home AS (SELECT o_orderkey AS k, 'r' || n_regionkey AS repo, n_nationkey AS nation FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
sup AS (SELECT s_suppkey AS k, s_nationkey AS nation, 'r' || n_regionkey AS repo FROM supplier JOIN nation ON s_nationkey = n_nationkey),
calls AS (SELECT DISTINCT h.k || '-' || s.k AS call_id, h.repo AS repo_id, CASE WHEN s.k % 3 = 0 THEN 'post' ELSE 'GET' END AS method,
  CASE WHEN s.k % 9 = 0 THEN '/gw' ELSE '' END || '/svc/' || s.nation || '/supplier/' || CASE WHEN h.k % 4 = 0 THEN '${{id}}' ELSE CAST(s.k AS VARCHAR) END || '?q=1' AS path, ' Svc-' || s.nation AS service, 'http' AS protocol
  FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) JOIN home h ON h.k = l_orderkey JOIN sup s ON s.k = l_suppkey WHERE s.nation <> h.nation),
eps AS (SELECT 'n' || n_nationkey AS ep_id, 'r' || n_regionkey AS repo_id, CASE WHEN n_nationkey % 2 = 0 THEN 'ALL' ELSE 'GET' END AS method, '/svc/' || n_nationkey || '/supplier/:id' AS path FROM nation
  UNION ALL SELECT 's' || k, repo, 'GET', '/svc/' || nation || '/supplier/' || k || '/' FROM sup WHERE k % 5 = 0
  UNION ALL SELECT 'any', 'r0', 'POST', '/svc/{{n}}/supplier/{{id}}' UNION ALL SELECT 'twin', 'r1', 'GET', '/svc/3/supplier/{{key}}'),
idx AS (SELECT ep_id, repo_id AS ep_repo, unnest(CASE WHEN method = 'ALL' THEN ['GET', 'POST', 'PUT', 'PATCH', 'DELETE', 'HEAD', 'OPTIONS', 'ALL'] ELSE [method] END) AS method, {_SIG.format('path')} AS sig FROM eps),
ix AS (SELECT *, string_split(sig[2:], '/') AS seg, len(list_filter(string_split(sig[2:], '/'), lambda x: x = ':_')) AS params FROM idx),
cs AS (SELECT *, upper(method) AS m, {_SIG.format('path')} AS sig, string_split({_SIG.format('path')}[2:], '/') AS seg FROM calls),
met AS (SELECT call_id, ep_id, ep_repo, params, cs.sig = ix.sig AS same FROM cs JOIN ix ON m = ix.method AND len(cs.seg) = len(ix.seg) AND len(list_filter(list_zip(cs.seg, ix.seg), lambda z: z[2] <> ':_' AND z[1] <> z[2])) = 0),
top AS (SELECT call_id, max(same) AS same, min(params) FILTER (NOT same) AS p FROM met GROUP BY ALL),
kept AS (SELECT met.* FROM met JOIN top USING (call_id) WHERE met.same AND top.same OR NOT top.same AND params = p),
one AS (SELECT call_id, CASE WHEN count(DISTINCT ep_id) = 1 THEN min(ep_id) END AS ep_id, CASE WHEN count(DISTINCT ep_id) = 1 THEN min(ep_repo) END AS ep_repo, CASE WHEN count(DISTINCT ep_id) = 1 THEN 'matched' ELSE 'ambiguous' END AS verdict FROM kept GROUP BY ALL),
direct AS (SELECT call_id, ep_id, ep_repo, coalesce(verdict, 'no-entrypoint-match') AS verdict FROM calls LEFT JOIN one USING (call_id))"""


def calls_of(spark, d):
    """Calls between nations: call_id, repo_id, method, path, service, protocol."""
    nation = table(spark, d, "nation")
    home = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat(F.lit("r"), "n_regionkey").alias("repo_id"), F.col("n_nationkey").alias("h_nation"))
    o = table(spark, d, "orders").join(home, F.col("o_custkey") == F.col("c_custkey"))
    served = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    j = served.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).where("s_nationkey <> h_nation")
    k = F.col("s_suppkey")
    path = F.concat(F.when(k % 9 == 0, "/gw").otherwise(""), F.lit("/svc/"), "s_nationkey", F.lit("/supplier/"), F.when(F.col("o_orderkey") % 4 == 0, F.lit("${id}")).otherwise(k.cast("string")), F.lit("?q=1"))
    return j.select(F.concat(F.col("o_orderkey").cast("string"), F.lit("-"), k.cast("string")).alias("call_id"), "repo_id", F.when(k % 3 == 0, "post").otherwise("GET").alias("method"), path.alias("path"), F.concat(F.lit(" Svc-"), "s_nationkey").alias("service"), F.lit("http").alias("protocol"))


def entrypoints_of(spark, d):
    """Routes: one with a parameter for each nation, literal ones for some
    suppliers, a general one, and a twin that makes one ambiguous."""
    nation = table(spark, d, "nation")
    repo = F.concat(F.lit("r"), "n_regionkey")
    a = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("ep_id"), repo.alias("repo_id"), F.when(F.col("n_nationkey") % 2 == 0, "ALL").otherwise("GET").alias("method"), F.concat(F.lit("/svc/"), "n_nationkey", F.lit("/supplier/:id")).alias("path"))
    s = table(spark, d, "supplier").where("s_suppkey % 5 = 0").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    b = s.select(F.concat(F.lit("s"), "s_suppkey").alias("ep_id"), repo.alias("repo_id"), F.lit("GET").alias("method"), F.concat(F.lit("/svc/"), "s_nationkey", F.lit("/supplier/"), "s_suppkey", F.lit("/")).alias("path"))
    c = spark.createDataFrame([("any", "r0", "POST", "/svc/{n}/supplier/{id}"), ("twin", "r1", "GET", "/svc/3/supplier/{key}")], "ep_id string, repo_id string, method string, path string")
    return a.unionByName(b).unionByName(c)


@query("l01_normalize_paths", f"{_BASE} SELECT DISTINCT path, {_SIG.format('path')} AS sig FROM (SELECT path FROM calls UNION SELECT path FROM eps)")
def l01(spark, d):
    p = calls_of(spark, d).select("path").union(entrypoints_of(spark, d).select("path")).distinct()
    return p.select("path", signature(F.col("path")).alias("sig"))


@query("l02_entry_index", f"{_BASE} SELECT ep_id, ep_repo, method, sig, params FROM ix")
def l02(spark, d):
    return linker.entry_index(entrypoints_of(spark, d)).drop("mask")


@query("l03_http_match", f"{_BASE} SELECT * FROM direct")
def l03(spark, d):
    s = Scratch(spark, "match")
    return linker.http_match(s.keep(calls_of(spark, d)), s.keep(linker.entry_index(entrypoints_of(spark, d))), s)


@query("l05_longest_prefix", "WITH p AS (SELECT 'app/' || regexp_extract(file_path, '^[^/]*/([^/]*)', 1) AS prefix, min(repo_id) AS owner, count(DISTINCT repo_id) AS n FROM nodes WHERE file_path LIKE 'app/%/%' GROUP BY 1 UNION ALL SELECT 'app', min(repo_id), count(DISTINCT repo_id) FROM nodes WHERE file_path LIKE 'app/%/%'), f AS (SELECT DISTINCT file_path FROM source_files), m AS (SELECT file_path, p.* FROM f JOIN p ON file_path = prefix OR starts_with(file_path, prefix || '/')) SELECT file_path, CASE WHEN arg_max(n, len(prefix)) = 1 THEN arg_max(owner, len(prefix)) END AS owner, arg_max(prefix, len(prefix)) AS prefix FROM m GROUP BY 1")
def l05(spark, d):
    """Owner of the folder that each source file lies in."""
    n = table(spark, d, "nodes").where("file_path like 'app/%/%'")
    folders = F.array(F.lit("app"), F.concat(F.lit("app/"), F.regexp_extract("file_path", "^[^/]*/([^/]*)", 1)))
    # app is a prefix even where no node lies below it
    p = n.select(F.explode(folders).alias("prefix"), F.col("repo_id").alias("owner")).unionByName(spark.createDataFrame([("app", None)], "prefix string, owner string"))
    return linker.longest_prefix(table(spark, d, "source_files").select("file_path").distinct(), "file_path", "file_path", p)


_MSG = """WITH c AS (SELECT event_id AS call_id, CASE WHEN user_id % 2 = 0 THEN ' Kafka' ELSE 'kafka' END AS system, CASE WHEN k % 3 = 0 THEN NULL ELSE 'topic-' || (k % 40) END AS value, CASE WHEN k % 5 = 0 THEN NULL ELSE 'ref-' || (k % 30) END AS ref FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)),
e AS (SELECT DISTINCT 'q' || s_suppkey AS ep_id, 'r' || (s_nationkey % 5) AS ep_repo, 'kafka' AS system, CASE WHEN s_suppkey % 2 = 0 THEN 'topic-' || (s_suppkey % 35) ELSE 'ref-' || (s_suppkey % 25) END AS destination FROM supplier WHERE s_suppkey < 45),
v AS (SELECT call_id, count(DISTINCT ep_id) AS n, min(ep_id) AS ep_id, min(ep_repo) AS ep_repo FROM c JOIN e ON lower(trim(c.system)) = e.system AND value = destination GROUP BY ALL),
r AS (SELECT call_id, count(DISTINCT ep_id) AS n, min(ep_id) AS ep_id, min(ep_repo) AS ep_repo FROM c JOIN e ON lower(trim(c.system)) = e.system AND ref = destination WHERE call_id NOT IN (SELECT call_id FROM v) GROUP BY ALL), u AS (FROM v UNION ALL FROM r)
SELECT call_id, CASE WHEN n = 1 THEN ep_id END AS ep_id, CASE WHEN n = 1 THEN ep_repo END AS ep_repo, CASE WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'ambiguous' WHEN value IS NULL AND ref IS NULL THEN 'no-destination' ELSE 'no-messaging-match' END AS verdict FROM c LEFT JOIN u USING (call_id)"""


@query("l06_message_match", _MSG)
def l06(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    c = table(spark, d, "events").withColumn("k", k).select(F.col("event_id").alias("call_id"), F.when(F.col("user_id") % 2 == 0, " Kafka").otherwise("kafka").alias("system"), F.when(F.col("k") % 3 == 0, None).otherwise(F.concat(F.lit("topic-"), F.col("k") % 40)).alias("value"), F.when(F.col("k") % 5 == 0, None).otherwise(F.concat(F.lit("ref-"), F.col("k") % 30)).alias("ref"))
    s = F.col("s_suppkey")
    # a small set of consumers is the fixture here
    e = table(spark, d, "supplier").where("s_suppkey < 45").select(F.concat(F.lit("q"), s).alias("ep_id"), F.concat(F.lit("r"), F.col("s_nationkey") % 5).alias("repo_id"), F.lit("kafka").alias("system"), F.when(s % 2 == 0, F.concat(F.lit("topic-"), s % 35)).otherwise(F.concat(F.lit("ref-"), s % 25)).alias("destination"))
    return linker.message_match(c, e)


_SERVICES = "svc AS (SELECT 'svc-' || n_nationkey AS service, 'r' || n_regionkey AS repo_id FROM nation WHERE n_nationkey % 3 <> 0)"
_HOP = f"""{_BASE}, {_SERVICES}, aimed AS (SELECT calls.*, svc.repo_id AS to_repo FROM calls LEFT JOIN svc ON lower(trim(calls.service)) = svc.service),
smet AS (SELECT met.*, t.same AS ts, t.p AS tp FROM met JOIN aimed USING (call_id) JOIN (SELECT call_id, max(same) AS same, min(params) FILTER (NOT same) AS p FROM met JOIN aimed USING (call_id) WHERE ep_repo = to_repo GROUP BY ALL) t USING (call_id) WHERE ep_repo = to_repo),
sone AS (SELECT call_id, CASE WHEN count(DISTINCT ep_id) = 1 THEN min(ep_id) END AS ep_id, CASE WHEN count(DISTINCT ep_id) = 1 THEN min(ep_repo) END AS ep_repo, CASE WHEN count(DISTINCT ep_id) = 1 THEN 'matched' ELSE 'ambiguous' END AS verdict, 'scoped' AS via FROM smet WHERE same AND ts OR NOT ts AND params = tp GROUP BY call_id),
wide AS (SELECT call_id, ep_id, ep_repo, verdict, 'direct' AS via FROM one WHERE call_id NOT IN (SELECT call_id FROM sone)),
rest AS (SELECT cs.call_id, cs.m, string_split(regexp_replace(sig, '^/gw(?=/)', '')[2:], '/') AS seg, regexp_replace(sig, '^/gw', '') AS sig FROM (SELECT call_id, m, CASE WHEN starts_with(sig, '/gw/') THEN sig[4:] ELSE sig END AS sig FROM cs) cs WHERE call_id NOT IN (SELECT call_id FROM sone) AND call_id NOT IN (SELECT call_id FROM wide)),
rmet AS (SELECT call_id, ep_id, ep_repo, params, r.sig = ix.sig AS same FROM (SELECT call_id, m, sig, string_split(sig[2:], '/') AS seg FROM rest) r JOIN ix ON m = ix.method AND len(r.seg) = len(ix.seg) AND len(list_filter(list_zip(r.seg, ix.seg), lambda z: z[2] <> ':_' AND z[1] <> z[2])) = 0),
rt AS (SELECT call_id, max(same) AS s, min(params) FILTER (NOT same) AS p FROM rmet GROUP BY ALL),
rone AS (SELECT call_id, CASE WHEN count(DISTINCT ep_id) = 1 THEN min(ep_id) END AS ep_id, CASE WHEN count(DISTINCT ep_id) = 1 THEN min(ep_repo) END AS ep_repo, CASE WHEN count(DISTINCT ep_id) = 1 THEN 'matched' ELSE 'ambiguous' END AS verdict FROM rmet JOIN rt USING (call_id) WHERE same AND s OR NOT s AND params = p GROUP BY ALL),
hops AS (FROM sone UNION ALL FROM wide UNION ALL SELECT rest.call_id, ep_id, ep_repo, coalesce(verdict, 'no-entrypoint-match') AS verdict, 'strip' AS via FROM rest LEFT JOIN rone USING (call_id))"""
_HOP = _HOP.replace("string_split(regexp_replace(sig, '^/gw(?=/)', '')[2:], '/') AS seg, regexp_replace(sig, '^/gw', '') AS sig FROM", "sig FROM")


def services_of(spark, d):
    """Names of services and their repositories."""
    return table(spark, d, "nation").where("n_nationkey % 3 <> 0").select(F.concat(F.lit("SVC-"), "n_nationkey").alias("service"), F.concat(F.lit("r"), "n_regionkey").alias("repo_id"))


def hops_of(spark, d):
    """Calls and their hops; the calls are kept, as every stage reads them."""
    s = Scratch(spark, "linker")
    calls = s.keep(calls_of(spark, d))
    return calls, s.keep(linker.hop(calls, entrypoints_of(spark, d), services_of(spark, d), ("/gw",)))


@query("l10_hop_with_fallback", f"{_HOP} SELECT * FROM hops")
def l10(spark, d):
    return hops_of(spark, d)[1]


@query("l08_hop_verdicts", f"{_HOP} SELECT via, verdict, count(*) AS n FROM hops GROUP BY ALL")
def l08(spark, d):
    return hops_of(spark, d)[1].groupBy("via", "verdict").agg(F.count(F.lit(1)).alias("n"))


_EDGES = f"{_HOP}, edges_ AS (SELECT 'resolve:' || call_id || ':' || ep_id AS edge_id, call_id, ep_id, via || '+http' AS via, 0.95 AS confidence, 'inferred' AS level FROM hops JOIN calls USING (call_id) WHERE ep_id IS NOT NULL AND ep_repo <> repo_id)"


def _edges(spark, d):
    calls, hops = hops_of(spark, d)
    return calls, linker.edges_of(hops.withColumn("confidence", F.lit(linker.PROTOCOL_CONFIDENCE)), calls)


@query("l20_edges", f"{_EDGES} SELECT * FROM edges_")
def l20(spark, d):
    return _edges(spark, d)[1]


@query("l20_metrics", f"{_EDGES} SELECT repo_id, count(*) AS n_calls, count(*) FILTER (service IN (' Svc-1', ' Svc-2')) AS n_excluded, count(e.call_id) FILTER (service NOT IN (' Svc-1', ' Svc-2')) AS n_edges, round(count(e.call_id) FILTER (service NOT IN (' Svc-1', ' Svc-2')) / nullif(count(*) FILTER (service NOT IN (' Svc-1', ' Svc-2')), 0), 6) AS rate FROM calls LEFT JOIN edges_ e USING (call_id) GROUP BY ALL")
def l20b(spark, d):
    calls, edges = _edges(spark, d)
    return linker.link_metrics(edges, calls, spark.createDataFrame([(" Svc-1",), (" Svc-2",)], "service string"))


@query("l24_unresolved_services", f"{_EDGES} SELECT trim(service) AS service, count(*) AS n_unresolved, NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey % 3 <> 0 AND 'Svc-' || n_nationkey = trim(calls.service)) AS likely_missing FROM calls WHERE call_id NOT IN (SELECT call_id FROM edges_) GROUP BY ALL")
def l24(spark, d):
    calls, edges = _edges(spark, d)
    return linker.unresolved_services(calls, edges, services_of(spark, d).withColumn("service", F.regexp_replace("service", "^SVC", "Svc")))


_SYM = """WITH s AS (SELECT DISTINCT id AS target_id, file_path || '#' || name AS precise, regexp_extract(file_path, '[^/]*$') || '#' || name AS owner, name AS method FROM nodes WHERE type = 'function' AND file_path IS NOT NULL),
r AS (SELECT DISTINCT file_path || '#' || name AS call_id, file_path || '#' || name AS precise, regexp_extract(file_path, '[^/]*$') || '#' || name AS owner, name AS method FROM node_snapshots WHERE type = 'function' AND file_path IS NOT NULL),
p AS (SELECT precise, min(target_id) AS t FROM s GROUP BY 1 HAVING count(DISTINCT target_id) = 1), o AS (SELECT owner, min(target_id) AS t FROM s GROUP BY 1 HAVING count(DISTINCT target_id) = 1), m AS (SELECT method, min(target_id) AS t FROM s GROUP BY 1 HAVING count(DISTINCT target_id) = 1)
SELECT call_id, coalesce(p.t, o.t, m.t) AS target_id, CASE WHEN p.t IS NOT NULL THEN 'precise' WHEN o.t IS NOT NULL THEN 'owner' ELSE 'method' END AS tier, CAST(CASE WHEN p.t IS NOT NULL THEN 1.0 WHEN o.t IS NOT NULL THEN 0.95 ELSE 0.85 END AS DOUBLE) AS confidence
FROM r LEFT JOIN p USING (precise) LEFT JOIN o USING (owner) LEFT JOIN m USING (method) WHERE coalesce(p.t, o.t, m.t) IS NOT NULL"""


@query("l13_symbol_hop", _SYM)
def l13(spark, d):
    """Functions of past deliveries to functions that are there now."""
    keys = lambda df: df.where("type = 'function' and file_path is not null").select("id", F.concat("file_path", F.lit("#"), "name").alias("precise"), F.concat(F.regexp_extract("file_path", "[^/]*$", 0), F.lit("#"), "name").alias("owner"), F.col("name").alias("method"))
    symbols = keys(table(spark, d, "nodes")).withColumnRenamed("id", "target_id").distinct()
    refs = keys(table(spark, d, "node_snapshots")).drop("id").distinct().withColumn("call_id", F.col("precise"))
    s = Scratch(spark, "symbols")
    return linker.symbol_hop(s.keep(refs), s.keep(symbols))


@query("l14_call_edge_hop", "WITH n AS (SELECT id, min(name) AS name FROM nodes GROUP BY id), c AS (SELECT DISTINCT source_id, target_id, name FROM edges JOIN n ON n.id = target_id WHERE edges.type = 'CALLS') SELECT source_id || '>' || name AS call_id, min(target_id) AS callee_id FROM c GROUP BY ALL HAVING count(*) = 1")
def l14(spark, d):
    n = table(spark, d, "nodes").groupBy("id").agg(F.min("name").alias("name"))
    c = table(spark, d, "edges").where("type = 'CALLS'").select("source_id", "target_id").distinct().join(n, F.col("target_id") == F.col("id")).select(F.col("source_id").alias("caller_id"), F.col("target_id").alias("callee_id"), "name")
    calls = c.select(F.concat("caller_id", F.lit(">"), "name").alias("call_id"), F.col("caller_id"), F.col("name").alias("method")).distinct()
    return linker.call_edge_hop(calls, c)


@query("l15_mapping_hop", """WITH m AS (SELECT DISTINCT p_brand AS sdk_class, p_type AS sdk_package, CAST(p_size AS VARCHAR) AS method, 'route-' || (p_partkey % 7) AS route FROM part),
c AS (SELECT p_partkey AS call_id, p_brand AS sdk_class, p_type AS sdk_package, CAST(p_size AS VARCHAR) AS method FROM part),
a AS (SELECT sdk_class, method, min(route) AS r FROM m GROUP BY ALL HAVING count(DISTINCT route) = 1), b AS (SELECT sdk_package, method, min(route) AS r FROM m GROUP BY ALL HAVING count(DISTINCT route) = 1), e AS (SELECT method, min(route) AS r FROM m GROUP BY ALL HAVING count(DISTINCT route) = 1)
SELECT call_id, coalesce(a.r, b.r, e.r) AS route, CASE WHEN a.r IS NOT NULL THEN 'class' WHEN b.r IS NOT NULL THEN 'package' ELSE 'method' END AS tier FROM c LEFT JOIN a USING (sdk_class, method) LEFT JOIN b USING (sdk_package, method) LEFT JOIN e USING (method) WHERE coalesce(a.r, b.r, e.r) IS NOT NULL""")
def l15(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("call_id"), F.col("p_brand").alias("sdk_class"), F.col("p_type").alias("sdk_package"), F.col("p_size").cast("string").alias("method"))
    return linker.mapping_hop(p, p.withColumn("route", F.concat(F.lit("route-"), F.col("call_id") % 7)))


@query("l17_rewrite_service", f"{_BASE} SELECT call_id, CASE WHEN regexp_matches(path, '^/gw/svc/(\\d+)/') THEN regexp_extract(path, '^/gw/svc/(\\d+)/', 1) WHEN regexp_matches(path, '^/svc/(1\\d)/') THEN regexp_extract(path, '^/svc/(1\\d)/', 1) END AS service FROM calls")
def l17(spark, d):
    return calls_of(spark, d).select("call_id", linker.rewrite_service(F.col("path"), [(r"^/gw/svc/(\d+)/", 1), (r"^/svc/(1\d)/", 1)]).alias("service"))


_IMP = """WITH p AS (SELECT DISTINCT regexp_extract(file_path, '^[^/]*/[^/]*') AS package FROM nodes WHERE file_path LIKE '%/%/%'),
d AS (SELECT DISTINCT id AS decl_id, regexp_extract(file_path, '^[^/]*/[^/]*') AS package, name, repo_id FROM nodes WHERE type IN ('class', 'interface') AND file_path LIKE '%/%/%' AND json_extract_string(properties, '$.isExported') = 'true'),
i AS (SELECT DISTINCT id AS file_id, repo_id, regexp_extract(file_path, '^[^/]*/[^/]*') || '/sub/' || start_line AS module, name FROM node_snapshots WHERE type IN ('class', 'interface') AND file_path LIKE '%/%/%' AND start_line IS NOT NULL),
u AS (SELECT package, name, min(decl_id) AS decl_id, min(repo_id) AS r FROM d GROUP BY ALL HAVING count(DISTINCT decl_id) = 1)
SELECT DISTINCT file_id, decl_id FROM i JOIN u ON i.name = u.name AND starts_with(i.module, u.package || '/') AND i.repo_id <> u.r"""


@query("l21_import_links", _IMP)
def l21(spark, d):
    """Classes of past deliveries, as imports, to declarations of their package
    in other repositories."""
    pk = F.regexp_extract("file_path", "^[^/]*/[^/]*", 0)
    n = table(spark, d, "nodes").where("file_path like '%/%/%'")
    decl = n.where("type in ('class', 'interface')").where(F.get_json_object("properties", "$.isExported") == "true").select(F.col("id").alias("decl_id"), pk.alias("package"), "name", "repo_id")
    i = table(spark, d, "node_snapshots").where("type in ('class', 'interface') and file_path like '%/%/%' and start_line is not null").select(F.col("id").alias("file_id"), "repo_id", F.concat(pk, F.lit("/sub/"), "start_line").alias("module"), "name").distinct()
    return linker.import_links(i, n.select(pk.alias("package")).distinct(), decl)


@query("l25_discover_services", f"{_BASE} SELECT trim(service) AS service, count(*) AS n_calls, count(DISTINCT repo_id) AS n_repos FROM calls WHERE lower(trim(service)) NOT IN ('svc-0') GROUP BY ALL")
def l25(spark, d):
    c = calls_of(spark, d).withColumn("service", F.trim("service")).where(F.lower("service") != "svc-0")
    return c.groupBy("service").agg(F.count(F.lit(1)).alias("n_calls"), F.count_distinct("repo_id").alias("n_repos"))


@query("l26_mapping_diff", "WITH o AS (SELECT p_partkey AS k, p_brand, p_size FROM part WHERE p_partkey % 5 <> 0), n AS (SELECT p_partkey AS k, p_brand, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END AS p_size FROM part WHERE p_partkey % 3 <> 0) SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.k = n.k WHERE o.k IS NULL OR n.k IS NULL OR o.p_size IS DISTINCT FROM n.p_size")
def l26(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_brand", "p_size")
    new = p.where("k % 3 <> 0").withColumn("p_size", F.when(F.col("k") % 7 == 0, None).otherwise(F.col("p_size")))
    return linker.table_diff(p.where("k % 5 <> 0"), new, ["k"], ["p_brand", "p_size"])


@query("m19_route_match", "WITH e AS (SELECT DISTINCT json_extract_string(properties, '$.path') AS path FROM nodes WHERE type = 'entrypoint'), b AS (SELECT path, regexp_replace(lower(path), '/(\\{[^}]*\\}|:[a-z_]\\w*)', '/:p', 'g') AS blind FROM e WHERE path IS NOT NULL) SELECT blind, count(*) AS n FROM b GROUP BY ALL")
def m19(spark, d):
    """Routes that differ by parameter names only."""
    e = table(spark, d, "nodes").where("type = 'entrypoint'").select(F.get_json_object("properties", "$.path").alias("path")).where("path is not null").distinct()
    return e.groupBy(param_blind(F.col("path")).alias("blind")).agg(F.count(F.lit(1)).alias("n"))
