"""Relational reads of the graph: symbols by name and place, overviews, edges
around nodes, external calls, dead nodes, bridges and rollups. Every function
takes a Graph; nodes and edges count once however often their rows repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import param_blind
from ..scale import checked_broadcast
from .graph import NODE_TYPES, USAGE, USAGE_ELSE, Graph, clamp_limit, glob_match, one_per_id, page, prop

PLACE = ("type", "name", "repo_id", "file_path", "start_line")


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def find_code(g: Graph, pattern: str, types: tuple[str, ...] = (), limit: int | None = None, exported_variables_only: bool = False) -> DataFrame:
    """Nodes whose name matches a glob (case aside), ordered by name without
    case, file and id; a page of at most limit. With exported_variables_only,
    variables must be exported; other types are not affected."""
    where = glob_match(F.col("name"), pattern)
    if exported_variables_only:
        where = where & ((F.col("type") != "variable") | (F.coalesce(prop("isExported"), F.lit("false")) == "true"))
    rows = g.some(*types, where=where, columns=PLACE)
    return rows.orderBy(F.lower("name"), _text("file_path"), "id").limit(clamp_limit(limit, "list"))


def symbols_in_file(g: Graph, path: str) -> DataFrame:
    """Nodes of the file whose path is path or ends with /path, files aside."""
    at = (F.col("file_path") == path) | F.endswith(F.col("file_path"), F.lit("/" + path))
    return g.some(where=at & (F.col("type") != "file"), columns=PLACE)


def find_named(g: Graph, kind: str, names: DataFrame, columns: tuple[str, ...] = ("name", "repo_id", "file_path", "start_line", "properties")) -> DataFrame:
    """Nodes of one type with exactly one of the wanted names (column name)."""
    wanted = checked_broadcast(names.select("name").distinct())
    return one_per_id(g.node_rows(kind).join(wanted, "name", "left_semi"), columns)


def find_function(g: Graph, names: DataFrame, file_hint: str | None = None, class_name: str | None = None) -> DataFrame:
    """Functions and methods by exact name with the class that owns them, if
    any; file_hint must lie in the path, class_name must own the method."""
    f = find_named(g, "function", names)
    if file_hint:
        f = f.where(F.contains(F.col("file_path"), F.lit(file_hint)))
    owners = g.pairs("HAS_METHOD").join(g.named("c", "class", columns=("name",)), F.col("source_id") == F.col("c_id")).select(F.col("target_id").alias("id"), F.col("c_name").alias("class_name"))
    if class_name:
        return f.join(owners.where(F.col("class_name") == class_name), "id")
    return f.join(owners, "id", "left")


def find_entity(g: Graph, name: str) -> DataFrame:
    """Entities by name or by table name."""
    return g.some("entity", where=(F.col("name") == name) | (prop("tableName") == name))


def list_entrypoints(g: Graph, kind: str | None = None, path: str | None = None, limit: int | None = None) -> DataFrame:
    """Entrypoints by type and address, then routes as http GET; a page. path
    matches any part of the address, parameter spelling aside."""
    cols = ("name", "repo_id", "properties")
    eps = g.some("entrypoint", columns=cols).select("id", "repo_id", F.coalesce(prop("entrypointType"), F.lit("")).alias("kind"), F.coalesce(prop("method"), F.lit("")).alias("method"), F.coalesce(prop("path"), prop("fullPath"), F.col("name")).alias("address"), F.lit(0).alias("late"))
    routes = g.some("route", columns=cols).select("id", "repo_id", F.lit("http").alias("kind"), F.lit("GET").alias("method"), F.coalesce(prop("path"), F.col("name")).alias("address"), F.lit(1).alias("late"))
    both = eps.unionByName(routes)
    if kind:
        both = both.where(F.col("kind") == kind)
    if path:
        both = both.where(F.contains(param_blind(F.col("address")), F.lit(path)))
    return both.orderBy("late", "kind", "address", "id").limit(clamp_limit(limit, "list")).drop("late")


def repo_overview(g: Graph) -> DataFrame:
    """For each repository the number of nodes of each type and its distinct
    entrypoint types, sorted and joined by commas."""
    n = g.some(columns=("type", "repo_id", "properties"))
    counts = [F.count_if(F.col("type") == t).alias(f"n_{t}") for t in NODE_TYPES]
    kinds = F.array_join(F.array_sort(F.collect_set(F.when(F.col("type") == "entrypoint", prop("entrypointType")))), ",")
    return n.groupBy("repo_id").agg(*counts, kinds.alias("entrypoint_types"))


def coverage_counts(g: Graph) -> DataFrame:
    """For each repository: functions, and those with an outgoing call;
    entities, and those that are operated on; external calls, and those that
    resolve (by edge)."""
    of = {"function": ("CALLS", "source_id"), "entity": ("OPERATES_ON", "target_id"), "external_call": ("RESOLVES_TO", "source_id")}
    n = g.some(*of, columns=("type", "repo_id"))
    touched = None
    for edge, end in of.values():
        one = g.pairs(edge).select(F.col(end).alias("id"))
        touched = one if touched is None else touched.unionByName(one)
    n = n.join(touched.distinct().withColumn("hit", F.lit(1)), "id", "left")
    cols = []
    for t in of:
        cols += [F.count_if(F.col("type") == t).alias(f"n_{t}"), F.count_if((F.col("type") == t) & F.col("hit").isNotNull()).alias(f"n_{t}_covered")]
    return n.groupBy("repo_id").agg(*cols)


def repositories(g: Graph, name_filter: str = "") -> DataFrame:
    """Repositories whose name holds the filter, case aside."""
    return g.some("repository", where=F.contains(F.lower("name"), F.lit(name_filter.lower())), columns=("name", "repo_id"))


def embedded_nodes(g: Graph) -> DataFrame:
    """Nodes with an embedding: id, repo, name and width."""
    return g.node_rows().where("embedding is not null").groupBy("id").agg(F.min("name").alias("name"), F.min("repo_id").alias("repo_id"), F.min(F.size("embedding")).alias("width"))


def direct_callers(g: Graph, targets: DataFrame) -> DataFrame:
    """Callers of the wanted nodes (column id), each caller of a target once:
    CALLS before REFERENCES_VARIABLE. target_id, caller_id, via, line,
    inferred (true if the edge of that kind at the least line was inferred)."""
    e = g.edges.where(F.col("type").isin("CALLS", "REFERENCES_VARIABLE")).join(checked_broadcast(targets.select(F.col("id").alias("target_id")).distinct()), "target_id", "left_semi")
    line = prop("line").try_cast("long")
    rank = F.struct(F.when(F.col("type") == "CALLS", 0).otherwise(1).alias("p"), F.coalesce(line, F.lit(0)).alias("line"), F.coalesce(prop("inferred"), F.lit("false")).alias("inferred"), F.col("type"))
    best = e.groupBy("target_id", "source_id").agg(F.min(rank).alias("r"))
    return best.select("target_id", F.col("source_id").alias("caller_id"), F.col("r.type").alias("via"), F.col("r.line").alias("line"), (F.col("r.inferred") == "true").alias("inferred"))


def direct_callees(g: Graph, sources: DataFrame) -> DataFrame:
    """source_id, callee_id, line (least call-site line)."""
    e = g.edges.where("type = 'CALLS'").join(checked_broadcast(sources.select(F.col("id").alias("source_id")).distinct()), "source_id", "left_semi")
    return e.groupBy("source_id", F.col("target_id").alias("callee_id")).agg(F.min(F.coalesce(prop("line").try_cast("long"), F.lit(0))).alias("line"))


def incoming(g: Graph, edge: str) -> DataFrame:
    """Children of each node over one edge type (subclasses, implementations):
    target_id, child_id, child_name."""
    return g.pairs(edge).join(g.named("child", columns=("name",)), F.col("source_id") == F.col("child_id")).select("target_id", "child_id", "child_name")


def entity_consumers(g: Graph, entity: str | None = None, operation: str | None = None) -> DataFrame:
    """Functions that operate on entities: entity_id, operation, function_id,
    file_path, class_name (null for plain functions)."""
    e = g.links("OPERATES_ON").select("source_id", "target_id", F.coalesce(prop("operation"), F.lit("")).alias("operation")).distinct()
    if operation:
        e = e.where(F.col("operation") == operation)
    if entity:
        e = e.join(F.broadcast(find_entity(g, entity).select(F.col("id").alias("target_id"))), "target_id", "left_semi")
    f = g.named("f", "function", columns=("file_path",))
    owner = g.pairs("HAS_METHOD").join(g.named("c", "class", columns=("name",)), F.col("source_id") == F.col("c_id")).select(F.col("target_id").alias("m_id"), F.col("c_name").alias("class_name"))
    out = e.join(f, F.col("source_id") == F.col("f_id")).join(owner, F.col("f_id") == F.col("m_id"), "left")
    return out.select(F.col("target_id").alias("entity_id"), "operation", F.col("f_id").alias("function_id"), F.col("f_file_path").alias("file_path"), "class_name")


def type_usages(g: Graph) -> DataFrame:
    """Uses of types: USES_TYPE edges, and files that import a declaration of
    another package (RESOLVES_TO from a file). target_id, user_id, kind."""
    uses = g.links("USES_TYPE").select("target_id", F.col("source_id").alias("user_id"), F.coalesce(prop("usage"), F.lit("property")).alias("kind"))
    files = g.some("file", columns=("type",)).select(F.col("id").alias("source_id"))
    imports = g.pairs("RESOLVES_TO").join(files, "source_id", "left_semi").select("target_id", F.col("source_id").alias("user_id"), F.lit("import").alias("kind"))
    return uses.unionByName(imports).distinct()


def entities_of_functions(g: Graph, functions: DataFrame) -> DataFrame:
    """function_id, entity_id for the wanted functions (column id)."""
    wanted = checked_broadcast(functions.select(F.col("id").alias("source_id")).distinct())
    return g.pairs("OPERATES_ON").join(wanted, "source_id", "left_semi").select(F.col("source_id").alias("function_id"), F.col("target_id").alias("entity_id"))


def external_calls(g: Graph, service: str | None = None) -> DataFrame:
    """External calls with their caller and, where an edge resolves them, the
    repository reached. The service filter meets the target service, the name
    or the name of the repository reached."""
    x = g.some("external_call", columns=("name", "repo_id", "properties"))
    caller = g.pairs("MAKES_EXTERNAL_CALL").groupBy(F.col("target_id").alias("id")).agg(F.min("source_id").alias("caller_id"))
    to = g.pairs("RESOLVES_TO").join(g.named("t", columns=("repo_id",)), F.col("target_id") == F.col("t_id")).groupBy(F.col("source_id").alias("id")).agg(F.min("t_repo_id").alias("to_repo"))
    repos = checked_broadcast(g.some("repository", columns=("name", "repo_id")).groupBy(F.col("repo_id").alias("to_repo")).agg(F.min("name").alias("resolved_name")))
    out = x.join(caller, "id", "left").join(to, "id", "left").join(repos, "to_repo", "left")
    out = out.select("id", "repo_id", "name", prop("targetService").alias("target_service"), prop("protocol").alias("protocol"), prop("path").alias("path"), prop("destination").alias("destination"), "caller_id", "to_repo", "resolved_name")
    if service:
        out = out.where((F.col("target_service") == service) | (F.col("name") == service) | (F.col("resolved_name") == service))
    return out


def unresolved_by_tail(unresolved: DataFrame, tail: str, limit: int | None = None) -> DataFrame:
    """Unresolved calls whose callee's last name is tail; '' gives none."""
    return unresolved.where((F.col("callee_name_tail") == tail) & F.lit(tail != "")).orderBy("file_path", "line", "caller_id").limit(clamp_limit(limit, "unresolved"))


def unresolved_in_files(unresolved: DataFrame, paths: DataFrame) -> DataFrame:
    """Unresolved calls of the wanted files (column file_path)."""
    return unresolved.join(checked_broadcast(paths.select("file_path").distinct()), "file_path", "left_semi")


def nodes_by_ids(g: Graph, ids: DataFrame) -> DataFrame:
    """The wanted nodes (column id) that exist, in no order."""
    return g.some(columns=("type", "name", "repo_id")).join(checked_broadcast(ids.select("id").distinct()), "id", "left_semi")


def neighbor_counts(g: Graph) -> DataFrame:
    """node_id, edge_type, direction, n: edges at every node."""
    e = g.links().select("source_id", "target_id", "type")
    ends = F.array(F.struct(F.col("source_id").alias("node_id"), F.lit("out").alias("direction")), F.struct(F.col("target_id").alias("node_id"), F.lit("in").alias("direction")))
    return e.select(F.explode(ends).alias("x"), F.col("type").alias("edge_type")).groupBy("x.node_id", "edge_type", "x.direction").agg(F.count(F.lit(1)).alias("n"))


def neighbors(g: Graph, node: DataFrame, direction: str = "both", types: tuple[str, ...] = (), limit: int | None = None, cursor: str = "") -> DataFrame:
    """Edges at one node (column id of a one-row table) after the cursor, by
    edge id, with the node at the other end; a page with has_more."""
    one = F.broadcast(node.select(F.col("id").alias("me")))
    e = g.links(*types).select(F.col("id").alias("edge_id"), "source_id", "target_id", F.col("type").alias("edge_type"))
    hit = {"out": F.col("source_id") == F.col("me"), "in": F.col("target_id") == F.col("me")}
    on = hit[direction] if direction in hit else hit["out"] | hit["in"]
    met = e.join(one, on).select("edge_id", "edge_type", F.when(F.col("source_id") == F.col("me"), F.col("target_id")).otherwise(F.col("source_id")).alias("other_id"))
    return page(met, "edge_id", clamp_limit(limit, "neighbors"), cursor)


def nodes_of_type(g: Graph, kind: str, limit: int | None = None, cursor: str = "") -> DataFrame:
    """Nodes of one type after the cursor, by id; a page with has_more."""
    return page(g.some(kind, columns=("name", "repo_id")), "id", clamp_limit(limit, "list"), cursor)


def edges_among(g: Graph, ids: DataFrame, limit: int | None = None) -> DataFrame:
    """Edges whose both ends are wanted (column id), by edge id; a page."""
    w = checked_broadcast(ids.select("id").distinct())
    e = g.links().select(F.col("id").alias("edge_id"), "source_id", "target_id", "type")
    e = e.join(w.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(w.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return e.orderBy("edge_id").limit(clamp_limit(limit, "edges_among"))


def dead_nodes(g: Graph, types: tuple[str, ...]) -> DataFrame:
    """Nodes that are not exported and that no edge of those that count as a
    use of their type reaches; an edge from the node itself is no use."""
    n = g.some(*types, columns=("type", "name", "repo_id", "file_path", "properties")).where(F.coalesce(prop("isExported"), F.lit("false")) != "true").drop("properties")
    counts = F.lit(False)
    for t in types:
        counts = counts | ((F.col("t") == t) & F.col("use").isin(*USAGE.get(t, USAGE_ELSE)))
    every = sorted({u for t in types for u in USAGE.get(t, USAGE_ELSE)})
    uses = g.links(*every).where("source_id <> target_id").select(F.col("target_id").alias("used"), F.col("type").alias("use")).distinct()
    return n.withColumn("t", F.col("type")).join(uses, (F.col("id") == F.col("used")) & counts, "left_anti").drop("t")


def bridges(g: Graph, limit: int | None = None) -> DataFrame:
    """External calls that resolve into another repository, with the caller
    and the handler of what they reach, where there are any; by edge id."""
    r = g.links("RESOLVES_TO").select(F.col("id").alias("edge_id"), F.col("source_id").alias("x_id"), F.col("target_id").alias("ep_id"), "confidence")
    r = r.join(g.named("x", "external_call", columns=("repo_id",)), "x_id").join(g.named("ep", "entrypoint", columns=("repo_id",)), "ep_id").where("x_repo_id <> ep_repo_id")
    caller = g.pairs("MAKES_EXTERNAL_CALL").groupBy(F.col("target_id").alias("x_id")).agg(F.min("source_id").alias("caller_id"))
    handler = g.pairs("HANDLES").groupBy(F.col("source_id").alias("ep_id")).agg(F.min("target_id").alias("handler_id"))
    out = r.join(caller, "x_id", "left").join(handler, "ep_id", "left")
    return out.select("edge_id", "x_id", "ep_id", F.col("x_repo_id").alias("from_repo"), F.col("ep_repo_id").alias("to_repo"), "caller_id", "handler_id", "confidence").orderBy("edge_id").limit(clamp_limit(limit, "bridges"))


def package_rollup(g: Graph) -> DataFrame:
    """Calls between packages: source_package, target_package, n_calls,
    min_confidence, inferred (some call was not made by the parser). Function
    to file to package comes from containment."""
    of_file = g.pairs("CONTAINS_FUNCTION").select(F.col("source_id").alias("file"), F.col("target_id").alias("fn"))
    of_package = g.pairs("CONTAINS_FILE").select(F.col("source_id").alias("package"), F.col("target_id").alias("file"))
    home = of_file.join(of_package, "file").select("fn", "package")
    calls = g.links("CALLS").select("source_id", "target_id", "confidence", "created_by")
    out = calls.join(home.select(F.col("fn").alias("source_id"), F.col("package").alias("source_package")), "source_id").join(home.select(F.col("fn").alias("target_id"), F.col("package").alias("target_package")), "target_id")
    return out.where("source_package <> target_package").groupBy("source_package", "target_package").agg(F.count(F.lit(1)).alias("n_calls"), F.min("confidence").alias("min_confidence"), F.bool_or(F.col("created_by") != "parser").alias("inferred"))


def component_graph(g: Graph) -> DataFrame:
    """Edges among entrypoints, components, classes and stores."""
    n = g.some("entrypoint", "component", "class", "state_store", columns=("type",)).select("id")
    e = g.links().select(F.col("id").alias("edge_id"), "source_id", "target_id", "type")
    return e.join(n.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(n.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def resolves_edge(g: Graph, calls: DataFrame) -> DataFrame:
    """The RESOLVES_TO edge of each wanted call (column id): the least edge id,
    with its chain as array."""
    e = g.links("RESOLVES_TO").join(checked_broadcast(calls.select(F.col("id").alias("source_id")).distinct()), "source_id", "left_semi")
    best = e.groupBy("source_id").agg(F.min(F.struct(F.col("id").alias("edge_id"), "target_id", "confidence", "properties")).alias("r"))
    chain = F.from_json(F.get_json_object("r.properties", "$.chain"), "array<string>")
    return best.select(F.col("source_id").alias("call_id"), "r.edge_id", "r.target_id", "r.confidence", F.array_join(F.coalesce(chain, F.array().cast("array<string>")), "+").alias("via"))


def functions_with(g: Graph, key: str) -> DataFrame:
    """Functions whose property key is present and not null."""
    return g.some("function", where=prop(key).isNotNull(), columns=("name", "repo_id", "file_path", "start_line", "properties")).select("id", "name", "repo_id", "file_path", "start_line", prop(key).alias("value"))


def call_edges_to(g: Graph, callees: DataFrame) -> DataFrame:
    """Distinct (caller_id, callee_id) into the wanted functions (column id)."""
    wanted = checked_broadcast(callees.select(F.col("id").alias("target_id")).distinct())
    return g.pairs("CALLS").join(wanted, "target_id", "left_semi").select(F.col("source_id").alias("caller_id"), F.col("target_id").alias("callee_id"))


def receipts(meta: DataFrame) -> DataFrame:
    """The newest applied and the newest pending receipt of each repository:
    repo_id, state, snapshot_no, at (ISO text)."""
    no = F.get_json_object("snapshot", "$.snapshotNo").try_cast("double").cast("long")
    r = meta.where("repo_id is not null").select("repo_id", F.get_json_object("snapshot", "$.state").alias("state"), no.alias("snapshot_no"), F.coalesce(F.get_json_object("snapshot", "$.appliedAt"), F.get_json_object("snapshot", "$.startedAt")).alias("at"))
    return r.where("state in ('applied', 'pending') and snapshot_no is not null").groupBy("repo_id", "state").agg(F.max("snapshot_no").alias("snapshot_no"), F.max("at").alias("at"))


def contains_text(g: Graph, needles: list[str]) -> DataFrame:
    """For each needle whether some node holds it in a text column:
    needle, found, n_nodes. All needles are sought in one scan."""
    texts = F.concat_ws("\u0001", "name", "summary", "file_path", "properties")
    hits = F.filter(F.array(*[F.when(F.contains(texts, F.lit(x)), F.lit(x)) for x in needles]), lambda x: x.isNotNull())
    found = g.node_rows().select("id", F.explode(hits).alias("needle")).groupBy("needle").agg(F.count_distinct("id").alias("n_nodes"))
    every = g.nodes.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(needles)], "needle string")
    return every.join(F.broadcast(found), "needle", "left").select("needle", F.col("n_nodes").isNotNull().alias("found"), F.coalesce("n_nodes", F.lit(0)).cast("long").alias("n_nodes"))


def bm25(g: Graph, query: str, limit: int = 100, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Nodes by BM25 of the query's words in name and summary: id, score
    (rounded to 6 digits); ties by id. Corpus figures come from one pass."""
    words = sorted({w for w in query.lower().split() if w})
    text = F.lower(F.concat_ws(" ", "name", "summary"))
    docs = g.some(columns=("name", "summary")).select("id", F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: w != "").alias("ws"))
    times = lambda x: F.size(F.filter("ws", lambda w: w == x))
    tf = [times(x).alias(f"tf{i}") for i, x in enumerate(words)]
    counted = docs.select("id", F.size("ws").alias("len"), *tf)
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))])
    score = F.lit(0.0)
    for i in range(len(words)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score = score + idf * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    any_hit = F.lit(False)
    for i in range(len(words)):
        any_hit = any_hit | (F.col(f"tf{i}") > 0)
    out = counted.where(any_hit).crossJoin(F.broadcast(stats)).select("id", F.round(score, 6).alias("score"))
    return out.orderBy(F.desc("score"), "id").limit(limit)

