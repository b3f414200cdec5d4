"""Bounded walks over edges: a frontier of (root, id) that meets the edges
once a level. Distances are least distances; every level is written, so the
lineage stays short and a lost executor costs one level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import Scratch, checked_broadcast
from .graph import FLOW, Graph, clamp_depth, clamp_limit, one_per_id, prop


def arcs(g: Graph, *types: str, direction: str = "out", weak: bool = False) -> DataFrame:
    """Distinct (a, b) along the walk, loops aside; with weak also whether
    every edge from a to b was inferred."""
    e = g.links(*types).where("source_id <> target_id")
    flag = F.coalesce(prop("inferred"), F.lit("false")) == "true"
    cols = {"out": ("source_id", "target_id"), "in": ("target_id", "source_id")}
    if direction in cols:
        a, b = cols[direction]
        e = e.select(F.col(a).alias("a"), F.col(b).alias("b"), flag.alias("weak"))
    else:
        both = F.array(F.struct(F.col("source_id").alias("a"), F.col("target_id").alias("b")), F.struct(F.col("target_id").alias("a"), F.col("source_id").alias("b")))
        e = e.select(F.explode(both).alias("x"), flag.alias("weak")).select("x.a", "x.b", "weak")
    return e.groupBy("a", "b").agg(F.bool_and("weak").alias("weak")) if weak else e.select("a", "b").distinct()


def walk(links: DataFrame, seeds: DataFrame, depth: int, scratch: Scratch, until: DataFrame | None = None) -> DataFrame:
    """root, id, distance for all ids within depth of each seed (root, id), the
    seeds at distance 0. links: a, b. With until (column id) the walk ends
    once a level has met one of them."""
    links = scratch.keep(links.select("a", "b"))
    seen = scratch.keep(seeds.select("root", "id", F.lit(0).alias("distance")).distinct())
    front = seen
    for d in range(1, depth + 1):
        near = links.join(checked_broadcast(front.select("root", F.col("id").alias("a"))), "a").select("root", F.col("b").alias("id")).distinct()
        front = scratch.keep(near.join(seen.select("root", "id"), ["root", "id"], "left_anti").withColumn("distance", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if until is not None and not front.join(until, "id", "left_semi").isEmpty():
            break
    return seen


def transitive_callers(g: Graph, targets: DataFrame, depth: float = 3, limit: int | None = None) -> DataFrame:
    """Callers of each target (column id) within depth: target_id, caller_id,
    distance. The target is no caller of itself; ordered by distance and id, at
    most limit over all targets."""
    s = Scratch(g.nodes.sparkSession, "callers")
    seen = walk(arcs(g, "CALLS", direction="in"), targets.select(F.col("id").alias("root"), "id"), clamp_depth(depth), s)
    out = seen.where("distance > 0").select(F.col("root").alias("target_id"), F.col("id").alias("caller_id"), "distance")
    return out.orderBy("distance", "caller_id", "target_id").limit(clamp_limit(limit, "callers"))


def reaching_entrypoints(g: Graph, targets: DataFrame, depth: float = 3, limit: int | None = None) -> DataFrame:
    """Entrypoints from which a target is reached: target_id, entrypoint_id,
    distance of the nearest handler (0 when the target handles it itself)."""
    s = Scratch(g.nodes.sparkSession, "entrypoints")
    seen = walk(arcs(g, "CALLS", direction="in"), targets.select(F.col("id").alias("root"), "id"), clamp_depth(depth), s)
    h = g.pairs("HANDLES").select(F.col("source_id").alias("entrypoint_id"), F.col("target_id").alias("id"))
    out = seen.join(h, "id").groupBy(F.col("root").alias("target_id"), "entrypoint_id").agg(F.min("distance").alias("distance"))
    return out.orderBy("distance", "entrypoint_id", "target_id").limit(clamp_limit(limit, "entrypoints"))


def shortest_path(g: Graph, start: DataFrame, end: DataFrame, depth: int = 10) -> DataFrame:
    """step, id: the shortest call path of at most depth hops; of several, the
    one with the least ids in order. Equal ends are a path of one step; no
    path gives no rows. start, end: one-row tables with column id."""
    s = Scratch(g.nodes.sparkSession, "path")
    links = s.keep(arcs(g, "CALLS"))
    back = walk(links.select(F.col("b").alias("a"), F.col("a").alias("b")), end.select(F.col("id").alias("root"), "id"), depth, s, until=start.select("id"))
    at = s.keep(back.groupBy("id").agg(F.min("distance").alias("left")))
    here = at.join(F.broadcast(start.select("id").distinct()), "id", "left_semi").select(F.lit(0).alias("step"), "id", "left")
    found = here.first()
    if found is None:
        return here.select("step", "id")
    # one row a step; the distances left say which neighbours lie on a shortest path
    rows, spark = [(0, found.id)], g.nodes.sparkSession
    for k in range(found.left, 0, -1):
        rows.append((len(rows), links.where(F.col("a") == rows[-1][1]).join(at.where(F.col("left") == k - 1), F.col("b") == F.col("id")).agg(F.min("b")).first()[0]))
    return spark.createDataFrame(rows, "step int, id string")


def call_tree(g: Graph, root: DataFrame, depth: float = 3, cap: int = 200) -> DataFrame:
    """id, name, depth of what the root (column id) calls, by depth, name and
    id; at most cap with the root at depth 0."""
    s = Scratch(g.nodes.sparkSession, "tree")
    seen = walk(arcs(g, "CALLS"), root.select(F.col("id").alias("root"), "id"), clamp_depth(depth), s)
    named = seen.join(g.some(columns=("name",)), "id").select("id", "name", F.col("distance").alias("depth"))
    return named.orderBy("depth", "name", "id").limit(cap)


def subgraph(g: Graph, root: DataFrame, depth: int = 2, direction: str = "both", types: tuple[str, ...] = FLOW, cap: int | None = None) -> DataFrame:
    """Induced edges among the root and the at most cap nodes nearest to it:
    edge_id, source_id, target_id, type. Depth is at most 5."""
    s = Scratch(g.nodes.sparkSession, "subgraph")
    seen = walk(arcs(g, *types, direction=direction), root.select(F.col("id").alias("root"), "id"), max(1, min(depth, 5)), s)
    kept = s.keep(seen.orderBy("distance", "id").limit(clamp_limit(cap, "subgraph") + 1).select("id"))
    e = g.links(*types).select(F.col("id").alias("edge_id"), "source_id", "target_id", "type")
    k = F.broadcast(kept)
    return e.join(k.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(k.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def expand_outbound(g: Graph, sources: DataFrame, types: tuple[str, ...] = FLOW, limit: int | None = None) -> DataFrame:
    """Distinct targets one hop from the sources (column id), by id; a page."""
    wanted = checked_broadcast(sources.select(F.col("id").alias("source_id")).distinct())
    out = g.pairs(*types).join(wanted, "source_id", "left_semi").select(F.col("target_id").alias("id")).distinct()
    return out.orderBy("id").limit(clamp_limit(limit, "expand"))


def select_reached(g: Graph, sources: DataFrame, candidates: DataFrame, types: tuple[str, ...] = FLOW) -> DataFrame:
    """Candidates (column id) that some source (column id) reaches in one hop."""
    wanted = checked_broadcast(sources.select(F.col("id").alias("source_id")).distinct())
    near = g.pairs(*types).join(wanted, "source_id", "left_semi").select(F.col("target_id").alias("id"))
    return candidates.select("id").distinct().join(near, "id", "left_semi")


def callee_first_order(g: Graph) -> DataFrame:
    """id, level of every function: 0 without calls to others, else one above
    its highest callee; -1 for functions on a cycle or above one. Each round
    peels the functions whose callees are all peeled."""
    s = Scratch(g.nodes.sparkSession, "order")
    nodes = s.keep(g.some("function", columns=("type",)).select("id"))
    inside = nodes.withColumnRenamed("id", "a")
    links = s.keep(arcs(g, "CALLS").join(inside, "a", "left_semi").join(nodes.withColumnRenamed("id", "b"), "b", "left_semi"))
    left, done, level = nodes, None, 0
    while True:
        ready = s.keep(left.join(links.select(F.col("a").alias("id")), "id", "left_anti").withColumn("level", F.lit(level)))
        if ready.isEmpty():
            break
        done = ready if done is None else done.unionByName(ready)
        left = s.keep(left.join(ready.select("id"), "id", "left_anti"))
        links = s.keep(links.join(ready.select(F.col("id").alias("b")), "b", "left_anti"))
        level += 1
    rest = left.withColumn("level", F.lit(-1))
    return rest if done is None else done.unionByName(rest)


def feature_area(g: Graph, roots: DataFrame, levels: int = 8, cap: int = 5000) -> DataFrame:
    """Nodes of a feature's area: what the roots (column id) contain within
    levels, the handlers of entrypoints among them, and one call hop from all
    of these. id, how (inside, handler, called), truncated (the area had more
    than cap nodes; the first by how and id are kept)."""
    s = Scratch(g.nodes.sparkSession, "area")
    kinds = [t for t in ("CONTAINS_PACKAGE", "CONTAINS_FILE", "CONTAINS_FUNCTION", "CONTAINS_CLASS", "CONTAINS_INTERFACE", "CONTAINS_ENUM", "CONTAINS_VARIABLE", "HAS_METHOD")]
    inside = s.keep(walk(arcs(g, *kinds), roots.select(F.lit("").alias("root"), "id"), levels, s).select("id").distinct())
    handlers = g.pairs("HANDLES").join(inside.withColumnRenamed("id", "source_id"), "source_id", "left_semi").select(F.col("target_id").alias("id"))
    base = s.keep(inside.withColumn("how", F.lit("inside")).unionByName(handlers.withColumn("how", F.lit("handler"))))
    called = g.pairs("CALLS").join(base.select(F.col("id").alias("source_id")).distinct(), "source_id", "left_semi").select(F.col("target_id").alias("id")).withColumn("how", F.lit("called"))
    rank = F.when(F.col("how") == "inside", 0).when(F.col("how") == "handler", 1).otherwise(2)
    every = s.keep(base.unionByName(called).groupBy("id").agg(F.min_by("how", rank).alias("how"), F.min(rank).alias("r")))
    n = every.count()
    return every.orderBy("r", "id").limit(cap).select("id", "how", F.lit(n > cap).alias("truncated"))


def callers_with_interfaces(g: Graph, depth: float = 2) -> DataFrame:
    """One row for each caller within depth of every function that handles an
    entrypoint: target_id, caller_id, distance."""
    targets = one_per_id(g.node_rows("function"), ("type",)).join(g.pairs("HANDLES").select(F.col("target_id").alias("id")).distinct(), "id", "left_semi")
    s = Scratch(g.nodes.sparkSession, "handled")
    seen = walk(arcs(g, "CALLS", direction="in"), targets.select(F.col("id").alias("root"), "id"), clamp_depth(depth), s)
    return seen.where("distance > 0").select(F.col("root").alias("target_id"), F.col("id").alias("caller_id"), "distance")
