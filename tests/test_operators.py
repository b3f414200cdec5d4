"""Small planted cases of the core operators: nulls, repeats, empty tables,
ties, hot keys, clashing names."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from compare import duck
from pyspark.sql import functions as F

from graphloom import scale
from graphloom.functions.json_values import canonical_json
from graphloom.functions.paths import signature
from graphloom.operators import adhoc, hierarchy, linker, orphans, snapshots, tools, transform, traverse, usage, writes
from graphloom.operators.graph import EDGE_COLUMNS, NODE_COLUMNS, Graph, clamp_depth, clamp_limit, glob_regex
from graphloom.plans import linker_queries
from graphloom.sources.tables import COLUMNS

N = "id string, type string, name string, properties string, summary string, repo_id string, file_path string, start_line long, end_line long"
E = "id string, source_id string, target_id string, type string, confidence double, created_by string, properties string"


def graph(spark, calls, handles=()):
    ids = sorted({x for e in [*calls, *handles] for x in e})
    nodes = [(f"r:{i}", "function", i, "{}", None, "r", "a.py", 1, 2) for i in ids if not i.startswith("ep")] + [(f"r:{i}", "entrypoint", i, '{"entrypointType":"http","path":"/x/:id"}', None, "r", "a.py", 1, 2) for i in ids if i.startswith("ep")]
    edges = [(f"{k}{n}", f"r:{a}", f"r:{b}", k, 1.0, "parser", '{"line":%d}' % n) for k, es in (("CALLS", calls), ("HANDLES", handles)) for n, (a, b) in enumerate(es)]
    return Graph(spark.createDataFrame(nodes * 2, N), spark.createDataFrame(edges * 2, E))


def one(spark, name):
    return spark.createDataFrame([(f"r:{name}",)], "id string")


def test_limits_and_globs():
    assert [clamp_limit(x, "list") for x in (None, 0, -3, float("nan"), 7.9, 10**6)] == [50, 50, 50, 50, 7, 1000]
    assert [clamp_depth(x) for x in (None, float("inf"), 0, 3.7, 99)] == [1, 1, 1, 3, 10]
    import re

    assert re.match(glob_regex("a*_%?"), "abc_%x") and not re.match(glob_regex("a_b"), "axb")


def test_walks(spark):
    g = graph(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("a", "a"), ("b", "d"), ("c", "d"), ("d", "e")], [("ep1", "x")])
    got = {(r.caller_id[2:], r.distance) for r in traverse.transitive_callers(g, one(spark, "a"), 5).collect()}
    assert got == {("c", 1), ("x", 1), ("b", 2)}
    assert [(r.entrypoint_id, r.distance) for r in traverse.reaching_entrypoints(g, one(spark, "c"), 5).collect()] == [("r:ep1", 3)]
    assert [r.id for r in traverse.shortest_path(g, one(spark, "x"), one(spark, "e")).orderBy("step").collect()] == ["r:x", "r:a", "r:b", "r:d", "r:e"]
    assert [r.id for r in traverse.shortest_path(g, one(spark, "e"), one(spark, "e")).collect()] == ["r:e"]
    assert traverse.shortest_path(g, one(spark, "e"), one(spark, "x")).count() == 0
    assert [(r.name, r.depth) for r in traverse.call_tree(g, one(spark, "b"), 2).collect()] == [("b", 0), ("c", 1), ("d", 1), ("a", 2), ("e", 2)]


def test_callee_first_order_against_brute_force(spark):
    r = random.Random(3)
    names = [f"n{i}" for i in range(40)]
    calls = [(a, b) for a, b in ((r.choice(names), r.choice(names)) for _ in range(55))]
    out = {n: {b for a, b in calls if a == n and b != n} for n in {x for e in calls for x in e}}
    level: dict[str, int] = {}
    while True:
        ready = [n for n in out if n not in level and all(m in level for m in out[n])]
        if not ready:
            break
        for n in ready:
            level[n] = 1 + max((level[m] for m in out[n]), default=-1)
    want = {f"r:{n}": level.get(n, -1) for n in out}
    assert {x.id: x.level for x in traverse.callee_first_order(graph(spark, calls)).collect()} == want


def test_guard(spark):
    g = graph(spark, [("a", "b")])
    assert adhoc.graph_sql(g, "select count(*) as n from nodes n join edges e on e.source_id = n.id").first().n == 1
    assert adhoc.graph_sql(g, "with x as (select id from nodes) select count(*) as n from x").first().n == 2
    for bad in ("insert into nodes values (1)", "select 1; select 2", "select * from other", "drop table nodes", "select embedding from nodes", "select reflect('a', 'b')", "select array(id) as a from nodes", "x" * 20000, "set a=b", "select * from parquet.`/tmp/x`", "with x as (select * from secrets) select * from x"):
        with pytest.raises(adhoc.Rejected):
            adhoc.graph_sql(g, bad)
    assert adhoc.match(g, "MATCH (a)-[:CALLS]->(b) WHERE toLower(b.name) CONTAINS 'b' RETURN a.name AS n").first().n == "a"


def test_snapshots_cases(spark):
    meta = spark.createDataFrame([("r", '{"snapshotNo":%d,"state":"%s"}' % x) for x in ((1, "applied"), (2, "pending"), (3, "applied"), (5, "applied"))] + [(None, "{}"), ("r", "no json")], "repo_id string, snapshot string")
    cols = "snapshot_no int, id string, type string, name string, properties string, repo_id string, file_path string, start_line long, end_line long, field int"
    rows = [(1, "a", "t", "n", '{"x":7,"y":1}', "r", "f", 1, 2, 0), (1, "b", "t", "n", None, "r", "f", None, 2, 0), (2, "z", "t", "n", None, "r", "f", 1, 2, 0), (3, "a", "t", "n", '{"y":1, "x":7.0}', "r", "f", 1, 2, 0), (3, "a", "t", "n", '{"y":1, "x":7.0}', "r", "f", 1, 2, 0), (3, "b", "t", "n", None, "r", "f", 5, 2, 0), (3, None, "t", "n", None, "r", "f", 5, 2, 0), (3, "c", "t", "n", None, "r", "f", 5, 2, 0)]
    got = {(r.snapshot_no, r.id, r.change) for r in snapshots.snapshot_changes(spark.createDataFrame(rows, cols), meta).collect()}
    assert got == {(3, "b", "changed"), (3, "c", "added"), (5, "a", "removed"), (5, "b", "removed"), (5, "c", "removed")}
    assert snapshots.snapshot_changes(spark.createDataFrame([], cols), meta).count() == 0


def test_canonical_json(spark):
    texts = ['{"a":1,"b":[1,2]}', '{ "b": [1, 2], "a": 1.0 }', '{"a":1e0,"b":[1,2]}', '{"a":1,"b":[2,1]}', '{"a":"1","b":[1,2]}', '{"a":null,"b":[1,2]}', '{"b":[1,2]}', "no json", None]
    got = [r.c for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", canonical_json(F.col("t")).alias("c")).orderBy("i").collect()]
    assert got[0] == got[1] == got[2] and len(set(got[2:])) == 7 and got[-1] is None


def test_hierarchy_against_brute_force(spark):
    r = random.Random(5)
    parent = {i: (r.randrange(400) if r.random() < 0.9 else None) for i in range(400)}
    for i in range(400, 700):
        parent[i] = i - 1 if i > 400 else None
    t0 = dt.datetime(2026, 1, 1)
    rows = [("w", f"f{i}", "d", f"f{p}" if p is not None else ("nobody" if i % 2 else None), t0) for i, p in parent.items()] + [("w", "f0", "d", None, t0 - dt.timedelta(1)), ("w", None, "d", "f1", t0), ("x", "far", "d", "f1", t0)]
    df = spark.createDataFrame(rows, "workspace_id string, id string, domain_id string, parent_feature_id string, updated_at timestamp_ntz")

    def up(i):
        seen, n = set(), 0
        while parent[i] is not None:
            if i in seen:
                return "", -1
            seen.add(i)
            i, n = parent[i], n + 1
        return f"f{i}", n

    want = {f"f{i}": up(i) for i in parent} | {"far": ("far", 0)}
    assert {x.feature_id: (x.root_id, x.depth) for x in hierarchy.feature_roots(df).collect()} == want
    paths = {x.feature_id: x.path for x in hierarchy.feature_paths(df).collect()}
    assert all(paths[k][0] == root and paths[k][-1] == k and len(paths[k]) == d + 1 for k, (root, d) in want.items() if d >= 0) and len(paths) == sum(d >= 0 for _, d in want.values())
    assert hierarchy.feature_roots(df.limit(0)).count() == 0


def test_orphans_cases(spark):
    t = lambda m: dt.datetime(2026, m, 5)
    refs = spark.createDataFrame([(1, "here", t(2)), (1, "here", t(2)), (2, "gone", t(2)), (3, "never", t(2)), (4, "late", t(2)), (5, None, t(2)), (6, "never", None), (7, "late", t(9))], "id long, node_id string, created_at timestamp_ntz")
    nodes = spark.createDataFrame([("here",), ("late",), (None,)], "id string")
    snaps = spark.createDataFrame([("r", 1, "here", t(1)), ("r", 1, "gone", t(1)), ("r", 2, "never", t(1)), ("r", 3, "late", t(3))], "repo_id string, snapshot_no int, id string, taken_at timestamp_ntz")
    meta = spark.createDataFrame([("r", '{"snapshotNo":1,"state":"applied"}'), ("r", '{"snapshotNo":3,"state":"applied"}')], "repo_id string, snapshot string")
    got = {(r.anchor_id, r.period, r.cause) for r in orphans.orphan_references(refs, nodes, snaps, meta).collect()}
    assert got == {(2, "2026-02", "deleted"), (3, "2026-02", "missing"), (4, "2026-02", "late"), (6, None, "missing")}
    assert orphans.orphan_references(refs.limit(0), nodes, snaps, meta).count() == 0


def test_skew_join_and_sums(spark):
    many = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i}") for i in range(4000)] + [(-1, None)], "n long, k string")
    part = many.select("k").distinct().where("k is not null").withColumn("v", F.length("k"))
    for big in (False, True):
        scale.BROADCAST_BYTES, kept = (1, scale.BROADCAST_BYTES) if big else (scale.BROADCAST_BYTES, scale.BROADCAST_BYTES)
        try:
            out = scale.skew_join(many, part.withColumn("text", F.repeat(F.lit("x"), 50)), ["k"], "left")
            assert out.count() == 4001 and out.where("v is null").count() == 1
        finally:
            scale.BROADCAST_BYTES = kept
    s = scale.Scratch(spark, "sums")
    rows = [("a", 1, 5), ("a", 2, 7), (None, 1, 3), (None, 2, 4), ("b", 1, 1)]
    got = {(r.g, r.o): r.before for r in scale.prefix_sums(spark.createDataFrame(rows, "g string, o int, v long"), "g", ["o"], "v", s).collect()}
    assert got == {("a", 1): 0, ("a", 2): 5, (None, 1): 0, (None, 2): 3, ("b", 1): 0}


def test_linker_cases(spark):
    eps = spark.createDataFrame([("e1", "r1", "GET", "/a/:id"), ("e2", "r1", "GET", "/a/me"), ("e3", "r2", "ALL", "/b/{x}/c"), ("t1", "r1", "GET", "/t/{a}"), ("t2", "r2", "GET", "/t/{b}"), ("n", "r1", "GET", None)], "ep_id string, repo_id string, method string, path string")
    calls = spark.createDataFrame([("c1", "get", "/a/7?q=1"), ("c2", "GET", "a/me/"), ("c3", "POST", "//b/9/c#x"), ("c4", "GET", "/t/1"), ("c5", "GET", None), ("c6", "GET", "/zz"), ("c7", "GET", "/a/${id}"), ("c8", "GET", "/a/x${tail}")], "call_id string, method string, path string")
    got = {r.call_id: (r.ep_id, r.verdict) for r in linker.http_match(calls, linker.entry_index(eps), scale.Scratch(spark, "t")).collect()}
    assert got == {"c1": ("e1", "matched"), "c2": ("e2", "matched"), "c3": ("e3", "matched"), "c4": (None, "ambiguous"), "c5": (None, "no-path"), "c6": (None, "no-entrypoint-match"), "c7": ("e1", "matched"), "c8": ("e1", "matched")}
    sig = spark.createDataFrame([("/a/${x}/b//c/",)], "p string").select(signature(F.col("p"))).first()[0]
    assert sig == "/a/:_/b/c"
    e = linker.edges_of(spark.createDataFrame([("h", "e", "r1", "direct", 0.95), ("m", "e", "r1", "direct", 1.0)], "call_id string, ep_id string, ep_repo string, via string, confidence double"), spark.createDataFrame([("h", "r1", "http"), ("m", "r1", "messaging")], "call_id string, repo_id string, protocol string"))
    assert [(r.call_id, r.level) for r in e.collect()] == [("m", "exact")]


def joined_rows(plan):
    """Rows that the joins of a plan that ran gave."""
    own = plan.metrics().apply("numOutputRows").value() if "Join" in plan.nodeName() else 0
    return own + sum(joined_rows(plan.children().apply(i)) for i in range(plan.children().size()))


@pytest.mark.parametrize("large", [False, True])
def test_longest_prefix_meets_a_prefix_once(spark, monkeypatch, large):
    if large:  # as if the prefixes were too many to send
        monkeypatch.setattr(linker, "small", lambda df: False)
    paths = [*[f"app/m/f{i}.py" for i in range(60)], "app/n/a.py", "app/n", "app/nn/a.py", "app/o/a.py", "lib/a.py", "", "/app", None]
    owners = [(p, f"r{i}") for i in range(50) for p in ("app", "app/m")] * 2
    prefixes = spark.createDataFrame([*owners, ("app/n", "r1"), ("app/n", "r1"), ("app/n", None), ("app/o", None), (None, "r1"), ("", "r1")], "prefix string, owner string")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = linker.longest_prefix(spark.createDataFrame([(p,) for p in paths], "p string"), "p", "p", prefixes)
        got = {r.p: (r.owner, r.prefix) for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    want = {p: (None, "app/m") for p in paths[:60]} | {"app/n/a.py": ("r1", "app/n"), "app/n": ("r1", "app/n"), "app/nn/a.py": (None, "app"), "app/o/a.py": (None, "app/o")}
    assert got == want
    # a path has at most three beginnings, and the join for hot keys consists of four
    assert 0 < joined_rows(df._jdf.queryExecution().executedPlan()) <= 4 * 3 * len(paths)


def test_app_is_a_prefix_without_nodes_below_it(spark, tmp_path):
    nodes = spark.createDataFrame([("r:a", "r", "src/a.py")], "id string, repo_id string, file_path string")
    files = spark.createDataFrame([("r", "app/x/a.py"), ("r", "app"), ("r", "src/a.py")], "repo_id string, file_path string")
    for name, df in (("nodes", nodes), ("source_files", files)):
        for c in set(COLUMNS[name].split()) - set(df.columns):
            df = df.withColumn(c, F.lit("x"))
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = linker_queries.l05(spark, str(tmp_path))
    want = duck(str(tmp_path)).execute(linker_queries.REGISTRY.sql["l05_longest_prefix"]).fetchall()
    assert sorted(tuple(r) for r in got.select("file_path", "owner", "prefix").collect()) == sorted(want) == [("app", None, "app"), ("app/x/a.py", None, "app")]


def test_transform_cases(spark):
    v = lambda t: spark.createDataFrame([(t,)], "t string").select(transform.mask_secrets(F.col("t"))).first()[0]
    assert v("{ apiKey: 'abc', name: \"bob\" }") == "{ apiKey: '[REDACTED]', name: \"bob\" }"
    assert v("x = 'a1b2c3d4e5f6a7b8c9d0ff'") == "x = '[REDACTED]'"
    assert v("y" * 300) == "y" * 200 + "…" and v(None) is None
    tails = spark.createDataFrame([("app.useLogger",), ("a[b]",), ("f()",), ("x.9y",), ("",)], "t string").select(transform.name_tail(F.col("t")).alias("n")).collect()
    assert [r.n for r in tails] == ["useLogger", None, None, "y", None]
    rows = spark.createDataFrame([("a", 3), ("b", 0)], "category string, found int").withColumn("expected", F.when(F.col("category") == "a", 4))
    assert [(r.category, r.verdict) for r in transform.scorecard(rows, "category", "found", "expected", {}).orderBy("category").collect()] == [("a", "PARTIAL"), ("b", "NONE")]


def test_writes_cases(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    assert sorted(tuple(r) for r in writes.upsert(old, spark.createDataFrame([("b", 3), ("b", 5), ("c", None)], "id string, v int")).collect()) == [("a", 1), ("b", 5), ("c", None)]
    changes = writes.changeset(old, spark.createDataFrame([("a", None)], "id string, v int"), ["v"])
    assert {(r.id, r.change) for r in changes.collect()} == {("a", "update"), ("b", "delete")}
    g = graph(spark, [("a", "b"), ("b", "c")])
    writes.build(g.some(columns=NODE_COLUMNS), g.links(), f"file://{tmp_path}/g")
    writes.build(g.some(columns=NODE_COLUMNS), g.links(), f"file://{tmp_path}/g")
    back = spark.read.parquet(f"file://{tmp_path}/g/edges.parquet")
    assert back.count() == 2 and set(back.columns) == {"id", *EDGE_COLUMNS}


def test_usage_cases(spark):
    t = lambda h, m=0: dt.datetime(2026, 1, 1, h, m)
    calls = spark.createDataFrame([("u", t(1), "a", True, 1.0), ("u", t(1, 29), "b", False, 2.0), ("u", t(2), "a", True, 3.0), (None, t(1), "a", True, 1.0)], "user_id string, ts timestamp_ntz, tool_name string, success boolean, duration_ms double")
    got = sorted((r.n_calls, r.n_errors) for r in usage.session_rollup(calls, "30 minutes").collect())
    assert got == [(1, 0), (2, 1)]
    assert [r.n_calls for r in usage.session_rollup(calls, "30 minutes", "2026-01-01 02:00:00").collect()] == [2]
    levels = spark.createDataFrame([("k", dt.datetime(2025, 12, 1), 1, 10.0), ("k", dt.datetime(2026, 1, 2, 23), 2, 4.0), ("j", dt.datetime(2026, 1, 3), 1, 1.0), (None, t(1), 1, 99.0)], "k string, ts timestamp_ntz, o int, v double")
    assert [r.level for r in usage.level_series(levels, "k", "ts", "o", "v", "2026-01-01", 4).orderBy("day").collect()] == [10.0, 4.0, 5.0, 5.0]


def test_semantic_search_rejects_other_widths(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "id int, v array<double>")
    q = spark.createDataFrame([([1.0, 1.0],)], "q array<double>")
    assert [tuple(r) for r in tools.semantic_search(rows, "id", "v", q).collect()] == [(1, 0.71), (2, 0.0)]
    with pytest.raises(Exception):
        tools.semantic_search(rows, "id", "v", spark.createDataFrame([([1.0],)], "q array<double>")).collect()
