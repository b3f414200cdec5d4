"""Queries of usage, delivery and evaluation (A, D, E) over the event and
order tables: an event is a tool call, an order a push or a task."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import statistics, usage
from ..sources.tables import table
from .registry import Registry

REGISTRY = Registry()
query = REGISTRY.query

_CALLS = """WITH calls AS (SELECT event_id, ts, user_id, CASE WHEN event_type = 'signup' THEN 'rest:signup' ELSE event_type END AS tool_name, value AS duration_ms, event_type <> 'error' AS success,
  CASE WHEN k % 7 = 3 THEN NULL ELSE k % 5 END AS result_count, k, CASE WHEN k % 3 = 0 THEN value END AS cost FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


def calls(spark, d):
    """Events as tool calls."""
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.select("event_id", "ts", "user_id", F.when(F.col("event_type") == "signup", "rest:signup").otherwise(F.col("event_type")).alias("tool_name"), F.col("value").alias("duration_ms"), (F.col("event_type") != "error").alias("success"), F.when(F.col("k") % 7 == 3, None).otherwise(F.col("k") % 5).alias("result_count"), "k", F.when(F.col("k") % 3 == 0, F.col("value")).alias("cost"))


_A1 = "SELECT tool_name, count(*) AS n_calls, count(*) FILTER (NOT success) / count(*) AS error_rate, round(avg(duration_ms), 6) AS mean_ms FROM calls WHERE ts >= '2024-01-05' AND ts < '2024-01-20' AND tool_name NOT LIKE 'rest:%' GROUP BY ALL"
_A2 = "SELECT tool_name, count(*) AS n_counted, count(*) FILTER (result_count = 0) / count(*) AS empty_rate FROM calls WHERE result_count IS NOT NULL GROUP BY ALL"


@query("a01_tool_stats", f"{_CALLS} {_A1}")
def a01(spark, d):
    return usage.tool_stats(calls(spark, d), "2024-01-05", "2024-01-20")


@query("a02_empty_rates", f"{_CALLS} {_A2}")
def a02(spark, d):
    return usage.empty_rates(calls(spark, d))


@query("a03_empty_percent", f"{_CALLS} SELECT tool_name, n_counted, floor(empty_rate * 1000 + 0.5) / 10 AS empty_pct FROM ({_A2})")
def a03(spark, d):
    return usage.empty_percent(calls(spark, d))


@query("a04_recent_calls", f"{_CALLS} SELECT event_id, tool_name, user_id FROM calls ORDER BY ts DESC, event_id DESC LIMIT 50")
def a04(spark, d):
    return usage.recent(calls(spark, d), "ts", "event_id", 50).select("event_id", "tool_name", "user_id")


_SESSIONS = f"""{_CALLS}, m AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS b FROM calls WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM m),
sessions AS (SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_calls, count(DISTINCT tool_name) AS n_tools, count(*) FILTER (NOT success) AS n_errors, round(sum(duration_ms), 4) AS sum_ms, round(avg(duration_ms), 6) AS mean_ms FROM s GROUP BY user_id, sid)"""


def _sessions(spark, d, closed=None):
    return usage.session_rollup(calls(spark, d), "12 hours", closed)


@query("a05_session_rollup", f"{_SESSIONS} SELECT * FROM sessions WHERE last_ts + INTERVAL 12 HOUR <= TIMESTAMP '2024-01-29'")
def a05(spark, d):
    return _sessions(spark, d, "2024-01-29")


@query("a06_month_to_date", f"{_CALLS} SELECT count(*) AS n FROM calls WHERE ts >= date_trunc('month', TIMESTAMP '2024-01-17 12:00:00') AND ts < TIMESTAMP '2024-01-17 12:00:00'")
def a06(spark, d):
    now = F.lit("2024-01-17 12:00:00").cast("timestamp_ntz")
    return calls(spark, d).where((F.col("ts") >= F.date_trunc("month", now)) & (F.col("ts") < now)).agg(F.count(F.lit(1)).alias("n"))


@query("a07_latest_push", "SELECT o_custkey, (max({'d': o_orderdate, 'k': o_orderkey, 'p': o_totalprice})).p AS o_totalprice, (max({'d': o_orderdate, 'k': o_orderkey, 'p': o_totalprice})).k AS o_orderkey FROM orders GROUP BY 1")
def a07(spark, d):
    return usage.latest_per(table(spark, d, "orders"), "o_custkey", F.struct("o_orderdate", "o_orderkey"), ("o_totalprice", "o_orderkey"))


@query("a08_flow_series", "SELECT CAST(g AS DATE) AS day, count(o_orderkey) AS n_rows FROM range(DATE '2001-06-20', DATE '2001-08-19', INTERVAL 1 DAY) t(g) LEFT JOIN orders ON CAST(o_orderdate AS DATE) = g GROUP BY g")
def a08(spark, d):
    return usage.flow_series(table(spark, d, "orders"), "o_orderdate", "2001-06-20", 60)


@query("a09_level_series", """WITH days AS (SELECT CAST(g AS DATE) AS day FROM range(DATE '1998-01-01', DATE '1998-03-02', INTERVAL 1 DAY) t(g)),
o AS (SELECT o_custkey AS c, CAST(o_orderdate AS DATE) AS d, o_orderdate AS t, o_orderkey AS k, o_totalprice AS p FROM orders)
SELECT day, round(sum(p), 2) AS level FROM (SELECT day, c, arg_max(p, {'t': t, 'k': k}) AS p FROM days JOIN o ON d <= day GROUP BY day, c) GROUP BY day""")
def a09(spark, d):
    return usage.level_series(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey", "o_totalprice", "1998-01-01", 60)


@query("a10_window_bounds", "SELECT DATE '2024-01-04' AS previous_start, DATE '2024-01-14' AS start, DATE '2024-01-24' AS end_day")
def a10(spark, d):
    a, b, c = usage.window_bounds(F.lit("2024-01-23 10:00:00").cast("timestamp_ntz"), 10)
    return spark.range(1).select(a.alias("previous_start"), b.alias("start"), c.alias("end_day"))


@query("a11_compare_windows", f"""{_CALLS}, x AS (SELECT tool_name, round(sum(duration_ms) FILTER (ts >= '2024-01-14'), 4) AS present, round(sum(duration_ms) FILTER (ts < '2024-01-14'), 4) AS previous FROM calls WHERE ts >= '2024-01-04' AND ts < '2024-01-24' GROUP BY ALL)
SELECT *, round((coalesce(present, 0) - previous) / nullif(previous, 0), 6) AS change FROM x""")
def a11(spark, d):
    return usage.compare_windows(calls(spark, d), "tool_name", "ts", "duration_ms", "2024-01-23 10:00:00", 10)


@query("a12_merge_tools", f"{_CALLS} SELECT a.*, empty_rate FROM ({_A1}) a LEFT JOIN (SELECT * FROM ({_A2}) WHERE tool_name <> 'view') USING (tool_name)")
def a12(spark, d):
    c = calls(spark, d)
    return usage.merge_tools(usage.tool_stats(c, "2024-01-05", "2024-01-20"), usage.empty_rates(c.where("tool_name <> 'view'")))


@query("a14_known_sum", f"{_CALLS} SELECT user_id, round(sum(cost), 4) AS total, count(*) AS n_rows, count(cost) AS n_known FROM calls GROUP BY ALL")
def a14(spark, d):
    return usage.known_sum(calls(spark, d), ["user_id"], "cost")


@query("a15_value_series", f"{_CALLS} SELECT CAST(g AS DATE) AS day, CASE WHEN count(event_id) = 0 THEN 0.0 ELSE round(sum(cost), 4) END AS total FROM range(DATE '2024-01-25', DATE '2024-02-14', INTERVAL 1 DAY) t(g) LEFT JOIN calls ON CAST(ts AS DATE) = g GROUP BY g")
def a15(spark, d):
    return usage.value_series(calls(spark, d), "ts", "cost", "2024-01-25", 20)


@query("a16_distinct_users", f"{_CALLS} SELECT count(DISTINCT u) AS n FROM (SELECT user_id AS u FROM calls WHERE success UNION ALL SELECT o_custkey FROM orders)")
def a16(spark, d):
    u = calls(spark, d).where("success").select("user_id").union(table(spark, d, "orders").select("o_custkey"))
    return u.agg(F.count_distinct("user_id").alias("n"))


@query("a17_adoption", f"{_CALLS} SELECT user_id, count(*) AS n_calls, round(count(*) FILTER (NOT success) / count(*), 6) AS error_rate, round(avg(duration_ms), 4) AS mean_ms, round(median(duration_ms), 4) AS median_ms FROM calls GROUP BY ALL")
def a17(spark, d):
    return usage.adoption(calls(spark, d), "user_id")


@query("a18_members", f"""{_SESSIONS}, c AS (SELECT user_id, tool_name, count(*) AS n, max(ts) AS t FROM calls WHERE k % 2 = 0 GROUP BY ALL),
a AS (SELECT user_id, sum(n) AS n_calls, (min({{'n': -n, 't': tool_name}})).t AS top_tool, max(t) AS t FROM c GROUP BY ALL), b AS (SELECT user_id, count(*) AS n_sessions, max(last_ts) AS l FROM sessions WHERE n_calls > 3 GROUP BY ALL)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(n_sessions, 0) AS n_sessions, CAST(coalesce(n_calls, 0) AS BIGINT) AS n_calls, top_tool, greatest(t, l) AS last_active FROM a FULL JOIN b ON a.user_id = b.user_id""")
def a18(spark, d):
    return usage.members(_sessions(spark, d).where("n_calls > 3"), calls(spark, d).where("k % 2 = 0"))


@query("a19_session_summary", f"{_SESSIONS} SELECT CASE WHEN n_calls >= 4 THEN 'heavy' ELSE 'light' END AS segment, count(*) AS n, CAST(median(n_calls) AS DOUBLE) AS median_calls, round(median(sum_ms), 4) AS median_ms FROM sessions GROUP BY ALL")
def a19(spark, d):
    return usage.session_summary(_sessions(spark, d), 4)


@query("a20_retention", f"{_CALLS} SELECT tool_name, count(*) AS n FROM calls WHERE ts >= TIMESTAMP '2024-01-28' - INTERVAL 14 DAY GROUP BY ALL")
def a20(spark, d):
    return usage.retained(calls(spark, d), "ts", "2024-01-28", 14).groupBy("tool_name").agg(F.count(F.lit(1)).alias("n"))


@query("a21_merge_watermarks", f"{_CALLS} SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts FROM calls WHERE k <> 5 GROUP BY ALL")
def a21(spark, d):
    c = calls(spark, d).where("k <> 5")
    old = c.where("success").groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return usage.merge_watermarks(old, c.where("not success"), "user_id", "ts")


@query("a22_tallies", f"{_CALLS} SELECT user_id, tool_name, count(*) AS n FROM calls GROUP BY ALL")
def a22(spark, d):
    return usage.tally(calls(spark, d), ["user_id", "tool_name"])


_ITEMS = "items AS (SELECT workspace_id, seq, i AS ordinality, arr[i] AS item FROM (SELECT *, unnest(range(1, len(arr) + 1)) AS i FROM (SELECT DISTINCT workspace_id, seq, kind, request_hash, CAST(json_extract(data, '$.included') AS VARCHAR[]) AS arr FROM intent_release_events)))"


def _items(spark, d):
    e = table(spark, d, "intent_release_events").select("workspace_id", "seq", "kind", "request_hash", F.get_json_object("data", "$.included").alias("j"))
    arr = F.from_json("j", "array<string>")
    e = e.select("workspace_id", "seq", "kind", "request_hash", arr.alias("a")).distinct()
    return e.select("workspace_id", "seq", F.posexplode("a").alias("p", "item")).select("workspace_id", "seq", (F.col("p") + 1).cast("long").alias("ordinality"), "item")


@query("a23_json_items", f"WITH {_ITEMS} SELECT * FROM items")
def a23(spark, d):
    """Elements of a JSON array with their ordinal."""
    return _items(spark, d)


@query("a25_ranked_issues", f"WITH {_ITEMS} SELECT item, count(*) AS n, CAST(sum(ordinality) AS BIGINT) AS severity FROM items GROUP BY ALL ORDER BY severity DESC, n DESC, item LIMIT 100")
def a25(spark, d):
    return usage.ranked_issues(_items(spark, d), ["item"], "ordinality", 100)


@query("a26_monthly_means", f"{_CALLS} SELECT strftime(ts, '%Y-%m') AS month, round(avg(result_count), 6) AS mean_a, round(avg(cost), 6) AS mean_b FROM calls GROUP BY ALL")
def a26(spark, d):
    return usage.monthly_means(calls(spark, d), "ts", "result_count", "cost")


@query("a27_offset_page", f"{_CALLS} SELECT event_id, cost FROM calls WHERE NOT success ORDER BY cost DESC NULLS LAST, event_id LIMIT 40 OFFSET 20")
def a27(spark, d):
    return usage.offset_page(calls(spark, d).where("not success").select("event_id", "cost"), [F.desc_nulls_last("cost"), F.asc("event_id")], 20, 40)


@query("a28_run_totals", "SELECT count(*) AS n, coalesce(sum(rows_read), 0) AS n_read, count(*) FILTER (status = 'failed') AS n_failed, count(finished_at) AS n_finished FROM (SELECT DISTINCT * FROM sync_runs)")
def a28(spark, d):
    r = table(spark, d, "sync_runs").distinct()
    return r.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("rows_read"), F.lit(0)).cast("long").alias("n_read"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.count("finished_at").alias("n_finished"))


# delivery: an order is a task, its lineitems are evidence of shipping

_TASKS = "WITH task AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, o_orderdate, min(l_shipdate) AS shipped, max(l_shipdate) AS last_shipped FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"


def _tasks(spark, d):
    ship = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("shipped"), F.max("l_shipdate").alias("last_shipped"))
    return table(spark, d, "orders").join(ship, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderdate", "shipped", "last_shipped")


@query("d01_delivery_counts", f"{_TASKS} SELECT o_orderpriority, count(*) AS n, count(shipped) AS n_shipped, count(*) FILTER (shipped < o_orderdate) AS n_odd, count(*) FILTER (shipped IS NULL) AS n_open FROM task GROUP BY ALL")
def d01(spark, d):
    t = _tasks(spark, d)
    return t.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count("shipped").alias("n_shipped"), F.count_if(F.col("shipped") < F.col("o_orderdate")).alias("n_odd"), F.count_if(F.col("shipped").isNull()).alias("n_open"))


@query("d02_interval_medians", f"{_TASKS}, s AS (SELECT o_orderpriority, datediff('day', CAST(o_orderdate AS DATE), CAST(shipped AS DATE)) AS n FROM task) SELECT o_orderpriority, CAST(median(n) FILTER (n >= 0) AS DOUBLE) AS median_days, count(*) FILTER (n >= 0) AS n FROM s GROUP BY ALL")
def d02(spark, d):
    return statistics.interval_median(_tasks(spark, d), ["o_orderpriority"], "o_orderdate", "shipped")


@query("d03_stage_time", """WITH o AS (SELECT l_orderkey, l_returnflag, l_linenumber, max(l_quantity) AS q FROM lineitem GROUP BY ALL), p AS (SELECT l_orderkey, l_returnflag, sum(q) AS s FROM o GROUP BY ALL)
SELECT l_returnflag, count(*) AS n_tasks, median(s) AS median_span FROM p GROUP BY ALL""")
def d03(spark, d):
    return statistics.stage_time(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag", ["l_linenumber"], F.col("l_quantity"))


@query("d04_unclaimed", f"{_TASKS}, c AS (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY ALL) SELECT o_orderkey, greatest(0, datediff('day', CAST(shipped AS DATE), CAST(last_shipped AS DATE)) - q) AS unclaimed FROM task JOIN c ON l_orderkey = o_orderkey")
def d04(spark, d):
    claimed = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"))
    t = _tasks(spark, d).join(claimed, F.col("l_orderkey") == F.col("o_orderkey"))
    return t.select("o_orderkey", F.greatest(F.lit(0.0), F.date_diff("last_shipped", "shipped") - F.col("q")).alias("unclaimed"))


@query("d05_filled_counts", "SELECT v AS l_returnflag, count(l_orderkey) AS n FROM (VALUES ('A'), ('N'), ('R'), ('X')) t(v) LEFT JOIN lineitem ON l_returnflag = v GROUP BY v")
def d05(spark, d):
    return statistics.filled_counts(table(spark, d, "lineitem"), "l_returnflag", ["A", "N", "R", "X"])


@query("d06_wait_median", "WITH x AS (SELECT l_partkey, l_suppkey, min(l_quantity) AS q FROM lineitem GROUP BY ALL) SELECT l_suppkey, median(q) AS median, max(q) - min(q) AS spread FROM x GROUP BY ALL")
def d06(spark, d):
    """Median over distinct changes (part and supplier), with its spread."""
    x = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min("l_quantity").alias("q"))
    return statistics.median_or_zero(x, ["l_suppkey"], "q")


@query("d07_linked_runs", "SELECT k AS task, count(DISTINCT r) AS n_runs FROM (SELECT l_orderkey AS k, l_partkey AS r FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY ALL")
def d07(spark, d):
    li = table(spark, d, "lineitem")
    return statistics.linked_runs(li.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("task"), F.col("l_partkey").alias("run")), li.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("task"), F.col("l_suppkey").alias("run")), "task", "run")


@query("d08_either_exists", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount > 0.09) OR EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)")
def d08(spark, d):
    """Orders that one of two semi joins holds."""
    o = table(spark, d, "orders")
    a = o.join(table(spark, d, "lineitem").where("l_discount > 0.09").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    b = o.join(table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    return a.select("o_orderkey").union(b.select("o_orderkey")).distinct()


@query("d09_keyset_page", "SELECT o_orderkey, o_orderdate FROM orders WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '1999-01-01', 500) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def d09(spark, d):
    return usage.keyset_page(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", ("1999-01-01", 500), 100)


# evaluation

_RUNS = "WITH runs AS (SELECT user_id AS target, tool_name AS kase, event_id % 4 AS run, CASE WHEN k % 2 = 0 THEN 'base' ELSE 'new' END AS arm, max(duration_ms) AS score FROM ({}) GROUP BY ALL)"


def _runs(spark, d):
    return calls(spark, d).groupBy(F.col("user_id").alias("target"), F.col("tool_name").alias("kase"), (F.col("event_id") % 4).alias("run"), F.when(F.col("k") % 2 == 0, "base").otherwise("new").alias("arm")).agg(F.max("duration_ms").alias("score"))


_RUNS = _RUNS.format("SELECT event_id, user_id, CASE WHEN event_type = 'signup' THEN 'rest:signup' ELSE event_type END AS tool_name, value AS duration_ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")


@query("e01_median_spread", f"{_RUNS} SELECT kase, arm, round(coalesce(median(score), 0), 6) AS median, round(coalesce(max(score) - min(score), 0), 6) AS spread FROM runs GROUP BY ALL")
def e01(spark, d):
    return statistics.median_or_zero(_runs(spark, d), ["kase", "arm"], "score")


@query("e02_paired_arms", f"""{_RUNS}, p AS (SELECT target, kase, run, max(score) FILTER (arm = 'base') AS x, max(score) FILTER (arm = 'new') AS y FROM runs GROUP BY ALL)
SELECT target, kase, count(*) AS n_pairs, round(avg(y - x), 6) AS mean_diff, round(median(y - x), 6) AS median_diff, count(*) FILTER (y > x) AS wins, count(*) FILTER (y = x) AS ties, count(*) FILTER (y < x) AS losses FROM p WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL""")
def e02(spark, d):
    return statistics.paired_arms(_runs(spark, d), ["target", "kase"], "run", "arm", "score", "base", "new")


@query("e03_arm_totals", f"{_RUNS} SELECT arm, count(*) AS n_rows, count(score) AS n_known, round(sum(score), 4) AS total FROM runs GROUP BY ALL")
def e03(spark, d):
    return usage.known_sum(_runs(spark, d), ["arm"], "score")


_VERDICTS = "WITH v AS (SELECT 'arm' || a AS left, 'arm' || b AS right, CASE WHEN k % 4 = 0 THEN 'tie' WHEN k % 4 = 1 THEN 'invalid' WHEN k % 4 = 2 THEN 'arm' || a ELSE 'arm' || b END AS winner FROM (SELECT user_id % 3 AS a, user_id % 3 + 1 AS b, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"


def _verdicts(spark, d):
    c = calls(spark, d).select((F.col("user_id") % 3).alias("a"), (F.col("user_id") % 3 + 1).alias("b"), (F.col("k") % 4).alias("m"))
    left, right = F.concat(F.lit("arm"), "a"), F.concat(F.lit("arm"), "b")
    return c.select(left.alias("left"), right.alias("right"), F.when(F.col("m") == 0, "tie").when(F.col("m") == 1, "invalid").when(F.col("m") == 2, left).otherwise(right).alias("winner"))


@query("e04_standings", f"{_VERDICTS} SELECT arm, count(*) AS n, round(avg(CASE WHEN winner = arm THEN 1.0 WHEN winner = 'tie' THEN 0.5 ELSE 0 END), 6) AS win_rate FROM (SELECT unnest([\"left\", \"right\"]) AS arm, winner FROM v WHERE winner <> 'invalid') GROUP BY ALL")
def e04(spark, d):
    return statistics.standings(_verdicts(spark, d))


@query("e04_head_to_head", f"{_VERDICTS} SELECT least(\"left\", \"right\") AS a, greatest(\"left\", \"right\") AS b, count(*) FILTER (winner = least(\"left\", \"right\")) AS wins_a, count(*) FILTER (winner = 'tie') AS ties, count(*) FILTER (winner = greatest(\"left\", \"right\")) AS wins_b FROM v GROUP BY ALL")
def e04b(spark, d):
    return statistics.head_to_head(_verdicts(spark, d))


@query("e05_percentiles", f"{_CALLS} SELECT tool_name, round(quantile_disc(duration_ms, 0.5), 2) AS p50, round(quantile_disc(duration_ms, 0.95), 2) AS p95, count(duration_ms) AS n FROM calls GROUP BY ALL")
def e05(spark, d):
    return statistics.nearest_rank(calls(spark, d), ["tool_name"], "duration_ms")


_PATHS = """WITH f AS (SELECT DISTINCT repo_id, file_path AS f FROM nodes WHERE type = 'class' AND file_path IS NOT NULL), t AS (SELECT DISTINCT repo_id, regexp_replace(file_path, '^[^/]*/', '') AS t FROM source_files WHERE language IS NOT NULL),
m AS (SELECT DISTINCT f.repo_id, f, t FROM f JOIN t ON f.repo_id = t.repo_id WHERE f = t OR (len(t) <= len(f) AND contains(t, '/') AND suffix(f, '/' || t)) OR (len(f) < len(t) AND contains(f, '/') AND suffix(t, '/' || f))),
s AS (SELECT repo_id, coalesce((SELECT count(DISTINCT f) FROM m WHERE m.repo_id = r.repo_id) / nullif((SELECT count(*) FROM f WHERE f.repo_id = r.repo_id), 0), 0) AS p, coalesce((SELECT count(DISTINCT t) FROM m WHERE m.repo_id = r.repo_id) / nullif((SELECT count(*) FROM t WHERE t.repo_id = r.repo_id), 0), 0) AS r
  FROM (SELECT repo_id FROM f UNION SELECT repo_id FROM t) r)
SELECT repo_id, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM s"""


@query("e06_path_scores", _PATHS)
def e06(spark, d):
    """Files of classes against source files less their first folder."""
    f = table(spark, d, "nodes").where("type = 'class' and file_path is not null").select("repo_id", F.col("file_path").alias("path"))
    t = table(spark, d, "source_files").where("language is not null").select("repo_id", F.regexp_replace("file_path", "^[^/]*/", "").alias("path"))
    return statistics.path_scores(f, t, "repo_id")


@query("e07_truth_score", f"{_CALLS}, x AS (SELECT user_id, coalesce(count(*) FILTER (k % 3 = 0 AND success) / nullif(count(*) FILTER (k % 3 = 0), 0), 0) AS c, coalesce(count(*) FILTER (k % 3 = 1 AND success AND k > 80) / nullif(count(*) FILTER (k % 3 = 1), 0), 0) AS b FROM (SELECT user_id, k, success FROM calls) GROUP BY ALL) SELECT user_id, CAST(floor(100 * c * (1 - b) + 0.5) AS BIGINT) AS score FROM x")
def e07(spark, d):
    c = calls(spark, d)
    present = F.col("success") & ((F.col("k") % 3 != 1) | (F.col("k") > 80))
    return statistics.truth_score(c, "user_id", F.col("k") % 3 == 0, F.col("k") % 3 == 1, present)


@query("e08_tool_gaps", f"{_CALLS}, a AS (SELECT tool_name, count(*) AS x, count(*) FILTER (result_count = 0) AS y FROM calls WHERE tool_name <> 'click' GROUP BY ALL), b AS (SELECT tool_name, count(*) AS z FROM calls WHERE k > 50 AND tool_name <> 'view' GROUP BY ALL) SELECT coalesce(a.tool_name, b.tool_name) AS tool_name, coalesce(x, 0) AS n_calls, coalesce(y, 0) AS n_empty, coalesce(z, 0) AS n_fallback FROM a FULL JOIN b ON a.tool_name = b.tool_name")
def e08(spark, d):
    c = calls(spark, d)
    return statistics.tool_gaps(c.where("tool_name <> 'click'"), c.where("k > 50 and tool_name <> 'view'"))
