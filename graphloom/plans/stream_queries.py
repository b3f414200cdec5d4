"""Queries of streams, sources and sinks: each drains a stream, or writes a
table in a format and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import writes
from ..scale import Scratch
from ..sources import documents
from ..sources.tables import table
from ..streaming import sessions
from .graph_queries import CODE, code_graph
from .registry import Registry
from .usage_queries import _SESSIONS

REGISTRY = Registry()
query = REGISTRY.query


def _stream(spark, d):
    return sessions.open_stream(spark, f"{d}/events.parquet").select("event_id", "ts", "user_id", F.col("event_type").alias("tool_name"), "value")


@query("st01_day_counts", "SELECT CAST(ts AS DATE) AS day, event_type AS tool_name, count(*) AS n FROM events GROUP BY ALL")
def st01(spark, d):
    return sessions.run(sessions.day_counts(_stream(spark, d)), ["day", "tool_name"])


@query("st02_session_counts", f"{_SESSIONS} SELECT user_id, first_ts, n_calls FROM sessions")
def st02(spark, d):
    return sessions.run(sessions.session_counts(_stream(spark, d), "12 hours"), ["user_id", "first_ts"])


@query("st03_distinct_calls", "SELECT DISTINCT event_id, user_id FROM events")
def st03(spark, d):
    return sessions.run(sessions.distinct_calls(_stream(spark, d), "event_id").select("event_id", "user_id"), ["event_id"], "append")


@query("st04_acceptance_marks", "SELECT event_type AS tool_name, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY ALL")
def st04(spark, d):
    return sessions.run(sessions.acceptance_marks(_stream(spark, d)), ["tool_name"])


@query("st05_session_totals", "SELECT CAST(user_id AS VARCHAR) AS session_id, count(*) AS n_counted, CAST(0 AS BIGINT) AS n_dropped, max(epoch_us(ts) * 1000) AS mark FROM events GROUP BY ALL")
def st05(spark, d):
    r = _stream(spark, d).select(F.col("user_id").cast("string").alias("session_id"), (F.unix_micros("ts") * 1000).alias("nanos"))
    return sessions.run(sessions.session_totals(r), ["session_id"], "update")


@query("s07_build_graph", f"WITH {CODE} SELECT type, count(*) AS n FROM e GROUP BY ALL")
def s07(spark, d):
    """A graph stored by edge type and read back."""
    g = code_graph(spark, d)
    out = f"{Scratch(spark, 'build').root}/graph"
    writes.build(g.some(), g.links(), out)
    return spark.read.parquet(f"{out}/edges.parquet").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("s08_checked_read", "SELECT count(*) AS n FROM edges")
def s08(spark, d):
    """A read whose columns and types are checked first."""
    return table(spark, d, "edges").agg(F.count(F.lit(1)).alias("n"))


@query("s09_csv", "SELECT doc_id, text, source FROM documents")
def s09(spark, d):
    """Texts through CSV: empty texts and nulls stay apart."""
    out = f"{Scratch(spark, 'csv').root}/csv"
    # CSV readers fold line ends, so texts go as hexadecimal digits
    docs = table(spark, d, "documents").select("doc_id", F.hex(F.encode("text", "utf-8")).alias("text"), "source")
    documents.write_csv(docs, out)
    back = documents.read_csv(spark, out, "doc_id long, text string, source string")
    return back.select("doc_id", F.decode(F.unhex("text"), "utf-8").alias("text"), "source")


@query("s12_since_cursor", "WITH c AS (SELECT workspace_id, max(cut_at) AS cursor FROM sync_runs WHERE status = 'succeeded' AND feed = 'release_events' GROUP BY ALL) SELECT DISTINCT workspace_id, seq, loaded_at FROM intent_release_events LEFT JOIN c USING (workspace_id) WHERE CASE WHEN cursor IS NULL THEN loaded_at >= '2026-03-01' ELSE loaded_at > cursor END")
def s12(spark, d):
    c = table(spark, d, "sync_runs").where("status = 'succeeded' and feed = 'release_events'").groupBy("workspace_id").agg(F.max("cut_at").alias("cursor"))
    return documents.since_cursor(table(spark, d, "intent_release_events").select("workspace_id", "seq", "loaded_at").distinct(), c, "workspace_id", "loaded_at", "2026-03-01")


@query("s13_json_lines", "SELECT run_id, workspace_id, feed, rows_read FROM sync_runs")
def s13(spark, d):
    """Records appended as JSON lines and read back."""
    out = f"{Scratch(spark, 'lines').root}/lines"
    r = table(spark, d, "sync_runs").select("run_id", "workspace_id", "feed", "rows_read")
    documents.append_lines(r.where("feed = 'repo_states'"), out)
    documents.append_lines(r.where("feed <> 'repo_states'"), out)
    return documents.read_lines(spark, out, "run_id long, workspace_id string, feed string, rows_read int")


@query("s15_full_scan", "SELECT count(*) AS n_rows, count(DISTINCT id) AS n_ids, count(*) FILTER (id IS NULL) AS n_null FROM nodes")
def s15(spark, d):
    n = table(spark, d, "nodes")
    return n.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("n_ids"), F.count_if(F.col("id").isNull()).alias("n_null"))
