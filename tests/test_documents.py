"""Readers of parsed repositories, overrides, telemetry; the session stream."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from graphloom.sources import documents
from graphloom.streaming import sessions


def test_parsed_repository(spark, tmp_path):
    at = {"filePath": "src/a.ts", "startLine": 3, "endLine": 9}
    repo = {
        "id": "r", "name": "n", "packages": [{"id": "r:p", "name": "p", "version": "1", "path": "src"}],
        "files": [{"id": "r:f", "path": "src/a.ts", "language": "ts", "packageId": "r:p"}],
        "functions": [{"id": "r:g", "name": "g", "kind": "function", "fileId": "r:f", "isExported": True, "location": at}, {"id": "r:m", "name": "m", "kind": "method", "classId": "r:c", "fileId": "r:f", "location": at}],
        "classes": [{"id": "r:c", "name": "C", "fileId": "r:f", "location": at}], "interfaces": [],
        "entrypoints": [{"id": "r:e", "type": "http", "handlerId": "r:g", "location": at}],
        "calls": [{"id": "k1", "callerId": "r:g", "calleeId": "r:m", "provenance": "iface-impl", "calleeExpression": "c.m"}, {"id": "k2", "callerId": "r:g", "calleeExpression": "this\n .bus.emit"}],
        "imports": [], "other": 1,
    }
    (tmp_path / "r.json").write_text(json.dumps(repo))
    nodes, edges, open_calls = documents.graph_tables(documents.read_parsed(spark, str(tmp_path / "r.json")))
    assert {(r.id, r.type) for r in nodes.collect()} == {("r:p", "package"), ("r:f", "file"), ("r:g", "function"), ("r:m", "function"), ("r:c", "class"), ("r:e", "entrypoint")}
    assert {(r.source_id, r.type, r.target_id, r.confidence) for r in edges.collect()} == {("r:f", "CONTAINS_FUNCTION", "r:g", 1.0), ("r:f", "CONTAINS_CLASS", "r:c", 1.0), ("r:c", "HAS_METHOD", "r:m", 1.0), ("r:p", "CONTAINS_FILE", "r:f", 1.0), ("r:e", "HANDLES", "r:g", 1.0), ("r:g", "CALLS", "r:m", 0.5)}
    assert [tuple(r) for r in open_calls.collect()] == [("r:g", "this .bus.emit", "emit")]


def test_mapper(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"services": [{"name": "a", "repo": "r", "aliases": ["b"]}], "sdkMappings": [], "unresolvableServices": ["x"]}))
    m = documents.read_mapper(spark, str(tmp_path / "m.json"))
    assert {tuple(r) for r in m["services"].collect()} == {("a", "r"), ("b", "r")} and m["unresolvable"].count() == 1
    (tmp_path / "n.json").write_text(json.dumps({"services": [{"name": "a"}]}))
    with pytest.raises(ValueError):
        documents.read_mapper(spark, str(tmp_path / "n.json"))


def test_csv_rejects_nul(spark, tmp_path):
    documents.write_csv(spark.createDataFrame([(1, 'a "b", c'), (2, ""), (3, None)], "i int, t string"), str(tmp_path / "c"))
    assert {tuple(r) for r in documents.read_csv(spark, str(tmp_path / "c"), "i int, t string").collect()} == {(1, 'a "b", c'), (2, ""), (3, None)}
    with pytest.raises(Exception):
        documents.write_csv(spark.createDataFrame([(1, "a\0")], "i int, t string"), str(tmp_path / "d"))


def test_otlp(spark, tmp_path):
    rec = lambda nanos, sid: {"timeUnixNano": nanos, "body": {"stringValue": "api"}, "attributes": [{"key": "n", "value": {"intValue": "4"}}] + ([{"key": "session.id", "value": {"stringValue": sid}}] if sid else [])}
    (tmp_path / "o.json").write_text(json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": [rec("7", "s"), rec(None, "s"), rec("9", None)]}]}]}))
    got = documents.read_otlp(spark, str(tmp_path / "o.json")).orderBy("nanos").collect()
    assert [(r.session_id, r.nanos, r.attrs["n"]) for r in got] == [("s", 0, "4"), ("s", 7, "4")]


def test_session_marks(spark, tmp_path):
    """A later batch's records at or below the mark are dropped, 0 counts."""
    for i, rows in enumerate([[("s", 5), ("s", 9), ("t", 0)], [("s", 9), ("s", 10), ("s", 0), ("t", 3)]]):
        spark.createDataFrame(rows, "session_id string, nanos long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if i == 0:
            import time

            time.sleep(1.1)
    stream = spark.readStream.schema("session_id string, nanos long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.session_id: (r.n_counted, r.n_dropped, r.mark) for r in sessions.run(sessions.session_totals(stream), ["session_id"], "update").collect()}
    assert got == {"s": (4, 1, 10), "t": (2, 0, 3)}
    assert spark.range(1).select(F.lit(1)).count() == 1
