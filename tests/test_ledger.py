"""The ledger: expiry, stale writers, crashes, retries, compaction, replay."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from graphloom.operators import ledger

T = "2026-01-01 {:02d}:00:00"


def items(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "item string")


def states(store, it, now):
    return {r.item: r.state for r in store.state(it, now).collect()}


def test_stale_writer_is_not_published(spark, tmp_path):
    s, it = ledger.LedgerStore(spark, f"file://{tmp_path}"), items(spark, "a", "b")
    one, got = s.lease(it, "A", T.format(0), T.format(1))
    assert got.count() == 2
    s.write(one, got.withColumn("by", F.lit("A")))
    assert states(s, it, T.format(0)) == {"a": "leased", "b": "leased"}
    assert states(s, it, T.format(2)) == {"a": "pending", "b": "pending"}
    two, got = s.lease(it, "B", T.format(2), T.format(3))
    assert two > one
    s.complete(one)
    assert states(s, it, T.format(2)) == {"a": "leased", "b": "leased"}
    assert s.published().count() == 0
    s.write(two, got.withColumn("by", F.lit("B")))
    s.complete(two)
    s.complete(two)
    assert sorted((r["item"], r.by) for r in s.published().collect()) == [("a", "B"), ("b", "B")]


def test_crash_retry_and_give_back(spark, tmp_path):
    s, it = ledger.LedgerStore(spark, f"file://{tmp_path}"), items(spark, "a", None, "a")
    one, got = s.lease(it, "A", T.format(0), T.format(9))
    s.write(one, got.withColumn("n", F.lit(1)))
    # a retry replaces what was written, an unfinished folder does not count
    s.write(one, got.withColumn("n", F.lit(2)))
    (tmp_path / "out" / f"{7:020d}").mkdir(parents=True)
    s.give_back(one)
    assert states(s, it, T.format(0)) == {"a": "pending"}
    two, got = s.lease(it, "B", T.format(0), T.format(9))
    s.write(two, got.withColumn("n", F.lit(3)))
    s.complete(two)
    assert [r.n for r in s.published().collect()] == [3]
    assert s.lease(it, "C", T.format(1), T.format(2))[1].count() == 0


def test_compaction_keeps_states(spark, tmp_path):
    s, it = ledger.LedgerStore(spark, f"file://{tmp_path}"), items(spark, "a", "b", "c")
    one, got = s.lease(items(spark, "a"), "A", T.format(0), T.format(1))
    s.write(one, got.withColumn("n", F.lit(1)))
    s.complete(one)
    two, _ = s.lease(items(spark, "b"), "B", T.format(0), T.format(1))
    before = states(s, it, T.format(0))
    s.compact()
    s.compact()
    assert states(s, it, T.format(0)) == before == {"a": "done", "b": "leased", "c": "pending"}
    s.complete(two)
    assert states(s, it, T.format(0))["b"] == "done"
    assert [r.n for r in s.published().collect()] == [1]


def at(h):
    return dt.datetime(2026, 1, 1, h)


def test_replay(spark):
    runs = spark.createDataFrame(
        [(1, "w", "f", at(2), "succeeded"), (2, "w", "f", at(4), "failed"), (3, "w", "f", at(6), "running"), (4, "w", "f", None, "succeeded"), (5, None, "f", at(9), "succeeded")],
        "run_id long, workspace_id string, feed string, cut_at timestamp_ntz, status string",
    )
    rows = [("f", "w", "old", at(1), at(1), "x"), ("f", "w", "old", at(1), at(1), "x"), ("f", "w", "changed", at(1), at(1), "x"), ("f", "w", "changed", at(3), at(3), "y"), ("f", "w", "same", at(1), at(1), None), ("f", "w", "same", at(3), at(3), None), ("f", "w", "new", at(8), at(8), "z"), ("f", "v", "other", at(1), at(1), "x"), ("f", "w", "never", at(1), None, "x")]
    it = spark.createDataFrame(rows, "feed string, workspace_id string, record_key string, at timestamp_ntz, loaded_at timestamp_ntz, version string")
    got = {r.record_key: r.state for r in ledger.replay(it, runs).collect()}
    assert got == {"old": "done", "changed": "leased", "same": "done", "new": "pending", "other": "pending", "never": "pending"}
    assert ledger.replay(it.limit(0), runs).count() == 0
    assert {r.state for r in ledger.replay(it, runs.limit(0)).collect()} == {"pending"}
