"""The index against brute force, with one place and with grown subtrees."""

from __future__ import annotations

import os

import numpy as np

from graphloom.llm import similar


def vectors(n, seed=3):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n // 4, 8))
    x = np.concatenate([base, base + r.normal(size=base.shape) * 0.05, base + r.normal(size=base.shape) * 0.1, r.normal(size=(n - 3 * (n // 4), 8))])
    return x


def brute(x, k, least):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    top = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return {tuple(sorted((f"n{i:04d}", f"n{j:04d}"))) for i in range(len(x)) for j in top[i] if s[i, j] >= least}


def rows_of(spark, x):
    data = [(f"n{i:04d}", [float(v) for v in row]) for i, row in enumerate(x)]
    data += [(None, data[0][1]), ("bad1", [1.0]), ("bad2", [0.0] * 8), ("bad3", [float("nan")] * 8), ("bad4", None), ("bad5", [None] * 8), data[0], data[1]]
    return spark.createDataFrame(data, "id string, embedding array<double>")


def test_pairs(spark):
    x = vectors(800)
    got = {(r.id_a, r.id_b) for r in similar.similar_pairs(rows_of(spark, x), width=8).collect()}
    want = brute(x, 5, 0.9)
    assert len(want) > 300 and len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)


def test_grown_tree(spark):
    x = vectors(1200, 5)
    index = similar.Index(similar.usable_vectors(rows_of(spark, x), 8), 5, 0.9, leaf=24, sample=300)
    assert len(index.tree.leaves) > 12 and index.measured >= 0.99
    near = {(r.id, r.other) for r in index.top().where("s >= 0.9").select("id", "other").collect()}
    want = brute(x, 5, 0.9)
    got = {tuple(sorted(p)) for p in near}
    assert len(got & want) >= 0.97 * len(want)


def test_equal_vectors_and_none(spark):
    rows = spark.createDataFrame([(f"e{i}", [1.0, 2.0]) for i in range(9)] + [("x", [-1.0, 0.5])], "id string, embedding array<double>")
    got = {(r.id_a, r.id_b) for r in similar.similar_pairs(rows, width=2).collect()}
    # each of the nine meets the five smallest others
    want = {tuple(sorted((f"e{i}", f"e{j}"))) for i in range(9) for j in [j for j in range(9) if j != i][:5]}
    assert got == want
    assert similar.similar_pairs(rows.limit(0), width=2).count() == 0
    assert similar.recall_report(rows.limit(0), width=2).first().recall == 1.0


def test_disk_does_not_grow_with_visits(spark, monkeypatch):
    """Wide visits send every vector to many groups; what stays on disk may not follow."""
    x = np.random.default_rng(11).normal(size=(3000, 64))
    data = spark.createDataFrame([(f"n{i:04d}", [float(v) for v in row]) for i, row in enumerate(x)], "id string, embedding array<double>")
    dirs = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def shuffled():
        return {os.path.join(r, f): os.path.getsize(os.path.join(r, f)) for d in dirs for r, _, fs in os.walk(d) for f in fs if f.startswith("shuffle_") and f.endswith(".data")}

    def run():
        index = similar.Index(similar.usable_vectors(data, 64), 5, 0.38, leaf=24)
        before = shuffled()
        rows = sorted(tuple(r) for r in index.neighbours().collect())
        return index, rows, sum(n for f, n in shuffled().items() if f not in before)

    monkeypatch.setattr(similar, "GROUP", 8, raising=False)
    _, whole, _ = run()
    monkeypatch.setattr(similar, "PASS", 1, raising=False)
    index, rows, left = run()
    assert index.visits > 20 and rows == whole and len(rows) > 1000
    assert left < 2 * 3000 * 64 * 4
    assert len(index._passes()[0]) > 4
