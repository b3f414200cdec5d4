"""Writes of the graph as new tables: upserts, deletions, changesets with
guards against degraded input, logs of operations. Every function returns the
table after the write; build() stores a graph atomically."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import EDGE_COLUMNS, NODE_COLUMNS

# A changeset that deletes this share of nodes, or of a kind of
# edges of at least so many, is refused.
MASS_DELETE, LEAST_EDGES = 0.8, 5


class Refused(ValueError):
    """A changeset that would delete too much."""


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of new replace those of old with the same key; of several new rows
    the last by their order column (_at, optional) wins, else the greatest."""
    cols = [c for c in old.columns]
    at = F.col("_at") if "_at" in new.columns else F.lit(0)
    last = new.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(at, *cols)).alias("r")).select("r.*")
    return old.join(last.select(key), key, "left_anti").unionByName(last)


def push_edges(old: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Upsert of edges; those with an end that is no node are dropped."""
    there = nodes.select("id").distinct()
    ok = new.join(there.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(there.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return upsert(old, ok.select(*old.columns))


def delete_repository(rows: DataFrame, repo: str, columns: tuple[str, ...] = ("id",)) -> DataFrame:
    """Rows without those whose id columns belong to a repository."""
    keep = F.lit(True)
    for c in columns:
        keep = keep & ~F.startswith(F.col(c), F.lit(repo + ":"))
    return rows.where(keep)


def delete_edges(edges: DataFrame, kind: str, repos: DataFrame | None = None) -> DataFrame:
    """Edges without those of one type, from the given repositories (repo_id)
    or from all."""
    gone = edges.where(F.col("type") == kind)
    if repos is not None:
        gone = gone.withColumn("repo_id", F.substring_index("source_id", ":", 1)).join(F.broadcast(repos.select("repo_id").distinct()), "repo_id", "left_semi")
    return edges.join(gone.select("id").distinct(), "id", "left_anti")


def set_resolved(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """Calls (id, ...) with resolved_id of the edge that resolves them (the
    least edge id); calls without an edge are cleared."""
    best = edges.where("type = 'RESOLVES_TO'").groupBy(F.col("source_id").alias("id")).agg(F.min_by("target_id", "id").alias("resolved_id"))
    return calls.drop("resolved_id").join(best, "id", "left")


def changeset(old: DataFrame, new: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """keys, change (add, update, delete) between two node tables, one row for
    each key, compared over the columns; null is a value."""
    keys = keys or ["id"]
    side = lambda df, p: df.groupBy(*keys).agg(F.max(F.xxhash64(*columns)).alias(p))
    j = side(old, "o").join(side(new, "n"), keys, "full_outer")
    return j.where(~F.col("o").eqNullSafe(F.col("n"))).select(*keys, F.when(F.col("o").isNull(), "add").when(F.col("n").isNull(), "delete").otherwise("update").alias("change"))


def changeset_guard(changes: DataFrame, old: DataFrame, by: list[str]) -> DataFrame:
    """by, n_old, n_deleted, refused: whether the deletions reach MASS_DELETE
    of what there was."""
    n = old.groupBy(*by).agg(F.count_distinct("id").alias("n_old"))
    d = changes.where("change = 'delete'").groupBy(*by).agg(F.count(F.lit(1)).alias("d"))
    j = n.join(d, by, "left").withColumn("n_deleted", F.coalesce("d", F.lit(0)).cast("long"))
    return j.select(*by, "n_old", "n_deleted", (F.col("n_deleted") >= MASS_DELETE * F.col("n_old")).alias("refused"))


def edge_guard(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """by, type, n_old, n_new, refused for kinds of edges, containment and
    links aside: refused where at least LEAST_EDGES shrink by MASS_DELETE."""
    count = lambda df, p: df.where("type not like 'CONTAINS_%' and type <> 'RESOLVES_TO'").groupBy(*by, "type").agg(F.count_distinct("id").alias(p))
    j = count(old, "n_old").join(count(new, "b"), [*by, "type"], "left").withColumn("n_new", F.coalesce("b", F.lit(0)).cast("long"))
    return j.select(*by, "type", "n_old", "n_new", ((F.col("n_old") >= LEAST_EDGES) & (F.col("n_old") - F.col("n_new") >= MASS_DELETE * F.col("n_old"))).alias("refused"))


def apply_changeset(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, deleted: DataFrame, new_edges: DataFrame, keep: tuple[str, ...] = ("RESOLVES_TO",)) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after a changeset: deleted nodes (id) go with every edge
    at them, changed nodes are replaced and lose the edges they are the source
    of, save those of the kept types, then the new edges are put in."""
    n = upsert(nodes.join(deleted.select("id").distinct(), "id", "left_anti"), new_nodes)
    touched = new_nodes.select("id").distinct()
    gone = deleted.select("id").distinct()
    e = edges.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    stale = e.join(touched.withColumnRenamed("id", "source_id"), "source_id", "left_semi").where(~F.col("type").isin(*keep))
    e = e.join(stale.select("id").distinct(), "id", "left_anti")
    return n, push_edges(e.select(*edges.columns), new_edges, n)


def latest_operations(log: DataFrame, keys: list[str], started: str, finished: str) -> DataFrame:
    """The latest completed operation of each key: keys, run_id, started."""
    done = log.where(F.col(finished).isNotNull() & (F.col("status") == "succeeded"))
    return done.groupBy(*keys).agg(F.max_by("run_id", F.struct(started, "run_id")).alias("run_id"), F.max(started).alias("started"))


def build(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Write a graph as nodes.parquet and edges.parquet (by type) under a new
    name beside folder, check the counts, then rename; a failed build leaves
    folder as it was."""
    spark = nodes.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    temp = f"{folder.rstrip('/')}.{uuid.uuid4().hex}"
    n, e = nodes.select("id", *[c for c in NODE_COLUMNS if c in nodes.columns]), edges.select("id", *EDGE_COLUMNS)
    n.write.parquet(f"{temp}/nodes.parquet")
    e.write.partitionBy("type").parquet(f"{temp}/edges.parquet")
    fs = path(temp).getFileSystem(spark._jsc.hadoopConfiguration())
    for name, df in (("nodes", n), ("edges", e)):
        got = spark.read.parquet(f"{temp}/{name}.parquet").count()
        if got != df.count():
            fs.delete(path(temp), True)
            raise Refused(f"{name}: {got} rows were written")
    if fs.exists(path(folder)):
        fs.delete(path(folder), True)
    if not fs.rename(path(temp), path(folder)):
        raise OSError(f"cannot rename {temp} to {folder}")
