"""Reads over intent records: word search, release folds, conditions, anchors
and their evidence, rollups of the feature tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import skew_join

#: Endings that a word loses to stand for its stem.
_ENDINGS = r"(?:ations?|ings?|edly|ed|es|s|ly)$"


def words_in(columns: list[str], words: list[str]) -> list[Column]:
    """For each word whether some column holds it, case aside."""
    text = F.lower(F.concat_ws("\u0001", *columns))
    return [F.contains(text, F.lit(w.lower())) for w in words]


def lexical(rows: DataFrame, key: str, columns: list[str], query: str) -> DataFrame:
    """key, mode: rows that hold all words of the query; only where there is
    no such row, those that hold any."""
    hits = words_in(columns, query.split())
    every, some = F.lit(True), F.lit(False)
    for h in hits:
        every, some = every & h, some | h
    m = rows.select(key, every.alias("every"), some.alias("some")).where("some")
    has = m.agg(F.coalesce(F.bool_or("every"), F.lit(False)).alias("has"))
    return m.crossJoin(F.broadcast(has)).where("every or not has").select(key, F.when(F.col("has"), "all").otherwise("any").alias("mode")).distinct()


def stems(text: Column) -> Column:
    """Distinct stems of a text: words of three or more letters, split at a
    change of case, without case and common endings."""
    split = F.lower(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2"))
    found = F.filter(F.split(split, r"[^a-z]+"), lambda w: F.length(w) >= 3)
    return F.array_distinct(F.transform(found, lambda w: F.regexp_replace(w, _ENDINGS, "")))


def task_matches(rows: DataFrame, key: str, title: str, body: str, task: str, least: int = 2, limit: int = 50) -> DataFrame:
    """key, n_shared, rank of rows that share at least least stems with the
    task; a stem in the title weighs double. Highest rank first, then key."""
    spark = rows.sparkSession
    want = spark.range(1).select(stems(F.lit(task)).alias("want"))
    r = rows.select(key, stems(F.coalesce(F.col(title), F.lit(""))).alias("t"), stems(F.coalesce(F.col(body), F.lit(""))).alias("b")).crossJoin(F.broadcast(want))
    shared = F.size(F.array_union(F.array_intersect("t", "want"), F.array_intersect("b", "want")))
    r = r.select(key, shared.cast("long").alias("n_shared"), (F.size(F.array_intersect("t", "want")) + shared).cast("long").alias("rank"))
    return r.where(F.col("n_shared") >= least).orderBy(F.desc("rank"), key).limit(limit)


def release_fold(events: DataFrame) -> DataFrame:
    """workspace_id, item, state, seq: what the newest release or plan says of
    every item: delivered by a baseline or release, planned by a plan. Releases
    that a later rollback names do not count; of rows with one (workspace, seq)
    the last loaded counts, which corrects the others."""
    kind = lambda k: F.col("kind").isin(*k)
    e = events.where("workspace_id is not null and seq is not null").groupBy("workspace_id", "seq").agg(F.max_by(F.struct("kind", "data"), F.struct("loaded_at", "request_hash", "kind", "data")).alias("r")).select("workspace_id", "seq", "r.*")
    undone = e.where(kind(["rollback"])).select("workspace_id", F.get_json_object("data", "$.releaseSeq").cast("int").alias("seq")).distinct()
    live = e.where(kind(["baseline", "release", "plan"])).join(undone, ["workspace_id", "seq"], "left_anti")
    items = live.select("workspace_id", "seq", F.when(kind(["plan"]), "planned").otherwise("delivered").alias("state"), F.explode(F.from_json(F.get_json_object("data", "$.included"), "array<string>")).alias("item"))
    return items.groupBy("workspace_id", "item").agg(F.max_by("state", "seq").alias("state"), F.max("seq").alias("seq"))


def condition_state(conditions: Column, context: dict[str, list[str]]) -> Column:
    """match, open, excluded or unevaluated of a JSON list of conditions: a
    dimension the context does not name is open, one without a common value
    excludes, a condition without a dimension cannot be evaluated. Excluded
    comes before unevaluated, that before open; null and empty match."""
    c = F.from_json(conditions, "array<struct<dimension: string, values: array<string>>>")
    known = F.create_map(*[x for k, v in context.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]))])
    truth = F.transform(c, lambda x: F.when(x["dimension"].isNull(), "unevaluated").when(known[x["dimension"]].isNull(), "open").when(F.arrays_overlap(known[x["dimension"]], x["values"]), "match").otherwise("excluded"))
    has = lambda w: F.coalesce(F.array_contains(truth, w), F.lit(False))
    return F.when(has("excluded"), "excluded").when(has("unevaluated"), "unevaluated").when(has("open"), "open").otherwise("match")


def rollup_counts(parts: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """key and one count column for each named part, zero where it has none."""
    both = None
    for name, df in parts:
        one = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(name))
        both = one if both is None else both.unionByName(one)
    return both.groupBy(key).agg(*[F.coalesce(F.sum(F.when(F.col("part") == n, F.col("n"))), F.lit(0)).cast("long").alias(f"n_{n}") for n, _ in parts])


def anchor_evidence(anchors: DataFrame, nodes: DataFrame) -> DataFrame:
    """anchor_id, evidence: fresh (the node is there as captured), stale (as
    another version), mismatch (as another type), absent. anchors: id, node_id,
    node_type, version. nodes: id, type, version."""
    a = anchors.where("id is not null and node_id is not null").groupBy("id").agg(F.min(F.struct("node_id", "node_type", "version")).alias("r")).select(F.col("id").alias("anchor_id"), "r.*")
    n = nodes.where("id is not null").groupBy(F.col("id").alias("node_id")).agg(F.min("type").alias("type"), F.min("version").alias("now"))
    j = skew_join(a, n, ["node_id"], "left")
    return j.select("anchor_id", F.when(F.col("type").isNull(), "absent").when(F.col("type") != F.col("node_type"), "mismatch").when(F.col("now").eqNullSafe(F.col("version")), "fresh").otherwise("stale").alias("evidence"))


def resolve_anchors(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """address, node_id, state: a path or path#name that exactly one node bears
    is resolved, none unresolved, several ambiguous."""
    n = nodes.where("file_path is not null").select("id", F.when(F.col("type") == "file", F.col("file_path")).otherwise(F.concat("file_path", F.lit("#"), "name")).alias("address")).distinct()
    hits = n.groupBy("address").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("i"))
    j = wanted.select("address").distinct().join(hits, "address", "left")
    return j.select("address", F.when(F.col("n") == 1, F.col("i")).alias("node_id"), F.when(F.col("n").isNull(), "unresolved").when(F.col("n") == 1, "resolved").otherwise("ambiguous").alias("state"))


def overlapping_variants(rows: DataFrame, group: str, key: str, dimension: str, value: str) -> DataFrame:
    """Pairs of variants of one group that share a value in a dimension: group,
    dimension, value, n_variants, first, last (least and greatest key). Whoever
    shares a value is named once for the value, not pair by pair."""
    return rows.where(F.col(value).isNotNull()).groupBy(group, dimension, value).agg(F.count_distinct(key).alias("n_variants"), F.min(key).alias("first"), F.max(key).alias("last")).where("n_variants > 1")
