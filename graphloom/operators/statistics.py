"""Medians, intervals and comparisons: delivery times, paired arms, pairwise
standings, percentiles, path precision and recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import suffix_match


def interval_median(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """keys, median_days, n: negative and unknown intervals leave the sample."""
    span = F.date_diff(end, start)
    kept = F.when(span >= 0, span)
    return rows.groupBy(*keys).agg(F.median(kept).alias("median_days"), F.count(kept).alias("n"))


def stage_time(rows: DataFrame, task: str, stage: str, occurrence: list[str], span: Column) -> DataFrame:
    """stage, n_tasks, median: repeats of an occurrence count once, spans add
    up for each task and stage, then the median over tasks."""
    once = rows.select(task, stage, *occurrence, span.alias("_span")).groupBy(task, stage, *occurrence).agg(F.max("_span").alias("_span"))
    per = once.groupBy(task, stage).agg(F.sum("_span").alias("_sum"))
    return per.groupBy(stage).agg(F.count(F.lit(1)).alias("n_tasks"), F.median("_sum").alias("median_span"))


def filled_counts(rows: DataFrame, key: str, words: list[str]) -> DataFrame:
    """Counts for every word of a fixed vocabulary, zero where none."""
    v = rows.sparkSession.createDataFrame([(w,) for w in words], f"`{key}` string")
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    return v.join(counts, key, "left").select(key, F.coalesce("c", F.lit(0)).cast("long").alias("n"))


def median_or_zero(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """median (0 on an empty or all-null group) and spread (greatest - least)."""
    return rows.groupBy(*keys).agg(F.round(F.coalesce(F.median(value), F.lit(0.0)), 6).alias("median"), F.round(F.coalesce(F.max(value) - F.min(value), F.lit(0.0)), 6).alias("spread"))


def paired_arms(runs: DataFrame, cell: list[str], run: str, arm: str, score: str, a: str, b: str) -> DataFrame:
    """For every cell with both arms in a run: mean difference b - a over its
    runs, and wins, ties and losses of b."""
    p = runs.groupBy(*cell, run).agg(F.max(F.when(F.col(arm) == a, F.col(score))).alias("x"), F.max(F.when(F.col(arm) == b, F.col(score))).alias("y")).where("x is not null and y is not null")
    diff = F.col("y") - F.col("x")
    return p.groupBy(*cell).agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg(diff), 6).alias("mean_diff"), F.round(F.median(diff), 6).alias("median_diff"), F.count_if(diff > 0).alias("wins"), F.count_if(diff == 0).alias("ties"), F.count_if(diff < 0).alias("losses"))


def standings(verdicts: DataFrame) -> DataFrame:
    """arm, n, win_rate ((wins + ties / 2) / n) from left, right, winner;
    verdicts that name neither arm nor tie are invalid and leave the count."""
    ok = verdicts.where((F.col("winner") == F.col("left")) | (F.col("winner") == F.col("right")) | (F.col("winner") == "tie"))
    sides = F.explode(F.array("left", "right")).alias("arm")
    point = F.when(F.col("winner") == F.col("arm"), 1.0).when(F.col("winner") == "tie", 0.5).otherwise(0.0)
    return ok.select(sides, "winner").groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(point), 6).alias("win_rate"))


def head_to_head(verdicts: DataFrame) -> DataFrame:
    """a, b (a before b by name), wins_a, ties, wins_b."""
    a, b = F.least("left", "right"), F.greatest("left", "right")
    v = verdicts.select(a.alias("a"), b.alias("b"), "winner")
    return v.groupBy("a", "b").agg(F.count_if(F.col("winner") == F.col("a")).alias("wins_a"), F.count_if(F.col("winner") == "tie").alias("ties"), F.count_if(F.col("winner") == F.col("b")).alias("wins_b"))


def nearest_rank(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """p50 and p95 by nearest rank: the element at ceil(f * n), to 2 digits."""
    at = lambda f: F.round(F.expr(f"percentile_disc({f}) within group (order by `{value}`)"), 2)
    return rows.groupBy(*keys).agg(at(0.5).alias("p50"), at(0.95).alias("p95"), F.count(value).alias("n"))


def path_scores(found: DataFrame, truth: DataFrame, case: str) -> DataFrame:
    """case, precision, recall, f1 of file paths under suffix matching; a case
    without truth scores 0. Both tables: case, path; repeats count once. Pairs
    arise only between paths of one case with one file name."""
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    f = found.select(case, F.col("path").alias("f")).distinct()
    t = truth.select(case, F.col("path").alias("t")).distinct()
    met = f.withColumn("k", name(F.col("f"))).join(t.withColumn("k", name(F.col("t"))), [case, "k"]).where(suffix_match(F.col("f"), F.col("t")))
    n = f.groupBy(case).agg(F.count(F.lit(1)).alias("n_f")).join(t.groupBy(case).agg(F.count(F.lit(1)).alias("n_t")), case, "full_outer")
    hits = met.groupBy(case).agg(F.count_distinct("f").alias("h_f"), F.count_distinct("t").alias("h_t"))
    p, r = F.coalesce(F.col("h_f") / F.col("n_f"), F.lit(0.0)), F.coalesce(F.col("h_t") / F.col("n_t"), F.lit(0.0))
    out = n.join(hits, case, "left").select(case, p.alias("p"), r.alias("r"))
    return out.select(case, F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)), 6).alias("f1"))


def truth_score(rows: DataFrame, case: str, required: Column, forbidden: Column, present: Column) -> DataFrame:
    """case, score: 100 times the share of required facts present times one
    less the share of forbidden ones present, rounded half up."""
    cover = F.coalesce(F.try_divide(F.count_if(required & present), F.count_if(required)), F.lit(0.0))
    bad = F.coalesce(F.try_divide(F.count_if(forbidden & present), F.count_if(forbidden)), F.lit(0.0))
    return rows.groupBy(case).agg(F.floor(100 * cover * (1 - bad) + 0.5).cast("long").alias("score"))


def tool_gaps(calls: DataFrame, fallbacks: DataFrame) -> DataFrame:
    """tool_name, n_calls, n_empty, n_fallback over the union of both sides."""
    c = calls.groupBy("tool_name").agg(F.count(F.lit(1)).alias("a"), F.count_if(F.col("result_count") == 0).alias("b"))
    f = fallbacks.groupBy("tool_name").agg(F.count(F.lit(1)).alias("c"))
    z = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    return c.join(f, "tool_name", "full_outer").select("tool_name", z("a").alias("n_calls"), z("b").alias("n_empty"), z("c").alias("n_fallback"))


def linked_runs(a: DataFrame, b: DataFrame, task: str, run: str) -> DataFrame:
    """task, n_runs: distinct runs over two link tables."""
    return a.select(task, run).union(b.select(task, run)).groupBy(task).agg(F.count_distinct(run).alias("n_runs"))
