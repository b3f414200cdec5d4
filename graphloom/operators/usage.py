"""Usage of tools and sessions over time: rates, windows, day series, level
series, session rollups, members. Rates of nothing are null, never zero, where
a reader must tell unknown from none. Days are UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def inside(ts: Column, start: str, end: str) -> Column:
    """Whether a time lies in the half-open window [start, end)."""
    return (ts >= F.lit(start).cast("timestamp_ntz")) & (ts < F.lit(end).cast("timestamp_ntz"))


def day_of(ts: Column) -> Column:
    """UTC day of a time."""
    return ts.cast("date")


def tool_stats(calls: DataFrame, start: str, end: str, exclude_prefix: str = "rest:") -> DataFrame:
    """tool_name, n_calls, error_rate, mean_ms of the window; tools under the
    excluded prefix do not count, null names are no tools."""
    c = calls.where(inside(F.col("ts"), start, end) & F.col("tool_name").isNotNull() & ~F.startswith(F.col("tool_name"), F.lit(exclude_prefix)))
    return c.groupBy("tool_name").agg(F.count(F.lit(1)).alias("n_calls"), (F.count_if(~F.col("success")) / F.count(F.lit(1))).alias("error_rate"), F.round(F.avg("duration_ms"), 6).alias("mean_ms"))


def empty_rates(calls: DataFrame) -> DataFrame:
    """tool_name, n_counted, empty_rate: calls without a result count leave
    both sides of the rate."""
    c = calls.where("result_count is not null and tool_name is not null")
    return c.groupBy("tool_name").agg(F.count(F.lit(1)).alias("n_counted"), (F.count_if(F.col("result_count") == 0) / F.count(F.lit(1))).alias("empty_rate"))


def empty_percent(calls: DataFrame) -> DataFrame:
    """Empty results in percent of one digit, half up; highest first."""
    r = empty_rates(calls)
    return r.select("tool_name", "n_counted", (F.floor(F.col("empty_rate") * 1000 + 0.5) / 10).alias("empty_pct")).orderBy(F.desc("empty_pct"), "tool_name")


def recent(rows: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """The n newest rows, equal times by the greater key."""
    return rows.orderBy(F.desc(by), F.desc(key)).limit(n)


def session_rollup(calls: DataFrame, gap: str = "30 minutes", closed_before: str | None = None) -> DataFrame:
    """user_id, first_ts, n_calls, n_tools, n_errors, sum_ms, mean_ms of each
    run of calls without a gap; with closed_before only sessions whose last
    call and gap lie before it, so that none is claimed while it may grow."""
    s = calls.where("user_id is not null").groupBy("user_id", F.session_window("ts", gap).alias("w"))
    out = s.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_calls"), F.count_distinct("tool_name").alias("n_tools"), F.count_if(~F.col("success")).alias("n_errors"), F.round(F.sum("duration_ms"), 4).alias("sum_ms"), F.round(F.avg("duration_ms"), 6).alias("mean_ms"))
    if closed_before:
        # told by the aggregate: a filter on the window's end would be pushed below it and cut sessions short
        out = out.where(F.col("last_ts") + F.expr(f"interval {gap}") <= F.lit(closed_before).cast(dict(calls.dtypes)["ts"]))
    return out.drop("w")


def latest_per(rows: DataFrame, key: str, by: Column, columns: tuple[str, ...]) -> DataFrame:
    """The newest row of each key, in one aggregate without a sort."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), by).alias("r")).select(key, "r.*")


def days(spark, first: str, n: int) -> DataFrame:
    """The n days from first."""
    d = F.lit(first).cast("date")
    return spark.range(1).select(F.explode(F.sequence(d, F.date_add(d, n - 1))).alias("day"))


def flow_series(rows: DataFrame, ts: str, first: str, n: int) -> DataFrame:
    """day, n_rows for exactly n days from first, zero where none."""
    counts = rows.groupBy(day_of(F.col(ts)).alias("day")).agg(F.count(F.lit(1)).alias("c"))
    return days(rows.sparkSession, first, n).join(counts, "day", "left").select("day", F.coalesce("c", F.lit(0)).cast("long").alias("n_rows"))


def level_series(rows: DataFrame, key: str, ts: str, order: str, value: str, first: str, n: int) -> DataFrame:
    """day, level for exactly n days from first: the sum over all keys of the
    newest value at the end of that day, carried forward from before the
    window. Each key's level is turned into day changes, which add up; so no
    calendar is crossed with the keys."""
    daily = rows.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).groupBy(key, day_of(F.col(ts)).alias("day")).agg(F.max_by(value, F.struct(ts, order)).alias("v"))
    last = F.date_add(F.lit(first).cast("date"), n - 1)
    w = Window.partitionBy(key).orderBy("day")
    moved = daily.where(F.col("day") <= last).withColumn("change", F.coalesce("v", F.lit(0.0)) - F.coalesce(F.lag("v").over(w), F.lit(0.0)))
    by_day = moved.groupBy(F.greatest("day", F.lit(first).cast("date")).alias("day")).agg(F.sum("change").alias("change"))
    # n rows at most from here on
    return days(rows.sparkSession, first, n).join(by_day, "day", "left").select("day", F.round(F.sum(F.coalesce("change", F.lit(0.0))).over(Window.orderBy("day")), 2).alias("level"))


def window_bounds(now: Column, n: int) -> tuple[Column, Column, Column]:
    """Starts of the previous and the present window of n whole days that end
    with the day of now, and the end (the next midnight)."""
    end = F.date_add(day_of(now), 1)
    return F.date_sub(end, 2 * n), F.date_sub(end, n), end


def compare_windows(rows: DataFrame, key: str, ts: str, value: str, now: str, n: int) -> DataFrame:
    """key, present, previous, change: sums of value over the last n days and
    the n before; change is null without a previous window."""
    a, b, c = window_bounds(F.lit(now).cast("timestamp_ntz"), n)
    day = day_of(F.col(ts))
    x = rows.where((day >= a) & (day < c)).groupBy(key).agg(F.round(F.sum(F.when(day >= b, F.col(value))), 4).alias("present"), F.round(F.sum(F.when(day < b, F.col(value))), 4).alias("previous"))
    return x.withColumn("change", F.round(F.try_divide(F.coalesce("present", F.lit(0.0)) - F.col("previous"), F.col("previous")), 6))


def merge_tools(stats: DataFrame, rates: DataFrame) -> DataFrame:
    """Tool rows with their empty rate, null where it is not known; most calls
    first, then by name."""
    return stats.join(rates.select("tool_name", "empty_rate"), "tool_name", "left").orderBy(F.desc("n_calls"), "tool_name")


def known_sum(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sum of the known values: null when none is known, with n_rows, n_known."""
    return rows.groupBy(*keys).agg(F.round(F.sum(value), 4).alias("total"), F.count(F.lit(1)).alias("n_rows"), F.count(value).alias("n_known"))


def value_series(rows: DataFrame, ts: str, value: str, first: str, n: int) -> DataFrame:
    """day, total: 0 on a day without rows, null on a day whose values are all unknown."""
    s = known_sum(rows.select(day_of(F.col(ts)).alias("day"), value), ["day"], value)
    return days(rows.sparkSession, first, n).join(s, "day", "left").select("day", F.when(F.col("n_rows").isNull(), 0.0).otherwise(F.col("total")).alias("total"))


def adoption(calls: DataFrame, key: str) -> DataFrame:
    """key, n_calls, error_rate and mean_ms weighted by calls, median_ms (exact)."""
    per = calls.groupBy(key, "tool_name").agg(F.count(F.lit(1)).alias("n"), F.avg("duration_ms").alias("m"), F.avg(F.when(F.col("success"), 0.0).otherwise(1.0)).alias("e"))
    weighted = per.groupBy(key).agg(F.sum("n").alias("n_calls"), F.round(F.sum(F.col("e") * F.col("n")) / F.sum("n"), 6).alias("error_rate"), F.round(F.sum(F.col("m") * F.col("n")) / F.sum("n"), 4).alias("mean_ms"))
    return weighted.join(calls.groupBy(key).agg(F.round(F.median("duration_ms"), 4).alias("median_ms")), key)


def members(sessions: DataFrame, calls: DataFrame) -> DataFrame:
    """One row for each user of either side: user_id, n_sessions, n_calls,
    top_tool (most calls, then the first name), last_active."""
    s = sessions.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.max("last_ts").alias("s_last"))
    per = calls.groupBy("user_id", "tool_name").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("t"))
    # the least of (-n, name) is the most called, first by name
    c = per.groupBy("user_id").agg(F.sum("n").alias("n_calls"), F.min(F.struct(-F.col("n"), F.col("tool_name"))).alias("top"), F.max("t").alias("c_last"))
    return s.join(c, "user_id", "full_outer").select("user_id", F.coalesce("n_sessions", F.lit(0)).cast("long").alias("n_sessions"), F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"), F.col("top.tool_name").alias("top_tool"), F.greatest("s_last", "c_last").alias("last_active"))


def session_summary(sessions: DataFrame, heavy: int) -> DataFrame:
    """segment (heavy from so many calls on, light), n, median_calls, median_ms."""
    return sessions.groupBy(F.when(F.col("n_calls") >= heavy, "heavy").otherwise("light").alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.median("n_calls").alias("median_calls"), F.round(F.median("sum_ms"), 4).alias("median_ms"))


def retained(rows: DataFrame, ts: str, now: str, keep_days: int) -> DataFrame:
    """Rows not older than keep_days before now; null times are kept."""
    return rows.where(F.col(ts).isNull() | (F.col(ts) >= F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {int(keep_days)} days")))


def merge_watermarks(old: DataFrame, rows: DataFrame, key: str, ts: str) -> DataFrame:
    """Upsert of the least and greatest time of each key: a mark only widens."""
    new = rows.groupBy(key).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    return old.unionByName(new).groupBy(key).agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def tally(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by keys, most first, then by key."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *keys)


def json_items(rows: DataFrame, key: list[str], json: str, path: str) -> DataFrame:
    """Elements of a JSON array with their ordinal from 1: key, ordinality, item."""
    items = F.from_json(F.get_json_object(json, path), "array<string>")
    return rows.select(*key, F.posexplode(items).alias("p", "item")).select(*key, (F.col("p") + 1).alias("ordinality"), "item")


def ranked_issues(items: DataFrame, keys: list[str], weight: str, top: int) -> DataFrame:
    """Grouped items by the sum of their weight, then their number, top n."""
    return items.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(weight).cast("long").alias("severity")).orderBy(F.desc("severity"), F.desc("n"), *keys).limit(top)


def monthly_means(rows: DataFrame, ts: str, a: str, b: str) -> DataFrame:
    """month, mean_a, mean_b: two independent means, null where unrated."""
    return rows.groupBy(F.date_format(ts, "yyyy-MM").alias("month")).agg(F.round(F.avg(a), 6).alias("mean_a"), F.round(F.avg(b), 6).alias("mean_b"))


def offset_page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page of an ordered list."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def keyset_page(rows: DataFrame, ts: str, key: str, after: tuple[str, int], limit: int) -> DataFrame:
    """The page after (time, key), by row comparison, newest first."""
    t = F.lit(after[0]).cast(dict(rows.dtypes)[ts])
    return rows.where((F.col(ts) < t) | ((F.col(ts) == t) & (F.col(key) < after[1]))).orderBy(F.desc(ts), F.desc(key)).limit(limit)
