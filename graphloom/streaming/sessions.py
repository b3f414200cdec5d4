"""Streams of tool calls: day counts, session rollups, deduplication, and the
per-session watermark. Each function takes a streaming table and gives one;
run() drains what there is and returns the result as a table.

State grows with the keys of the watermark's span; on a cluster set
spark.sql.streaming.stateStore.providerClass to the RocksDB provider, so that
it need not fit in memory."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..scale import Scratch


def open_stream(spark: SparkSession, path: str, ts: str = "ts") -> DataFrame:
    """A parquet table as a stream; the time column becomes an instant, as
    watermarks need."""
    schema = spark.read.parquet(path).schema
    # a pattern, as the source lists folders and not single files
    return spark.readStream.schema(schema).parquet(path[:-1] + "[" + path[-1] + "]").withColumn(ts, F.col(ts).cast("timestamp"))


def day_counts(calls: DataFrame, late: str = "1 day") -> DataFrame:
    """day, tool_name, n by tumbling UTC day."""
    w = calls.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "tool_name").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").cast("date").alias("day"), "tool_name", "n")


def session_counts(calls: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """user_id, first_ts, n_calls of runs of calls without a gap."""
    s = calls.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("first_ts"), F.count(F.lit(1)).alias("n_calls"))
    return s.select("user_id", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), "n_calls")


def distinct_calls(calls: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """Calls once for each key within the watermark."""
    return calls.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def acceptance_marks(calls: DataFrame) -> DataFrame:
    """tool_name, first_ts, last_ts: times of acceptance by scope; they only widen."""
    m = calls.groupBy("tool_name").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return m.select("tool_name", F.col("a").cast("timestamp_ntz").alias("first_ts"), F.col("b").cast("timestamp_ntz").alias("last_ts"))


def session_totals(records: DataFrame) -> DataFrame:
    """session_id, n_counted, n_dropped, mark from records (session_id, nanos,
    amount): a record at or below its session's mark was counted in an earlier
    batch and is dropped; one without a time (0) always counts. The mark is
    the greatest time of what was counted, kept for each session for ever."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark, counted, dropped = state.get if state.exists else (0, 0, 0)
        top = mark
        for pdf in batches:
            old = (pdf.nanos != 0) & (pdf.nanos <= mark)
            dropped += int(old.sum())
            counted += int((~old).sum())
            top = max(top, int(pdf.nanos.max()) if len(pdf) else top)
        state.update((top, counted, dropped))
        yield pd.DataFrame({"session_id": [key[0]], "n_counted": [counted], "n_dropped": [dropped], "mark": [top]})

    return records.groupBy("session_id").applyInPandasWithState(fold, "session_id string, n_counted long, n_dropped long, mark long", "mark long, counted long, dropped long", "update", GroupStateTimeout.NoTimeout)


def run(stream: DataFrame, keys: list[str], mode: str = "complete") -> DataFrame:
    """Drain a stream into tables, one for each batch, and read the result: in
    complete mode the last table, in append mode all, in update mode the last
    row of each key. A batch that is run again replaces its own table."""
    spark = stream.sparkSession
    scratch = Scratch(spark, "stream")

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{scratch.root}/out/{number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{scratch.root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    schema = stream.schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch.root}/out")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    rows = spark.read.parquet(f"{scratch.root}/out/*")
    if mode == "append":
        return rows.drop("_batch")
    if mode == "complete":
        last = rows.agg(F.max("_batch")).first()[0]
        return rows.where(F.col("_batch") == last).drop("_batch")
    cols = [c for c in schema.names if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), "_batch").alias("r")).select(*keys, "r.*")
