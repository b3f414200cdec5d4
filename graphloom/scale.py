"""Helpers that keep plans safe at scale: shared scratch tables, size-checked
broadcasts, joins that survive hot keys, dense numbering, seeded prefix sums."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of rows, and of bytes, that a size-checked broadcast may send.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
#: A key that holds more than one row in HOT_SHARE is hot; so at most HOT_SHARE keys are.
HOT_SHARE = 500
#: Setting that deletes the shuffle files of a statement when it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Parts of a hot key whose partner is too large to broadcast.
SALTS = 64


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir of the
    session. Only a local session without that setting gets a temporary one."""
    jsc = spark.sparkContext._jsc.sc()
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="graphloom-")
    atexit.register(shutil.rmtree, made, True)
    spark.sparkContext.setCheckpointDir("file://" + made)
    return "file://" + made


#: Folders that runs of this process made, by session application.
_MADE: dict[str, list[str]] = {}


def clean_scratch(spark: SparkSession) -> None:
    """Delete the scratch tables of all runs of this session so far; to be
    called when their results are stored, as a result reads them."""
    for root in _MADE.pop(spark.sparkContext.applicationId, []):
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Written tables of one run, under a random name in the shared folder. A
    written table survives the loss of executors, unlike cached blocks."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.made = 0
        _MADE.setdefault(spark.sparkContext.applicationId, []).append(self.root)

    def keep(self, df: DataFrame, by: str | None = None, free: bool = False) -> DataFrame:
        """Write df, in parts by a column if given, and return the written
        table; cuts the lineage. free: the shuffle files of the write are deleted
        at its end instead of whenever the driver collects its garbage."""
        self.made += 1
        path = f"{self.root}/{self.made}"
        out = df.write.option("compression", "zstd")
        before = self.spark.conf.get(FREE_SHUFFLES, "false")
        self.spark.conf.set(FREE_SHUFFLES, "true" if free else before)
        try:
            (out.partitionBy(by) if by else out).parquet(path)
        finally:
            self.spark.conf.set(FREE_SHUFFLES, before)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path = path
        return kept

    def drop(self, kept: DataFrame | None) -> None:
        """Delete a table that a later one has replaced."""
        if kept is not None and hasattr(kept, "_scratch_path"):
            jvm = self.spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(kept._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def row_count_up_to(df: DataFrame, limit: int) -> int:
    """Exact count when at most limit, else limit + 1."""
    return df.limit(limit + 1).count()


def _row_bytes(df: DataFrame) -> Column:
    """Bytes of a row as JSON text, a bound that needs no knowledge of types."""
    return F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most so many rows and bytes, told without counting
    more rows than that."""
    if row_count_up_to(df, rows) > rows:
        return False
    return (df.agg(F.sum(_row_bytes(df))).first()[0] or 0) <= size


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when df has at most limit rows, which are ids and
    numbers of bounded width; beyond that the planner shuffles (and splits
    skewed partitions). Tables with texts go through small() first."""
    return F.broadcast(df) if row_count_up_to(df, limit) <= limit else df


def hot_keys(df: DataFrame, keys: list[str], share: int = HOT_SHARE) -> DataFrame:
    """Keys that hold more than one row in share, counted exactly with map-side
    combining. There can be at most share of them."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = df.select(F.count(F.lit(1)).alias("_all"))
    return counts.join(F.broadcast(total), F.col("_n") * share > F.col("_all")).select(*keys)


def skew_join(many: DataFrame, one: DataFrame, keys: list[str], how: str = "inner", share: int = HOT_SHARE, rows: int | None = None) -> DataFrame:
    """Join many (any skew) with one (unique by keys), how inner or left.

    Rows of hot keys meet a broadcast of their partners, of which there are at
    most share by construction; all other rows take a shuffled join. Null keys
    match nothing and, for left, stay in the result. Where many is known to have
    few rows (rows), no key of it can be too hot and a plain join does."""
    spark = many.sparkSession
    if rows is not None and rows <= BROADCAST_ROWS:
        return many.join(one, keys, how)
    found = hot_keys(many.dropna(subset=keys), keys, share).collect()
    if not found:
        return many.join(one, keys, how)
    hot = F.broadcast(spark.createDataFrame(found, many.select(*keys).schema))
    marked = many.join(hot.withColumn("_hot", F.lit(True)), keys, "left")
    cols = [*many.columns, *[c for c in one.columns if c not in keys]]
    few = one.join(hot, keys, "left_semi")
    if small(few):
        a = marked.where("_hot").drop("_hot").join(F.broadcast(few), keys, how).select(*cols)
    else:
        # partners too large to send: a hot key is spread over salts, its one partner repeated for each
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
        spread = marked.where("_hot").drop("_hot").withColumn("_salt", salted([c for c in many.columns], SALTS).cast("int"))
        a = spread.join(few.select("*", salts), [*keys, "_salt"], how).select(*cols)
    b = marked.where("_hot is null").drop("_hot").join(one, keys, how).select(*cols)
    return a.unionByName(b)


def number_rows(df: DataFrame, order: list[str], scratch: Scratch, name: str = "n", partitions: int | None = None) -> DataFrame:
    """Dense numbers from 0 in the given order, without a single-task sort:
    range-partition, sort and write, then add each partition's offset. The
    driver sees one count per partition."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    low = F.lit((1 << 33) - 1)
    written = scratch.keep(ranged.withColumn("_pid", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(low)))
    sizes = dict(written.groupBy("_pid").count().collect())
    at, offsets = 0, []
    for pid in sorted(sizes):
        offsets.append((pid, at))
        at += sizes[pid]
    table = F.broadcast(df.sparkSession.createDataFrame(offsets or [(0, 0)], "_pid int, _off long"))
    return written.join(table, "_pid").withColumn(name, F.col("_pos") + F.col("_off")).drop("_pid", "_pos", "_off")


def salted(keys: list[str], salts: int) -> Column:
    """A salt that spreads one key over several tasks, the same for equal rows."""
    return F.pmod(F.xxhash64(*keys), F.lit(salts))


def prefix_sums(df: DataFrame, group: str, order: list[str], value: str, scratch: Scratch, name: str = "before", partitions: int | None = None) -> DataFrame:
    """For each row the sum of value over the rows before it in its group, in
    the given order. Rows are range-partitioned by group and order and summed
    within partitions; the driver sees one total for each partition and group
    in it, so no group is held by one task."""
    import pandas as pd
    from pyspark import TaskContext

    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]

    def run(batches):
        at: dict = {}
        pid = TaskContext.get().partitionId()
        for pdf in batches:
            for g, part in pdf.groupby(group, sort=False, dropna=False):
                g = None if pd.isna(g) else g
                sums = part[value].cumsum()
                yield part.assign(_local=sums - part[value] + at.get(g, 0), _pid=pid)
                at[g] = at.get(g, 0) + int(sums.iloc[-1])
        if False:
            yield pd.DataFrame()

    kept = scratch.keep(ranged.mapInPandas(run, ", ".join([*fields, "_local long", "_pid int"])))
    totals = kept.groupBy(group, "_pid").agg(F.sum(value).alias("t")).orderBy(group, "_pid").collect()
    at, offsets = {}, []
    for g, pid, t in totals:
        offsets.append((g, pid, at.get(g, 0)))
        at[g] = at.get(g, 0) + t
    kind = df.schema[group].dataType.simpleString()
    table = F.broadcast(df.sparkSession.createDataFrame(offsets, f"_g {kind}, _p int, _off long"))
    met = kept.join(table, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_pid") == F.col("_p")))
    return met.withColumn(name, F.col("_local") + F.col("_off")).drop("_local", "_off", "_pid", "_g", "_p")
