"""Processing only new or changed records, by a ledger of work items.

A work item is one version of one record. It is pending, leased or done. A
lease carries a fencing token that grows; work is done only when the token of
its completion is the newest that was leased, so a stale writer changes
nothing. An expired lease is pending again. Every write goes to a path made
from its token, so a retry replaces what it wrote before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scale import skew_join

KEY = ["feed", "workspace_id", "record_key"]


def feed_items(rows: DataFrame, feed: str, record_key: Column, newest_by: Column, version: Column) -> DataFrame:
    """The rows of a feed as versions of work items: feed, workspace_id,
    record_key, at (what the newest is told by), loaded_at, version (null is
    a value). Rows without workspace or key are no records."""
    return rows.select(
        F.lit(feed).alias("feed"),
        "workspace_id",
        record_key.cast("string").alias("record_key"),
        newest_by.alias("at"),
        "loaded_at",
        version.alias("version"),
    ).where("workspace_id is not null and record_key is not null")


def fold(log: DataFrame, keys: list[str]) -> DataFrame:
    """The log by item or scope: keys, fence (newest token leased), expires and
    owner of that lease, done_fence (newest token completed), and free_fence
    (newest token given back). Rows of the log: keys, kind (lease, done, free),
    fence, owner, expires. Folding a folded log again changes nothing."""
    of = lambda k: F.when(F.col("kind") == k, F.col("fence"))
    return log.groupBy(*keys).agg(
        F.max(of("lease")).alias("fence"),
        F.max_by(F.struct("expires", "owner"), of("lease")).alias("held"),
        F.max(of("done")).alias("done_fence"),
        F.max(of("free")).alias("free_fence"),
    ).select(*keys, "fence", "held.expires", "held.owner", "done_fence", "free_fence")


def run_log(runs: DataFrame) -> DataFrame:
    """Recorded runs as ledger rows of their scope (workspace_id, feed). A run
    leases what was loaded by its cut; the instant of the cut is its fencing
    token, as a later cut covers all that an earlier one does. A succeeded run
    completes its lease, a failed or cancelled one gives it back, a running one
    holds it. Runs without cut, workspace or feed lease nothing."""
    fence = F.unix_micros(F.col("cut_at").cast("timestamp"))
    kinds = F.array(F.lit("lease"), F.when(F.col("status") == "succeeded", "done").when(F.col("status") != "running", "free"))
    r = runs.dropna(subset=["workspace_id", "feed", "cut_at"]).select("workspace_id", "feed", fence.alias("fence"), F.col("run_id").cast("string").alias("owner"), F.lit(None).cast("timestamp").alias("expires"), F.explode(F.array_compact(kinds)).alias("kind"))
    return r.distinct()


def replay(items: DataFrame, runs: DataFrame) -> DataFrame:
    """State of every record after the recorded runs: KEY, state, version.

    The runs enter the ledger (run_log) and the ledger is folded: the newest
    completed token fences all earlier ones. A record is done if its newest
    version equals the newest of the versions that token covers; else it is
    leased while a newer token is held that covers it, otherwise pending. Equal
    times are told apart by loaded_at, then by the version. Rows never loaded
    (null) are covered by no token. A row with a null time is older than any
    other."""
    known = skew_join(items, fold(run_log(runs), ["workspace_id", "feed"]), ["workspace_id", "feed"], "left")
    order = F.struct(F.col("at").isNotNull(), "at", F.col("loaded_at").isNotNull(), "loaded_at", "version")
    wrapped = F.struct("version")
    loaded = F.unix_micros(F.col("loaded_at").cast("timestamp"))
    done = loaded <= F.col("done_fence")
    held = (F.col("fence") > F.coalesce("done_fence", F.lit(-(1 << 62)))) & (F.col("fence") > F.coalesce("free_fence", F.lit(-(1 << 62)))) & (loaded <= F.col("fence"))
    folded = known.groupBy(*KEY).agg(
        F.max_by(wrapped, order).alias("newest"),
        F.max_by(F.when(done, wrapped), F.when(done, order)).alias("seen"),
        F.bool_or(F.coalesce(held, F.lit(False))).alias("held"),
    )
    is_done = F.col("seen").isNotNull() & F.col("newest").eqNullSafe(F.col("seen"))
    return folded.select(*KEY, F.when(is_done, "done").when(F.col("held"), "leased").otherwise("pending").alias("state"), F.col("newest.version").alias("version"))


def release_items(events: DataFrame) -> DataFrame:
    """Work items of the release log: one record for each workspace and seq."""
    return feed_items(events, "release_events", F.col("seq"), F.col("loaded_at"), F.col("request_hash"))


def repo_state_items(states: DataFrame) -> DataFrame:
    """Work items of the repository states. The version is the parse hash and
    the instant of the push, so one instant spelled with another offset is the
    same version; a text that is no time stands for itself."""
    instant = F.col("last_pushed_at").try_cast("timestamp")
    pushed = F.coalesce(F.unix_micros(instant).cast("string"), F.col("last_pushed_at"))
    return feed_items(states, "repo_states", F.col("repo_key"), F.col("observed_at"), F.to_json(F.struct(F.col("last_parse_hash").alias("h"), pushed.alias("p"))))


class LedgerStore:
    """The ledger as files: a log of leases and completions under one folder.

    lease() claims pending items under a new fencing token, complete() marks
    them done, state() folds the log, published() gives the outputs of winning
    tokens only. The token is the name of a file that can be created once only,
    so two workers never share one. A batch is read from what its lease wrote,
    never from a second evaluation of the plan."""

    LOG = "item string, kind string, fence long, owner string, expires timestamp"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda x: path(f"{self.folder}/{x}")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, sub: str) -> list[str]:
        """Finished tables below a folder, by name."""
        if not self._fs.exists(self._path(sub)):
            return []
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(sub)))
        return [n for n in names if self._fs.exists(self._path(f"{sub}/{n}/_SUCCESS"))]

    def _next_fence(self) -> int:
        self._fs.mkdirs(self._path("fence"))
        n = max([int(s.getPath().getName()) for s in self._fs.listStatus(self._path("fence"))], default=0) + 1
        while True:
            try:
                self._fs.create(self._path(f"fence/{n}"), False).close()
                return n
            except Exception:
                if not self._fs.exists(self._path(f"fence/{n}")):
                    raise
                n += 1

    def _log(self) -> DataFrame:
        whole = [f"{self.folder}/log/{n}" for n in self._names("log")]
        return self.spark.read.schema(self.LOG).parquet(*whole) if whole else self.spark.createDataFrame([], self.LOG)

    def state(self, items: DataFrame, now: str) -> DataFrame:
        """item, state, fence for every item (distinct, null is none)."""
        state = F.when(F.col("done_fence") == F.col("fence"), "done").when((F.col("expires") > F.lit(now).cast("timestamp")) & ~F.coalesce(F.col("free_fence") == F.col("fence"), F.lit(False)), "leased").otherwise("pending")
        return items.where("item is not null").select("item").distinct().join(fold(self._log(), ["item"]), "item", "left").select("item", state.alias("state"), "fence")

    def lease(self, items: DataFrame, owner: str, now: str, until: str) -> tuple[int, DataFrame]:
        """Claim all pending items; returns the token and the claimed items.

        Two workers may claim at once: then the item belongs to the greater
        token, and the other's completion is rejected by the fold."""
        fence = self._next_fence()
        path = f"{self.folder}/log/{fence:020d}-lease"
        claim = self.state(items, now).where("state = 'pending'").select("item", F.lit("lease").alias("kind"), F.lit(fence).cast("long").alias("fence"), F.lit(owner).alias("owner"), F.lit(until).cast("timestamp").alias("expires"))
        claim.write.mode("overwrite").parquet(path)
        return fence, self.spark.read.schema(self.LOG).parquet(path).select("item")

    def _mark(self, fence: int, kind: str) -> None:
        held = self.spark.read.schema(self.LOG).parquet(f"{self.folder}/log/{fence:020d}-lease")
        held.withColumn("kind", F.lit(kind)).write.mode("overwrite").parquet(f"{self.folder}/log/{fence:020d}-{kind}")

    def complete(self, fence: int) -> None:
        """Mark all items of a lease done; a repeat writes the same path."""
        self._mark(fence, "done")

    def give_back(self, fence: int) -> None:
        """Give all items of a lease back before it expires."""
        self._mark(fence, "free")

    def write(self, fence: int, outputs: DataFrame) -> None:
        """Write the outputs (column item, others free) of a lease; a retry
        replaces what it wrote before."""
        outputs.write.mode("overwrite").parquet(f"{self.folder}/out/{fence:020d}")

    def published(self) -> DataFrame | None:
        """Outputs of the items whose completion carries their newest token, so
        each item's once; None when there is none. What a stale worker wrote,
        or one that did not finish, is not among them."""
        names = self._names("out")
        if not names:
            return None
        wins = fold(self._log(), ["item"]).where("done_fence = fence").select("item", "fence")
        every = None
        for n in names:
            one = self.spark.read.parquet(f"{self.folder}/out/{n}").withColumn("fence", F.lit(int(n)).cast("long"))
            every = one if every is None else every.unionByName(one, allowMissingColumns=True)
        return every.join(wins, ["item", "fence"], "left_semi")

    def compact(self) -> None:
        """Replace the log by its fold. The fold is written before the old rows
        go; a crash between leaves rows twice, which fold alike. Leases that are
        open keep their rows, as complete() reads them."""
        names = self._names("log")
        done = {n.split("-")[0] for n in names if not n.endswith("-lease")}
        old = [n for n in names if n.split("-")[0] in done]
        if not old:
            return
        log = self.spark.read.schema(self.LOG).parquet(*[f"{self.folder}/log/{n}" for n in old])
        f = fold(log, ["item"])
        row = lambda kind, c: F.when(F.col(c).isNotNull(), F.struct(F.lit(kind).alias("kind"), F.col(c).alias("fence")))
        rows = f.select("item", "owner", "expires", F.explode(F.array_compact(F.array(row("lease", "fence"), row("done", "done_fence"), row("free", "free_fence")))).alias("x"))
        rows.select("item", "x.kind", "x.fence", "owner", "expires").write.mode("overwrite").parquet(f"{self.folder}/log/{self._next_fence():020d}-base")
        for n in old:
            self._fs.delete(self._path(f"log/{n}"), True)
