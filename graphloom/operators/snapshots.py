"""What changed between full snapshots.

Snapshots are unpivoted into signed (key, field, value) cells plus one
presence cell per key. A delivery adds its cells to its own transition and
takes them from the next one, so cells that both deliveries hold cancel; the
cells that do not sum to zero classify the key and name the changed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.json_values import canonical_json
from ..scale import Scratch, checked_broadcast, number_rows

#: Plain fields that are compared by value, and the one compared as JSON.
PLAIN = ("type", "name", "file_path", "start_line", "end_line")
JSON = "properties"


def applied_deliveries(meta: DataFrame) -> DataFrame:
    """(repo_id, snapshot_no) of deliveries with an applied receipt, each once.
    Receipts that are no JSON, or lack a number or a repository, do not count."""
    text = F.col("snapshot")
    return (
        meta.where((F.get_json_object(text, "$.state") == "applied") & F.col("repo_id").isNotNull())
        .select("repo_id", F.get_json_object(text, "$.snapshotNo").try_cast("double").cast("int").alias("snapshot_no"))
        .where("snapshot_no is not null")
        .distinct()
    )


def delivery_chain(meta: DataFrame, scratch: Scratch) -> DataFrame:
    """Each applied delivery with the number of the one before (has_prev) and
    after it (next_no) in its repository. Neighbours come from dense numbers
    and a join on them, so a repository with a third of all deliveries is not
    sorted by one task."""
    n = scratch.keep(number_rows(applied_deliveries(meta), ["repo_id", "snapshot_no"], scratch))
    before = n.select("repo_id", (F.col("n") + 1).alias("n"), F.lit(True).alias("has_prev"))
    after = n.select("repo_id", (F.col("n") - 1).alias("n"), F.col("snapshot_no").alias("next_no"))
    chain = n.join(before, ["repo_id", "n"], "left").join(after, ["repo_id", "n"], "left")
    return scratch.keep(chain.select("repo_id", "snapshot_no", F.coalesce("has_prev", F.lit(False)).alias("has_prev"), "next_no"))


def snapshot_changes(snapshots: DataFrame, meta: DataFrame) -> DataFrame:
    """repo_id, snapshot_no, id, change (added, removed, changed) and
    changed_fields (sorted array, empty unless changed), one row for each key
    of an applied delivery that differs from the delivery applied before it.

    Rows repeated in a delivery count once. A key with several different rows
    in one delivery is the set of its cells: it is changed when that set
    differs. Null is a value; rows with a null id or repo_id are no records.
    An applied delivery without rows is an empty snapshot. The first applied
    delivery of a repository gives no rows. Values are compared by 64-bit
    hashes of their text, keys exactly. Extra columns are ignored."""
    scratch = Scratch(snapshots.sparkSession, "snapshots")
    chain = checked_broadcast(delivery_chain(meta, scratch))
    hashes = [F.xxhash64(F.col(c).cast("string")).alias(c) for c in PLAIN] + [F.xxhash64(canonical_json(F.col(JSON))).alias(JSON)]
    rows = (
        snapshots.where("id is not null")
        .select("repo_id", "snapshot_no", "id", *[F.col(c) for c in (*PLAIN, JSON)])
        .join(chain, ["repo_id", "snapshot_no"])
        .where("has_prev or next_no is not null")
        .select("repo_id", "id", "snapshot_no", "has_prev", "next_no", *hashes)
        .repartition("repo_id", "id")
    )
    cells = [F.struct(F.lit(0).alias("field"), F.lit(0).cast("long").alias("value"))] + [
        F.struct(F.lit(i).alias("field"), F.col(c).alias("value")) for i, c in enumerate((*PLAIN, JSON), 1)
    ]
    sides = F.array(
        F.struct(F.when(F.col("has_prev"), F.col("snapshot_no")).alias("at"), F.lit(1).alias("sign")),
        F.struct(F.col("next_no").alias("at"), F.lit(-1).alias("sign")),
    )
    signed = (
        rows.select("repo_id", "id", F.explode(sides).alias("s"), *PLAIN, JSON)
        .where("s.at is not null")
        .select("repo_id", "id", F.col("s.at").alias("snapshot_no"), F.col("s.sign").alias("sign"), F.explode(F.array(*cells)).alias("c"))
    )
    # the sum over distinct signed cells: each side counts once however often its row is repeated
    net = F.max(F.when(F.col("sign") > 0, 1).otherwise(0)) - F.max(F.when(F.col("sign") < 0, 1).otherwise(0))
    summed = signed.groupBy("repo_id", "id", "snapshot_no", F.col("c.field").alias("field"), F.col("c.value").alias("value")).agg(net.alias("net")).where("net <> 0")
    per_key = summed.groupBy("repo_id", "id", "snapshot_no").agg(
        F.sum(F.when(F.col("field") == 0, F.col("net")).otherwise(0)).alias("presence"),
        F.bit_or(F.expr("shiftleft(1, field)")).alias("mask"),
    )
    changed = F.array_compact(F.array(*[F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) > 0, c) for i, c in enumerate((*PLAIN, JSON), 1)]))
    return per_key.select(
        "repo_id",
        "snapshot_no",
        "id",
        F.when(F.col("presence") > 0, "added").when(F.col("presence") < 0, "removed").otherwise("changed").alias("change"),
        F.when(F.col("presence") == 0, F.array_sort(changed)).otherwise(F.array().cast("array<string>")).alias("changed_fields"),
    )
