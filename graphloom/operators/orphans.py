"""References to records that do not exist, by compressed bitmaps.

Referenced keys are numbered densely. For every range of numbers and every
period the references form a bitmap; so do the keys that are parents now, the
keys that some delivery held, and the keys by the period of their first
delivery. References AND NOT parents leaves the orphans, whose bits are
decoded to keys and then to the references themselves."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scale import Scratch, checked_broadcast, number_rows, skew_join
from .snapshots import applied_deliveries

#: Numbers in one range: the width of Spark's built-in bitmaps.
RANGE = 32768


def pack(bits: bytes) -> bytes:
    """A bitmap of one range as a container: the sorted positions when there
    are few, else the bits; the first byte says which."""
    a = np.frombuffer(bits, dtype=np.uint8)
    on = np.flatnonzero(np.unpackbits(a, bitorder="little"))
    return b"\0" + on.astype("<u2").tobytes() if 2 * len(on) < len(a) else b"\1" + bytes(bits)


def unpack(packed: bytes) -> np.ndarray:
    """A container as RANGE booleans."""
    if packed[:1] == b"\1":
        return np.unpackbits(np.frombuffer(packed[1:], dtype=np.uint8), bitorder="little").astype(bool)
    out = np.zeros(RANGE, dtype=bool)
    out[np.frombuffer(packed[1:], dtype="<u2")] = True
    return out


@F.pandas_udf(T.BinaryType())
def _packed(bits: pd.Series) -> pd.Series:
    return bits.map(pack)


def containers(coded: DataFrame) -> DataFrame:
    """(code, kind, period) as (chunk, kind, period, bits), combined map-side
    by Spark's bitmap aggregate and then packed."""
    at = F.col("code") + 1
    built = coded.groupBy((F.bitmap_bucket_number(at) - 1).alias("chunk"), "kind", "period").agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    return built.select("chunk", "kind", "period", _packed("bits").alias("bits"))


def _and_not(pdf: pd.DataFrame) -> pd.DataFrame:
    """All containers of one range (at most four kinds a period) to the
    surviving numbers with their cause."""
    chunk = int(pdf.chunk.iloc[0])
    none = np.zeros(RANGE, dtype=bool)
    # a missing month comes as None or NaN; '' sorts it before all others
    of = {(k, p if isinstance(p, str) else ""): unpack(b) for k, p, b in zip(pdf.kind, pdf.period, pdf.bits)}
    now, held = of.get(("now", ""), none), of.get(("held", ""), none)
    first = {p: b for (k, p), b in of.items() if k == "first"}
    out = []
    for (kind, period), refs in sorted(((k, v) for k, v in of.items() if k[0] == "ref"), key=lambda x: x[0]):
        gone = refs & ~now
        before = none.copy()
        for p, b in first.items():
            if p < period:
                before |= b
        for cause, bits in (("deleted", gone & held), ("missing", gone & ~held), ("late", refs & now & held & ~before if period else none)):
            codes = np.flatnonzero(bits)
            if len(codes):
                out.append(pd.DataFrame({"code": codes.astype("int64") + chunk * RANGE, "period": period, "cause": cause}))
    return pd.concat(out) if out else pd.DataFrame({"code": pd.Series(dtype="int64"), "period": pd.Series(dtype=object), "cause": pd.Series(dtype=object)})


def orphan_references(refs: DataFrame, nodes: DataFrame, snapshots: DataFrame, meta: DataFrame) -> DataFrame:
    """anchor_id, period, cause (deleted, missing, late) of each anchor whose
    node is not there or came later; see TESTDATA.md, problem 5.

    refs: id, node_id, created_at; an id that comes several times counts once
    (its least created_at, then node_id). Anchors without id or node_id refer
    to nothing and give no row. Without created_at the period is null and the
    anchor cannot be late. Only applied deliveries count; rows of nodes and
    snapshots with a null id hold nothing. Keys are compared exactly."""
    scratch = Scratch(refs.sparkSession, "orphans")
    anchors = scratch.keep(
        refs.where("id is not null")
        .groupBy("id")
        .agg(F.min(F.struct("created_at", "node_id")).alias("r"))
        .select(F.col("id").alias("anchor_id"), "r.node_id", "r.created_at", F.date_format("r.created_at", "yyyy-MM").alias("period"))
        .where("node_id is not null")
    )
    used = scratch.keep(anchors.select("node_id", "period").distinct())
    keys = scratch.keep(number_rows(used.select("node_id").distinct(), ["node_id"], scratch, "code"))
    applied = checked_broadcast(applied_deliveries(meta))
    held = snapshots.where("id is not null").select("repo_id", "snapshot_no", F.col("id").alias("node_id"), "taken_at").join(applied, ["repo_id", "snapshot_no"]).groupBy("node_id").agg(F.min("taken_at").alias("first"), F.lit(True).alias("is_held"))
    there = nodes.where("id is not null").select(F.col("id").alias("node_id")).distinct().withColumn("is_now", F.lit(True))
    known = scratch.keep(keys.join(held, "node_id", "left").join(there, "node_id", "left"))
    kinds = F.array(
        F.when(F.col("is_now"), F.struct(F.lit("now").alias("kind"), F.lit("").alias("period"))),
        F.when(F.col("is_held"), F.struct(F.lit("held").alias("kind"), F.lit("").alias("period"))),
        F.when(F.col("is_held"), F.struct(F.lit("first").alias("kind"), F.coalesce(F.date_format("first", "yyyy-MM"), F.lit("")).alias("period"))),
    )
    parents = known.select("code", F.explode(kinds).alias("k")).where("k is not null").select("code", "k.kind", "k.period")
    wanted = skew_join(used, keys, ["node_id"]).select("code", F.lit("ref").alias("kind"), F.coalesce("period", F.lit("")).alias("period"))
    bits = containers(wanted.unionByName(parents))
    survivors = bits.groupBy("chunk").applyInPandas(_and_not, "code long, period string, cause string")
    named = survivors.join(known.select("code", "node_id", "first"), "code").select("node_id", F.col("period").alias("_p"), "cause", "first")
    pairs = skew_join(anchors.withColumn("_p", F.coalesce("period", F.lit(""))), scratch.keep(named), ["node_id", "_p"])
    return pairs.where((F.col("cause") != "late") | (F.col("first") > F.col("created_at"))).select("anchor_id", "period", "cause")


def reference_report(anchors: DataFrame, edges: DataFrame, nodes: DataFrame, snapshots: DataFrame, meta: DataFrame) -> DataFrame:
    """table, period, cause, n_refs: orphan references of intent_anchors and of
    both ends of the edges, in one pass. Edges carry no time, so their period
    is null and none of them is late."""
    when = dict(anchors.dtypes)["created_at"]
    tag = lambda name, key: F.concat(F.lit(f"{name}\u0001"), key.cast("string")).alias("id")
    refs = anchors.select(tag("intent_anchors", F.col("id")), "node_id", "created_at")
    for end in ("source_id", "target_id"):
        refs = refs.unionByName(edges.select(tag(f"edges.{end}", F.col("id")), F.col(end).alias("node_id"), F.lit(None).cast(when).alias("created_at")))
    found = orphan_references(refs, nodes, snapshots, meta)
    return found.groupBy(F.substring_index("anchor_id", "\u0001", 1).alias("table"), "period", "cause").agg(F.count(F.lit(1)).alias("n_refs"))
