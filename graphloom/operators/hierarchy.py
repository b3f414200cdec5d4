"""Parent-child links to full hierarchies, by tree contraction.

Each round rakes all leaves (records them with their parent) and compresses
unary chains (a node whose parent has no other child jumps to its
grandparent), which halves chains; so the rounds grow with the logarithm of
size and depth. Replaying the records backwards gives roots and depths. What
a round cannot rake is a set of cycles; all that hangs from it never reaches
a root."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import Scratch, skew_join


def current_features(rows: DataFrame) -> DataFrame:
    """The row with the greatest updated_at for each id (null is least; ties
    by the greatest parent, domain and workspace). A null id is no feature."""
    cols = ["updated_at", "parent_feature_id", "domain_id", "workspace_id"]
    order = F.struct(*[x for c in cols for x in (F.col(c).isNotNull(), F.col(c))])
    kept = rows.where("id is not null").groupBy("id").agg(F.max_by(F.struct(*cols), order).alias("r"))
    return kept.select("id", "r.workspace_id", "r.domain_id", "r.parent_feature_id")


def holding_links(features: DataFrame) -> DataFrame:
    """(v, p) where p is a feature of the same workspace and domain. A null
    workspace or domain equals no other."""
    n = features.count()
    f = features.select(F.col("id").alias("v"), F.col("parent_feature_id").alias("p"), F.col("workspace_id").alias("w"), F.col("domain_id").alias("d")).where("p is not null")
    parents = features.select(F.col("id").alias("p"), F.col("workspace_id").alias("pw"), F.col("domain_id").alias("pd"))
    return skew_join(f, parents, ["p"], rows=n).where("w = pw and d = pd").select("v", "p")


def _flag_leaves(links: DataFrame) -> DataFrame:
    inner = links.select(F.col("p").alias("v")).distinct().withColumn("_inner", F.lit(True))
    return links.join(inner, "v", "left").withColumn("leaf", F.col("_inner").isNull()).drop("_inner")


def _compress(links: DataFrame) -> DataFrame:
    """Nodes whose parent is unary and no root take their grandparent."""
    unary = links.groupBy("p").agg(F.count(F.lit(1)).alias("_n"), F.min("v").alias("_c")).where("_n = 1").select(F.col("p").alias("v"), "_c")
    jump = unary.join(links, "v").select(F.col("_c"), F.col("v").alias("_u"), F.col("p").alias("_p"), F.col("w").alias("_w"), F.col("via").alias("_via"))
    out = links.join(jump.withColumnRenamed("_c", "v"), "v", "left")
    via = F.when(F.col("_u").isNull() | F.col("via").isNull(), F.col("via")).otherwise(F.concat("_via", F.array("_u"), "via"))
    return out.select("v", F.coalesce("_p", "p").alias("p"), (F.col("w") + F.coalesce("_w", F.lit(0).cast("long"))).alias("w"), via.alias("via"))


def contract(links: DataFrame, roots: DataFrame, paths: bool = False) -> DataFrame:
    """links (v, p: one row for each v), roots (v): v, root, depth, path.

    root is '' and depth -1 where the links upwards never end. path (only if
    paths, which asks for links without cycles) is the array of ids from the
    root to v. Cycles of one (a node that is its own parent) count."""
    spark = links.sparkSession
    scratch = Scratch(spark, "hierarchy")
    via = (F.array() if paths else F.lit(None)).cast("array<string>")
    now = scratch.keep(_flag_leaves(links.select("v", "p", F.lit(1).cast("long").alias("w"), via.alias("via"))))
    records = []
    while True:
        counts = now.agg(F.count(F.lit(1)), F.count(F.when(F.col("leaf"), 1))).first()
        if not counts[1]:
            break
        records.append((now.where("leaf").drop("leaf"), counts[1]))
        if counts[0] == counts[1]:
            break
        now = scratch.keep(_flag_leaves(_compress(now.where("not leaf").drop("leaf"))))
    none = F.lit(None).cast("array<string>")
    done = roots.select("v", F.col("v").alias("root"), F.lit(0).cast("long").alias("depth"), (F.array("v") if paths else none).alias("path"))
    if counts[0] > counts[1]:
        done = done.unionByName(now.where("not leaf").select("v", F.lit("").alias("root"), F.lit(-1).cast("long").alias("depth"), none.alias("path")))
    parts = [scratch.keep(done)]
    for record, size in reversed(records):
        known = parts[0]
        for x in parts[1:]:
            known = known.unionByName(x)
        at = known.withColumnRenamed("v", "p").withColumnRenamed("path", "_path")
        depth = F.when(F.col("depth") < 0, F.lit(-1)).otherwise(F.col("depth") + F.col("w"))
        path = F.concat("_path", "via", F.array("v")) if paths else none
        parts.append(scratch.keep(skew_join(record, at, ["p"], rows=size).select("v", "root", depth.cast("long").alias("depth"), path.alias("path"))))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def feature_roots(rows: DataFrame) -> DataFrame:
    """feature_id, root_id, depth for each feature (see contract)."""
    scratch = Scratch(rows.sparkSession, "features")
    features = scratch.keep(current_features(rows))
    links = scratch.keep(holding_links(features))
    roots = features.select(F.col("id").alias("v")).join(links.select("v"), "v", "left_anti")
    return contract(links, roots).select(F.col("v").alias("feature_id"), F.col("root").alias("root_id"), F.col("depth").cast("int").alias("depth"))


def feature_paths(rows: DataFrame) -> DataFrame:
    """feature_id, root_id, depth, path of every feature that reaches a root;
    path is the array of ids from the root down to the feature."""
    scratch = Scratch(rows.sparkSession, "features")
    features = scratch.keep(current_features(rows))
    links = scratch.keep(holding_links(features))
    roots = features.select(F.col("id").alias("v")).join(links.select("v"), "v", "left_anti")
    ends = scratch.keep(contract(links, roots).where("depth >= 0").select("v"))
    tree = contract(links.join(ends, "v", "left_semi"), roots, paths=True)
    return tree.select(F.col("v").alias("feature_id"), F.col("root").alias("root_id"), F.col("depth").cast("int").alias("depth"), "path")


def feature_descendants(rows: DataFrame) -> DataFrame:
    """ancestor_id, descendant_id, distance: every feature below every other
    on its path; as many rows as the depths add up to."""
    paths = feature_paths(rows)
    return paths.select(F.col("feature_id").alias("descendant_id"), "depth", F.posexplode("path").alias("at", "ancestor_id")).where("at < depth").select("ancestor_id", "descendant_id", (F.col("depth") - F.col("at")).cast("int").alias("distance"))
