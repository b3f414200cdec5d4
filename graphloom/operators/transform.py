"""From parsed repositories to the graph: containment and use edges, type
references, unresolved calls, masking, checks of what was parsed, and the
order in which functions can be described."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import checked_broadcast

# Capitalised words in type texts that name no type of a repository.
NOT_TYPES = (
    "Function Object String Number Boolean Symbol BigInt Date Error RegExp JSON Math Infinity NaN true false null undefined this never unknown void any object"
).split()
# Longest stored callee expression, longest stored value.
CALLEE_CHARS, VALUE_CHARS = 160, 200
#: Parts of names that hold secrets.
SECRET = "password|passwd|secret|token|apikey|privatekey|credential"


def edge_id(source: Column, kind: str, target: Column) -> Column:
    """The id of an edge that has none of its own."""
    return F.concat(source, F.lit(f":{kind}:"), target)


def containment(nodes: DataFrame) -> DataFrame:
    """Edges from files to what they declare: edge_id, source_id, target_id,
    type. Methods belong to their class and not to the file; a file is found by
    repository and path."""
    files = nodes.where("type = 'file'").groupBy("repo_id", "file_path").agg(F.min("id").alias("source_id"))
    kinds = {"function": "CONTAINS_FUNCTION", "class": "CONTAINS_CLASS", "interface": "CONTAINS_INTERFACE", "enum": "CONTAINS_ENUM", "variable": "CONTAINS_VARIABLE"}
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("type")]
    method = F.coalesce(F.get_json_object("properties", "$.kind"), F.lit("")) == "method"
    inner = nodes.where(F.col("type").isin(*kinds) & ~method).select("repo_id", "file_path", F.col("id").alias("target_id"), kind.alias("type")).distinct()
    e = inner.join(files, ["repo_id", "file_path"])
    return e.select(F.concat("source_id", F.lit(":"), "type", F.lit(":"), "target_id").alias("edge_id"), "source_id", "target_id", "type")


def name_tail(expression: Column) -> Column:
    """The plain name an expression ends with, null if it ends otherwise."""
    tail = F.regexp_extract(expression, r"([A-Za-z_$][A-Za-z0-9_$]*+)$", 1)
    return F.when(tail != "", tail)


def unresolved_calls(calls: DataFrame) -> DataFrame:
    """caller_id, callee_expression (on one line, cut to CALLEE_CHARS),
    callee_name_tail (of the whole expression) of calls without a callee."""
    flat = F.trim(F.regexp_replace("callee_expression", r"\s+", " "))
    c = calls.where("callee_id is null and callee_expression is not null").select("caller_id", flat.alias("x"))
    return c.select("caller_id", F.substring("x", 1, CALLEE_CHARS).alias("callee_expression"), name_tail(F.col("x")).alias("callee_name_tail"))


def call_edges(calls: DataFrame) -> DataFrame:
    """Edges of resolved calls: inferred and of confidence 0.5 where the callee
    came from an interface's implementation."""
    guess = F.coalesce(F.col("provenance") == "iface-impl", F.lit(False))
    return calls.where("callee_id is not null").select(F.col("id").alias("edge_id"), F.col("caller_id").alias("source_id"), F.col("callee_id").alias("target_id"), F.when(guess, 0.5).otherwise(1.0).alias("confidence"), guess.alias("inferred"))


def type_names(text: Column) -> Column:
    """Distinct names of types in a type text, in order of their first place."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])[A-Z][A-Za-z0-9_]*+"), F.lit(0))
    return F.array_except(found, F.array(*[F.lit(x) for x in NOT_TYPES]))


def uses_type(sites: DataFrame, types: DataFrame) -> DataFrame:
    """USES_TYPE edges: source_id, target_id, usage, confidence. sites: id,
    repo_id, usage, name. types: type_id, repo_id, name. A name that several
    types of the repository bear links all of them at confidence 0.5."""
    t = types.select("type_id", "repo_id", "name").distinct()
    n = t.groupBy("repo_id", "name").agg(F.count(F.lit(1)).alias("n"))
    met = sites.select("id", "repo_id", "usage", "name").distinct().join(t, ["repo_id", "name"]).join(n, ["repo_id", "name"])
    return met.where("id <> type_id").groupBy(F.col("id").alias("source_id"), F.col("type_id").alias("target_id"), "usage").agg(F.max(F.when(F.col("n") > 1, 0.5).otherwise(1.0)).alias("confidence"))


def first_wins(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The first row of each key in the given order of emission."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("r")).select(key, "r.*")


def merge_versions(nodes: DataFrame, extra: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts or vectors made for a version of a node (id, version, value)
    merged into nodes (id, version), and the count of merged and dropped: a
    value for another version, or for no node, is dropped."""
    j = extra.join(nodes.select("id", F.col("version").alias("_v")), "id", "left").withColumn("fits", F.coalesce(F.col("_v") == F.col("version"), F.lit(False)))
    merged = nodes.join(j.where("fits").select("id", "value"), "id", "left")
    counts = j.agg(F.count_if("fits").alias("n_merged"), F.count_if(~F.col("fits")).alias("n_dropped"))
    return merged, counts


def mask_secrets(value: Column) -> Column:
    """A value without secrets: quoted values of keys named like secrets, and
    quoted runs of 20 or more letters and digits, become [REDACTED]; at most
    VALUE_CHARS characters remain, with an ellipsis when cut."""
    keyed = rf"(?i)((?<![\w$])['\"]?[\w$-]*(?:{SECRET})[\w$-]*['\"]?\s*[:=]\s*)(['\"`])[^'\"`\n]*\2"
    v = F.regexp_replace(value, keyed, "$1$2[REDACTED]$2")
    v = F.regexp_replace(v, r"(['\"`])(?=[^'\"`\s]*\d)(?=[^'\"`\s]*[A-Za-z])[A-Za-z0-9+/=_-]{20,}\1", "$1[REDACTED]$1")
    return F.when(F.length(v) > VALUE_CHARS, F.concat(F.substring(v, 1, VALUE_CHARS), F.lit("…"))).otherwise(v)


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Referential integrity: edge_type, side (source, target), n_missing,
    sample (the five least ids) of ends that are no node."""
    there = nodes.select(F.col("id").alias("end")).distinct()
    ends = edges.select("id", "type", F.explode(F.array(F.struct(F.lit("source").alias("side"), F.col("source_id").alias("end")), F.struct(F.lit("target").alias("side"), F.col("target_id").alias("end")))).alias("x")).select("id", F.col("type").alias("edge_type"), "x.side", "x.end").distinct()
    gone = ends.join(there, "end", "left_anti")
    from pyspark.sql import Window

    w = Window.partitionBy("edge_type", "side").orderBy("id")
    few = gone.select("edge_type", "side", "id").withColumn("r", F.row_number().over(w)).where("r <= 5")
    sample = few.groupBy("edge_type", "side").agg(F.array_join(F.array_sort(F.collect_list("id")), " ").alias("sample"))
    return gone.groupBy("edge_type", "side").agg(F.count(F.lit(1)).alias("n_missing")).join(sample, ["edge_type", "side"])


def clean_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends exist, the least id for each (source, target, type)."""
    there = nodes.select("id").distinct()
    e = edges.join(there.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(there.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return e.groupBy("source_id", "target_id", "type").agg(F.min("id").alias("id"))


def resolution_by_package(functions: DataFrame, calling: DataFrame, least: int = 20) -> DataFrame:
    """package, n_functions, n_resolved, ratio, blackout: packages of at least
    least functions without any resolved call, while another package of any
    size resolves more than half. functions: package, id. calling: id."""
    per = functions.select("package", "id").distinct().join(calling.select("id").distinct().withColumn("c", F.lit(1)), "id", "left").groupBy("package").agg(F.count(F.lit(1)).alias("n_functions"), F.count("c").alias("n_resolved"))
    per = per.withColumn("ratio", F.round(F.col("n_resolved") / F.col("n_functions"), 6))
    best = per.agg(F.max("ratio").alias("best"))
    return per.crossJoin(F.broadcast(best)).withColumn("blackout", (F.col("n_functions") >= least) & (F.col("n_resolved") == 0) & (F.col("best") > 0.5)).drop("best")


def scorecard(counts: DataFrame, category: str, found: str, expected: str, bars: dict[str, float], bar: float = 0.8) -> DataFrame:
    """category, score (capped at 1, null without expectation), verdict: PASS
    from the category's bar on, PARTIAL from 0.5 (and below its bar), else
    FAIL; NONE without expectation."""
    need = F.lit(bar)
    for name, b in bars.items():
        need = F.when(F.col(category) == name, b).otherwise(need)
    ratio = F.try_divide(F.col(found), F.col(expected))
    c = counts.withColumn("score", F.when(ratio.isNotNull(), F.round(F.least(F.lit(1.0), ratio), 6)))
    return c.select(category, "score", F.when(F.col("score").isNull(), "NONE").when(F.col("score") >= need, "PASS").when(F.col("score") >= 0.5, "PARTIAL").otherwise("FAIL").alias("verdict"))


def shape_clusters(rows: DataFrame, text: str, top: int) -> DataFrame:
    """shape, n, example: texts that are alike but for names, numbers and
    quoted parts, most first."""
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(text), r"`[^`\n]*`", "q"), r"[0-9]+", "0"), r"[ \t\r\n]+", " ")
    return rows.where(F.col(text).isNotNull()).groupBy(s.alias("shape")).agg(F.count(F.lit(1)).alias("n"), F.min(text).alias("example")).orderBy(F.desc("n"), "shape").limit(top)


def dominant(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """The most frequent value of each key, the first by name on a tie."""
    n = rows.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*key).agg(F.min(F.struct(-F.col("n"), F.col(value))).alias("m"), F.sum("n").alias("n_files")).select(*key, F.col(f"m.{value}").alias(value), "n_files")


def reusable(old: DataFrame, new: DataFrame) -> DataFrame:
    """id, reuse: whether the input of a node (id, input) has the md5 it had
    when its vector was made (old: id, checksum)."""
    return new.select("id", F.md5("input").alias("c")).join(old, "id", "left").select("id", F.coalesce(F.col("c") == F.col("checksum"), F.lit(False)).alias("reuse"))


def relationship_diagram(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """name, diagram: a block of text for each entity (name, field, kind) with
    its fields and its relations (name, other), in order of name."""
    f = entities.groupBy("name").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("  "), "kind", F.lit(" "), "field"))), "\n").alias("fields"))
    r = relations.groupBy("name").agg(F.array_join(F.array_sort(F.collect_set(F.concat("name", F.lit(" --> "), "other"))), "\n").alias("links"))
    return f.join(r, "name", "left").select("name", F.concat(F.lit("entity "), "name", F.lit(" {\n"), "fields", F.lit("\n}"), F.when(F.col("links").isNotNull(), F.concat(F.lit("\n"), "links")).otherwise("")).alias("diagram"))


def apply_rules(facts: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """facts with the names of the user's rules (name, SQL condition) that hold
    for them: one row for each fact and rule."""
    hits = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in rules]))
    return facts.withColumn("rule", F.explode(hits))


def sole_owner(rows: DataFrame, key: str, owner: str) -> DataFrame:
    """Keys with exactly one owner."""
    return checked_broadcast(rows.groupBy(key).agg(F.count_distinct(owner).alias("n"), F.min(owner).alias(owner)).where("n = 1").drop("n"))
