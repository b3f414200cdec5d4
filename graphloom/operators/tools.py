"""Questions that combine reads of the graph: search, similarity, impact,
dependencies between services, messages between repositories, explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import Scratch
from . import reads, traverse
from .graph import Graph, clamp_depth, one_per_id, prop

# Which kind stands for a declaration that has several, and the weights of a change's risk.
KINDS = ("class", "function", "interface", "type_alias", "enum", "entity", "component", "route", "variable")
RISK_ENTRYPOINT, RISK_REPO, RISK_HIGH, RISK_MEDIUM = 3, 5, 20, 8


def kind_rank(kind: Column) -> Column:
    """Place of a kind in KINDS, 99 for others."""
    return F.coalesce(F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])[kind], F.lit(99))


def one_per_place(rows: DataFrame) -> DataFrame:
    """Declarations of one name at one place folded to the kind that stands
    for them: name, file_path, start_line, id, type, kinds (all, in order)."""
    ranked = F.struct(kind_rank(F.col("type")).alias("k"), "id", "type")
    g = rows.groupBy("name", "file_path", "start_line").agg(F.min(ranked).alias("w"), F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(kind_rank(F.col("type")).alias("k"), "type"))), lambda x: x["type"]), ",").alias("kinds"))
    return g.select("name", "file_path", "start_line", "w.id", "w.type", "kinds")


def search_symbols(g: Graph, query: str, home: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """Declarations whose name holds every word of the query (case aside; a
    glob where it has * or ?), folded by place; those that bear exactly the
    query's name first, then those of the home repository, then by name."""
    words = query.lower().split()
    if any(c in query for c in "*?"):
        from .graph import glob_match

        where = glob_match(F.col("name"), query)
    else:
        where = F.lit(True)
        for w in words:
            where = where & F.contains(F.lower("name"), F.lit(w))
    rows = one_per_place(g.some(*KINDS, where=where, columns=reads.PLACE))
    exact = F.when(F.lower("name") == query.lower(), 0).otherwise(1)
    near = [F.when(F.startswith(F.col("id"), F.lit(f"{home}:")), 0).otherwise(1)] if home else []
    return rows.orderBy(exact, *near, F.lower("name"), F.coalesce("file_path", F.lit("")), "id").offset(offset).limit(limit)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where one is all zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def semantic_search(rows: DataFrame, key: str, vector: str, query: DataFrame, limit: int = 10) -> DataFrame:
    """key, score (two digits): the rows most similar to a query vector (one
    row, column q). Rows of another width raise; at most 25 rows."""
    a, q = F.col(vector).cast("array<double>"), F.col("q").cast("array<double>")
    met = rows.where(F.col(vector).isNotNull()).crossJoin(F.broadcast(query.select("q")))
    fits = F.when(F.size(a) == F.size(q), cosine(a, q)).otherwise(F.raise_error(F.lit("vectors of another width")).cast("double"))
    return met.select(key, fits.alias("s")).orderBy(F.desc("s"), key).limit(min(limit, 25)).select(key, F.round("s", 2).alias("score"))


def describe_repositories(g: Graph) -> DataFrame:
    """repo_id, kind, n_packages, n_entrypoints: monorepo with several packages,
    backend with http, graphql or grpc entrypoints, cli with cli ones, else library."""
    n = g.some("package", "entrypoint", "repository", columns=("type", "repo_id", "properties"))
    k = prop("entrypointType")
    d = n.groupBy("repo_id").agg(F.count_if(F.col("type") == "package").alias("n_packages"), F.count_if(F.col("type") == "entrypoint").alias("n_entrypoints"), F.count_if(k.isin("http", "graphql", "grpc")).alias("web"), F.count_if(k == "cli").alias("cli"))
    kind = F.when(F.col("n_packages") > 1, "monorepo").when(F.col("web") > 0, "backend").when(F.col("cli") > 0, "cli").otherwise("library")
    return d.select("repo_id", kind.alias("kind"), "n_packages", "n_entrypoints")


def coverage_rates(g: Graph) -> DataFrame:
    """Coverage counts as rates; nothing of nothing is 0. low_external: fewer
    than a fifth of the external calls resolve."""
    c = reads.coverage_counts(g)
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 6)
    return c.select("repo_id", rate("n_function_covered", "n_function").alias("call_rate"), rate("n_entity_covered", "n_entity").alias("entity_rate"), rate("n_external_call_covered", "n_external_call").alias("external_rate"), ((F.col("n_external_call") > 0) & (rate("n_external_call_covered", "n_external_call") < 0.2)).alias("low_external"))


def dependents(g: Graph) -> DataFrame:
    """target_id, user_id, kind: subclasses and implementations first, then
    other uses of a type; each user of a type once."""
    heirs = g.links("EXTENDS", "IMPLEMENTS_INTERFACE").select("target_id", F.col("source_id").alias("user_id"), F.lower("type").alias("kind"))
    uses = reads.type_usages(g).select("target_id", "user_id", "kind")
    rank = F.when(F.col("kind").isin("extends", "implements_interface"), 0).otherwise(1)
    return heirs.unionByName(uses).groupBy("target_id", "user_id").agg(F.min(F.struct(rank.alias("r"), "kind")).alias("b")).select("target_id", "user_id", "b.kind")


def change_impact(g: Graph, targets: DataFrame, depth: float = 2) -> DataFrame:
    """For each target (column id): n_direct, n_transitive callers within
    depth, n_entrypoints they handle, n_repos of callers elsewhere, n_tests
    (callers in test files) and the risk. All targets walk in one frontier."""
    s = Scratch(g.nodes.sparkSession, "impact")
    seen = s.keep(traverse.walk(traverse.arcs(g, "CALLS", direction="in"), targets.select(F.col("id").alias("root"), "id"), clamp_depth(depth), s))
    info = g.some(columns=("file_path",)).select("id", F.col("file_path").rlike(r"(?i)(?:^|/)(?:tests?|__tests__|spec)/|[._-](?:test|spec)\.").alias("is_test"))
    h = g.pairs("HANDLES").select(F.col("source_id").alias("ep"), F.col("target_id").alias("id"))
    eps = seen.join(h, "id").groupBy("root").agg(F.count_distinct("ep").alias("e"))
    away = F.substring_index("root", ":", 1) != F.substring_index("id", ":", 1)
    callers = seen.join(info, "id", "left").groupBy("root").agg(
        F.count_if(F.col("distance") == 1).alias("n_direct"), F.count_if(F.col("distance") > 1).alias("n_transitive"), F.count_distinct(F.when(away, F.substring_index("id", ":", 1))).alias("n_repos"), F.count_if(F.coalesce("is_test", F.lit(False)) & (F.col("distance") > 0)).alias("n_tests")
    )
    j = callers.join(eps, "root", "left").withColumn("n_entrypoints", F.coalesce("e", F.lit(0)).cast("long"))
    score = F.col("n_direct") + RISK_ENTRYPOINT * F.col("n_entrypoints") + RISK_REPO * F.col("n_repos")
    risk = F.when(score >= RISK_HIGH, "high").when(score >= RISK_MEDIUM, "medium").otherwise("low")
    return j.select(F.col("root").alias("target_id"), "n_direct", "n_transitive", "n_entrypoints", "n_repos", "n_tests", risk.alias("risk"))


def service_dependencies(g: Graph) -> DataFrame:
    """from_repo, service, n_calls, n_resolved, protocols, n_patterns: what each
    repository calls; a service is the target named, else the repository
    reached, else the call's name; calls into the own repository are left out."""
    x = reads.external_calls(g)
    service = F.coalesce("target_service", "resolved_name", "name")
    x = x.where(F.col("to_repo").isNull() | (F.col("to_repo") != F.col("repo_id")))
    return x.groupBy(F.col("repo_id").alias("from_repo"), service.alias("service")).agg(F.count(F.lit(1)).alias("n_calls"), F.count("to_repo").alias("n_resolved"), F.array_join(F.array_sort(F.collect_set("protocol")), ",").alias("protocols"), F.count_distinct("path").alias("n_patterns"))


def message_pairs(producers: DataFrame, consumers: DataFrame, aliases: DataFrame) -> DataFrame:
    """system, destination, n_producers, n_consumers, cross: producers and
    consumers (repo_id, system, ref) by the destination their reference stands
    for (aliases: system, ref, value; a reference with several values stands
    for itself). cross: repositories of both sides differ. Sides are counted
    before they meet, so a busy destination gives one row."""
    sole = aliases.where("value is not null").groupBy("system", "ref").agg(F.count_distinct("value").alias("n"), F.min("value").alias("value")).where("n = 1").drop("n")
    key = lambda df: df.join(sole, ["system", "ref"], "left").withColumn("destination", F.coalesce("value", "ref"))
    side = lambda df, p: key(df).groupBy("system", "destination").agg(F.count(F.lit(1)).alias(f"n_{p}"), F.array_sort(F.collect_set("repo_id")).alias(p))
    j = side(producers, "producers").join(side(consumers, "consumers"), ["system", "destination"])
    return j.select("system", "destination", "n_producers", "n_consumers", (F.size(F.array_union("producers", "consumers")) > 1).alias("cross"))


def explain(g: Graph, ids: DataFrame) -> DataFrame:
    """For each wanted function (column id): name, file_path, n_callers,
    n_callees, n_entities, n_external, n_entrypoints around it."""
    f = one_per_id(g.node_rows("function").join(F.broadcast(ids.select("id").distinct()), "id", "left_semi"), ("name", "file_path"))
    sides = [("CALLS", "target_id", "callers"), ("CALLS", "source_id", "callees"), ("OPERATES_ON", "source_id", "entities"), ("MAKES_EXTERNAL_CALL", "source_id", "external"), ("HANDLES", "target_id", "entrypoints")]
    cases = F.array(*[F.when(F.col("type") == t, F.struct(F.col(c).alias("id"), F.lit(p).alias("part"))) for t, c, p in sides])
    e = g.links(*{t for t, _, _ in sides}).where("source_id <> target_id").select("source_id", "target_id", "type").distinct()
    n = e.select(F.explode(F.array_compact(cases)).alias("x")).select("x.*").join(F.broadcast(ids.select("id").distinct()), "id", "left_semi").groupBy("id").agg(*[F.count_if(F.col("part") == p).alias(f"n_{p}") for _, _, p in sides])
    return f.join(n, "id", "left").select("id", "name", "file_path", *[F.coalesce(f"n_{p}", F.lit(0)).cast("long").alias(f"n_{p}") for _, _, p in sides])


def ambiguous_names(g: Graph, kind: str) -> DataFrame:
    """name, n, chosen (least id) of names that several nodes of a type bear."""
    return g.some(kind, columns=("name",)).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("chosen")).where("n > 1")


def parse_function_name(text: Column) -> tuple[Column, Column]:
    """Name and class of what a user calls a function: split at the last dot,
    unless there is a signature, a path, a space, or no name on either side."""
    whole = F.coalesce(text, F.lit(""))
    split = whole.rlike(r"^[^/\\\s(]+\.[^/\\\s(.]+$")
    name = F.when(split, F.regexp_extract(whole, r"([^.]*)$", 1)).otherwise(whole)
    return name, F.when(split, F.regexp_extract(whole, r"^(.*)\.[^.]*$", 1))


def method_matches(requested: Column, stored: Column) -> Column:
    """Whether an http method meets a stored one: none asks for any, ALL is any."""
    wild = lambda c: F.upper(c).isin("ALL", "*", "ANY")
    return requested.isNull() | (requested == "") | wild(requested) | F.coalesce(wild(stored) | (F.upper(stored) == F.upper(requested)), F.lit(False))


def dynamic_boundaries(unresolved: DataFrame, names: DataFrame, shown: int = 5) -> DataFrame:
    """name, n_calls, sample: unresolved calls that end in a wanted name
    (column name), with the shown first places."""
    from pyspark.sql import Window

    u = unresolved.join(F.broadcast(names.select(F.col("name").alias("callee_name_tail")).distinct()), "callee_name_tail", "left_semi")
    place = F.concat("file_path", F.lit(":"), "line")
    few = u.withColumn("r", F.row_number().over(Window.partitionBy("callee_name_tail").orderBy("file_path", "line", "caller_id"))).where(F.col("r") <= shown)
    sample = few.groupBy("callee_name_tail").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", place.alias("p")))), lambda x: x["p"]), " ").alias("sample"))
    return u.groupBy("callee_name_tail").agg(F.count(F.lit(1)).alias("n_calls")).join(sample, "callee_name_tail").select(F.col("callee_name_tail").alias("name"), "n_calls", "sample")
