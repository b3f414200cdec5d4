"""Links between repositories: which entrypoint a call in another repository
reaches, by route, by message, by symbol, by mapping; with its way and its
confidence. A key that several targets share is ambiguous and links nothing.

Routes with parameters are matched by masks: of the few distinct parameter
positions of the entrypoints, each gives one key of a call, and keys are
joined by equality; so no call meets all entrypoints of its length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import segments, signature
from ..scale import Scratch, checked_broadcast, skew_join, small

# Methods that a wildcard stands for, and the confidence of each way.
METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")
PROTOCOL_CONFIDENCE = 0.95
SYMBOL_CONFIDENCE = {"precise": 1.0, "owner": 0.95, "method": 0.85}
MAPPING_CONFIDENCE = 0.9
# Fixed value: the message system of calls between processes of one application.
IPC = "electron-ipc"


def entry_index(entrypoints: DataFrame) -> DataFrame:
    """ep_id, ep_repo, method, sig, params, mask: entrypoints (ep_id, repo_id,
    method, path) under each method they answer. mask has a 1 for each
    parameter segment."""
    e = entrypoints.where("path is not null").withColumn("sig", signature(F.col("path")))
    many = F.when(F.upper("method") == "ALL", F.array(*[F.lit(m) for m in (*METHODS, "ALL")])).otherwise(F.array(F.upper("method")))
    mask = F.array_join(F.transform(segments(F.col("sig")), lambda s: F.when(s == ":_", "1").otherwise("0")), "")
    e = e.select(F.col("ep_id"), F.col("repo_id").alias("ep_repo"), F.explode(many).alias("method"), "sig", mask.alias("mask"))
    return e.withColumn("params", F.length(F.replace(F.col("mask"), F.lit("0"), F.lit("")))).distinct()


def _masked(sig: Column, mask: Column) -> Column:
    parts = segments(sig)
    return F.array_join(F.transform(parts, lambda s, i: F.when(F.substring(mask, i + 1, F.lit(1)) == "1", ":_").otherwise(s)), "/")


def _one(found: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each call: its sole target, or ambiguous."""
    n = F.count_distinct("ep_id")
    return found.groupBy(*keys).agg(n.alias("n"), F.min(F.struct("ep_id", "ep_repo")).alias("t")).select(*keys, F.when(F.col("n") == 1, F.col("t.ep_id")).alias("ep_id"), F.when(F.col("n") == 1, F.col("t.ep_repo")).alias("ep_repo"), F.when(F.col("n") == 1, "matched").otherwise("ambiguous").alias("verdict"))


def http_match(calls: DataFrame, index: DataFrame, scratch: Scratch, scoped: bool = False) -> DataFrame:
    """call_id, ep_id, ep_repo, verdict of calls (call_id, method, path; with
    scoped also to_repo, which the entrypoint must be of).

    First the same method and signature; where none, entrypoints whose
    parameters stand for the call's segments, of which the fewest parameters
    win. Ties are ambiguous. no-path: the call has none; no-entrypoint-match:
    nothing answers."""
    c = calls.withColumn("sig", signature(F.col("path"))).withColumn("method", F.upper("method"))
    extra = ["to_repo"] if scoped else []
    on = [F.col("to_repo") == F.col("ep_repo")] if scoped else []
    slim = c.where("sig is not null").select("call_id", F.col("method").alias("m"), F.col("sig").alias("s"), *extra)
    join = lambda a, b, conds: a.join(b, [*conds, *on])
    slim = scratch.keep(slim)
    exact = scratch.keep(_one(join(slim, index, [F.col("m") == F.col("method"), F.col("s") == F.col("sig")]), ["call_id"]))
    rest = slim.join(exact.select("call_id"), "call_id", "left_anti")
    masks = checked_broadcast(index.where("params > 0").select("method", "mask").distinct())
    keyed = rest.withColumn("len", F.size(segments(F.col("s")))).join(masks, (F.col("m") == F.col("method")) & (F.length("mask") == F.col("len"))).select("call_id", "m", *extra, F.col("mask").alias("k_mask"), _masked(F.col("s"), F.col("mask")).alias("key"))
    shaped = index.where("params > 0").select("ep_id", "ep_repo", F.col("method").alias("i_method"), "mask", "params", _masked(F.col("sig"), F.col("mask")).alias("i_key"))
    met = scratch.keep(join(keyed, shaped, [F.col("m") == F.col("i_method"), F.col("k_mask") == F.col("mask"), F.col("key") == F.col("i_key")]).select("call_id", "ep_id", "ep_repo", "params"))
    few = met.groupBy("call_id").agg(F.min("params").alias("least"))
    loose = _one(met.join(few, "call_id").where(F.col("params") == F.col("least")), ["call_id"])
    hits = exact.unionByName(loose)
    out = c.select("call_id", "sig").join(hits, "call_id", "left")
    return out.select("call_id", "ep_id", "ep_repo", F.when(F.col("sig").isNull(), "no-path").otherwise(F.coalesce("verdict", F.lit("no-entrypoint-match"))).alias("verdict"))


def message_match(calls: DataFrame, consumers: DataFrame) -> DataFrame:
    """call_id, ep_id, ep_repo, verdict of messages (call_id, system, value,
    ref) against consumers (ep_id, repo_id, system, destination): the system
    without case and spaces, the destination exactly, the value before the
    reference; a reference is tried only where the value meets nothing."""
    sys = lambda c: F.lower(F.trim(c))
    e = consumers.select("ep_id", F.col("repo_id").alias("ep_repo"), sys(F.col("system")).alias("e_sys"), "destination")
    c = calls.select("call_id", sys(F.col("system")).alias("c_sys"), "value", "ref")
    meet = lambda rows, by: _one(rows.join(e, (F.col("c_sys") == F.col("e_sys")) & (F.col(by) == F.col("destination"))), ["call_id"])
    first = meet(c, "value")
    second = meet(c.join(first.select("call_id"), "call_id", "left_anti"), "ref")
    out = c.join(first.unionByName(second), "call_id", "left")
    none = F.when(F.col("value").isNull() & F.col("ref").isNull(), "no-destination").otherwise("no-messaging-match")
    return out.select("call_id", "ep_id", "ep_repo", F.coalesce("verdict", none).alias("verdict"))


def longest_prefix(rows: DataFrame, key: str, path: str, prefixes: DataFrame) -> DataFrame:
    """key, owner, prefix: the owner of the longest prefix (prefixes: prefix,
    owner) that a path begins with, at a segment boundary; owner is null where
    several own it. A path meets its own few prefixes, by equality, and each
    once however many own it."""
    owned = Scratch(rows.sparkSession, "prefixes").keep(prefixes.groupBy("prefix").agg(F.count_distinct("owner").alias("n"), F.min("owner").alias("o")))
    parts = F.split(F.col(path), "/")
    begins = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    own = rows.where(F.col(path).isNotNull()).select(key, F.explode(begins).alias("prefix")).where("prefix <> ''")
    met = own.join(F.broadcast(owned), "prefix") if small(owned) else skew_join(own, owned, ["prefix"])
    best = met.groupBy(key).agg(F.max_by(F.struct("prefix", "n", "o"), F.length("prefix")).alias("b"))
    return best.select(key, F.when(F.col("b.n") == 1, F.col("b.o")).alias("owner"), F.col("b.prefix").alias("prefix"))


def hop(calls: DataFrame, entrypoints: DataFrame, services: DataFrame, strip: tuple[str, ...] = ()) -> DataFrame:
    """call_id, ep_id, ep_repo, verdict, via: first among the entrypoints of
    the repository the service names (services: service, repo_id), then, only
    where none answers, among all, then with a gateway prefix taken off.
    Ambiguity is final."""
    scratch = Scratch(calls.sparkSession, "hop")
    index = scratch.keep(entry_index(entrypoints))
    names = services.select(F.lower(F.trim("service")).alias("_s"), F.col("repo_id").alias("to_repo")).groupBy("_s").agg(F.min("to_repo").alias("to_repo"), F.count_distinct("to_repo").alias("_n")).where("_n = 1").drop("_n")
    aimed = scratch.keep(calls.withColumn("_s", F.lower(F.trim("service"))).join(checked_broadcast(scratch.keep(names)), "_s", "left").drop("_s"))
    scoped = http_match(aimed.where("to_repo is not null"), index, scratch, scoped=True).withColumn("via", F.lit("scoped"))
    final = scratch.keep(scoped.where("verdict <> 'no-entrypoint-match'"))
    rest = scratch.keep(aimed.drop("to_repo").join(final.select("call_id"), "call_id", "left_anti"))
    wide = scratch.keep(http_match(rest, index, scratch).withColumn("via", F.lit("direct")))
    done = final.unionByName(wide.where("verdict <> 'no-entrypoint-match'"))
    left = wide.where("verdict = 'no-entrypoint-match'")
    if not strip:
        return done.unionByName(left)
    pattern = "^(?:" + "|".join(strip) + ")(?=/)"
    again = rest.join(left.select("call_id"), "call_id", "left_semi").withColumn("path", F.regexp_replace("path", pattern, ""))
    return done.unionByName(http_match(again, index, scratch).withColumn("via", F.lit("strip")))


def symbol_hop(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """call_id, target_id, tier, confidence: the symbol a reference names.
    refs: call_id, precise, owner, method. symbols: target_id and the same
    keys. Each tier is tried where the one before has no sole candidate."""
    out, rest = None, refs
    for tier, confidence in SYMBOL_CONFIDENCE.items():
        sole = symbols.where(F.col(tier).isNotNull()).groupBy(tier).agg(F.count_distinct("target_id").alias("n"), F.min("target_id").alias("target_id")).where("n = 1").drop("n")
        hit = rest.join(sole, tier).select("call_id", "target_id", F.lit(tier).alias("tier"), F.lit(confidence).alias("confidence"))
        out = hit if out is None else out.unionByName(hit)
        rest = rest.join(sole.select(tier), tier, "left_anti")
    return out


def call_edge_hop(calls: DataFrame, callees: DataFrame) -> DataFrame:
    """call_id, callee_id: the only callee of the caller whose name is the
    call's method. calls: call_id, caller_id, method. callees: caller_id,
    callee_id, name."""
    met = calls.join(callees, (calls.caller_id == callees.caller_id) & (calls.method == callees.name)).select("call_id", "callee_id").distinct()
    return met.groupBy("call_id").agg(F.count(F.lit(1)).alias("n"), F.min("callee_id").alias("callee_id")).where("n = 1").select("call_id", "callee_id")


def mapping_hop(calls: DataFrame, mappings: DataFrame) -> DataFrame:
    """call_id, route, tier: a mapping row by class and method, by package and
    method, by method; a key with several routes maps nothing."""
    out, rest = None, calls
    for tier, keys in (("class", ["sdk_class", "method"]), ("package", ["sdk_package", "method"]), ("method", ["method"])):
        sole = checked_broadcast(mappings.dropna(subset=keys).groupBy(*keys).agg(F.count_distinct("route").alias("n"), F.min("route").alias("route")).where("n = 1").drop("n"))
        hit = rest.join(sole, keys).select("call_id", "route", F.lit(tier).alias("tier"))
        out = hit if out is None else out.unionByName(hit)
        rest = rest.join(hit.select("call_id"), "call_id", "left_anti")
    return out


def rewrite_service(path: Column, rules: list[tuple[str, int]]) -> Column:
    """The service that the first matching rule (pattern, group) takes from a path."""
    out = F.lit(None).cast("string")
    for pattern, group in reversed(rules):
        out = F.when(path.rlike(pattern), F.regexp_extract(path, pattern, group)).otherwise(out)
    return out


def edges_of(hops: DataFrame, calls: DataFrame) -> DataFrame:
    """Edges of matched hops: edge_id, call_id, ep_id, via, confidence, level
    (exact from 1.0 on). An http call into its own repository gives none, a
    message does."""
    h = hops.where("ep_id is not null").join(calls.select("call_id", "repo_id", "protocol"), "call_id")
    h = h.where((F.col("repo_id") != F.col("ep_repo")) | (F.col("protocol") != "http"))
    return h.select(F.concat(F.lit("resolve:"), "call_id", F.lit(":"), "ep_id").alias("edge_id"), "call_id", "ep_id", F.concat_ws("+", "via", "protocol").alias("via"), "confidence", F.when(F.col("confidence") >= 1.0, "exact").otherwise("inferred").alias("level"))


def link_metrics(edges: DataFrame, calls: DataFrame, unresolvable: DataFrame) -> DataFrame:
    """repo_id, n_calls, n_excluded, n_edges, rate = edges over the calls that
    count (null where none does). Calls to unresolvable services (service) do
    not count."""
    bad = checked_broadcast(unresolvable.select("service").distinct().withColumn("bad", F.lit(True)))
    c = calls.join(bad, "service", "left").join(edges.select("call_id", F.lit(1).alias("hit")).distinct(), "call_id", "left")
    n, x, e = F.count(F.lit(1)), F.count("bad"), F.count(F.when(F.col("bad").isNull(), F.col("hit")))
    return c.groupBy("repo_id").agg(n.alias("n_calls"), x.alias("n_excluded"), e.alias("n_edges"), F.round(F.try_divide(e, n - x), 6).alias("rate"))


def unresolved_services(calls: DataFrame, edges: DataFrame, services: DataFrame) -> DataFrame:
    """service, n_unresolved, likely_missing: services of calls without an
    edge, most first; no repository of that name is known."""
    u = calls.join(edges.select("call_id"), "call_id", "left_anti").groupBy(F.trim("service").alias("service")).agg(F.count(F.lit(1)).alias("n_unresolved"))
    known = checked_broadcast(services.select(F.trim("service").alias("service"), F.lit(True).alias("k")).distinct())
    return u.join(known, "service", "left").select("service", "n_unresolved", F.col("k").isNull().alias("likely_missing"))


def import_links(imports: DataFrame, packages: DataFrame, declarations: DataFrame) -> DataFrame:
    """file_id, decl_id: named imports (file_id, repo_id, module, name) to the
    exported declaration (decl_id, package, repo_id, name) of the package with
    the longest name that the module begins with; another repository's, and
    the only one of its name there. packages: package."""
    owned = longest_prefix(imports.withColumn("_k", F.struct("file_id", "repo_id", "module", "name")), "_k", "module", packages.select(F.col("package").alias("prefix"), F.col("package").alias("owner")))
    want = owned.where("owner is not null").select("_k.file_id", F.col("_k.repo_id").alias("from_repo"), "_k.name", F.col("owner").alias("package"))
    d = declarations.select("decl_id", "package", "name", "repo_id").distinct().groupBy("package", "name").agg(F.count_distinct("decl_id").alias("n"), F.min("decl_id").alias("decl_id"), F.min("repo_id").alias("decl_repo")).where("n = 1")
    return want.join(d, ["package", "name"]).where("from_repo <> decl_repo").select("file_id", "decl_id").distinct()


def table_diff(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, change (added, removed, changed) between two tables with one row
    for each key; null is a value."""
    side = lambda df, p: df.select(*keys, F.struct(*[F.col(c) for c in columns]).alias(p))
    j = side(old, "o").join(side(new, "n"), keys, "full_outer")
    return j.where(~F.col("o").eqNullSafe(F.col("n"))).select(*keys, F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("changed").alias("change"))
