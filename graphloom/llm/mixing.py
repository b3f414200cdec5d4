"""Mixing sources to target weights, by min-cost flow.

Every document supplies its tokens to its own source; the sources that hold
its text are its membership pattern. Patterns supply tokens, sources demand
their share of the total, and every further use of a pattern's texts costs
more, so that a text which several sources hold is repeated last and repeats
are spread evenly. The flow is solved over patterns; documents are then picked
in a seeded order by their place on the token line."""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import Scratch, prefix_sums, skew_join
from .bpe import FOLDER, token_count


class Flow:
    """Min-cost flow with successive shortest paths; for small networks."""

    def __init__(self) -> None:
        self.out: dict[object, list[int]] = {}
        self.to: list[object] = []
        self.cap: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: object, b: object, cap: int, cost: int = 0) -> int:
        """Add an arc and its reverse; returns its number."""
        for u, v, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.out.setdefault(u, []).append(len(self.to))
            self.out.setdefault(v, [])
            self.to.append(v)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def used(self, arc: int) -> int:
        """Flow on an arc."""
        return self.cap[arc ^ 1]

    def run(self, s: object, t: object) -> int:
        """Send as much as possible at the least cost; returns the amount."""
        sent = 0
        while True:
            dist, via, queue, waiting = {s: 0}, {}, deque([s]), {s}
            while queue:
                u = queue.popleft()
                waiting.discard(u)
                for e in self.out[u]:
                    v = self.to[e]
                    if self.cap[e] > 0 and dist[u] + self.cost[e] < dist.get(v, math.inf):
                        dist[v], via[v] = dist[u] + self.cost[e], e
                        if v not in waiting:
                            waiting.add(v)
                            queue.append(v)
            if t not in via:
                return sent
            path, v = [], t
            while v != s:
                path.append(via[v])
                v = self.to[via[v] ^ 1]
            amount = min(self.cap[e] for e in path)
            for e in path:
                self.cap[e] -= amount
                self.cap[e ^ 1] += amount
            sent += amount


@dataclass
class Plan:
    """Tokens routed from patterns to sources, and the total aimed at."""

    total: int
    quota: dict[str, int]
    routed: dict[tuple[str, str], int]


#: Patterns at most; those beyond the largest are routed as their sources apart, without the cost of a shared text.
PATTERNS = 4096


def _solve(texts: dict[str, int], supply: dict[tuple[str, str], int], repeats: dict[str, int], quota: dict[str, int]) -> tuple[int, dict]:
    net = Flow()
    net.arc("s", "t", 0)
    arcs = {}
    for p, size in texts.items():
        room = sum(n * repeats[s] for (q, s), n in supply.items() if q == p)
        # convex: each use of the whole pattern costs one more than the use before
        for use in range(max(1, min(8, -(-room // size)))):
            net.arc("s", ("p", p), size, use)
        net.arc("s", ("p", p), room, 8)
    for (p, s), n in supply.items():
        arcs[p, s] = net.arc(("p", p), ("q", s), n * repeats[s])
    for s, q in quota.items():
        net.arc(("q", s), "t", q)
    return net.run("s", "t"), {k: net.used(a) for k, a in arcs.items()}


def plan_flow(texts: dict[str, int], supply: dict[tuple[str, str], int], weights: dict[str, float], repeats: dict[str, int], total: int | None = None) -> Plan:
    """Route tokens to sources. texts: tokens of the distinct texts of each
    pattern. supply: tokens of the documents of a source in a pattern. Without
    a total, the largest is taken at which every source with text and weight
    gets its full share."""
    supply = {(p, s): n for (p, s), n in supply.items() if n > 0 and weights[s] > 0 and repeats[s] > 0}
    have = {s: sum(n for (_, x), n in supply.items() if x == s) * repeats[s] for s in {s for _, s in supply}}
    weight = sum(weights[s] for s in have)
    if not have:
        return Plan(0, {}, {})
    texts = {p: n for p, n in texts.items() if any(q == p for q, _ in supply)}
    if total is None:
        # a document serves its own source, so the scarcest source bounds the whole
        total = int(min(have[s] * weight / weights[s] for s in have))
    quota = {s: min(have[s], int(total * weights[s] / weight)) for s in sorted(have)} if total else {}
    return Plan(total, quota, _solve(texts, supply, repeats, quota)[1])


def targets_of(targets: DataFrame) -> list:
    """Rows (source, weight, max_repeats) of the target table, one for each
    source: the greatest weight, then the greatest cap. A null or negative
    weight is 0, a null cap is 1. The table names sources and is small."""
    t = targets.where("source is not null").select("source", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("max_repeats"))
    return t.groupBy("source").agg(F.max(F.struct("weight", "max_repeats")).alias("x")).select("source", "x.*").orderBy("source").collect()


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 1, folder: str = FOLDER) -> DataFrame:
    """doc_id, source, uses, n_tokens: the documents of the mix, how often
    each is used (1 to max_repeats of its source) and its size in tokens.

    Every document is supply of its own source, also where others hold the same
    text; the first document of a text in its source comes before its copies.
    Sources without text or weight get nothing, the others share the total by
    weight. A document counts where most of it lies within the share, so a
    share is met up to half a document for each pattern. Null and empty texts
    have no tokens and are never used. A repeated doc_id counts once, with its
    least source and text hash."""
    scratch = Scratch(documents.sparkSession, "mixing")
    rows = {r.source: r for r in targets_of(targets)}
    weights = {s: float(r.weight) for s, r in rows.items()}
    repeats = {s: int(r.max_repeats) for s, r in rows.items()}
    spark = documents.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(s,) for s in rows] or [("",)], "source string"))
    docs = documents.where("doc_id is not null and text <> ''").select("doc_id", "source", "text").join(wanted, "source")
    # counted before any shuffle and kept, so each text is encoded once and no text is moved
    sized = scratch.keep(docs.select("doc_id", "source", F.sha2("text", 256).alias("key"), token_count(F.col("text"), folder=folder).alias("n_tokens")))
    once = sized.where("n_tokens > 0").groupBy("doc_id").agg(F.min(F.struct("source", "key", "n_tokens")).alias("d")).select("doc_id", "d.*")
    held = once.groupBy("key", "source").agg(F.min("doc_id").alias("first"), F.max("n_tokens").alias("size"))
    shared = held.groupBy("key").agg(F.array_join(F.sort_array(F.collect_set("source")), "\u0001").alias("pattern"))
    known = scratch.keep(held.join(shared, "key").select("key", "source", "first", "pattern", "size"))
    records = scratch.keep(skew_join(once, known, ["key", "source"]).select("doc_id", "source", "pattern", "n_tokens", (F.col("doc_id") != F.col("first")).alias("copy")))
    large = known.groupBy("pattern").agg(F.sum("size").alias("n")).orderBy(F.desc("n"), "pattern").limit(PATTERNS + 1).collect()
    if len(large) > PATTERNS:
        records = scratch.keep(records.withColumn("pattern", F.when(F.col("pattern").isin([r.pattern for r in large[:PATTERNS]]), F.col("pattern")).otherwise(F.col("source"))))
    supply = {(r.pattern, r.source): int(r.n) for r in records.groupBy("pattern", "source").agg(F.sum("n_tokens").alias("n")).collect()}
    texts = {r.pattern: int(r.n) for r in records.where("not copy").groupBy("pattern").agg(F.max("n_tokens"), F.sum("n_tokens").alias("n")).collect()}
    texts = {p: max(1, n // max(1, p.count("\u0001") + 1)) for p, n in texts.items()}
    plan = plan_flow(texts, supply, weights, repeats, total)
    spans = [(f"{p}\u0002{s}", n, supply[p, s], repeats[s]) for (p, s), n in plan.routed.items() if n]
    line = records.select("doc_id", "source", "n_tokens", F.concat_ws("\u0002", "pattern", "source").alias("part"), F.struct("copy", F.xxhash64(F.lit(seed), "doc_id").alias("o")).alias("_o"))
    line = prefix_sums(line.select("doc_id", "source", "n_tokens", "part", F.col("_o.copy").cast("int").alias("_c"), F.col("_o.o").alias("_o")), "part", ["_c", "_o", "doc_id"], "n_tokens", scratch)
    table = F.broadcast(spark.createDataFrame(spans, "part string, share long, lap long, cap int"))
    # a document is used once for every lap of the line on which its middle lies within the share
    middle = F.col("before") + F.col("n_tokens") / 2
    picked = line.join(table, "part").withColumn("uses", F.least(F.ceil((F.col("share") - middle) / F.col("lap")), F.col("cap")).cast("int"))
    return picked.where("uses > 0").select("doc_id", "source", "uses", "n_tokens")


def mix_shares(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 1) -> DataFrame:
    """For each source of the targets: weight, max_repeats, target_share (of
    all weights), goal_share (of the weights of sources that have text),
    n_docs, n_uses, n_tokens, most_uses, share (really reached)."""
    spark = documents.sparkSession
    rows = targets_of(targets)
    whole = sum(r.weight for r in rows) or 1.0
    per = {r.source: r for r in mix(documents, targets, total, seed).groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("uses").alias("n_uses"), F.sum(F.col("uses") * F.col("n_tokens")).alias("n_tokens"), F.max("uses").alias("most_uses")).collect()}
    goal = sum(r.weight for r in rows if r.source in per) or 1.0
    reached = sum(r.n_tokens for r in per.values()) or 1
    out = []
    for r in rows:
        x = per.get(r.source)
        n = (x.n_docs, x.n_uses, x.n_tokens, x.most_uses) if x else (0, 0, 0, 0)
        out.append((r.source, float(r.weight), int(r.max_repeats), r.weight / whole, r.weight / goal if x else 0.0, *map(int, n), n[2] / reached))
    return spark.createDataFrame(out, "source string, weight double, max_repeats int, target_share double, goal_share double, n_docs long, n_uses long, n_tokens long, most_uses int, share double")
