"""The most similar vectors of every vector.

A hierarchical k-means tree is fitted on a bounded sample, its lower part on
executors where the collection needs more leaves than the sample can tell
apart, and every vector is filed in a leaf. Every vector then walks the tree
best-bin-first through a priority queue and visits as many leaves as
calibration asks for: the visits are widened until the recall, measured against
brute force for query vectors outside the sample, reaches the target. Leaves
that lie side by side and their visitors meet as a group, to which a visitor is sent
once; crowded groups are spread over many tasks; equal vectors are searched once.
The groups meet in passes that each send about as many bytes as the vectors have,
so that the disk needed does not grow with the visits."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scale import Scratch, checked_broadcast, skew_join

#: Vectors that a tree is fitted on at most in one place (bound on the driver: 16 MB), and least sample for one leaf.
SAMPLE, LEAF_SAMPLE = 60_000, 24
#: Query vectors that calibration starts with, those it goes up to, and the true pairs it asks for.
PROBES, PROBES_MOST, PAIRS = 2_000, 16_000, 200
#: Children of a tree node, vectors wanted in a leaf, leaves at most (bound on what every task holds: 51 MB), and top leaves that grow on executors.
BRANCH, LEAF, LEAVES, TOP = 16, 1024, 200_000, 512
#: Recall that calibration must reach over the probes.
RECALL = 0.995
#: Vectors and visitors in one block of a group.
BLOCK, VISITORS = 65_536, 131_072
#: Leaves of one group at most, about a block of vectors.
GROUP = BLOCK // LEAF
#: Bytes that one pass of groups may send at least; beyond that, as many as the vectors have.
PASS = 256 << 20


class Tree:
    """A k-means tree of unit vectors. children[i] are the nodes below node i
    (none for a leaf), centers their unit centres by node."""

    def __init__(self) -> None:
        self.centers: list[np.ndarray] = []
        self.children: list[np.ndarray] = []
        self.leaves: list[int] = []
        self.stacked: list[np.ndarray | None] = []

    def fit(self, x: np.ndarray, leaf: int, seed: int = 7) -> Tree:
        """Split the sample until its parts have at most leaf vectors."""
        rng = np.random.default_rng(seed)
        self._add(np.zeros(x.shape[1], dtype=np.float32))
        work = [(0, np.arange(len(x)))]
        while work:
            node, rows = work.pop()
            if len(rows) <= leaf:
                continue
            k = min(BRANCH, -(-len(rows) // leaf) + 1)
            label, centers = kmeans(x[rows], k, rng)
            parts = [rows[label == j] for j in range(k)]
            if max(map(len, parts)) == len(rows):
                continue
            below = []
            for part, center in zip(parts, centers):
                if len(part):
                    below.append(self._add(center))
                    work.append((below[-1], part))
            self.children[node] = np.array(below)
        return self.seal()

    def _add(self, center: np.ndarray) -> int:
        self.centers.append(center)
        self.children.append(np.zeros(0, dtype=int))
        return len(self.centers) - 1

    def seal(self) -> Tree:
        """Number the leaves and stack the centres below each node."""
        self.leaves = [i for i, c in enumerate(self.children) if not len(c)]
        self.number = {n: i for i, n in enumerate(self.leaves)}
        self.stacked = [np.stack([self.centers[j] for j in c]) if len(c) else None for c in self.children]
        self.group = self._groups()
        return self

    def _groups(self) -> np.ndarray:
        """Group of each leaf: parts of the tree, side by side below one node,
        with at most GROUP leaves together, and at least about 16 groups.
        Children have greater numbers than their parent."""
        most = max(1, min(GROUP, len(self.leaves) // 16))
        size = np.array([not len(c) for c in self.children], dtype=np.int64)
        for i in range(len(self.children) - 1, -1, -1):
            if len(self.children[i]):
                size[i] = size[self.children[i]].sum()
        group, made = np.zeros(len(self.children), dtype=np.int32), 0
        for i, c in enumerate(self.children):
            if size[i] <= most:
                group[c] = group[i]
                continue
            held = most
            for j in c:
                if size[j] <= most:
                    made, held = (made + 1, size[j]) if held + size[j] > most else (made, held + size[j])
                    group[j] = made
        return group[self.leaves]

    def graft(self, parts: dict[int, list[tuple[int, int, bytes]]]) -> Tree:
        """Put grown subtrees in the place of leaves: by leaf number the rows
        (node, parent, center) of a subtree, its root 0 being the leaf."""
        old = list(self.leaves)
        for number, rows in parts.items():
            at = {0: old[number]}
            below: dict[int, list[int]] = {}
            for node, parent, center in sorted(rows):
                if node:
                    at[node] = self._add(np.frombuffer(center, dtype=np.float32))
                    below.setdefault(parent, []).append(at[node])
            for parent, nodes in below.items():
                self.children[at[parent]] = np.array(nodes)
        return self.seal()

    def file(self, x: np.ndarray) -> np.ndarray:
        """Leaf numbers of vectors, by the nearest centre at each level."""
        out = np.zeros(len(x), dtype=np.int32)
        work = [(0, np.arange(len(x)))]
        while work:
            node, rows = work.pop()
            if self.stacked[node] is None:
                out[rows] = self.number[node]
                continue
            near = (x[rows] @ self.stacked[node].T).argmax(axis=1)
            for j in np.unique(near):
                work.append((int(self.children[node][j]), rows[near == j]))
        return out

    def visit(self, v: np.ndarray, count: int) -> list[int]:
        """The first count leaves that best-bin-first traversal reaches: the
        queue holds unvisited branches by their similarity to v."""
        queue: list[tuple[float, int]] = [(0.0, 0)]
        out: list[int] = []
        while queue and len(out) < count:
            node = heapq.heappop(queue)[1]
            centers = self.stacked[node]
            if centers is None:
                out.append(self.number[node])
                continue
            for s, child in zip((-(centers @ v)).tolist(), self.children[node].tolist()):
                heapq.heappush(queue, (s, child))
        return out


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: labels and unit centres."""
    centers = x[rng.choice(len(x), k, replace=False)]
    label = np.zeros(len(x), dtype=int)
    for _ in range(steps):
        label = (x @ centers.T).argmax(axis=1)
        order = np.argsort(label, kind="stable")
        used, first = np.unique(label[order], return_index=True)
        sums = np.zeros((k, x.shape[1]))
        sums[used] = np.add.reduceat(x[order].astype(np.float64), first, axis=0)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centers).astype(np.float32)
    return (x @ centers.T).argmax(axis=1), centers


def _stack(packed: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(packed), dtype=np.float32).reshape(len(packed), -1)


def usable_vectors(rows: DataFrame, width: int) -> DataFrame:
    """id and v (unit vector, packed 32-bit floats), one row for each id: the
    least of its usable vectors. Usable are arrays of exactly width finite
    numbers that are not all zero; a null id is no row."""

    @F.pandas_udf(T.BinaryType())
    def pack(vectors: pd.Series) -> pd.Series:
        a = np.stack(vectors.to_numpy()).astype(np.float64)
        a /= np.abs(a).max(axis=1, keepdims=True)
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        return pd.Series([r.tobytes() for r in a.astype(np.float32)])

    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = rows.where("id is not null").select("id", e.alias("embedding")).where((F.size("embedding") == width) & F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda x: x != 0))
    return good.groupBy("id").agg(F.min("embedding").alias("embedding")).select("id", pack("embedding").alias("v"))


def _draw(column: str, seed: int, share: float) -> Column:
    """A share of the rows by a hash, the same whatever the layout."""
    return F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(1 << 32)) < F.lit(int(min(1.0, share) * (1 << 32)))


def _near(s: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of similarities of at least least; of rows with many,
    the k greatest at least."""
    if least > -1 and (many := np.count_nonzero(s >= least)) <= 4 * k * len(s):
        return np.nonzero(s >= least) if many else (np.zeros(0, dtype=int), np.zeros(0, dtype=int))
    top = np.argpartition(-s, k - 1, axis=1)[:, :k] if s.shape[1] > k else np.broadcast_to(np.arange(s.shape[1]), s.shape)
    i, j = np.repeat(np.arange(len(s)), top.shape[1]), top.ravel()
    ok = s[i, j] >= least
    return i[ok], j[ok]


def _truth(reps: DataFrame, probes: list, k: int, least: float, tree: Tree) -> DataFrame:
    """Exact neighbours of the probe vectors by brute force over all vectors:
    probe, gid, s and the leaf of the neighbour. The probes are bounded, so
    each task holds them and passes its vectors in blocks."""
    names = [r.gid for r in probes]
    q = np.frombuffer(b"".join(bytes(r.v) for r in probes), dtype=np.float32).reshape(len(probes), -1)

    def scan(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                part = pdf.iloc[at : at + 4096]
                x = _stack(part.v)
                leaf = tree.file(x)
                s = q @ x.T
                # one more than k, as a probe meets itself
                i, j = _near(s, k + 1, least)
                yield pd.DataFrame({"probe": i.astype("int32"), "gid": part.gid.to_numpy()[j], "s": s[i, j].astype("float64"), "leaf": leaf[j]})

    found = reps.select("gid", "v").mapInPandas(scan, "probe int, gid string, s double, leaf int")
    mine = reps.sparkSession.createDataFrame([(i, n) for i, n in enumerate(names)], "probe int, own string")
    w = Window.partitionBy("probe").orderBy(F.desc("s"), "gid")
    return found.join(F.broadcast(mine), "probe").where("gid <> own").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)


class Index:
    """A fitted and calibrated search tree over the vectors of a table."""

    def __init__(self, vectors: DataFrame, k: int = 5, least: float = -1.0, recall: float = RECALL, scratch: Scratch | None = None, leaf: int = LEAF, sample: int = SAMPLE):
        self.k, self.least = k, least
        self.scratch = scratch or Scratch(vectors.sparkSession, "similar")
        keyed = self.scratch.keep(vectors.withColumn("gid", F.md5("v")), free=True)
        # from here on ids and vectors are apart, so that no shuffle takes both along
        self.members = self.scratch.keep(keyed.select("id", "gid"))
        # the first k + 1 ids of each group of equal vectors; Spark limits each group before it shuffles
        ranked = self.members.withColumn("r", F.row_number().over(Window.partitionBy("gid").orderBy("id"))).where(F.col("r") <= k + 1)
        self.heads = self.scratch.keep(ranked, free=True)
        equal = checked_broadcast(self.scratch.keep(self.heads.where("r = 2").select("gid").join(self.heads.where("r = 1").select("gid", F.col("id").alias("first")), "gid"), free=True))
        first = skew_join(keyed, equal, ["gid"], "left").where("first is null or first = id")
        self.reps = self.scratch.keep(first.select("gid", "v"), free=True)
        self.scratch.drop(keyed)
        self.filed: DataFrame | None = None
        self.n = self.reps.count()
        self.leaf = max(leaf, self.n // LEAVES)
        self.tree = Tree()
        self.visits, self.measured, self.pairs = 1, 1.0, 0
        self._fit(sample)
        if self.n:
            self._calibrate(recall)

    def _fit(self, most: int) -> None:
        """Fit the tree; where most vectors cannot tell all leaves apart, grow
        the leaves of a small top tree on executors, each on at most most."""
        share = most / max(1, self.n)
        x = _stack(pd.Series([bytes(r.v) for r in self.reps.where(_draw("gid", 1, share)).collect()])) if self.n else np.zeros((0, 1), dtype=np.float32)
        if not len(x):
            self.tree._add(np.zeros(1, dtype=np.float32))
            self.tree.seal()
            return
        grown = self.n // self.leaf * LEAF_SAMPLE > most
        self.tree.fit(x, max(LEAF_SAMPLE, len(x) // TOP) if grown else max(LEAF_SAMPLE, int(self.leaf * len(x) / self.n)))
        if not grown:
            return
        tree, want, seen = self.tree, LEAF_SAMPLE, 2 * LEAF_SAMPLE / self.leaf

        @F.pandas_udf(T.IntegerType())
        def file(v: pd.Series) -> pd.Series:
            return pd.Series(tree.file(_stack(v)))

        def grow(pdf: pd.DataFrame) -> pd.DataFrame:
            sub = Tree().fit(_stack(pdf.v.iloc[:most]), max(want, 2 * want * most // max(most, len(pdf))))
            above = {int(j): i for i, c in enumerate(sub.children) for j in c}
            return pd.DataFrame({"top": int(pdf.top.iloc[0]), "node": range(len(sub.centers)), "parent": [above.get(i, -1) for i in range(len(sub.centers))], "center": [c.astype(np.float32).tobytes() for c in sub.centers]})

        rows = self.reps.where(_draw("gid", 2, seen)).select("v", file("v").alias("top")).groupBy("top").applyInPandas(grow, "top int, node int, parent int, center binary").collect()
        parts: dict[int, list] = {}
        for r in rows:
            parts.setdefault(r.top, []).append((r.node, r.parent, bytes(r.center)))
        self.tree.graft(parts)

    def _calibrate(self, recall: float) -> None:
        """Widen the visits until the probes' neighbours are found. Where few
        probes have a neighbour, more are drawn."""
        leaves, want, asked = len(self.tree.leaves), PROBES, 0
        ranks: list[int] = []
        while asked < min(self.n, PROBES_MOST) and self.pairs < PAIRS:
            low, high = asked / self.n, min(1.0, want / self.n)
            part = self.reps.where(_draw("gid", 3, high) & ~_draw("gid", 3, low)).collect()
            asked, want = want, min(PROBES_MOST, want * 2)
            # a task holds PROBES query vectors at a time
            for at in range(0, len(part), PROBES):
                probes = part[at : at + PROBES]
                wanted: dict[int, list[int]] = {}
                for r in _truth(self.reps, probes, self.k, self.least, self.tree).select("probe", "leaf").collect():
                    wanted.setdefault(r.probe, []).append(r.leaf)
                for p, found in wanted.items():
                    order = {leaf: i for i, leaf in enumerate(self.tree.visit(np.frombuffer(bytes(probes[p].v), dtype=np.float32), leaves))}
                    ranks += [order[x] for x in found]
                self.pairs = len(ranks)
        if ranks:
            r = np.sort(np.array(ranks))
            self.visits = int(r[min(len(r) - 1, int(np.ceil(recall * len(r))) - 1)]) + 1
            self.measured = float((r < self.visits).mean())

    def _file(self) -> DataFrame:
        """gid, v, leaf and its group, asks: the visits of each vector, one array
        for each group: its number and the leaves to visit there."""
        if self.filed is not None:
            return self.filed
        tree, visits = self.tree, self.visits

        def walk(batches):
            for batch in batches:
                x = np.frombuffer(b"".join(batch.column("v").to_pylist()), dtype=np.float32).reshape(batch.num_rows, -1)
                leaf = tree.file(x)
                flat, ends, outer = [], [0], [0]
                for v in x:
                    seen = np.array(tree.visit(v, visits), dtype=np.int32)
                    of = tree.group[seen]
                    for g in np.unique(of):
                        flat += [[g], seen[of == g]]
                        ends.append(ends[-1] + 1 + len(flat[-1]))
                    outer.append(len(ends) - 1)
                inner = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, dtype=np.int32), *flat]).astype(np.int32)))
                asks = pa.ListArray.from_arrays(pa.array(outer, pa.int32()), inner)
                yield pa.RecordBatch.from_arrays([batch.column("gid"), batch.column("v"), pa.array(leaf, pa.int32()), pa.array(tree.group[leaf], pa.int32()), asks], ["gid", "v", "leaf", "grp", "asks"])

        reps = self.reps
        self.filed = self.scratch.keep(reps.select("gid", "v").mapInArrow(walk, "gid string, v binary, leaf int, grp int, asks array<array<int>>"))
        self.reps = self.filed.select("gid", "v")
        self.scratch.drop(reps)
        return self.filed

    def _passes(self) -> tuple[list[tuple[int, int]], pd.DataFrame]:
        """Ranges of groups that meet in one pass, and by group the blocks of
        its vectors and of its visitors. The driver holds one row a group, of
        which there are fewer than leaves."""
        count = lambda df: df.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).toPandas().set_index("grp").n
        of = pd.DataFrame({"own": count(self.filed), "asks": count(self.filed.select(F.explode("asks").alias("a")).select(F.col("a")[0].alias("grp")))}).dropna().sort_index()
        nb, nq = -(-of.own // BLOCK), -(-of.asks // VISITORS)
        one = 4 * max(1, len(self.tree.centers[0])) + 48
        at = ((of.own * nq + of.asks * nb) * one).cumsum() // max(PASS, self.n * one)
        plan = pd.DataFrame({"grp": of.index.astype(int), "nb": nb.astype(int).to_numpy(), "nq": nq.astype(int).to_numpy()})
        lows = plan.grp.groupby(at.to_numpy()).min().tolist()
        return list(zip(lows, [*lows[1:], 1 << 30])), plan

    def neighbours(self) -> DataFrame:
        """gid, other, s: for each distinct vector its k most similar other
        distinct vectors among the leaves it visits, at least self.least."""
        k, least = self.k, self.least
        filed = self._file()
        passes, plan = self._passes()
        salt = lambda n: F.pmod(F.xxhash64("gid"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))

        def meet(data: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
            none = pd.DataFrame({"gid": pd.Series(dtype=object), "other": pd.Series(dtype=object), "s": pd.Series(dtype=float)})
            if not len(data) or not len(ask):
                return none
            x, q = _stack(data.v), _stack(ask.w)
            ids, names, leaf = data.gid.to_numpy(), ask["ask"].to_numpy(), data.leaf.to_numpy()
            who = np.repeat(np.arange(len(q)), [len(v) for v in ask.leaves])
            where = np.concatenate(ask.leaves.to_list())
            out = []
            for one in np.unique(leaf):
                c_all, r_all = np.flatnonzero(leaf == one), who[where == one]
                for i in range(0, len(r_all), 2048):
                    r_part = r_all[i : i + 2048]
                    # one more than k, as a vector meets itself
                    r, c = _near(q[r_part] @ x[c_all].T, k + 1, least - 1e-6 if least > -1 else least - 1)
                    r, c = r_part[r], c_all[c]
                    other = names[r] != ids[c]
                    r, c = r[other], c[other]
                    if len(r):
                        out.append(pd.DataFrame({"gid": names[r], "other": ids[c], "s": np.einsum("ij,ij->i", q[r].astype(np.float64), x[c].astype(np.float64))}))
            return pd.concat(out) if out else none

        found = None
        for low, high in passes:
            rows = plan[(plan.grp >= low) & (plan.grp < high)]
            here = F.broadcast(filed.sparkSession.createDataFrame(rows.values.tolist(), "grp int, nb int, nq int"))
            within = F.filter("asks", lambda a: (a[0] >= F.lit(low)) & (a[0] < F.lit(high)))
            asked = filed.select("gid", "v", F.explode(within).alias("a")).select("gid", "v", F.col("a")[0].alias("grp"), F.slice("a", 2, F.size("a") - 1).alias("leaves"))
            left = filed.where((F.col("grp") >= low) & (F.col("grp") < high)).join(here, "grp").select("grp", salt("nb").alias("b"), every("nq").alias("q"), "gid", "v", "leaf")
            right = asked.join(here, "grp").select(F.col("grp").alias("grp_"), salt("nq").alias("q_"), every("nb").alias("b_"), F.col("gid").alias("ask"), F.col("v").alias("w"), "leaves")
            met = left.groupBy("grp", "b", "q").cogroup(right.groupBy("grp_", "b_", "q_")).applyInPandas(meet, "gid string, other string, s double")
            one = self.scratch.keep(met, free=True)
            found = one if found is None else found.unionByName(one)
        if found is None:
            return filed.sparkSession.createDataFrame([], "gid string, other string, s double")
        w = Window.partitionBy("gid").orderBy(F.desc("s"), "other")
        return found.where(F.col("s") >= least).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("gid", "other", "s")

    def top(self) -> DataFrame:
        """id, other, s: for each id its k most similar other ids, equal
        similarities by the smaller id. Ids with equal vectors have s 1."""
        near = self.scratch.keep(self.neighbours(), free=True)
        slim = self.heads.select(F.col("gid").alias("other"), F.struct(F.lit(0.0).alias("away"), F.col("id")).alias("h"), "r")
        own = slim.select(F.col("other").alias("gid"), "h")
        others = skew_join(near, self.scratch.keep(slim.where(F.col("r") <= self.k).groupBy("other").agg(F.collect_list("h").alias("hs")), free=True), ["other"])
        more = others.select("gid", F.explode(F.transform("hs", lambda x: F.struct((1 - F.col("s")).alias("away"), x["id"].alias("id")))).alias("h"))
        # at most k + 1 own heads and k * k heads of neighbours for each group
        lists = own.unionByName(more).groupBy("gid").agg(F.sort_array(F.collect_list("h")).alias("hs"))
        mine = skew_join(self.members, lists, ["gid"])
        best = F.slice(F.filter("hs", lambda x: x["id"] != F.col("id")), 1, self.k)
        return mine.select("id", F.explode(best).alias("h")).select("id", F.col("h.id").alias("other"), (1 - F.col("h.away")).alias("s"))


def similar_pairs(rows: DataFrame, width: int = 64, k: int = 5, least: float = 0.9) -> DataFrame:
    """id_a, id_b: pairs where one id is among the k most similar of the other
    with a cosine of at least least; each pair once, the smaller id first."""
    index = Index(usable_vectors(rows, width), k, least)
    top = index.top().where(F.col("s") >= least)
    return top.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def recall_report(rows: DataFrame, width: int = 64, k: int = 5, least: float = 0.9) -> DataFrame:
    """n_true, n_found, recall: the index against brute force for the queries
    whose id hash is divisible by 50, each against all vectors."""
    scratch = Scratch(rows.sparkSession, "recall")
    index = Index(usable_vectors(rows, width), k, least, scratch=scratch)
    probes = scratch.keep(index.reps.where(F.pmod(F.xxhash64("gid"), F.lit(50)) == 0))
    # the query set is passed in blocks: one block of queries against all vectors at a time
    blocks = probes.select("gid", "v", F.pmod(F.xxhash64("gid", F.lit(1)), F.lit(max(1, probes.count() // 2048))).cast("int").alias("blk"))
    parts = [r.blk for r in blocks.select("blk").distinct().collect()]
    exact = None
    for b in parts:
        asked = blocks.where(F.col("blk") == b).collect()
        names = rows.sparkSession.createDataFrame([(i, r.gid) for i, r in enumerate(asked)], "probe int, me string")
        one = scratch.keep(_truth(index.reps, asked, k, least, index.tree).join(F.broadcast(names), "probe").select(F.col("me").alias("gid"), F.col("gid").alias("other")))
        exact = one if exact is None else exact.unionByName(one)
    if exact is None:
        return rows.sparkSession.createDataFrame([(0, 0, 1.0)], "n_true long, n_found long, recall double")
    hit = exact.join(index.neighbours().select("gid", "other", F.lit(1).alias("hit")), ["gid", "other"], "left")
    return hit.agg(F.count(F.lit(1)).alias("n_true"), F.count("hit").alias("n_found")).withColumn("recall", F.when(F.col("n_true") == 0, 1.0).otherwise(F.col("n_found") / F.col("n_true")))
