"""Min-hash banding over word shingles and hashes of what precedes a word, for
whole batches of texts at once; and links by them without pairs of all members."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import Scratch

#: Words in a shingle, bands, and hashes in a band: a pair of similarity 0.8
#: shares a band with probability 1 - (1 - 0.8 ** 4) ** 12 > 0.998.
WORDS, BANDS, ROWS = 5, 12, 4
#: Words that stand for the end of a text.
CLOSING = 8
#: Words before the last one that a text is aligned by.
ANCHOR = 3
#: Characters that are hashed at a time.
CHUNK = 4_000_000

_U = np.uint64


def mixed(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers."""
    with np.errstate(over="ignore"):
        x = (np.arange(1, n + 1, dtype=_U) + _U(seed) * _U(0x9E3779B9)) * _U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return (x ^ (x >> _U(31))) | _U(1)


def words_of(text: str) -> list[str]:
    """Words of a text without case."""
    return text.lower().split()


class Hashes:
    """Hashes of a batch of texts, flat over all their words: start and count
    say where each text's words lie."""

    def __init__(self, words: list[list[str]]):
        self.count = np.array([len(w) for w in words], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.count)[:-1]]).astype(np.int64) if len(words) else np.zeros(0, dtype=np.int64)
        self.flat = [x for w in words for x in w]
        n = len(self.flat)
        self.h = pd.util.hash_array(np.array(self.flat, dtype=object), categorize=True) if n else np.zeros(0, dtype=_U)
        self.place = np.arange(n, dtype=np.int64) - np.repeat(self.start, self.count)

    def shingles(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the word shingles, with start and count for each text; a
        text of fewer words is one shingle, a blank text has none."""
        n = len(self.h)
        out = np.zeros(n, dtype=_U)
        left = np.repeat(self.count, self.count) - self.place
        with np.errstate(over="ignore"):
            for j, m in enumerate(mixed(WORDS, 1)):
                out[: n - j] += np.where(left[: n - j] > j, self.h[j:] * m, _U(0))
            out ^= out >> _U(29)
        full = (left >= WORDS) | (self.place == 0)
        count = np.where(self.count == 0, 0, np.maximum(1, self.count - WORDS + 1))
        start = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64) if len(count) else count
        return out[full], start, count

    def bands(self) -> np.ndarray:
        """One 64-bit key for each band of each text; rows of blank texts are 0."""
        s, start, count = self.shingles()
        out = np.zeros((len(count), BANDS), dtype=np.int64)
        some = count > 0
        if not some.any():
            return out
        keep, mult = mixed(ROWS, 3), mixed(BANDS * ROWS, 2)
        with np.errstate(over="ignore"):
            for b in range(BANDS):
                key = np.zeros(int(some.sum()), dtype=_U)
                for r in range(ROWS):
                    x = s * mult[b * ROWS + r]
                    x ^= x >> _U(31)
                    x *= _U(0x9E3779B97F4A7C15)
                    key += np.minimum.reduceat(x, start[some]) * keep[r]
                out[some, b] = (key ^ (key >> _U(29))).view(np.int64)
        return out

    def before(self) -> np.ndarray:
        """For every word a key of all words before it in its text."""
        if not len(self.h):
            return np.zeros(0, dtype=np.int64)
        with np.errstate(over="ignore"):
            weighted = self.h * mixed(int(self.count.max(initial=0)), 4)[self.place]
            run = np.cumsum(weighted, dtype=_U) - weighted
            run = run - np.repeat(run[np.minimum(self.start, len(run) - 1)], self.count)
            return (run + self.place.astype(_U) * _U(0x9E3779B97F4A7C15)).view(np.int64)

    def closing(self, words: int = CLOSING) -> np.ndarray:
        """For every word a key of so many words before it; meaningless where
        there are fewer."""
        n, out = len(self.h), np.zeros(len(self.h), dtype=_U)
        with np.errstate(over="ignore"):
            for j, m in enumerate(mixed(words, 5), 1):
                out[j:] += self.h[: n - j] * m
            return (out ^ (out >> _U(29))).view(np.int64)


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about CHUNK characters each."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def shingle_set(words: list[str]) -> np.ndarray:
    """Distinct shingle hashes of one list of words."""
    return np.unique(Hashes([words]).shingles()[0])


def buckets(made: DataFrame) -> DataFrame:
    """tid, bucket from made (tid, bands): the band buckets of two texts or more."""
    rows = made.select("tid", F.posexplode("bands").alias("band", "key")).select("tid", F.xxhash64("band", "key").alias("bucket"))
    return rows.join(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket"), "bucket", "left_semi")


def _spots(made: DataFrame, keys: list) -> DataFrame:
    """tid, p, word, before, more, key, loose from made: the words of the texts
    by place, more being whether others follow, once for each (key, loose)."""
    # zipped, so that a row takes no array along
    spots = made.select("tid", "n", F.posexplode(F.arrays_zip("words", "before", "closing", "near")).alias("p", "x"))
    pairs = F.array_compact(F.array(*[F.when(at, F.struct(key.alias("key"), F.lit(loose).alias("loose"))) for at, key, loose in keys]))
    keyed = spots.select("tid", "p", F.col("x.words").alias("word"), F.col("x.before").alias("before"), (F.col("p") < F.col("n") - 1).alias("more"), pairs.alias("keys"))
    return keyed.where(F.size("keys") > 0).select("tid", "p", "word", "before", "more", F.explode("keys").alias("k")).select("tid", "p", "word", "before", "more", "k.*")


def _band_keys(batches):
    for batch in batches:
        bands = Hashes(batch.column("words").to_pylist()).bands()
        steps = pa.array(np.arange(0, bands.size + 1, BANDS), pa.int32())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "w", "hub", "other")), pa.ListArray.from_arrays(steps, pa.array(bands.ravel(), pa.int64()))], ["key", "w", "hub", "other", "bands"])


def _links(spots: DataFrame, made: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct (tid, hub) from spots: each text with the texts that have its
    last key and there go on, its last word being the beginning of theirs. Texts
    that begin alike up to there and go on alike (within the word or after it)
    stand or fall together when they are aligned, so one of them is given; no
    beginning is left out. So a family with a shared beginning gives few links
    a text, whatever its size. Where the key is loose, so that texts of any
    beginning can have it, the beginning must share a band with the text."""
    ends = scratch.keep(spots.where("not more").select("tid", "key", F.xxhash64("word").alias("w"), "word", "loose"), free=True)
    begun = F.transform(
        F.sequence(F.lit(1), F.length("word")),
        lambda i: F.struct(F.xxhash64(F.substring("word", F.lit(1), i)).alias("w"), F.substring("word", i + 1, F.lit(1)).rlike(r"^[\p{L}\p{N}]").alias("mid"), (i == F.length("word")).alias("full")),
    )
    met = spots.join(ends.select("key").distinct(), "key", "left_semi").select("tid", "p", "key", "before", "loose", "more", F.explode(begun).alias("x")).where("more or not x.full")
    # two of each, as one of them can be the text itself
    grouped = met.select("*", "x.w", "x.mid").groupBy("key", "w", "before", "mid", "loose").agg(F.min("p").alias("p"), F.min("tid").alias("hub"), F.max("tid").alias("other"))
    hubs = scratch.keep(grouped.join(ends.groupBy("key", "w").agg(F.min("word").alias("word")), ["key", "w"]), free=True)
    pick = F.when(F.col("hub") == F.col("tid"), F.col("other")).otherwise(F.col("hub")).alias("hub")
    close = ends.where("not loose").select("tid", "key", "w").join(hubs.where("not loose").select("key", "w", "hub", "other"), ["key", "w"]).select("tid", pick)
    beginnings = hubs.where("loose").join(made.select(F.col("tid").alias("hub"), "words"), "hub").select("key", "w", "hub", "other", F.concat(F.slice("words", F.lit(1), F.col("p")), F.array("word")).alias("words"))
    theirs = beginnings.mapInArrow(_band_keys, "key long, w long, hub long, other long, bands array<long>")
    mine = ends.where("loose").select("tid", "key", "w").join(made.select("tid", "bands"), "tid")
    banded = lambda df, *c: df.select(*c, "key", "w", F.posexplode("bands").alias("band", "b")).select(*c, F.xxhash64("key", "w", "band", "b").alias("bucket"))
    near = banded(mine, "tid").join(banded(theirs, "hub", "other"), "bucket").select("tid", pick)
    return close.unionByName(near).where("hub <> tid").distinct()


def band_links(made: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct (tid, hub) from made (tid, n, words, before, closing, near,
    bands): each text with the texts of its band buckets that can go on where it
    ends, as they have its last words; see _links."""
    shared = scratch.keep(buckets(made), free=True)
    members = made.join(shared.select("tid").distinct(), "tid", "left_semi")
    near = scratch.keep(_spots(members, [(F.col("p") >= ANCHOR, F.col("x.near"), False)]), free=True)
    # words without their like at the end of a text of some bucket are not sent to the buckets
    near = near.join(near.where("not more").select("key").distinct(), "key", "left_semi")
    return _links(scratch.keep(near.join(shared, "tid").select("tid", "p", "word", "before", "more", "loose", F.xxhash64("bucket", "key").alias("key")), free=True), made, scratch)


def beginning_links(made: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct (tid, hub) from made (tid, n, words, before, closing, near,
    bands): each text with the texts that have the same words before its last
    word and there go on. The same words are all before (from WORDS on) or the
    CLOSING ones, after a beginning that shares a band; see _links."""
    return _links(_spots(made, [(F.col("p") >= WORDS, F.col("x.before"), False), (F.col("p") >= CLOSING, F.col("x.closing"), True)]), made, scratch)
