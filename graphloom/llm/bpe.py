"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Pre-tokens are merged through a hierarchical-bitmap rank queue: for each merge
rank a bucket holds the linked-list positions whose pair has that rank, three
levels of 64-bit words say which buckets are filled, and find-first-set gives
the next rank. Entries whose pair has changed since are stale and skipped. A
pre-token of n bytes takes O(n) queue steps, however long it is."""

from __future__ import annotations

import base64
import functools
import os

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the public pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Default place of the vocabularies; a parameter of every function here.
FOLDER = os.environ.get("GRAPHLOOM_TOKENIZERS", "/opt/tokenizers")
#: Encoded pre-tokens one worker keeps before it starts its memory anew, and their longest length in bytes.
MEMORY, MEMORY_BYTES = 200_000, 64


def load_ranks(path: str) -> dict[bytes, int]:
    """The token ids of a rank file, which are also the merge ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class RankQueue:
    """Positions by rank, smallest rank first."""

    def __init__(self, ranks: int):
        words = (ranks >> 6) + 1
        self.low = [0] * words
        self.mid = [0] * ((words >> 6) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, at: int) -> None:
        """Add a position to the bucket of a rank."""
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(at)
            return
        self.buckets[rank] = [at]
        w = rank >> 6
        self.low[w] |= 1 << (rank & 63)
        self.mid[w >> 6] |= 1 << (w & 63)
        self.top |= 1 << (w >> 6)

    def pop(self) -> tuple[int, list[int]] | None:
        """The smallest filled rank with its positions in order, or None."""
        if not self.top:
            return None
        m = (self.top & -self.top).bit_length() - 1
        word = self.mid[m]
        w = (m << 6) + (word & -word).bit_length() - 1
        bits = self.low[w]
        rank = (w << 6) + (bits & -bits).bit_length() - 1
        self.low[w] = bits & (bits - 1)
        if not self.low[w]:
            self.mid[m] = word & (word - 1)
            if not self.mid[m]:
                self.top &= self.top - 1
        return rank, sorted(self.buckets.pop(rank))


class Encoder:
    """Encodes texts with one vocabulary, without special tokens."""

    def __init__(self, path: str, pattern: str = PATTERN):
        self.ranks = load_ranks(path)
        self.longest = max(map(len, self.ranks))
        self.queue = RankQueue(max(self.ranks.values()))
        self.split = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token."""
        n, ranks, queue = len(piece), self.ranks, self.queue
        if n < 2:
            return [ranks[piece]] if n else []
        after = list(range(1, n + 1))  # where the part that starts here ends, and the next starts
        before = list(range(-1, n - 1))
        pair = [-1] * n  # rank of the part that starts here with the next one, -1 if none
        for i in range(n - 1):
            r = ranks.get(piece[i : i + 2])
            if r is not None:
                pair[i] = r
                queue.push(r, i)
        while (found := queue.pop()) is not None:
            rank, places = found
            for i in places:
                if pair[i] != rank:
                    continue  # stale
                j = after[i]
                k = after[j]
                after[i] = k
                pair[j] = -1
                h = before[i]
                if k < n:
                    before[k] = i
                    end = after[k]
                    r = ranks.get(piece[i:end]) if end - i <= self.longest else None
                    pair[i] = -1 if r is None else r
                    if r is not None:
                        queue.push(r, i)
                else:
                    pair[i] = -1
                if h >= 0:
                    r = ranks.get(piece[h:k]) if k - h <= self.longest else None
                    pair[h] = -1 if r is None else r
                    if r is not None:
                        queue.push(r, h)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def encode(self, text: str | None) -> list[int]:
        """Token ids of a text; a null and an empty text have none."""
        if not text:
            return []
        out: list[int] = []
        known = self.known
        for piece in self.split(text):
            ids = known.get(piece)
            if ids is None:
                raw = piece.encode("utf-8")
                ids = self.merge(raw)
                if len(raw) <= MEMORY_BYTES:
                    if len(known) >= MEMORY:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each worker and vocabulary."""
    return Encoder(path)


def token_ids(text: Column, vocabulary: str = "byte_bpe_50k", folder: str = FOLDER) -> Column:
    """array<int> of the ids of a text column; null and empty texts give []."""
    path = f"{folder}/{vocabulary}.tiktoken"

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pd.Series) -> pd.Series:
        encode = encoder(path).encode
        return pd.Series([np.array(encode(t), dtype="int32") for t in texts], dtype=object)

    return ids(text)


def token_count(text: Column, vocabulary: str = "byte_bpe_50k", folder: str = FOLDER) -> Column:
    """Number of tokens of a text column; 0 for null and empty texts."""
    path = f"{folder}/{vocabulary}.tiktoken"

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        encode = encoder(path).encode
        return pd.Series([len(encode(t)) for t in texts], dtype="int64")

    return count(text)


def encode_documents(documents: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """doc_id, ids: every row of documents, whole texts. Repeated rows stay
    repeated; extra columns are dropped; an empty table gives no rows. The
    vocabulary file must be readable on every executor under folder."""
    return documents.select("doc_id", token_ids(F.col("text"), vocabulary, folder).alias("ids"))
