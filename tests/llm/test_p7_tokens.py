"""Encoding against the public encoder of the same vocabulary, and round trips."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from graphloom.llm import bpe

PATH = f"{bpe.FOLDER}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")
TEXTS = ["", None, " ", "Hello, world!", "naïve café — 東京 🚀\r\n\tx", "a" * 5000, "ab" * 3000 + " end", "'s't're I'm 12345 !!! ???", "\u0000�​", "   lead and trail   "]


def test_against_public_encoder():
    import tiktoken

    enc = tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
    mine = bpe.encoder(PATH)
    r = random.Random(1)
    texts = [t for t in TEXTS if t] + ["".join(r.choice("abcdefgh  .,\n'é東🚀01") for _ in range(r.randint(1, 400))) for _ in range(200)]
    for t in texts:
        ids = mine.encode(t)
        assert ids == enc.encode_ordinary(t)
        assert enc.decode_bytes(ids).decode() == t


def test_documents(spark):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)] + [(0, "", 7)], "doc_id long, text string, ids int")
    got = bpe.encode_documents(docs).collect()
    assert len(got) == len(TEXTS) + 1 and got[0].ids == [] and got[1].ids == []
    counts = docs.select("doc_id", bpe.token_count(F.col("text")).alias("n")).collect()
    assert [len(r.ids) for r in got] == [r.n for r in counts]
    assert bpe.encode_documents(docs.limit(0)).count() == 0
