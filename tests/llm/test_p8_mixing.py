"""Shares, caps and copies of the mix."""

from __future__ import annotations

import os

import pytest

from graphloom.llm import bpe, mixing

pytestmark = pytest.mark.skipif(not os.path.exists(f"{bpe.FOLDER}/byte_bpe_50k.tiktoken"), reason="no vocabulary here")


def text(i, n):
    return " ".join(f"word{(i * 31 + j) % 97}" for j in range(n))


def test_shares_and_caps(spark):
    docs = [(i, text(i, 20), "a") for i in range(100)] + [(200 + i, text(i, 10), "b") for i in range(40)] + [(300 + i, text(i, 20), "b") for i in range(5)] + [(400 + i, "same text here", "c") for i in range(60)]
    docs += [(500, None, "a"), (501, "", "b"), (502, text(1, 9), None), (503, text(1, 9), "unknown"), docs[0]]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, source string, key int")
    targets = spark.createDataFrame([("a", 5.0, 1), ("b", 3.0, 3), ("c", 1.0, 2), ("none", 4.0, 1), ("zero", 0.0, 1), ("a", 5.0, 1), (None, 1.0, 1)], "source string, weight double, max_repeats int")
    got = mixing.mix(df, targets).collect()
    cap = {"a": 1, "b": 3, "c": 2}
    assert len({r.doc_id for r in got}) == len(got) and all(1 <= r.uses <= cap[r.source] for r in got)
    tokens = {s: sum(r.uses * r.n_tokens for r in got if r.source == s) for s in cap}
    whole, largest = sum(tokens.values()), max(r.n_tokens for r in got)
    for s, w in (("a", 5), ("b", 3), ("c", 1)):
        assert abs(tokens[s] - whole * w / 9) <= 2 * largest
    # copies of a text are supply of their own
    assert sum(r.source == "c" for r in got) > 1
    shares = {r.source: r for r in mixing.mix_shares(df, targets).collect()}
    assert shares["none"].n_docs == 0 and shares["zero"].share == 0 and abs(sum(r.share for r in shares.values()) - 1) < 1e-9
    assert mixing.mix(df.limit(0), targets).count() == 0 and mixing.mix(df, targets.limit(0)).count() == 0


def test_texts_of_several_sources_are_repeated_last():
    plan = mixing.plan_flow({"a": 100, "a\u0001b": 100}, {("a", "a"): 100, ("a\u0001b", "a"): 100, ("a\u0001b", "b"): 100}, {"a": 1.0, "b": 1.0}, {"a": 1, "b": 1}, total=200)
    assert plan.routed["a\u0001b", "b"] == 100 and plan.routed["a", "a"] == 100 and plan.routed["a\u0001b", "a"] == 0
