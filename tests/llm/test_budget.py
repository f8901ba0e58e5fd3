"""Packing and mixing."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from glyphlake.llm import mixing as X
from glyphlake.llm import packing as K
from glyphlake.llm.tokens import count_tokens, sized_documents

DOCS = "doc_id long, source string, tokens long, capacity int, h int"
LIMITS = "container string, capacity_tokens int"


def check(packed, docs, limits):
    for kind, capacity in limits.items():
        own = [r for r in packed if r["container"] == kind]
        fill, pieces = Counter(), defaultdict(list)
        for r in own:
            fill[r["container_id"]] += r["tokens"]
            pieces[r["doc_id"]].append((r["token_start"], r["tokens"]))
        assert max(fill.values(), default=0) <= capacity
        assert all(fill[r["container_id"]] == r["used"] for r in own)
        assert set(pieces) == {d for d, n in docs.items() if n > 0}
        for d, parts in pieces.items():
            at = 0
            for start, n in sorted(parts):
                assert start == at and n > 0
                at += n
            assert at == docs[d] and (docs[d] > capacity or len(parts) == 1)
        yield kind, len(fill), -(-sum(docs.values()) // capacity)


def test_packing(spark):
    rnd = random.Random(1)
    docs = {i: rnd.choice([0, rnd.randint(1, 60), rnd.randint(1, 600), 37]) for i in range(4000)}
    limits = {"small": 128, "large": 1024}
    packed = K.pack(spark.createDataFrame([(d, "s", n, 9, 9) for d, n in docs.items()], DOCS), spark.createDataFrame([*limits.items(), ("none", 0), ("null", None), ("small", 128)], LIMITS))
    found = packed.collect()
    assert len({(r["container"], r["doc_id"], r["piece_no"]) for r in found}) == len(found)
    for kind, n, least in check(found, docs, limits):
        assert n <= 1.02 * least + 1, kind
    sums = {(r["container"], r["container_id"]): r["tokens"] for r in K.fill(packed).collect()}
    assert all(sums[r["container"], r["container_id"]] == r["used"] for r in found)


@pytest.mark.parametrize("sizes", [[], [5], [128] * 7, [129], [64] * 1001, [127] * 50 + [1] * 20, [43, 43, 42] * 30, [100_000]])
def test_packing_edges(spark, sizes):
    docs = dict(enumerate(sizes))
    packed = K.pack(spark.createDataFrame([(d, None, n, 0, 0) for d, n in docs.items()], DOCS), spark.createDataFrame([("c", 128)], LIMITS)).collect()
    for _, n, least in check(packed, docs, {"c": 128}):
        assert n <= least + 50


def test_plan_holds_the_histogram():
    rnd = np.random.default_rng(3)
    for capacity in (16, 100, 512):
        hist = rnd.integers(0, 40, capacity + 1)
        hist[0] = 0
        held = np.zeros_like(hist)
        for times, need in K.plan(hist, capacity):
            assert times > 0 and 0 < sum(n * m for n, m in need.items()) <= capacity
            for n, m in need.items():
                held[n] += times * m
        assert (held == hist).all()


def test_mixing(spark):
    rnd = random.Random(2)
    share = {"a": 0.5, "b": 0.3, "c": 0.15, "none": 0.05}
    docs = [(i, rnd.choices(["a", "b", "c", "x", None], [60, 30, 3, 5, 2])[0], rnd.choice([0, rnd.randint(1, 900)]), 1, 1) for i in range(6000)]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.15, 4), ("none", 0.05, 4), (None, 0.1, 1), ("c", 0.15, 4)], "source string, target_share double, max_repeats int")
    mixed, asked, want = X.mix(spark.createDataFrame(docs, DOCS), targets)
    rows = mixed.collect()
    assert len(rows) == sum(d[1] in ("a", "b", "c") for d in docs) and {r["repeats"] for r in rows if r["source"] == "a"} <= {0, 1}
    got = {r["source"]: r for r in X.shares(mixed, asked, want).collect()}
    whole = sum(v for k, v in share.items() if k != "none")
    for s in "abc":
        assert got[s]["actual_share"] == pytest.approx(share[s] / whole, abs=0.005) and got[s]["used_tokens"] == sum(r["tokens"] * r["repeats"] for r in rows if r["source"] == s)
        assert max(r["repeats"] for r in rows if r["source"] == s) <= {"a": 1, "b": 2, "c": 4}[s]
        assert abs(got[s]["used_tokens"] - got[s]["budget_tokens"]) <= 900 and {r["repeats"] for r in rows if r["source"] == s} <= {k := min(r["repeats"] for r in rows if r["source"] == s), k + 1}
    assert got["none"]["used_tokens"] == 0 and got["none"]["actual_share"] == 0
    # The largest mix there is: one source is used up.
    assert any(got[s]["used_tokens"] == got[s]["available_tokens"] * {"a": 1, "b": 2, "c": 4}[s] for s in "abc")


def test_mixing_edges(spark):
    targets = spark.createDataFrame([("a", 1.0, None), ("b", None, 2)], "source string, target_share double, max_repeats int")
    mixed, asked, want = X.mix(spark.createDataFrame([(1, "a", 10, 0, 0), (2, "a", 10, 0, 0), (3, "b", 5, 0, 0)], DOCS), targets)
    assert {(r["doc_id"], r["repeats"]) for r in mixed.collect()} == {(1, 1), (2, 1), (3, 0)}
    mixed, asked, want = X.mix(spark.createDataFrame([], DOCS), targets)
    assert mixed.count() == 0 and {r["actual_share"] for r in X.shares(mixed, asked, want).collect()} == {0.0}


def test_token_counts(spark):
    import os

    from glyphlake.llm.tokens import VOCABULARY

    if not os.path.exists(VOCABULARY):
        pytest.skip("no vocabulary")
    df = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, "Hello world", None), (4, "循环水泵 " * 3000, "t")], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["tokens"] for r in count_tokens(df, "text").collect()}
    assert got[1] == got[2] == 0 and got[3] == 2 and got[4] > 3000
    twice = spark.createDataFrame([(1, "a", "s", None), (1, "a", "s", None), (2, None, None, None)], "doc_id long, text string, source string, loaded_at timestamp")
    assert sorted(tuple(r) for r in sized_documents(twice).collect()) == [(1, "s", 1), (2, None, 0)]


def test_salts_follow_the_count_of_a_length(spark, monkeypatch):
    monkeypatch.setattr(K, "RANKED", 7)
    docs = {i: 37 if i % 3 else 5 + i % 60 for i in range(600)}
    packed = K.pack(spark.createDataFrame([(d, "s", n, 9, 9) for d, n in docs.items()], DOCS), spark.createDataFrame([("c", 128)], LIMITS), common=None).collect()
    for _, n, least in check(packed, docs, {"c": 128}):
        assert n <= 1.1 * least
