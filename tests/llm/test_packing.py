import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import packing as P


def sequential(sizes, capacity):
    """Best fit decreasing, one item at a time."""
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - s)
        else:
            gaps.append(capacity - s)
    return len(gaps), sorted(gaps)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120), st.integers(50, 60))
def test_classes_equal_one_at_a_time(sizes, capacity):
    counts = {s: sizes.count(s) for s in set(sizes)}
    ranges, bins = P.best_fit(counts, capacity)
    used = [0] * bins
    for s in counts:
        own = sorted(x for x in ranges if x[0] == s)
        assert own[0][1] == 0 and own[-1][2] == counts[s] and all(a[2] == b[1] for a, b in zip(own, own[1:]))
        for _, lo, hi, first, each in own:
            for r in range(lo, hi):
                used[first + (r - lo) // each] += s
    assert max(used, default=0) <= capacity and sum(used) == sum(sizes)
    n, gaps = sequential(sizes, capacity)
    assert bins == n and sorted(capacity - u for u in used) == gaps


def test_frame(spark):
    rng = random.Random(1)
    docs = [(i, rng.choice([0, 5, 100, rng.randrange(1, 600), 1300])) for i in range(500)] + [(None, 4), (900, None)]
    sizes = spark.createDataFrame(docs, "doc_id bigint, tokens bigint")
    limits = spark.createDataFrame([(1, "a", 512), (2, "b", 100), (3, "c", None)], "pack_id int, label string, capacity_tokens int")
    rows = P.pack(sizes, limits).collect()
    for pack_id, cap in ((1, 512), (2, 100)):
        mine = [r for r in rows if r.pack_id == pack_id]
        fill = {}
        for r in mine:
            fill[r.bin_id] = fill.get(r.bin_id, 0) + r.tokens
        assert max(fill.values()) <= cap
        by_doc = {}
        for r in mine:
            by_doc.setdefault(r.doc_id, []).append((r.piece, r.first_token, r.tokens))
        for i, t in docs:
            if i is None or not t:
                assert i not in by_doc
                continue
            want = [(k, k * cap, min(cap, t - k * cap)) for k in range(-(-t // cap))]
            assert sorted(by_doc[i]) == want
    assert {r.pack_id for r in rows} == {1, 2}
    assert P.pack(sizes.limit(0), limits).collect() == [] and P.pack(sizes, limits.limit(0)).collect() == []


def test_shares_of_a_hot_class(spark, monkeypatch):
    monkeypatch.setattr(P, "RANK_TOGETHER", 10)
    sizes = spark.createDataFrame([(i, 7) for i in range(203)], "doc_id bigint, tokens bigint")
    limits = spark.createDataFrame([(1, 20)], "pack_id int, capacity_tokens int")
    rows = P.pack(sizes, limits).collect()
    fill = {}
    for r in rows:
        fill[r.bin_id] = fill.get(r.bin_id, 0) + 1
    assert len(rows) == 203 and sorted(fill.values()) == [1] + [2] * 101


@pytest.mark.skipif(not os.path.exists(P.VOCABULARY), reason="no vocabulary")
def test_tokens(spark):
    texts = ["Hello world", "", None, "naïve café " * 5000, "x" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.tokens for r in P.token_counts(df).collect()}
    enc = P.tokenizer(P.VOCABULARY)
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert enc.decode(enc.encode_ordinary(texts[3])) == texts[3]


def test_limits_are_whole_or_refused(spark):
    sizes = spark.createDataFrame([(1, 3)], "doc_id bigint, tokens bigint")
    many = spark.range(P.MAX_LIMITS + 1).selectExpr("cast(id as int) pack_id", "cast(id + 3 as int) capacity_tokens")
    with pytest.raises(ValueError):
        P.pack(sizes, many)
