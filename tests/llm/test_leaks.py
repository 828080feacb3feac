import random

import numpy as np
import pytest

from weftline.llm import leaks as L

WORDS = [f"{a}{b}" for a in ["al", "be", "cor", "dun", "el", "fa", "gor"] for b in ["ba", "den", "fir", "gul", "ho", "ju"]]


def edit(a, b):
    """Least edit distance of a to any part of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return min(row)


def holds(item, doc):
    return any(edit(item[i : i + n], doc) <= n // 8 for n in range(24, len(item) + 1) for i in range(len(item) - n + 1))


def test_myers_equals_dynamic_programming():
    rng = np.random.default_rng(0)
    for m in (1, 24, 40, 64):
        p, t = rng.integers(0, 4, (20, m)), rng.integers(0, 4, (20, 70))
        assert L.myers(p, t).tolist() == [edit(list(a), list(b)) for a, b in zip(p, t)]


@pytest.mark.parametrize("seed", range(6))
def test_against_brute_force(seed):
    rng = random.Random(seed)
    items = [[rng.choice(WORDS) for _ in range(50)] for _ in range(6)]
    docs = []
    for _ in range(60):
        item = rng.choice(items)
        n = rng.randrange(18, 44)
        lo = rng.randrange(50 - n)
        part = item[lo : lo + n]
        for _ in range(rng.randrange(0, n // 6)):
            k = rng.randrange(len(part))
            part = rng.choice([part[:k] + part[k + 1 :], part[:k] + [rng.choice(WORDS)] + part[k:], part[:k] + [rng.choice(WORDS)] + part[k + 1 :]])
        docs.append([rng.choice(WORDS) for _ in range(rng.randrange(20))] + part + [rng.choice(WORDS) for _ in range(rng.randrange(20))])
    known = L.Items([(i, " ".join(x)) for i, x in enumerate(items)])
    d, i = L.find_leaks(known, [" ".join(x) for x in docs])
    got = set(zip(d.tolist(), i.tolist()))
    want = {(a, b) for a, doc in enumerate(docs) for b, item in enumerate(items) if holds(item, doc)}
    assert got == want and 5 < len(want) < 60


def test_writing_makes_no_difference():
    plain = "In The Last Tram DZ-7808 Renée Ardett says that the costume team lost his farewell speech GS-99 in 1972"
    assert L.words_of("IN &quot;THE <b>LAST</b> TRAM</p> DZ­-7808&quot;, RENÉE   ARDETT\nsays thаt the cоstume team lоst his farewell—speech (GS-99), in 1972.") == L.words_of(plain)
    assert "dz-7808" in L.words_of(plain)
    assert L.words_of(None) == [] and L.words_of("") == [] and L.words_of("… ! —") == []


def test_frame(spark):
    rng = random.Random(9)
    passage = " ".join(f"{rng.choice(WORDS)}{k}q" for k in range(60))
    docs = spark.createDataFrame([(1, "x y z " * 30_000 + passage, "a"), (2, None, "b"), (3, "", "c"), (4, " ".join(passage.split()[:20]), "d"), (5, passage.upper(), "e")], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(7, passage), (7, passage), (8, None), (9, "short"), (None, passage)], "item_id bigint, text string")
    assert sorted(tuple(r) for r in L.leaked_items(docs, items).collect()) == [(1, 7), (5, 7)]
    assert L.leaked_items(docs.limit(0), items).collect() == [] and L.leaked_items(docs, items.limit(0)).collect() == []


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_WORDS", 60)
    rng = random.Random(2)
    texts = [" ".join(f"{rng.choice(WORDS)}{i}" for _ in range(40)) for i in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    items = spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")
    assert sorted(tuple(r) for r in L.leaked_items(docs, items).collect()) == [(i, i) for i in range(5)]
