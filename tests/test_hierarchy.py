import random

import pytest

from weftline.operators.hierarchy import all_descendants, all_figures, descendants, marked_above, resolve_tree, subtree_figures


def brute(parents):
    out = {}
    for v in parents:
        walk, at = [], {}
        x = v
        while True:
            if x in at:
                out[v] = (min(walk[at[x]:]), -1, [])
                break
            at[x] = len(walk)
            walk.append(x)
            if parents[x] is None or parents[x] not in parents:
                out[v] = (x, len(walk) - 1, walk[::-1])
                break
            x = parents[x]
    return out


def run(spark, parents, **kw):
    df = spark.createDataFrame(list(parents.items()), "id bigint, parent bigint")
    return {r.id: (r.root, r.level, list(r.path)) for r in resolve_tree(df, **kw).collect()}


@pytest.mark.parametrize("split", [1, 3, 8])
def test_random_graphs_with_cycles(spark, split):
    rng = random.Random(split)
    parents = {i: rng.choice([None, rng.randrange(400), rng.randrange(400), 10_000 + i]) for i in range(300)}
    assert run(spark, parents, split=split) == brute(parents)


def test_chain_star_and_loops(spark):
    chain = {i: i - 1 if i else None for i in range(600)}
    star = {1000 + i: 599 for i in range(300)}
    loops = {5000: 5000, 5001: 5002, 5002: 5003, 5003: 5001, 5004: 5001, -1: 0, -2: None}
    both = chain | star | loops
    assert run(spark, both) == brute(both)


def test_descendants_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 4), (None, 1)], "id bigint, parent bigint")
    tree = resolve_tree(df)
    assert sorted(tuple(r) for r in descendants(tree).collect()) == [(1, 2, 1), (1, 3, 2), (2, 3, 1)]
    assert resolve_tree(df.limit(0)).collect() == []


def test_subtree_figures_count_what_the_rows_below_would(spark):
    rng = random.Random(2)
    parents = {i: rng.choice([None, *range(max(0, i - 3), i)]) if i else None for i in range(250)} | {1000 + i: 1000 + i - 1 if i else 249 for i in range(80)} | {5000: 5001, 5001: 5000, 5002: 5001}
    tree = resolve_tree(spark.createDataFrame(list(parents.items()), "id bigint, parent bigint"))
    want = {}
    for r in descendants(tree).collect():
        n, h = want.get(r.id, (0, 0))
        want[r.id] = (n + 1, max(h, r.steps))
    assert {r.id: (r.descendants, r.height) for r in subtree_figures(tree).collect()} == want
    assert subtree_figures(tree.limit(0)).collect() == []


def test_descendants_of_cycles_and_of_all_else_are_whole(spark):
    rng = random.Random(7)
    graphs = [{i: rng.randrange(n) if i % 9 else rng.choice([None, 10_000 + i, i]) for i in range(n)} for n in (40, 90)]
    graphs.append({9: 4, 4: 7, 7: 2, 2: 9, 20: 7, 21: 20, 22: 21, 23: 4, 30: 30, 31: 30, 40: None, 41: 40, 42: 41, 50: 51, 51: 50})
    for parents in graphs:
        df = spark.createDataFrame([*parents.items(), (None, 4)], "id bigint, parent bigint")
        want, figures = set(), {v: (0, 0) for v in parents}
        for v in parents:
            x, held = v, [v]
            while (x := parents[x]) in parents and x not in held:
                want.add((x, v, len(held)))
                figures[x] = (figures[x][0] + 1, max(figures[x][1], len(held)))
                held.append(x)
        assert len(want) > len(descendants(resolve_tree(df)).collect())
        got = [tuple(r) for r in all_descendants(df).collect()]
        assert set(got) == want and len(got) == len(want)
        assert sorted((r.id, (r.descendants, r.height)) for r in all_figures(df).collect()) == sorted(figures.items())
    assert all_descendants(df.limit(0)).collect() == all_figures(df.limit(0)).collect() == []


def test_marks_go_down_chains_and_round_circles(spark):
    parents = {i: i - 1 if i else None for i in range(70)} | {100: 102, 101: 100, 102: 101, 103: 102, 200: 999, 300: 301, 301: 300} | {400 + i: 400 + (i + 1) % 37 for i in range(37)}
    marked = {20, 101, 200, 405, None}
    rows = [(i, p, True if i in marked else None if i % 2 else False) for i, p in parents.items()] + [(None, 1, True)]
    want = set()
    for v in parents:
        x, seen = v, set()
        while x in parents and x not in seen:
            if x in marked:
                want.add(v)
            seen.add(x)
            x = parents[x]
    df = spark.createDataFrame(rows, "id bigint, parent bigint, marked boolean")
    assert {r.id for r in marked_above(df).collect()} == want
    assert marked_above(df.limit(0)).collect() == []
