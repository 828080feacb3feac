import random

from pyspark.sql import functions as F

from weftline.llm import groups
from weftline.llm.groups import hash_to_min, star_links


def union_find(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def test_random_links(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(500), rng.randrange(500)) for _ in range(330)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    got = {r.id: r.group_id for r in hash_to_min(df).collect()}
    assert got == union_find([p for p in pairs if p[0] != p[1]])


def test_long_chain_and_hot_key(spark):
    chain = [(i, i + 1) for i in range(0, 3000)]
    random.Random(2).shuffle(chain)
    got = {r.group_id for r in hash_to_min(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {0}
    hot = spark.range(5000).select("id", F.lit("one").alias("key"))
    links = star_links(hot)
    assert links.count() == 4999
    rows = hash_to_min(links)
    assert rows.count() == 5000 and rows.select("group_id").distinct().collect()[0].group_id == 0


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, 2), (2, 1), (1, 2), (3, 3), (4, None), (None, 5)], "a bigint, b bigint")
    assert sorted(tuple(r) for r in hash_to_min(df).collect()) == [(1, 1), (2, 1)]
    assert hash_to_min(df.limit(0)).collect() == []
    keyed = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (None, "x"), (3, "y")], "id bigint, key string")
    assert star_links(keyed).collect() == []


def test_settled_groups_leave_the_rounds(spark, monkeypatch):
    sizes = []
    plain = groups._round

    def counted(links):
        sizes.append(links.count())
        return plain(links)

    monkeypatch.setattr(groups, "_round", counted, raising=True)
    stars = [(10_000 + 10 * s, 10_000 + 10 * s + i) for s in range(200) for i in range(1, 6)]
    chain = [(i, i + 1) for i in range(0, 60)]
    rows = hash_to_min(spark.createDataFrame(stars + chain, "a bigint, b bigint")).collect()
    got = {r.id: r.group_id for r in rows}
    assert len(rows) == len(got) and got == union_find(stars + chain)
    # of the 1000 links of stars nothing is left after two rounds, while the chain goes on
    assert len(sizes) > 3 and sizes[2] < 300 and sizes[-1] < 100
