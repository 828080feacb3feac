import math
import random

from pyspark.sql import functions as F

from weftline.llm import names as N
from weftline.llm.variants import read_mark, variant_pairs


def test_fold(spark):
    cases = {"Radilfält, Björn": "bjorn radilfalt", "Zora_Stroedham": "zora stroedham", "Ann \"Annie\" Oak (dancer)": "ann oak", "Alexandra Iskesen - 1959": "alexandra iskesen", "  ": None, None: None, "MARY ANN": "mary ann", "MaryAnn Oak": "mary ann oak", "Oak Hill, Jr.": "oak hill", "Ann Jr": "ann jr", "Jean-Luc O’Hara": "jean luc o hara"}
    df = spark.createDataFrame([(c,) for c in cases], "n string").select("n", N.fold_name(F.col("n")).alias("f"))
    assert {r.n: r.f for r in df.collect()} == cases


def brute_cos(idf, a, b):
    def vec(n):
        tf = {}
        for t in n.split(" "):
            p = "^" + t + "$"
            for i in range(len(t)):
                tf[p[i : i + 3]] = tf.get(p[i : i + 3], 0) + 1
        w = {g: (1 + math.log(c)) * idf[g] for g, c in tf.items() if g in idf}
        s = math.sqrt(sum(x * x for x in w.values())) or 1
        return {g: x / s for g, x in w.items()}

    x, y = vec(a), vec(b)
    return sum(v * y.get(g, 0) for g, v in x.items())


def test_joins_lose_no_pair(spark):
    rng = random.Random(4)
    first, last = ["anna", "bella", "clara", "doris", "annabel"], ["stone", "stonewall", "river", "riverton", "hill", "hillman"]
    rows = []
    for i in range(160):
        n = rng.choice(first) + " " + rng.choice(last)
        if rng.random() < 0.5:
            k = rng.randrange(1, len(n) - 1)
            n = n[:k] + rng.choice("xyz") + n[k + 1 :]
        rows.append((i, n, rng.choice([None, "1980-01-01", "1990-02-02"]), rng.choice([None, "F", "M"]), rng.choice([None, "SE", "DE"])))
    df = spark.createDataFrame(rows, "unit bigint, name string, born string, gender string, country string").withColumn("born", F.to_date("born"))
    idf = N.gram_weights(df.select("name").distinct())
    got = {(r.a, r.b) for r in N.similar_pairs(N.with_bearers(df), idf).collect()}
    born = {n: {r[2] for r in rows if r[1] == n and r[2]} for n in {r[1] for r in rows}}
    want = set()
    for a in rows:
        for b in rows:
            if a[0] >= b[0] or any(x and y and x != y for x, y in zip(a[2:], b[2:])):
                continue
            day, sex, place = (bool(x and y) for x, y in zip(a[2:], b[2:]))
            if not day and (len(born[a[1]]) > 1 or len(born[b[1]]) > 1):
                continue
            least = N.SAME_DAY if day else (N.SAME_PLACE + (0 if sex else 0.05)) if place else N.SAME_SEX if sex else 9
            if brute_cos(idf, a[1], b[1]) >= least:
                want.add((a[0], b[0]))
    assert got == want and len(want) > 50
    # birthdays of more than ten records by grams: the same pairs
    assert {(r.a, r.b) for r in N.similar_pairs(N.with_bearers(df), idf, together=10).collect()} == want


def test_average_linkage_keeps_contradictions_apart(spark):
    units = spark.createDataFrame([(1, "1980-01-01", "F", "SE"), (2, None, "F", None), (3, "1985-05-05", "F", "SE"), (4, None, None, None), (5, None, None, None)], "unit bigint, born string, gender string, country string").withColumn("born", F.to_date("born"))
    links = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (4, 5, 0.7)], "a bigint, b bigint, score double")
    got = {r.unit: r.cluster for r in N.average_linkage(links, units).collect()}
    assert got[1] == got[2] == 1 and got[3] == 3 and got[4] == got[5] == 4
    assert N.average_linkage(links.limit(0), units).collect() == []


def test_average_needs_both_sides(spark):
    units = spark.createDataFrame([(i, None, None, None) for i in range(4)], "unit bigint, born date, gender string, country string")
    links = spark.createDataFrame([(0, 1, 0.95), (1, 2, 0.55), (0, 2, 0.1), (2, 3, 0.9)], "a bigint, b bigint, score double")
    got = {r.unit: r.cluster for r in N.average_linkage(links, units).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2}


def test_one_link_joins_no_clusters_of_unlike_names(spark):
    # 1 and 2 are alike, 3 and 4 are alike, 2 and 3 just so: all links are of 0.5 and more, as similar_pairs makes them
    names = {1: "anna stone", 2: "anna stonewall", 3: "berta wallman", 4: "berta wallmann"}
    units = spark.createDataFrame([(i, None, "F", None) for i in names], "unit bigint, born date, gender string, country string")
    profiles = spark.createDataFrame(list(names.items()), "unit bigint, name string")
    links = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.55), (3, 4, 0.9)], "a bigint, b bigint, score double")
    got = {r.unit: r.cluster for r in N.average_linkage(links, units, profiles=profiles, idf=N.gram_weights(profiles.select("name"))).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3}


def test_pairs_without_link_count_by_their_names(spark):
    # two of one name that nothing links directly stay with the record both are linked to
    units = spark.createDataFrame([(1, None, "F", None), (2, None, None, None), (3, None, None, None)], "unit bigint, born date, gender string, country string")
    profiles = spark.createDataFrame([(1, "anna stone"), (2, "anna stone"), (3, "anna stone"), (3, "other hill")], "unit bigint, name string")
    links = spark.createDataFrame([(1, 2, 0.75), (1, 3, 0.75)], "a bigint, b bigint, score double")
    got = {r.unit: r.cluster for r in N.average_linkage(links, units, profiles=profiles, idf=N.gram_weights(profiles.select("name").distinct())).collect()}
    assert got == {1: 1, 2: 1, 3: 1}


def test_only_bearers(spark):
    rows = [(1, "a b", "1980-01-01", "F", None), (2, "a b", None, "F", None), (3, "a b", None, "M", None), (4, "c d", None, None, None), (5, "c d", None, None, None), (6, "e f", "1980-01-01", None, None), (7, "e f", "1981-01-01", None, None), (8, "e f", None, None, None)]
    df = spark.createDataFrame(rows, "unit bigint, name string, born string, gender string, country string").withColumn("born", F.to_date("born"))
    assert {(r.a, r.b) for r in N.only_bearers(df).collect()} == {(1, 2), (4, 5)}


def test_marks(spark):
    cases = {"I": ("i", None, None), "2": ("ii", None, None), "the younger": ("the younger", None, None), "1975": ("1975", 1975, None), "FR": ("fr", None, "FR"), "n/a": (None, None, None), None: (None, None, None)}
    mark, year, land = read_mark(F.col("d"))
    got = spark.createDataFrame([(d,) for d in cases], "d string").select("d", mark.alias("m"), year.alias("y"), land.alias("c")).collect()
    assert {r.d: (r.m, r.y, r.c) for r in got} == cases


def test_marks_link_and_keep_apart(spark):
    # one name of two bearers: the undated records are placed by their mark and their year
    rows = [(1, "ann oak", "1980-01-01", None, None, "i", 1980), (2, "ann oak", "1990-01-01", None, None, "ii", 1990), (3, "ann oak", None, None, None, "ii", None), (4, "ann oak", None, None, None, "1980", 1980), (5, "ann oak", None, None, None, None, 1990), (6, "eve elm", None, None, None, "i", None), (7, "eve elm", None, None, None, "ii", None)]
    df = N.with_bearers(spark.createDataFrame(rows, "unit bigint, name string, born string, gender string, country string, mark string, year int").withColumn("born", F.to_date("born")))
    idf = N.gram_weights(df.select("name").distinct())
    assert {(r.a, r.b) for r in N.similar_pairs(df, idf).collect()} == {(2, 3)}
    assert N.only_bearers(df).collect() == []
    assert {(r.a, r.b) for r in N.year_bearers(df).collect()} == {(2, 5)}


def test_variant_pairs(spark):
    df = spark.createDataFrame([(1, "A", 1), (2, "A", 1), (3, "B", 1), (4, None, 1), (5, "C", 5)], "id bigint, name string, cluster bigint")
    assert sorted(tuple(r) for r in variant_pairs(df).collect()) == [(1, 3), (2, 3)]
    assert variant_pairs(df.limit(0)).collect() == []


def test_components_within_tasks_and_as_rounds_over_tables_give_the_same(spark):
    rng = random.Random(9)
    first, last = ["anna", "bella", "clara", "annabel"], ["stone", "stonewall", "river", "hillman"]
    rows = [(i, rng.choice(first) + " " + rng.choice(last), rng.choice([None, None, "1980-01-01", "1990-02-02"]), rng.choice([None, "F", "M"]), rng.choice([None, None, "SE"])) for i in range(60)]
    units = spark.createDataFrame(rows, "unit bigint, name string, born string, gender string, country string").withColumn("born", F.to_date("born"))
    profiles = units.select("unit", "name")
    idf = N.gram_weights(profiles.select("name").distinct())
    pairs = {(a, b): rng.choice([0.55, 0.7, 0.9]) for a, b in (sorted(rng.sample(range(60), 2)) for _ in range(90)) if not any(x and y and x != y for x, y in zip(rows[a][2:], rows[b][2:]))}
    links = spark.createDataFrame([(*k, v) for k, v in pairs.items()], "a bigint, b bigint, score double")
    within, rounds = ({r.unit: r.cluster for r in N.average_linkage(links, units.drop("name"), profiles=profiles, idf=idf, within=n).collect()} for n in (1_000, 0))
    assert within == rounds and len(set(within.values())) < len(within)


def test_long_names_have_all_their_grams(spark):
    long = " ".join(f"{a}{b}{c}x" for a in "abcd" for b in "efgh" for c in "klmn")
    v = N.Vectors(N.gram_weights(spark.createDataFrame([(long,), ("anna stone",)], "name string")))
    size, ids, w = v.many([long, "zzz", "anna stone"])
    assert size[0] == len(set(v.one(long)[0])) > 64 and size[1] == 0 and abs((w[: size[0]] ** 2).sum() - 1) < 1e-9
