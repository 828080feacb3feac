import datetime as dt
import random

from pyspark.sql import functions as F

from weftline.operators.references import first_seen, key_runs, orphans

T = dt.datetime(2024, 1, 1)


def test_against_brute_force(spark):
    rng = random.Random(5)
    targets = [(rng.randrange(400), T + dt.timedelta(hours=rng.randrange(500))) for _ in range(500)] + [(None, T)]
    refs = [(i, rng.choice([None, 7, rng.randrange(600), -3]), T + dt.timedelta(hours=rng.randrange(500))) for i in range(900)]
    gone = [(k,) for k in range(0, 600, 3)] + [(None,)]
    first = {}
    for k, t in targets:
        if k is not None:
            first[k] = min(first.get(k, t), t)
    want = set()
    for i, k, t in refs:
        if k is None:
            continue
        if k in first:
            if first[k] > t:
                want.add((i, "late"))
        else:
            want.add((i, "deleted" if (k,) in gone else "missing"))
    r, t, g = spark.createDataFrame(refs, "row_id bigint, key bigint, seen timestamp"), spark.createDataFrame(targets, "key bigint, seen timestamp"), spark.createDataFrame(gone, "key bigint")
    for kw in ({"bucket": 64}, {"bucket": 1 << 16}, {"ordered": False}):
        assert {(x.row_id, x.kind) for x in orphans(r, t, g, **kw).collect()} == want
    assert orphans(r.limit(0), t, g).collect() == []
    assert {x.kind for x in orphans(r, t.limit(0), g.limit(0)).collect()} == {"missing"}


def test_runs_are_contiguous(spark):
    t = spark.createDataFrame([(k, T) for k in [1, 2, 3, 3, 7, 8, 63, 64, 65]], "key bigint, seen timestamp")
    got = sorted((r.run_start, r.run_end) for r in key_runs(t, bucket=64).collect())
    assert got == [(1, 3), (7, 8), (63, 63), (64, 65)]


def test_first_seen_counts_deliveries_once(spark):
    df = spark.createDataFrame([(1, 5, T), (1, 5, T + dt.timedelta(days=1)), (2, None, T), (None, 1, T)], "id bigint, k bigint, loaded_at timestamp")
    assert sorted(tuple(r) for r in first_seen(df, "id", F.col("k")).collect()) == [(1, 5, T), (2, None, T)]
