import os

from weftline.session import Written, drop_written, fixed_values, shared_dir


def test_written_tables_come_and_go(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id bigint, v string")
    one, two = Written(df), Written(df.limit(0))
    assert sorted(tuple(r) for r in one.df.collect()) == [(1, "a"), (2, None)] and two.df.collect() == [] and two.df.schema == df.schema
    assert one.path.startswith(shared_dir(spark)) and os.path.isdir(one.path.removeprefix("file://"))
    drop_written()
    assert not os.path.exists(one.path.removeprefix("file://")) and not os.path.exists(two.path.removeprefix("file://"))


def test_the_clusters_folder_is_used():
    from types import SimpleNamespace

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: "hdfs://shared/x" if key == "spark.checkpoint.dir" else default))
    assert shared_dir(cluster) == "hdfs://shared/x"


def test_fixed_tables_are_whole_or_refused(spark):
    assert fixed_values(spark.createDataFrame([("b",), ("a",), (None,), ("a",)], "v string"), "v") == ["a", "b"]
    try:
        fixed_values(spark.range(50), "id", most=10)
        raise AssertionError
    except ValueError:
        pass
