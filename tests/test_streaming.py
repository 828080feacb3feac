import datetime as dt

from pyspark.sql import functions as F

from weftline.streaming import events as S


def test_hourly_stream_equals_batch(spark, sf, tmp_path):
    import shutil

    src = tmp_path / "in"
    src.mkdir()
    shutil.copy(f"{sf}/events.parquet", src / "events.parquet")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    q = S.hourly(S.read_stream(spark, str(src))).writeStream.outputMode("complete").format("memory").queryName("hours").option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.hour, r.event_type): r.events for r in spark.table("hours").collect()}
    want = {(r.hour, r.event_type): r.events for r in S.hourly(spark.read.parquet(f"{sf}/events.parquet")).collect()}
    assert got == want and want
    sink = S.run_once(S.read_stream(spark, str(src)), S.append_batch(out), str(tmp_path / "state2"))
    sink.awaitTermination(120)
    assert spark.read.parquet(out).count() == spark.read.parquet(f"{sf}/events.parquet").count()


def test_stale_runs(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    for n, rows in enumerate([[(1, t0, "RUNNING"), (2, t0, "RUNNING")], [(2, t0 + dt.timedelta(minutes=5), "OK")], [(3, t0 + dt.timedelta(hours=9), "RUNNING")], [(3, t0 + dt.timedelta(hours=10), "RUNNING")]]):
        spark.createDataFrame(rows, "run_id bigint, ts timestamp, status string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        del n
    stream = S.read_stream(spark, str(tmp_path / "in"), 1)
    q = S.stale_runs(stream, 60).writeStream.format("memory").queryName("stale").outputMode("append").option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {r.run_id: r.status for r in spark.table("stale").select("run_id", F.col("status")).collect()}
    assert got.get(2) == "OK" and got.get(1) == "FAILED" and 3 not in got
