import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from weftline.operators.moments import estimate_zones, normalise_moments, parse_moment, plain_date, zones_for

CASES = [
    ("2024-02-29", "DMY", None, "2024-02-29"), ("2023-02-30", "DMY", None, None), ("0000-00-00", "DMY", None, None), ("1975-00-00", "DMY", None, "1975"), ("2017-05-??", "DMY", None, "2017-05"),
    ("03/04/2020", "DMY", None, "2020-04-03"), ("03/04/2020", "MDY", None, "2020-03-04"), ("13/04/2020", "MDY", None, "2020-04-13"), ("04/13/2020", "DMY", None, "2020-04-13"), ("31/04/2024", "DMY", None, None),
    ("1.2.29", "DMY", None, "2029-02-01"), ("1.2.30", "DMY", None, "1930-02-01"), ("10. März 1970", "DMY", None, "1970-03-10"), ("10 de febrero de 1979", "DMY", None, "1979-02-10"), ("Friday, April 21st, 2017", "MDY", None, "2017-04-21"),
    ("2020-W53-5", "DMY", None, "2021-01-01"), ("2021-W53-1", "DMY", None, None), ("2024-366", "DMY", None, "2024-12-31"), ("2023-366", "DMY", None, None), ("March 2022", "DMY", None, "2022-03"), ("c. 1955", "DMY", None, "1955"), ("01/1963", "DMY", None, "1963-01"),
    ("1485078373354", "DMY", None, "2017-01-22T09:46:13Z"), ("-100483200000", "DMY", None, "1966-10-26T00:00:00Z"), ("1483281954", "DMY", None, "2017-01-01T14:45:54Z"), ("1485915070000000", "DMY", None, "2017-02-01T02:11:10Z"),
    ("2017-10-29 02:30", "DMY", "Europe/Berlin", "2017-10-29T00:30:00Z"), ("2017-03-26 02:30", "DMY", "Europe/Berlin", "2017-03-26T01:30:00Z"), ("2017-07-01 12:00", "DMY", None, "2017-07-01T12:00:00Z"),
    ("20170108T110633Z", "DMY", None, "2017-01-08T11:06:33Z"), ("Apr 10, 2020 1:09 AM EDT", "MDY", None, "2020-04-10T05:09:00Z"), ("Fri, 01 May 2020 20:34:15 +0100", "DMY", None, "2020-05-01T19:34:15Z"), ("2018-09-30 12:53 America/Phoenix", "DMY", None, "2018-09-30T19:53:00Z"),
    ("2017-02-17 11:23 [Europe/Lisbon]", "DMY", None, "2017-02-17T11:23:00Z"), ("01.02.2017, 02:15 Uhr", "DMY", "Europe/Berlin", "2017-02-01T01:15:00Z"), ("12:30", "DMY", None, None), ("2020-01-01 25:00", "DMY", None, None), ("2020-01-01T10:00:00.999Z", "DMY", None, "2020-01-01T10:00:00Z"),
    (None, "DMY", None, None), ("", "DMY", None, None), ("soon", "DMY", None, None), ("x" * 100_000, "DMY", None, None), ("2020-01-01", None, None, "2020-01-01"),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, t, o, z) for i, (t, o, z, _) in enumerate(CASES)], "i int, t string, o string, z string")
    got = {r.i: r.n for r in df.select("i", parse_moment(F.col("t"), F.col("o"), F.col("z")).alias("n")).collect()}
    assert [(c[0], got[i]) for i, c in enumerate(CASES)] == [(c[0], c[3]) for c in CASES]


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/New_York", "Asia/Kolkata", "Australia/Sydney"])
def test_local_times_against_zoneinfo(spark, zone):
    start = dt.datetime(2021, 1, 1, 0, 30)
    times = [start + dt.timedelta(hours=5 * k) for k in range(1700)]
    df = spark.createDataFrame([(t.strftime("%Y-%m-%d %H:%M"),) for t in times], "t string")
    got = {r.t: r.n for r in df.select("t", parse_moment(F.col("t"), F.lit("YMD"), F.lit(zone)).alias("n")).collect()}
    for t in times:
        # fold 0 is the first pass of a repeated hour, and moves a skipped one forward
        want = t.replace(tzinfo=ZoneInfo(zone)).astimezone(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        assert got[t.strftime("%Y-%m-%d %H:%M")] == want


def test_estimated_zones(spark):
    zones = ["America/New_York", "Asia/Tokyo", "UTC"]
    rows = []
    for host, zone in (("a", "Asia/Tokyo"), ("b", "America/New_York")):
        for k in range(200):
            utc = dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * k)
            local = utc.replace(tzinfo=dt.UTC).astimezone(ZoneInfo(zone)).replace(tzinfo=None)
            rows.append((host, local, utc + dt.timedelta(minutes=3)))
    df = spark.createDataFrame(rows, "host string, local timestamp_ntz, arrived timestamp_ntz")
    got = {r.host: r.zone for r in estimate_zones(df, "host", "local", "arrived", zones).collect()}
    assert got == {"a": "Asia/Tokyo", "b": "America/New_York"}
    sites = spark.createDataFrame([("a", None, "DMY"), ("b", "UTC", "DMY"), ("c", "Asia/Tokyo", "YMD"), ("d", "America/New_York", "MDY")], "host string, zone string, date_order string")
    filled = {r.host: r.zone for r in zones_for(sites, df).collect()}
    assert filled == {"a": "Asia/Tokyo", "b": "UTC", "c": "Asia/Tokyo", "d": "America/New_York"}


def test_frame(spark):
    sites = spark.createDataFrame([("h", "UTC", "DMY")], "host string, zone string, date_order string")
    df = spark.createDataFrame([(1, "2020-01-02", "h", "clash"), (1, "2020-01-02", "h", "clash"), (2, "x", "h", ""), (3, "2020", None, ""), (None, "2020", "h", "")], "id bigint, date string, host string, zone string")
    assert sorted(tuple(r) for r in normalise_moments(df, "id", "date", "host", sites).collect()) == [(1, "2020-01-02"), (3, "2020")]
    assert normalise_moments(df.limit(0), "id", "date", "host", sites).collect() == []


def test_plain_dates_are_read_as_by_the_whole_parser(spark):
    sure = ["1955/01/02", "1955.01.02", "1955-01-02", "19550104", "01/02/1955", "13-01-1968", "01.13.1968", "29-02-2024", "10 Agosto 1976", "1 Agosto 1973", "01-Apr-1962", "Apr 01, 1961", "Apr 1 1961", "10 Apr, 1955", "5 MAI 1970"]
    left = ["1955-02-30", "0000-05-05", "00000101", "31/04/2024", "1955-01/02", "1955-01-02 ", "19550104\n", "01/02/55", "10 foo 1976", "32 May 1970", "sat 12 1999", "on 1955-01-04", "1 of 1980", "Apr 1955", "TBA", "", "1955-009", "100137600000"]
    rows = [(t, o) for t in [*sure, *left, None] for o in ("DMY", "MDY", "YMD", "dmy", None)]
    df = spark.createDataFrame(rows, "t string, o string")
    got = df.select("t", plain_date(F.col("t"), F.col("o")).cast("string").alias("plain"), parse_moment(F.col("t"), F.col("o"), F.lit("UTC")).alias("whole")).collect()
    assert all(r.plain == r.whole for r in got if r.plain is not None)
    assert {r.t for r in got if r.plain is not None} == set(sure)
