import base64
import json
import random

from pyspark.sql import functions as F

from weftline import session
from weftline.operators.relational import fold_chain, spread_labels
from weftline.sources import captures, html, sinks


def test_captures(spark, tmp_path):
    lines = [{"key": "a", "data": [{"id": 1, "title": "x"}, {"id": None, "title": None}]}, {"key": "b", "errors": ["down"]}, {"key": "c", "data": []}]
    (tmp_path / "c.json").write_text("\n".join(map(json.dumps, lines)) + "\nno json\n\n")
    rows = captures.read_captures(spark, str(tmp_path), "struct<id:bigint,title:string>").collect()
    got = sorted((r.key or "", r.ordinal if r.ordinal is not None else -1, r.error or "") for r in rows)
    assert got == [("", -1, "unreadable"), ("a", 0, ""), ("a", 1, ""), ("b", -1, "down")]


def test_manifest_and_siblings(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for n in ("film.mp4", "film.en.srt", "FILM.srt", "other.srt", "film.mp4.bak"):
        (tmp_path / "d" / n).write_text("x")
    files = captures.manifest(spark, str(tmp_path))
    assert files.count() == 5
    got = {(r.name, r.sibling) for r in captures.siblings(files, ["{stem}.srt", "{stem}.*.srt"]).collect() if r.name == "film.mp4"}
    assert got == {("film.mp4", "FILM.srt"), ("film.mp4", "film.en.srt")}


def test_data_uris(spark):
    good = "data:image/png;base64," + base64.b64encode(b"abc").decode()
    df = spark.createDataFrame([(good,), ("data:image/png;base64,@@@",), ("http://x",), (None,)], "u string").select("u", captures.decode_data_uri(F.col("u")).alias("d"))
    got = {r.u: (r.d.mime, bytes(r.d.data)) if r.d else None for r in df.collect()}
    assert got == {good: ("image/png", b"abc"), "data:image/png;base64,@@@": None, "http://x": None, None: None}


PAGE = '<html><body><h1 class="big title">Ann &amp; Bo</h1><ul><li><a href="/a">One</a><li><a href="/b"> Two\n<b>x</b></a></ul><img src=i.png><div class="bio"><p>First</p> second</div>'
RULES = {"title": ("h1", "class", "title", "text"), "links": ("a", "href", None, "href"), "names": ("a", None, None, "text"), "image": ("img", None, None, "src"), "bio": ("div", "class", "bio", "text")}


def test_html(spark):
    want = {"title": ["Ann & Bo"], "links": ["/a", "/b"], "names": ["One", "Two x"], "image": ["i.png"], "bio": ["First second"]}
    assert html.page_fields(PAGE, RULES) == want
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<h1 class=title>open")], "id bigint, page string")
    got = {r.id: {k: list(r[k]) for k in RULES} for r in html.project_pages(df, "id", "page", RULES).collect()}
    assert got[1] == want and got[2] == got[3] == {k: [] for k in RULES} and got[4]["title"] == ["open"]


def test_sinks(spark):
    cur = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id int, v string, w string")
    upd = spark.createDataFrame([(1, None, "y"), (3, "z", "z")], "id int, v string, w string")
    assert sorted(tuple(r) for r in sinks.merge_update(cur, upd, "id", ["v", "w"]).collect()) == [(1, "a", "y"), (2, "b", None)]
    assert sinks.purge(cur, upd, "id").count() == 1 and sinks.purge(cur, upd.limit(0), "id").count() == 2
    blobs = spark.createDataFrame([("h1", 1)], "sha256 string, n int")
    assert sinks.add_blobs(blobs, spark.createDataFrame([("h1", 2), ("h2", 3), ("h2", 3)], "sha256 string, n int")).count() == 2
    m = spark.createDataFrame([({"a": 1, "b": 2},)], "m map<string,int>").select(sinks.set_key(F.col("m"), "a", F.lit(9)).alias("s"), sinks.drop_key(F.col("m"), "b").alias("d")).first()
    assert m.s == {"a": 9, "b": 2} and m.d == {"a": 1}
    ids = spark.createDataFrame([([("e", "1")], "1"), ([("e", "1")], "2"), (None, "3"), ([("e", "1")], None)], "ids array<struct<endpoint:string,foreign_id:string>>, new string")
    assert [len(r.x) for r in ids.select(sinks.add_foreign_id(F.col("ids"), "e", F.col("new")).alias("x")).collect()] == [1, 2, 1, 1]


def test_labels_and_waves(spark):
    keyed = spark.createDataFrame([(i, f"k{i}") for i in range(60)] + [(i + 1, f"k{i}") for i in range(59)] + [(100, "z"), (100, "z"), (101, None)], "id bigint, key string")
    got = {r.id: r.group_id for r in spread_labels(keyed, keyed.select("id")).collect()}
    assert {got[i] for i in range(60)} == {0} and got[100] == 100 and got[101] == 101
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 3), (9, 10), (None, 1)], "parent bigint, child bigint")
    seeds = spark.createDataFrame([(1,), (None,)], "id bigint")
    assert sorted(tuple(r) for r in fold_chain(links, seeds).collect()) == [(1, 0), (2, 1), (3, 1)]


def test_labels_of_long_chains_take_few_rounds_and_leave_one_table(spark, monkeypatch):
    rng = random.Random(4)
    chain = rng.sample(range(2000), 400)
    rows = [(v, f"k{i + j}") for i, v in enumerate(chain) for j in (0, 1)] + [(5000 + i, "hub") for i in range(50)] + [(5000, "x"), (6000, "x"), (9999, "x"), (9999, "hub")]
    ids = spark.createDataFrame([(v,) for v in [*chain, *range(5000, 5050), 6000, 7000, 7000, None]], "id bigint")
    made, plain = [], session.Written
    monkeypatch.setattr(session, "Written", lambda *a, **kw: made.append(1) or plain(*a, **kw))
    kept = len(session._written)
    got = sorted(tuple(r) for r in spread_labels(spark.createDataFrame(rows, "id bigint, key string"), ids).collect())
    assert got == sorted([(v, min(chain)) for v in chain] + [(v, 5000) for v in [*range(5000, 5050), 6000]] + [(7000, 7000)])
    assert len(session._written) - kept == 1 and len(made) < 30
    assert spread_labels(spark.createDataFrame(rows, "id bigint, key string").limit(0), ids.where("id > 6000")).collect() == [(7000, 7000)]
