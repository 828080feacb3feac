from __future__ import annotations

from weftline.plans import reviews


def write(spark, sf, name, rows, columns):
    spark.createDataFrame(rows, columns).write.parquet(f"{sf}/{name}.parquet")


def test_report_has_every_changed_address(spark, tmp_path):
    rows = [(1, "a.example", "https://www.a.example/x/", "a.example/x"), (2, "a.example", "http://a.example/y?ref=1", "a.example/y"), (3, "a.example", "https://a.example/z", "a.example/z"), (20001, "a.example", "http://a.example:80/p#f", "a.example/p"), (5, None, "http://b.example/", "b.example")]
    write(spark, tmp_path, "urls", rows, "id bigint, host string, url string, norm_key string")
    got = [(r.host, r.place, r.lines, r.line) for r in reviews.QUERIES["k10_changed"](spark, str(tmp_path)).orderBy("host", "place").collect()]
    assert got == [("a.example", 1, 3, "http://a.example/y?ref=1 -> a.example/y"), ("a.example", 2, 3, "http://a.example:80/p#f -> a.example/p"), ("a.example", 3, 3, "https://www.a.example/x/ -> a.example/x")]


def test_strong_keys_group_and_names_only_without_them(spark, tmp_path):
    sources = [(1, "https://box.example/graphql", None), (2, "box.example", None), (3, None, "https://www.site.example/p/1/"), (4, None, "site.example/p/1"), (5, None, None)]
    write(spark, tmp_path, "sources", sources, "id bigint, endpoint string, url_key string")
    rows = [(1, 5, "#17", None, "Ann Oak", None), (2, 5, "17", None, "Other Hill", None), (3, 1, None, "42", "Ann Oak", None), (4, 2, "17.0", "42", "X Y", None), (5, 3, None, None, "Ann Oak", None), (6, 4, None, None, "Eve Elm", None), (7, 5, None, "42", "Ann Oak", None), (8, 5, "n/a", None, "ann  OAK", None), (9, 5, None, None, "Ann Oak", "II"), (10, 5, None, None, None, None), (11, 5, None, None, None, None)]
    write(spark, tmp_path, "performers", rows, "id bigint, source_id bigint, stored_id string, remote_site_id string, name string, disambiguation string")
    got = {r.id: r.group_id for r in reviews.QUERIES["a10_strong_groups"](spark, str(tmp_path)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 7, 8: 7, 9: 9, 10: 10, 11: 11}


def test_parsed_ids_come_out_in_order(spark, tmp_path):
    rows = [(7, "12; 007,3"), (3, "x,5;5"), (4, None), (5, "1234567890123456")]
    write(spark, tmp_path, "performers", rows, "id bigint, stored_id string")
    got = {r.id: r.ids for r in reviews.QUERIES["u8_ids"](spark, str(tmp_path)).collect()}
    assert got == {7: "12,7,3", 3: "5,3", 4: "4", 5: "1234567890123456,5"}
