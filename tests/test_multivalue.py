import json

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.operators.multivalue import split_packed, split_strings


def split(text):
    _, pos, values = split_strings(pa.array([text], pa.string()))
    assert pos.tolist() == list(range(1, len(values) + 1))
    return values.to_pylist()


def test_delimiters_quotes_and_joiners():
    assert split('"mirror, lantern and canal", amber garden') == ["mirror, lantern and canal", "amber garden"]
    assert split("AKA: wandering letter; unlit bridge") == ["wandering letter", "unlit bridge"]
    assert split("a.k.a. one aka two / three、four•five\tsix\nseven|eight") == ["one", "two", "three", "four", "five", "six", "seven", "eight"]
    assert split("misty/ribbon, a / b") == ["misty/ribbon", "a", "b"]
    assert split("“garden, orchard”, “amber”") == ["garden, orchard", "amber"]
    assert split('Ann "Annie" Oak, Bo') == ['Ann "Annie" Oak', "Bo"]
    assert split('"circus ""fading""","b"') == ['circus "fading"', "b"]
    assert split('["salon \\"tidal\\"", "x; y", "caf\\u00e9"]') == ['salon "tidal"', "x; y", "café"]
    assert split("also known as \"x aka y\", z") == ["x aka y", "z"]


def test_nothing_is_no_value():
    for text in (None, "", " ", " , ", "[]", "-", "n/a", "unknown", ",;|", '""'):
        assert split(text) == []
    assert split(", a, , n/a, b,") == ["a", "b"]


def test_odd_quote_is_a_letter():
    assert split('5" tall, b') == ['5" tall', "b"]


def test_very_long_text_and_many_rows():
    long = ", ".join(f"name {i}" for i in range(20_000))
    parents, pos, values = split_strings(pa.array([None, long, "a"], pa.string()))
    assert len(values) == 20_001 and parents[-1] == 2 and pos[-2] == 20_000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(categories=["Lu", "Ll"], max_codepoint=0x17F), min_size=3, max_size=12), min_size=1, max_size=8))
def test_round_trip_quoted_and_json(names):
    names = [n + "x1" for n in names]
    assert split(", ".join(f'"{n}, jr"' for n in names)) == [f"{n}, jr" for n in names]
    assert split(json.dumps([n + "; z" for n in names])) == [n + "; z" for n in names]


def test_frame(spark):
    df = spark.createDataFrame([(1, "a, b", 7), (1, "a, b", 8), (2, None, 1), (None, "x", 1), (3, "", 1)], "id bigint, aliases string, pos int")
    rows = sorted(tuple(r) for r in split_packed(df, "id", "aliases").collect())
    assert rows == [(1, 1, "a"), (1, 2, "b")]
    assert split_packed(df.limit(0), "id", "aliases").collect() == []
