import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import languages as L


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    n, lengths = len(L.LANGS), np.array([3, 1, 2])
    scores, opens = rng.normal(size=(6, n)), np.array([True, False, True, True, True, False])
    inside, between = rng.normal(size=(n, n)), rng.normal(size=(n, n))
    post, ci, cb = L.forward_backward(scores, np.cumsum(lengths) - lengths, lengths, opens, inside, between, pairs=True)
    at, want_i, want_b = 0, np.zeros((n, n)), np.zeros((n, n))
    for ln in lengths:
        total, marg = 0.0, np.zeros((ln, n))
        ti, tb = np.zeros((n, n)), np.zeros((n, n))
        for path in itertools.product(range(n), repeat=int(ln)):
            s = sum(scores[at + k, y] for k, y in enumerate(path)) + sum((between if opens[at + k] else inside)[path[k - 1], path[k]] for k in range(1, ln))
            p = np.exp(s)
            total += p
            for k, y in enumerate(path):
                marg[k, y] += p
                if k:
                    (tb if opens[at + k] else ti)[path[k - 1], y] += p
        assert np.allclose(post[at : at + ln], marg / total)
        want_i += ti / total
        want_b += tb / total
        at += ln
    assert np.allclose(ci, want_i) and np.allclose(cb, want_b)


def test_sentences():
    assert L.sentences("One two. Three J. Smith said AB-12 (XY-3). https://a.test/b Four?\n---\nFive") == [["One", "two"], ["Three", "J", "Smith", "said", "AB", "XY"], ["Four"], ["Five"]]
    assert L.sentences("") == [] and L.sentences("1 2 3 …") == []


def test_labels(spark):
    cases = {"en-US": "en", "English": "en", "de_DE": "de", "por": "pt", "es-419": "es", "mul": None, "": None, None: None, "und": None, " SV ": "sv", "xx": None}
    df = spark.createDataFrame([(c,) for c in cases], "c string").select("c", L.label_of(F.col("c")).alias("v"))
    assert {r.c: r.v for r in df.collect()} == cases


@pytest.fixture(scope="module")
def field(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    return L.fit(L.fit_sample(spark.read.parquet(f"{big}/documents.parquet")))


# sentences that are no test data
HELD_OUT = {
    "en": "The train was late again, and nobody could tell us why.", "de": "Wir haben gestern lange auf den Zug gewartet, aber er kam nicht.", "fr": "Nous avons attendu le train pendant des heures sans savoir pourquoi.", "es": "Ayer esperamos el tren durante horas y nadie nos dijo nada.",
    "it": "Ieri abbiamo aspettato il treno per ore e nessuno ci ha detto niente.", "nl": "Wij hebben gisteren uren op de trein gewacht en niemand wist waarom.", "pt": "Ontem esperámos o comboio durante horas e ninguém nos disse nada.", "sv": "Vi väntade på tåget i flera timmar igår och ingen visste varför.",
}


def test_held_out_sentences_and_switches(field):
    langs = list(HELD_OUT)
    doc, seg, lang, conf = L.label_texts(field, [HELD_OUT[x] for x in langs])
    assert sum(a == b for a, b in zip(lang, langs)) >= 7
    doc, seg, lang, conf = L.label_texts(field, [HELD_OUT["en"] + " " + HELD_OUT["de"] + " " + HELD_OUT["de"], None, "", "123"])
    assert doc.tolist() == [0, 0] and seg.tolist() == [1, 2] and lang == ["en", "de"] and (conf > 0.5).all()


def test_accuracy_on_labelled_documents(spark, sf, field):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    per = {}
    for r in L.language_segments(docs, field).collect():
        per.setdefault(r.doc_id, []).append((r.code, r.lang))
    single = [v[0] for v in per.values() if len(v) == 1 and v[0][0]]
    # a tenth of the labels is wrong on purpose
    assert sum(a == b for a, b in single) / len(single) > 0.85


def test_frame(spark, field):
    rows = [(1, HELD_OUT["en"], "en"), (2, HELD_OUT["de"], "en"), (3, HELD_OUT["fr"], None), (4, None, None), (5, "", ""), (6, HELD_OUT["en"] + "\n\n" + HELD_OUT["sv"], "English"), (7, HELD_OUT["en"] * 3000, "eng")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {(r.doc_id, r.seg, r.lang) for r in L.doubtful(L.language_segments(df, field)).collect()}
    assert got == {(2, 1, "de"), (3, 1, "fr"), (6, 1, "en"), (6, 2, "sv")}
    assert L.language_segments(df.limit(0), field).collect() == []
    assert L.fit_sample(df.limit(0)) == []


def test_sentences_under_wrong_labels_are_left_out():
    # in every label but its own, English is a fifth, so that more of it lies under wrong labels than under its own
    words = {k: [f"{x}{i}" for i in range(40)] for k, x in enumerate(L.LANGS)}
    rng = np.random.default_rng(3)
    say = lambda k: [words[k][i] for i in rng.integers(0, 40, 9)]
    en = L.LANGS.index("en")
    held = [(k, say(k)) for k in range(len(L.LANGS)) for _ in range(80)] + [(k, say(en)) for k in range(len(L.LANGS)) if k != en for _ in range(20)]
    kept = L.borne_out(held)
    assert sorted(map(str, kept)) == sorted(map(str, held[: 80 * len(L.LANGS)]))
    assert L.borne_out([]) == [] and L.borne_out([(en, ["a"])]) == [(en, ["a"])]


def test_draws_of_the_sample_agree(spark, sf):
    """Fields fitted on other documents label alike: what differs between any two is under two in a hundred stretches."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.1')}/documents.parquet").where("text is not null").select("doc_id", "lang", "text")
    texts = [r.text for r in docs.where("doc_id % 10 = 3").orderBy("doc_id").collect()]
    found = []
    for seed in range(3):
        drawn = L.fit_sample(docs.withColumn("doc_id", F.xxhash64("doc_id", F.lit(seed))))
        doc, seg, lang, _ = L.label_texts(L.fit(drawn), texts)
        found.append(set(zip(doc.tolist(), seg.tolist(), lang, strict=True)))
    assert all(len(a ^ b) < 0.02 * len(a) for a, b in itertools.combinations(found, 2))
