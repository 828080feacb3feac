"""Problem 10: the language of every document and of every stretch of it, by a linear-chain conditional random field.

Words are labelled with languages. A word's score comes from its affixes, its character n-grams and a lexicon of frequent
words; two learned transition matrices, one within sentences and one between them, tie neighbours together.
Forward-backward gives each word its marginals, which are summed over sentences. The field is fitted on the driver by
gradient ascent over a bounded sample of labelled documents (FIT_DOCS a language), until its marginals stand, and learns
from those sentences only that bear out their document's label; all documents are then labelled.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.leaks import spread
from weftline.session import table

LANGS = ["de", "en", "es", "fr", "it", "nl", "pt", "sv"]
#: Labelled documents of each language that the field is fitted on at most, characters that such a document may have, and
#: sentences of each, from all over it, so that no document with a wrong label outweighs many with the right one.
FIT_DOCS, FIT_CHARS, FIT_SENTENCES = 250, 20_000, 12
FEATURES = 1 << 17
#: Words of the sample that must have a feature for it to count.
LEAST_COUNT = 5
#: Steps of the ascent at most: on samples of very few words marginals may swing on.
MOST_STEPS = 150

# Notations of the languages' names, as they stand in front of any region.
NAMES = {
    "de": "de deu ger german deutsch germany", "en": "en eng english englisch anglais", "es": "es spa esp spanish espanol español castellano", "fr": "fr fra fre french francais français",
    "it": "it ita italian italiano", "nl": "nl nld dut dutch nederlands", "pt": "pt por portuguese portugues português", "sv": "sv swe swedish svenska",
}

_LINK = re.compile(r"(?:https?://|www\.)\S+", re.I)
_TAG = re.compile(r"<[/!a-zA-Z][^<>]{0,500}>")
_WORD = re.compile(r"[^\W\d_]+")
# the end of a sentence: a stop behind at least two letters, digits or a bracket, with its closing quotes, and a blank
_END = re.compile(r"(?:(?<=\w\w)|(?<=[)\]\d\"'»”“’]))[.!?…]+[\"'»”“’)\]]*(?=\s)|\n\s*(?:[-*_=#~]{3,}\s*)?(?:\n|$)|\n\s*[-*_=#~]{3,}\s*")


def label_of(c: Column) -> Column:
    """The two-letter code that a label names, null if it names none of the languages."""
    head = F.regexp_extract(F.lower(F.btrim(c)), r"^([\p{L}]+)", 1)
    names = F.create_map(*[F.lit(x) for code, words in NAMES.items() for w in words.split() for x in (w, code)])
    return F.try_element_at(names, head)


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence; links, markup and sentences without words do not count."""
    if "&" in text:
        text = html.unescape(text)
    if "http" in text or "www." in text:
        text = _LINK.sub(" ", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    out, lo = [], 0
    for m in _END.finditer(text):
        out.append(text[lo : m.end()])
        lo = m.end()
    out.append(text[lo:])
    found = [_WORD.findall(s) for s in out]
    return [s for s in found if s]


def features(word: str) -> list[int]:
    """Hashed features of a word: itself, prefixes and suffixes, trigrams, and whether it is written like a name."""
    w = word.lower()
    marked = "^" + w + "$"
    out = ["w" + w, "cap" if word[:1].isupper() else "low"]
    out += ["p" + w[:k] for k in (1, 2, 3) if len(w) > k] + ["s" + w[-k:] for k in (1, 2, 3, 4) if len(w) > k]
    out += ["g" + marked[i : i + 3] for i in range(len(marked) - 2)]
    return [crc32(f.encode("utf-8", "surrogatepass")) % FEATURES for f in out]


class Field:
    """Weights of the conditional random field."""

    def __init__(self, weights: np.ndarray, inside: np.ndarray, between: np.ndarray):
        self.weights, self.inside, self.between = weights, inside, between
        self.cache: dict[str, int] = {}
        self.rows = np.zeros((1024, len(LANGS)), np.float32)

    def scores(self, words: list[str]) -> np.ndarray:
        """The score of each word for each language; words seen before are looked up."""
        cache = self.cache
        idx = np.empty(len(words), np.int64)
        for i, w in enumerate(words):
            k = cache.get(w)
            if k is None:
                k = len(cache)
                if k == len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                f = features(w)
                self.rows[k] = self.weights[f].sum(axis=0) / len(f) ** 0.5
                cache[w] = k
            idx[i] = k
        out = self.rows[idx]
        if len(cache) > 400_000:
            self.cache = {}
        return out

    def marginals(self, scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, opens: np.ndarray) -> np.ndarray:
        """Forward-backward over sequences laid one after the other. opens: whether a word begins a sentence."""
        return forward_backward(scores, starts, lengths, opens, self.inside, self.between)[0]


def forward_backward(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, opens: np.ndarray, inside: np.ndarray, between: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """Marginals of each word and, if asked for, expected counts of transitions inside and between sentences.

    All sequences take a step at once, longest first, so that the ones still running are a prefix of the arrays.
    """
    n = len(LANGS)
    order = np.argsort(-lengths, kind="stable")
    st, ln = starts[order], lengths[order]
    running = np.searchsorted(-ln, -np.arange(ln[0] if len(ln) else 0), side="left")  # sequences longer than t
    e = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64)
    ti, tb = np.exp(inside), np.exp(between)
    alpha = np.empty_like(e)
    for t in range(len(running)):
        k = running[t]
        at = st[:k] + t
        if t == 0:
            a = e[at].copy()
        else:
            b = opens[at][:, None]
            prev = alpha[at - 1]
            a = np.where(b, prev @ tb, prev @ ti) * e[at]
        alpha[at] = a / a.sum(axis=1, keepdims=True)
    post = alpha.copy()
    ci, cb = np.zeros((n, n)), np.zeros((n, n))
    beta = np.ones((len(st), n))
    for t in range(len(running) - 1, 0, -1):
        k = running[t]
        at = st[:k] + t
        b = opens[at][:, None]
        v = e[at] * beta[:k]
        if pairs:
            open_rows = opens[at]
            for mask, trans, acc in ((~open_rows, ti, ci), (open_rows, tb, cb)):
                if mask.any():
                    x = alpha[at[mask] - 1][:, :, None] * trans * v[mask][:, None, :]
                    acc += (x / x.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        nb = np.where(b, v @ tb.T, v @ ti.T)
        beta[:k] = nb / nb.sum(axis=1, keepdims=True)
        p = alpha[at - 1] * beta[:k]
        post[at - 1] = p / p.sum(axis=1, keepdims=True)
    return post, ci if pairs else None, cb if pairs else None


def fit(samples: list[tuple[str, str]], rate: float = 0.5, seed: int = 7) -> Field:
    """(language, text) of documents -> a field.

    The labels are not trusted: only sentences whose words bear out the label of their document are learned from (see
    `borne_out`). Code-switched sequences are made by joining sentences of several languages.
    """
    rng = np.random.default_rng(seed)
    held = []
    for lang, text in samples:
        own = [s for s in sentences(text) if len(s) >= 3]
        held += [(LANGS.index(lang), own[i]) for i in sorted(rng.permutation(len(own))[:FIT_SENTENCES])]
    agreed = borne_out(held)
    if not agreed:
        return Field(np.zeros((FEATURES, len(LANGS)), np.float32), np.eye(len(LANGS)) * 2.0, np.eye(len(LANGS)) * 1.0)
    return _ascend(agreed, _switched(agreed, rng), rate)


def borne_out(held: list[tuple[int, list[str]]]) -> list[tuple[int, list[str]]]:
    """(label, words) of sentences -> those whose words fit their label best.

    Each label begins as a mixture of its own language and of what is wrongly labelled with it, whose shares differ from
    label to label. Word frequencies of every class are taken from its sentences, each sentence goes to the class that
    makes its words most likely, and so on until none moves: a language that is the lesser part of all labels but its own
    ends up in its own class, since all of its words are more frequent there.
    """
    n = len(LANGS)
    if not held:
        return []
    label = np.array([k for k, _ in held])
    sizes = np.array([len(w) for _, w in held])
    types, idx = np.unique(np.array([w.lower() for _, s in held for w in s], dtype=object), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    now, before = label, None
    while before is None or (now != before).any():
        counts = np.stack([np.bincount(idx, weights=np.repeat(now == k, sizes), minlength=len(types)) for k in range(n)], axis=1) + 0.1
        odds = np.log(counts / counts.sum(axis=0))
        # a label none of the sentences has can't win any
        odds[:, np.bincount(now, minlength=n) == 0] = -1e9
        total = np.add.reduceat(odds[idx], starts, axis=0)
        # the likelihood never falls from round to round, so no state comes twice; what is as likely stays where it is
        best = total.argmax(axis=1)
        stays = total[np.arange(len(now)), now] >= total[np.arange(len(now)), best] - 1e-9
        now, before = np.where(stays, now, best), now
    return [x for x, k in zip(held, now, strict=True) if x[0] == k]


def _switched(held: list[tuple[int, list[str]]], rng: np.random.Generator) -> list[list[int]]:
    """Sequences of two to six sentences, with a change of language at about every third."""
    queue: dict[int, list[int]] = {}
    for i in rng.permutation(len(held)):
        queue.setdefault(held[i][0], []).append(int(i))
    sequences = []
    while queue:
        seq, lang = [], int(rng.choice(list(queue)))
        for _ in range(int(rng.integers(2, 7))):
            if lang not in queue or rng.random() < 0.3:
                if not queue:
                    break
                lang = int(rng.choice(list(queue)))
            seq.append(queue[lang].pop())
            if not queue[lang]:
                del queue[lang]
        sequences.append(seq)
    return sequences


def _ascend(held: list[tuple[int, list[str]]], sequences: list[list[int]], rate: float, enough: float = 1e-3) -> Field:
    """Gradient ascent until the words' marginals stand: a step that changes none of the mean marginals of the right labels by `enough`."""
    n = len(LANGS)
    words = [w for seq in sequences for i in seq for w in held[i][1]]
    gold = np.array([held[i][0] for seq in sequences for i in seq for _ in held[i][1]])
    opens = np.array([k == 0 for seq in sequences for i in seq for k in range(len(held[i][1]))])
    lengths = np.array([sum(len(held[i][1]) for i in seq) for seq in sequences])
    starts = np.cumsum(lengths) - lengths
    types, idx = np.unique(np.array(words, dtype=object), return_inverse=True)
    feats = [features(w) for w in types]
    size = np.array([len(f) for f in feats])
    flat, owner = np.concatenate([np.array(f) for f in feats]), np.repeat(np.arange(len(types)), size)
    scale = 1 / np.sqrt(size)
    # a feature of very few words says nothing about a language; the lexicon is what is left of the words
    often = np.bincount(flat, weights=np.bincount(idx, minlength=len(types))[owner], minlength=FEATURES) >= LEAST_COUNT
    flat, owner = flat[often[flat]], owner[often[flat]]
    used, flat = np.unique(flat, return_inverse=True)
    w, gw = np.zeros((len(used), n)), np.full((len(used), n), 1e-6)
    inside, between = np.eye(n) * 2.0, np.eye(n) * 1.0
    gi, gb = np.full((n, n), 1e-6), np.full((n, n), 1e-6)
    hot = np.zeros((len(words), n))
    hot[np.arange(len(words)), gold] = 1
    first = np.zeros(len(words), bool)
    first[starts] = True
    to, frm = gold[1:], gold[:-1]
    true_i, true_b = np.zeros((n, n)), np.zeros((n, n))
    np.add.at(true_i, (frm[~first[1:] & ~opens[1:]], to[~first[1:] & ~opens[1:]]), 1)
    np.add.at(true_b, (frm[~first[1:] & opens[1:]], to[~first[1:] & opens[1:]]), 1)

    def per_feature(x: np.ndarray) -> np.ndarray:
        by_type = np.stack([np.bincount(idx, weights=x[:, k], minlength=len(types)) for k in range(n)], axis=1) * scale[:, None]
        return np.stack([np.bincount(flat, weights=by_type[owner, k], minlength=len(used)) for k in range(n)], axis=1)

    # the mean marginal of the right label, by label
    right, labels = np.zeros(n), np.bincount(gold, minlength=n)
    for _ in range(MOST_STEPS):
        emit = np.stack([np.bincount(owner, weights=w[flat, k], minlength=len(types)) for k in range(n)], axis=1) * scale[:, None]
        post, ci, cb = forward_backward(emit[idx], starts, lengths, opens, inside, between, pairs=True)
        was, right = right, np.bincount(gold, weights=post[np.arange(len(gold)), gold], minlength=n) / np.maximum(labels, 1)
        if np.abs(right - was).max() < enough:
            break
        # Adagrad on the penalised likelihood
        for x, acc, g in ((w, gw, per_feature(hot - post) - 0.5 * w), (inside, gi, true_i - ci), (between, gb, true_b - cb)):
            acc += g * g
            x += rate * g / np.sqrt(acc)
        # transitions stay distributions, so that none of the languages gains by the length of a text
        for x in (inside, between):
            x -= np.log(np.exp(x).sum(axis=1, keepdims=True))
    weights = np.zeros((FEATURES, n), np.float32)
    weights[used] = w
    return Field(weights, inside, between)


def label_texts(field: Field, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Stretches of one language of each text: (number of the text, stretch from 1, language, confidence).

    A sentence's language is the one with the largest sum of its words' marginals; where that is under half of them, it is
    that of the sentence before. Texts without words have no stretch.
    """
    words, opens, sent_len, sent_doc, lengths, docs = [], [], [], [], [], []
    for d, text in enumerate(texts):
        own = sentences(text) if text else []
        if not own:
            continue
        n = 0
        for s in own:
            words += s
            opens += [True] + [False] * (len(s) - 1)
            sent_len.append(len(s))
            sent_doc.append(d)
            n += len(s)
        lengths.append(n)
        docs.append(d)
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), [], np.zeros(0)
    ln = np.array(lengths)
    post = field.marginals(field.scores(words), np.cumsum(ln) - ln, ln, np.array(opens))
    sl, sd = np.array(sent_len), np.array(sent_doc)
    sums = np.add.reduceat(post, np.cumsum(sl) - sl, axis=0)
    best = sums.argmax(axis=1)
    # a sentence that is of no language by half, such as a bare name, goes with the one before it
    sure = (sums.max(axis=1) >= 0.5 * sl) | np.append(True, np.diff(sd) != 0)
    best = best[np.maximum.accumulate(np.where(sure, np.arange(len(best)), 0))]
    new = np.ones(len(sd), bool)
    new[1:] = (np.diff(sd) != 0) | (np.diff(best) != 0)
    at = np.flatnonzero(new)
    doc, lang = sd[at], best[at]
    total = np.add.reduceat(sums, at, axis=0)
    conf = total[np.arange(len(at)), lang] / total.sum(axis=1)
    first = np.searchsorted(doc, doc, side="left")
    return doc, (np.arange(len(at)) - first + 1).astype(np.int32), [LANGS[k] for k in lang], conf


def fit_sample(docs: DataFrame, per_lang: int = FIT_DOCS, chars: int = FIT_CHARS) -> list[tuple[str, str]]:
    """At most `per_lang` whole documents for each label, by hash of their id, none of more than `chars` characters."""
    known = docs.select("doc_id", label_of(F.col("lang")).alias("code"), "text").where(f"code is not null and length(text) between 40 and {chars}")
    # a bound on the hash that keeps about twice as many as are wanted, then exactly the least of those: no text is sorted but these
    share = known.groupBy("code").agg(F.count("*").alias("n"))
    bound = F.lit(-(2.0**63)) + F.lit(2.0**64) * F.least(F.lit(1.0), F.lit(2.0 * per_lang + 50) / F.col("n"))
    near = known.withColumn("h", F.xxhash64("doc_id")).join(F.broadcast(share), "code").where(F.col("h").cast("double") <= bound)
    ranked = near.withColumn("k", F.row_number().over(Window.partitionBy("code").orderBy("h", "doc_id"))).where(F.col("k") <= per_lang)
    return [(r.code, r.text) for r in ranked.select("code", "text", "doc_id").orderBy("code", "doc_id").collect()]


def language_segments(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs(doc_id, text, lang) -> (doc_id, code, seg, of, lang, confidence): every stretch of whole sentences in one language.

    code is what the document's label names, null if it names nothing; `of` is the number of the document's stretches.
    Null, empty and wordless texts have no row.
    """
    field = field or fit(fit_sample(docs))
    shared = docs.sparkSession.sparkContext.broadcast((field.weights, field.inside, field.between))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*shared.value)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                doc, seg, lang, conf = label_texts(own, part.column(2).to_pylist())
                at = pa.array(doc, pa.int64())
                of = np.bincount(doc)[doc].astype(np.int32) if len(doc) else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(seg), pa.array(of), pa.array(lang, pa.string()), pa.array(conf, pa.float64())], names=["doc_id", "code", "seg", "of", "lang", "confidence"])

    read = spread(docs.where("text is not null").select("doc_id", label_of(F.col("lang")).alias("code"), "text"))
    return read.mapInArrow(label, "doc_id bigint, code string, seg int, of int, lang string, confidence double")


def doubtful(segments: DataFrame) -> DataFrame:
    """Of `language_segments`, the documents whose label is missing, names nothing or is wrong, and those in several languages."""
    return segments.where((F.col("of") > 1) | F.col("code").isNull() | (F.col("code") != F.col("lang")))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return doubtful(language_segments(table(spark, sf, "documents").select("doc_id", "text", "lang"))).select("doc_id", "seg", "lang")


def p10_documents(spark: SparkSession, sf: str) -> DataFrame:
    """One row per document: its languages in order of appearance and the least confidence of its stretches."""
    segments = language_segments(table(spark, sf, "documents").select("doc_id", "text", "lang"))
    return segments.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "lang"))), lambda x: x["lang"]), ",").alias("languages"), F.round(F.min("confidence"), 4).alias("confidence"))


QUERIES = {"p10_found": p10_found, "p10_documents": p10_documents}
ORACLES: dict[str, str] = {}
