"""Problem 9: passages of held-out items that appear, letter for letter or changed a little, in documents.

Pigeonhole: a passage of L words with at most e = L // 8 of them changed has, among e + 1 equal pieces, one that is exact.
Passages of 48 words and more hold a shorter one that qualifies too, so L is 24, 32 or 40 and a piece has 6 words. All runs
of 6 words of all items are looked up in every document; what is hit is checked by counting matches near the hit's
diagonal, and what is left is verified with Myers' bit-parallel edit distance over words. Whole texts are searched.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import table

PIECE, LENGTHS = 6, (24, 32, 40)
#: Words of items in one broadcast; a larger set of items is searched in blocks of this size.
BLOCK_WORDS = 2_000_000

# Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("асеорхуіјѕһԁԛԝьвкмнтαβεικνορτυχγωɑɡıᴀ", "aceopxyijshdqwbbkmhtabeiknoptuxywagia", strict=True))
_SIMILAR = str.maketrans({**LOOKALIKES, "­": None, "​": None, "‌": None, "‍": None, "⁠": None, "﻿": None, "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-"})
_INLINE = re.compile(r"</?(?:b|i|u|em|strong|span|a|font|sup|sub|mark|small)\b[^<>]{0,500}>", re.I)
_TAG = re.compile(r"<[/!a-zA-Z][^<>]{0,500}>")
_WORD = re.compile(r"[^\W\d_]+-\d+|[^\W_]+")
_MARKS = re.compile(r"[̀-ͯ]")


def words_of(text: str | None) -> list[str]:
    """The words of a text, without case, accents, punctuation, markup, look-alikes; codes such as AB-123 are one word."""
    if not text:
        return []
    if not text.isascii() or "&" in text or "<" in text:
        if "&" in text:
            text = html.unescape(html.unescape(text))
        if "<" in text:
            text = _TAG.sub(" ", _INLINE.sub("", text))
        if not text.isascii():
            text = _MARKS.sub("", unicodedata.normalize("NFKD", text.translate(_SIMILAR))).casefold().translate(_SIMILAR)
    return _WORD.findall(text.casefold())


class Items:
    """Held-out items as one array of word numbers, and all runs of PIECE words in it, sorted by hash."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocab: dict[str, int] = {}
        words, self.owner_ids = [], [i for i, _ in items]
        owner = []
        for k, (_, text) in enumerate(items):
            own = [self.vocab.setdefault(w, len(self.vocab)) for w in words_of(text)]
            words += [*own, -2]
            owner += [k] * (len(own) + 1)
        self.words, self.owner = np.array(words, np.int32), np.array(owner, np.int32)
        h, ok = runs(self.words)
        at = np.flatnonzero(ok)
        order = np.argsort(h[at], kind="stable")
        self.at, self.hash = at[order].astype(np.int64), h[at][order]


def runs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each run of PIECE words, and whether it has only known words."""
    n = max(0, len(words) - PIECE + 1)
    h, ok = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(PIECE):
        w = words[k : k + n]
        h = h * np.uint64(0x9E3779B97F4A7C15) + (w.astype(np.int64) + 3).astype(np.uint64)
        h ^= h >> np.uint64(29)
        ok &= w >= 0
    return h, ok


def _near(items: np.ndarray, docs: np.ndarray, q: np.ndarray, p: np.ndarray, lo: int, hi: int, band: int) -> np.ndarray:
    """Whether the item's word at q + k is in the document near p + k, for k from lo to hi: one row for each hit."""
    k = np.arange(lo, hi)
    iw = items[np.clip(q[:, None] + k, 0, len(items) - 1)]
    iw = np.where((q[:, None] + k < 0) | (q[:, None] + k >= len(items)), -2, iw)
    wide = np.arange(lo - band, hi + band)
    dw = docs[np.clip(p[:, None] + wide, 0, len(docs) - 1)]
    dw = np.where((p[:, None] + wide < 0) | (p[:, None] + wide >= len(docs)), -3, dw)
    found = np.zeros(iw.shape, bool)
    for s in range(2 * band + 1):
        found |= iw == dw[:, s : s + iw.shape[1]]
    # a document's unknown words and ends are negative, an item's end is -2
    return found & (iw >= 0)


def _windows(found: np.ndarray, inside: np.ndarray, piece_at: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, hit, start) of the windows around the piece that miss at most an eighth of their words."""
    out = []
    miss = np.concatenate([np.zeros((len(found), 1), np.int32), np.cumsum(~found, axis=1, dtype=np.int32)], axis=1)
    away = np.concatenate([np.zeros((len(found), 1), np.int32), np.cumsum(~inside, axis=1, dtype=np.int32)], axis=1)
    for length in LENGTHS:
        first, last = max(0, piece_at + PIECE - length), min(piece_at, found.shape[1] - length)
        starts = np.arange(first, last + 1)
        if not len(starts):
            continue
        few = (miss[:, starts + length] - miss[:, starts] <= length // 8) & (away[:, starts + length] == away[:, starts])
        hit, at = np.nonzero(few)
        out.append((length, hit, starts[at]))
    return out


def myers(pattern: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The least edit distance of each pattern (row of at most 64 words) to any part of its text (row), bit-parallel."""
    n, m = pattern.shape
    one, high = np.uint64(1), np.uint64(1) << np.uint64(m - 1)
    full = np.uint64(0xFFFFFFFFFFFFFFFF) if m == 64 else (one << np.uint64(m)) - one
    bits = one << np.arange(m, dtype=np.uint64)
    vp, vn = np.full(n, full), np.zeros(n, np.uint64)
    score = np.full(n, m, np.int32)
    best = score.copy()
    for j in range(text.shape[1]):
        eq = ((pattern == text[:, j, None]) * bits).sum(axis=1, dtype=np.uint64)
        x = eq | vn
        d0 = ((vp + (x & vp)) ^ vp) | x
        hn, hp = vp & d0, vn | ~(vp | d0)
        score = score + ((hp & high) != 0) - ((hn & high) != 0)
        hp, hn = (hp << one) & full, (hn << one) & full
        vp, vn = (hn | ~(hp | d0)) & full, hp & d0 & full
        np.minimum(best, score, out=best)
    return best


def find_leaks(items: Items, texts: list[str | None], step: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Texts against items -> (number of the text, number of the item), each pair once."""
    known = items.vocab
    words, owner = [], []
    for k, text in enumerate(texts):
        own = [known.get(w, -1) for w in words_of(text)]
        words.append(np.array([*own, -1], np.int32))
        owner.append(len(own) + 1)
    if not words or not len(items.hash):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    docs, doc_of = np.concatenate(words), np.repeat(np.arange(len(texts)), owner)
    h, ok = runs(docs)
    at = np.flatnonzero(ok)
    lo, hi = np.searchsorted(items.hash, h[at], "left"), np.searchsorted(items.hash, h[at], "right")
    hits = hi - lo
    p = np.repeat(at, hits)
    q = items.at[np.repeat(lo, hits) + np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits)] if hits.sum() else np.zeros(0, np.int64)
    # of hits of one document on one diagonal of one item, one after the other, the first stands for all that overlap it
    order = np.lexsort((p, p - q))
    p, q = p[order], q[order]
    same = np.zeros(len(p), bool)
    if len(p):
        same[1:] = (np.diff(p - q) == 0) & (np.diff(p) == 1) & (items.owner[q[1:]] == items.owner[q[:-1]])
        # ... a run of hits is kept at its first and at every sixth, so that every window holds a kept one
        start = np.maximum.accumulate(np.where(~same, np.arange(len(p)), 0))
        same &= (np.arange(len(p)) - start) % PIECE != 0
    p, q = p[~same], q[~same]
    reach, band = LENGTHS[-1] - PIECE, LENGTHS[-1] // 8
    pairs: set[tuple[int, int]] = set()
    for s in range(0, len(p), step):
        pp, qq = p[s : s + step], q[s : s + step]
        # first along a narrow stretch: of any window that qualifies, the half beside the piece misses no more than the whole may
        side = 9
        left, right = _near(items.words, docs, qq, pp, -side, 0, band).sum(axis=1), _near(items.words, docs, qq, pp, PIECE, PIECE + side, band).sum(axis=1)
        good = np.maximum(left, right) >= side - LENGTHS[-1] // 8
        pp, qq = pp[good], qq[good]
        if not len(pp):
            continue
        found = _near(items.words, docs, qq, pp, -reach, LENGTHS[-1], band)
        k = np.arange(-reach, LENGTHS[-1])
        where = np.clip(qq[:, None] + k, 0, len(items.words) - 1)
        inside = (qq[:, None] + k >= 0) & (qq[:, None] + k < len(items.words)) & (items.words[where] >= 0) & (items.owner[where] == items.owner[qq][:, None])
        for length, hit, start in _windows(found, inside, reach):
            e = length // 8
            new = [i for i, (a, b) in enumerate(zip(doc_of[pp[hit]].tolist(), items.owner[qq[hit]].tolist(), strict=True)) if (a, b) not in pairs]
            hit, start = hit[new], start[new]
            for z in range(0, len(hit), 4096):
                ht, st = hit[z : z + 4096], start[z : z + 4096]
                first = qq[ht] - reach + st
                pattern = items.words[first[:, None] + np.arange(length)]
                span = pp[ht] - reach + st
                cells = span[:, None] + np.arange(-e, length + e)
                text = docs[np.clip(cells, 0, len(docs) - 1)]
                own = (cells >= 0) & (cells < len(docs)) & (doc_of[np.clip(cells, 0, len(docs) - 1)] == doc_of[pp[ht]][:, None])
                near = myers(pattern, np.where(own, text, -1)) <= e
                pairs |= set(zip(doc_of[pp[ht[near]]].tolist(), items.owner[qq[ht[near]]].tolist(), strict=True))
    done = np.array(sorted(pairs), np.int64).reshape(-1, 2)
    return done[:, 0], done[:, 1]


def spread(df: DataFrame, per_core: int = 3) -> DataFrame:
    """`df` in enough partitions to keep all cores busy; as it is where it has them, so that large inputs are never shuffled."""
    least = df.sparkSession.sparkContext.defaultParallelism * per_core
    return df if df.rdd.getNumPartitions() * 2 >= least else df.repartition(least)


def leaked_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> (doc_id, item_id), each pair once.

    A document leaks an item if it holds at least 24 consecutive words of it with at most an eighth changed, by edits of
    words. Null and empty texts leak nothing, items shorter than that cannot leak. The items are a stated query set: they
    are broadcast in blocks of at most BLOCK_WORDS words, and every document is searched for each block.
    """
    spark = docs.sparkSession
    held = [(r.item_id, r.text) for r in items.select("item_id", "text").where("item_id is not null and text is not null").dropDuplicates(["item_id"]).orderBy("item_id").toLocalIterator()]
    blocks, size = [[]], 0
    for item in held:
        n = len(item[1]) // 4 + 1
        if size + n > BLOCK_WORDS:
            blocks, size = [*blocks, []], 0
        blocks[-1].append(item)
        size += n
    docs = spread(docs.where("text is not null").select("doc_id", "text"))
    out = None
    for block in blocks:
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            known = Items(shared.value)
            ids = np.array(known.owner_ids or [0], np.int64)
            for b in batches:
                for lo in range(0, b.num_rows, 500):
                    part = b.slice(lo, 500)
                    d, i = find_leaks(known, part.column(1).to_pylist())
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(d)), pa.array(ids[i])], names=["doc_id", "item_id"])

        part = docs.mapInArrow(search, "doc_id bigint, item_id bigint")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaked_items(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p9_by_item(spark: SparkSession, sf: str) -> DataFrame:
    """Each test item with the number of documents that leak it, none included."""
    counts = p9_found(spark, sf).groupBy("item_id").agg(F.count("*").alias("documents"))
    return table(spark, sf, "eval_items").select("item_id", "task").join(counts, "item_id", "left").select("item_id", "task", F.coalesce("documents", F.lit(0)).alias("documents"))


QUERIES = {"p9_found": p9_found, "p9_by_item": p9_by_item}
ORACLES: dict[str, str] = {}
