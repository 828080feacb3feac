"""Variant spellings of names: character n-gram vectors, sparse cosine joins, average-linkage clustering.

Names are folded to tokens of plain letters and become tf-idf vectors of the trigrams of their tokens, so order, case,
accents, separators and notes in brackets count for nothing. Similar pairs are found by prefix filtering: with grams in
one global order from rare to frequent, two vectors of cosine t or more share a gram among the first of both, those
before the rest's norm falls below t. The join key is a gram together with a piece of evidence both records must share,
which keeps posting lists short. Clusters are merged in rounds of mutual best neighbours by average similarity; clusters
whose evidence contradicts never merge. Nothing is gathered but the gram statistics, whose number is bounded.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.groups import hash_to_min
from weftline.session import Written

#: Grams kept in a broadcast at most: trigrams of folded letters, of which there are fewer than 30 ** 3 besides rare scripts.
MAX_GRAMS = 200_000
#: Vectors of names that a task keeps at hand at most; others are made anew.
KEPT = 100_000


def _fold_pairs() -> tuple[str, str]:
    """Latin letters with marks and their base letters, by rule."""
    src, dst = [], []
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFKD", chr(code))[0]
        if base.isascii() and base.isalpha():
            src.append(chr(code))
            dst.append(base)
    extra = {"ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "ı": "i", "’": "'", "_": " ", " ": " "}
    return "".join(src) + "".join(extra), "".join(dst) + "".join(extra.values())


def fold_name(c: Column) -> Column:
    """A name as tokens of letters: no accents, case, notes in brackets or behind a dash, quoted nicknames; "B, A" and "AB" with two capitals are "A B"; words such as "Jr." behind a name are left out."""
    src, dst = _fold_pairs()
    plain = c.rlike(r"^(?:[A-Z]?[a-z]+|[A-Z]+)(?: (?:[A-Z]?[a-z]+|[A-Z]+))*$")
    s = F.regexp_replace(F.translate(c, src, dst), r"(\p{Ll})(\p{Lu})", "$1 $2")
    s = F.regexp_replace(F.regexp_replace(F.lower(s), "ß", "ss"), "[æœ]", "ae")
    s = F.regexp_replace(s, r"\([^)]*\)|\[[^\]]*\]|\"[^\"]*\"|“[^”]*”", " ")
    s = F.regexp_replace(s, r" [-–—] .*$", "")
    s = F.regexp_replace(s, r"^\s*([^,]+),\s*+(?!jr\b|sr\b)([^,]+)\s*$", "$2 $1")
    s = F.regexp_replace(F.btrim(F.regexp_replace(s, r"[^\p{L}]+", " ")), r"(?<=\S \S{2,40}) (?:jr|sr|ii|iii)$", "")
    # outside the branch: in it the whole chain would run once for the test and once for the value
    return F.nullif(F.when(plain, F.lower(c)).otherwise(s), F.lit(""))


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name) -> (gram, df): in how many names of a batch each trigram of a token, with its ends marked, is; null has the number of names."""
    for b in batches:
        counts: Counter[str] = Counter()
        for name in b.column("name").to_pylist():
            grams = set()
            for t in (name or "").split(" "):
                p = "^" + t + "$"
                grams.update([p[i : i + 3] for i in range(len(t))])
            counts.update(grams)
        yield pa.RecordBatch.from_arrays([pa.array([None, *counts], pa.string()), pa.array([b.num_rows, *counts.values()], pa.int64())], names=["gram", "df"])


def gram_weights(names: DataFrame) -> dict[str, float]:
    """names(name): distinct -> inverse document frequency of each gram, over all names."""
    per = names.select("name").mapInArrow(_gram_counts, "gram string, df bigint").groupBy("gram").agg(F.sum("df").alias("df"))
    rows = per.orderBy(F.col("gram").isNotNull(), F.desc("df"), "gram").limit(MAX_GRAMS + 2).collect()
    if len(rows) > MAX_GRAMS + 1:
        raise ValueError(f"more than {MAX_GRAMS} grams: names are not folded to letters")
    n = rows[0].df if rows else 0
    return {r.gram: math.log((n + 1) / r.df) + 1e-9 for r in rows[1:]}


class Vectors:
    """Vectors of names: gram ids in the one global order, from rare to frequent, weights, and the norms of what follows."""

    def __init__(self, idf: dict[str, float]):
        self.ids = {g: i for i, g in enumerate(sorted(idf, key=lambda g: (-idf[g], g)))}
        self.idf = [idf[g] for g in self.ids]
        self.weight = np.array(self.idf, np.float64)
        self.kept: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def one(self, name: str) -> tuple[list[int], list[float]]:
        ids, tf = self.ids, {}
        for t in name.split(" "):
            p = "^" + t + "$"
            for i in range(len(t)):
                g = ids.get(p[i : i + 3])
                if g is not None:
                    tf[g] = tf.get(g, 0) + 1
        order = sorted(tf)
        w = [(1 + math.log(tf[g])) * self.idf[g] for g in order]
        norm = math.sqrt(sum(x * x for x in w)) or 1.0
        return order, [x / norm for x in w]

    def many(self, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """`one` for each of `names`: the number of its grams, and all grams and weights one name after the other."""
        n, wide, find, raw, counts = len(names), max(1, len(self.ids)), self.ids.get, [], []
        for name in names:
            before = len(raw)
            for t in name.split(" "):
                p = "^" + t + "$"
                raw += [find(p[i : i + 3], -1) for i in range(len(t))]
            counts.append(len(raw) - before)
        cells = np.array(raw, np.int64)
        cells = (np.repeat(np.arange(n), counts) * wide + cells)[cells >= 0]
        cells, tf = np.unique(cells, return_counts=True)
        owner, ids = cells // wide, cells % wide
        w = (1 + np.log(tf)) * self.weight[ids]
        return np.bincount(owner, minlength=n), ids, w / np.sqrt(np.bincount(owner, weights=w * w, minlength=n))[owner]

    def cosines(self, left: pa.Array, right: pa.Array) -> np.ndarray:
        """The cosine of each pair of two columns of names.

        Vectors of the left names are laid out densely, a block of names at a time; those of the right names pick their
        grams out of them. Vectors are kept between calls, at most KEPT of them.
        """
        n = len(left)
        if not n:
            return np.zeros(0, np.float32)
        both = pa.chunked_array([left, right]).combine_chunks().dictionary_encode()
        codes = both.indices.to_numpy()
        if len(self.kept) > KEPT:
            self.kept.clear()
        names = both.dictionary.to_pylist()
        new = [x for x in names if x not in self.kept]
        size, ids, w = self.many(new)
        ends = np.cumsum(size)
        self.kept |= zip(new, zip(np.split(ids.astype(np.int32), ends[:-1]), np.split(w.astype(np.float32), ends[:-1]), strict=True), strict=True) if new else ()
        made = [self.kept[x] for x in names]
        sizes = np.array([len(x) for x, _ in made], np.int64)
        starts = np.cumsum(sizes) - sizes
        flat_ids, flat_w = np.concatenate([x for x, _ in made]), np.concatenate([y for _, y in made])
        order = np.argsort(codes[:n], kind="stable")
        l, r = codes[:n][order], codes[n:][order]
        out = np.zeros(n, dtype=np.float32)
        out[order] = self.dots(starts, sizes, flat_ids, flat_w, l, r)
        return out

    def dots(self, starts: np.ndarray, sizes: np.ndarray, flat_ids: np.ndarray, flat_w: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The cosine of each pair of vectors that lie at `starts` of two flat arrays; `left` is in order."""
        n = len(left)
        out = np.zeros(n, dtype=np.float32)
        width = len(self.ids) or 1
        names, first = np.unique(left, return_index=True)
        ends = np.append(first, n)
        block = max(1, (1 << 21) // width)
        dense = np.zeros((min(block, len(names)), width), np.float32)
        for lo in range(0, len(names), block):
            own = names[lo : lo + block]
            row, at = _spans(starts[own], sizes[own])
            dense[row, flat_ids[at]] = flat_w[at]
            a, b = ends[lo], ends[min(lo + block, len(names))]
            pair, cell = _spans(starts[right[a:b]], sizes[right[a:b]])
            line = np.repeat(np.arange(len(own)), np.diff(ends[lo : lo + len(own) + 1]))
            out[a:b] = np.bincount(pair, weights=dense[line[pair], flat_ids[cell]] * flat_w[cell], minlength=b - a)
            dense[row, flat_ids[at]] = 0
        return out


def _spans(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of spans of a flat array: the span each cell belongs to, and the cell's place in the array."""
    span = np.repeat(np.arange(len(sizes)), sizes)
    return span, np.arange(len(span)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)


# Evidence two records share, from strong to weak, and the least cosine of their names that it takes.
SAME_DAY, SAME_PLACE, SAME_SEX = 0.3, 0.75, 0.9
#: Records of one birthday up to which all are compared with each other; beyond it only those that share a prefix gram.
TOGETHER = 64
#: The score of a link by the whole name alone, to the only record it can mean.
SAME_NAME = 0.75


#: What two records, units or clusters must not differ in where both have it. `mark` tells performers of one name apart
#: (an ordinal, a role, a year, a country), `year` is that of the birthday or else of the mark.
EVIDENCE = ("born", "gender", "country", "mark", "year")


def with_marks(df: DataFrame) -> DataFrame:
    """df with null for what it lacks of `mark` and `year`."""
    kinds = {"mark": "string", "year": "int"}
    return df.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in df.columns})


def least_cosine(day: np.ndarray, mark: np.ndarray, place: np.ndarray, sex: np.ndarray) -> np.ndarray:
    """The least cosine for each pair, by what both have: birthday, mark, country, gender."""
    return np.where(day, SAME_DAY, np.where(mark, SAME_PLACE, np.where(place, np.where(sex, SAME_PLACE, SAME_PLACE + 0.05), SAME_SEX)))


def with_bearers(profiles: DataFrame) -> DataFrame:
    """profiles(name, born, ...) with `bearers`: how many birthdays the records of each name have, 2 for all that are more than one. A name of several says nothing by itself."""
    per = profiles.groupBy("name").agg(F.when(F.count("born") == 0, 0).when(F.min("born") == F.max("born"), 1).otherwise(2).alias("bearers"))
    return profiles.join(per, "name")


#: Columns of a posting: key of kind, evidence and gram; whether it asks or only answers; weight of the gram and norm of those
#: behind it; the cosine it takes; evidence both must not have; evidence in bits (`_packed_evidence`); all grams (`_sketch`).
POSTING = {"key": "bigint", "asks": "boolean", "weight": "float", "after": "float", "least": "float", "apart": "bigint", "said": "bigint", "mask": "bigint", "mark": "bigint", "marked": "bigint", "b0": "bigint", "b1": "bigint", "b2": "bigint", "b3": "bigint", "slack": "int", "most": "float"}
#: Places of the evidence in its number.
BORN_BITS, YEAR_BITS, GENDER_BITS, COUNTRY_BITS = 0xFFFFF, 0xFFF << 20, 0xFFFF << 32, -1 << 48


def _packed_evidence(b: pa.RecordBatch) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Evidence as numbers in which equal values have equal bits, and masks with the bits of what is there; the mark has its own.

    Values that differ may, very rarely, have equal bits; linkage compares the values themselves.
    """
    said, mask = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
    for column, place in (("born", BORN_BITS), ("year", YEAR_BITS), ("gender", GENDER_BITS), ("country", COUNTRY_BITS)):
        values = b.column(column).dictionary_encode()
        low = place & -place
        codes = np.array([(crc32(str(x).encode()) * low) & (place & (1 << 64) - 1) for x in values.dictionary.to_pylist()] or [0], np.uint64).view(np.int64)
        there = values.is_valid().to_numpy(zero_copy_only=False)
        said |= np.where(there, codes[np.asarray(values.indices.fill_null(0))], 0)
        mask |= np.where(there, np.int64(place), 0)
    marks = b.column("mark").dictionary_encode()
    codes = np.array([crc32(x.encode()) for x in marks.dictionary.to_pylist()] or [0], np.int64)
    there = marks.is_valid().to_numpy(zero_copy_only=False)
    return (said, np.where(there, codes[np.asarray(marks.indices.fill_null(0))], 0)), (mask, np.where(there, np.int64(-1), 0))


def _sketch(line: np.ndarray, ids: np.ndarray, w: np.ndarray, size: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of each name: its grams as 256 bits in four numbers, how many of them share a bit with another, and the largest weight."""
    n = len(size)
    cell = np.unique(line * 256 + ids % 256)
    owner, bit = cell // 256, cell % 256
    bits = [np.zeros(n, np.uint64) for _ in range(4)]
    for k in range(4):
        mine = bit // 64 == k
        np.bitwise_or.at(bits[k], owner[mine], np.uint64(1) << (bit[mine] % 64).astype(np.uint64))
    most = np.zeros(n)
    np.maximum.at(most, line, w)
    return [x.view(np.int64) for x in bits], (size - np.bincount(owner, minlength=n)).astype(np.int32), (most * (1 + 1e-6)).astype(np.float32)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Batches of rows sorted by `key`, cut anew so that the rows of a key are in one batch."""
    rest = None
    for b in batches:
        if not b.num_rows:
            continue
        b = b if rest is None else pa.concat_batches([rest, b])
        keys = b.column(key).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        at = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
        if at:
            yield b.slice(0, at)
        rest = b.slice(at)
    if rest is not None:
        yield rest


#: Pairs of one birthday that are looked at in one go, at most, but for what one record is compared with.
PAIRS = 1 << 18


def _day_links(v: Vectors, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """All pairs of units of one birthday, of similar name and without contradiction; b is in order of birthdays.

    Pairs are laid out over many birthdays at a time, what contradicts falls out first, and only the rest is compared by name.
    """
    days = b.column("born").dictionary_encode().indices.to_numpy(zero_copy_only=False)
    units = b.column("unit").to_numpy(zero_copy_only=False)
    marks = [np.asarray(b.column(x).dictionary_encode().indices.fill_null(-1)) for x in EVIDENCE if x != "born"]
    size, ids, w = v.many(b.column("name").to_pylist())
    starts = np.cumsum(size) - size
    w = w.astype(np.float32)
    # each record is laid out against those behind it on its day
    ends = np.flatnonzero(np.append(np.diff(days) != 0, True)) + 1
    here = np.arange(b.num_rows)
    behind = ends[np.searchsorted(ends, here, side="right")] - here - 1
    upto = np.cumsum(behind)
    lo = 0
    while lo < b.num_rows:
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] - behind[lo] + PAIRS, side="right")))
        line, j = _spans(here[lo:hi] + 1, behind[lo:hi])
        i = line + lo
        ok = units[i] != units[j]
        for m in marks:
            x, y = m[i], m[j]
            ok &= (x == y) | (x < 0) | (y < 0)
        i, j = i[ok], j[ok]
        cos = v.dots(starts, size, ids, w, i, j)
        near = cos >= SAME_DAY - 1e-5
        a, o = units[i[near]], units[j[near]]
        s = 0.5 + 0.5 * (cos[near].astype(np.float64) - SAME_DAY) / (1 - SAME_DAY)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, o), pa.int64()), pa.array(np.maximum(a, o), pa.int64()), pa.array(s, pa.float64())], names=["a", "b", "score"])
        lo = hi


def similar_pairs(profiles: DataFrame, idf: dict[str, float], together: int = TOGETHER) -> DataFrame:
    """profiles(unit, name, born date, gender, country, bearers) -> (a, b, score), a < b: units of similar name whose evidence agrees.

    Joined on a prefix gram and the birthday both have; or, where one has none, the country both have; or, where one has
    neither, the gender both have, at a higher threshold each time. Evidence that both have and that differs rules a pair
    out. A mark both have counts as a country both have. A name with several bearers is compared on a birthday or a mark
    only. What the name alone links is in `only_bearers`, the name and the year in `year_bearers`. A birthday of up to
    `together` records is compared as one block, without grams; both ways find the same pairs.
    """
    profiles = with_marks(profiles)
    spark = profiles.sparkSession
    shared = spark.sparkContext.broadcast(idf)
    kinds = (("day", "born", SAME_DAY), ("marked", "mark", SAME_PLACE), ("place", "country", SAME_PLACE), ("sex", "gender", SAME_SEX))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vectors(shared.value)
        for b in batches:
            there = [b.column(c).is_valid().to_numpy(zero_copy_only=False) for _, c, _ in kinds]
            dateless = ~there[0]
            there[0] = b.column("crowded").fill_null(False).to_numpy(zero_copy_only=False)
            telling = b.column("telling").to_numpy(zero_copy_only=False)
            there[2:] = [x & telling for x in there[2:]]
            size, ids, w = v.many(b.column("name").to_pylist())
            line = np.repeat(np.arange(len(size)), size)
            # the square of the norm of a gram and all behind it
            upto = np.cumsum(w * w)
            rest = np.append(upto, 0.0)[np.cumsum(size) - 1][line] - upto + w * w
            after = np.sqrt(np.maximum(rest - w * w, 0))
            bits, slack, most = _sketch(line, ids, w, size)
            said, mask = _packed_evidence(b)
            at, key, least, apart = [], [], [], []
            for k, (found, (_, column, t)) in enumerate(zip(there, kinds, strict=True)):
                i = np.flatnonzero(found[line] & (rest >= t * t - 1e-6))
                values = b.column(column).dictionary_encode()
                codes = np.array([crc32(str(x).encode()) for x in values.dictionary.to_pylist()] or [0], np.int64)
                at.append(i)
                # kind, value and gram in one number; a pair that meets by chance is judged like any other
                key.append(((codes[np.asarray(values.indices.fill_null(0))][line[i]] << 2 | k) << 28) ^ ids[i])
                least.append(np.full(len(i), t, np.float32))
                apart.append(np.full(len(i), COUNTRY_BITS if column == "gender" else 0, np.int64))
            at, key, least, apart = (np.concatenate(x) for x in (at, key, least, apart))
            row = line[at]
            own = b.select(["unit", "name"]).take(pa.array(row, pa.int32()))
            asks = dateless[row] | (least == np.float32(SAME_DAY))
            more = [key, asks, w[at].astype(np.float32), after[at].astype(np.float32), least, apart, said[0][row], mask[0][row], said[1][row], mask[1][row], *(x[row] for x in bits), slack[row], most[row]]
            yield pa.RecordBatch.from_arrays([*own.columns, *map(pa.array, more)], names=["unit", "name", *POSTING])

    # the few records of a birthday are compared as a block; a birthday that many share is no evidence by itself
    often = profiles.where("born is not null").groupBy("born").agg(F.count("*").alias("there"))
    counted = profiles.select("unit", "name", *EVIDENCE, "bearers").join(often, "born", "left")
    held = Written(counted.select("unit", "name", *EVIDENCE, (F.col("there") > together).alias("crowded"), (F.col("bearers") < 2).alias("telling")))
    own = held.df
    # a posting is of use where one without birthday meets it, or on a crowded day
    useful = own.where("crowded or mark is not null or (telling and (country is not null or gender is not null))")
    posted = Written(useful.mapInArrow(post, "unit bigint, name string, " + ", ".join(f"{k} {t}" for k, t in POSTING.items())))
    l, r = (lambda c: F.col(f"l.{c}")), (lambda c: F.col(f"r.{c}"))
    both = l("mask").bitwiseAND(r("mask"))
    fits = (l("said").bitwiseXOR(r("said")).bitwiseAND(both) == 0) & (l("mark").bitwiseXOR(r("mark")).bitwiseAND(l("marked")).bitwiseAND(r("marked")) == 0) & (both.bitwiseAND(l("apart")) == 0)
    # all grams that both have lie behind their first one: it and Cauchy's bound on the rest say how similar they can be
    bound = l("weight") * r("weight") + l("after") * r("after") >= l("least") - F.lit(1e-4)
    # grams that both have: at most the bits both have, and those that share a bit with another; each gives at most both largest weights
    grams = F.least(l("slack"), r("slack"))
    for x in ("b0", "b1", "b2", "b3"):
        grams = grams + F.bit_count(l(x).bitwiseAND(r(x)))
    enough = grams * l("most") * r("most") >= l("least") - F.lit(1e-4)
    # without a common birthday one of both has none: that one asks, so those that have one never meet each other
    dated = lambda side: side("mask").bitwiseAND(F.lit(BORN_BITS)) != 0
    ordered = (l("unit") < r("unit")) | (~dated(l) & dated(r))
    pairs = posted.df.where("asks").alias("l").join(posted.df.alias("r"), (l("key") == r("key")) & bound & enough & fits & ordered)
    out = pairs.select(l("unit").alias("a"), r("unit").alias("b"), l("name").alias("x"), r("name").alias("y"), both.alias("both"), (l("marked").bitwiseAND(r("marked")) != 0).alias("marked"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vectors(shared.value)
        for b in batches:
            cos = v.cosines(b.column("x"), b.column("y"))
            both = b.column("both").to_numpy()
            day, place, sex = ((both & x) != 0 for x in (BORN_BITS, COUNTRY_BITS, GENDER_BITS))
            least = least_cosine(day, b.column("marked").to_numpy(zero_copy_only=False), place, sex)
            ok = np.flatnonzero(cos >= least - 1e-5)
            # scores of all kinds of evidence lie between 0.5 and 1
            s = 0.5 + 0.5 * (cos[ok] - least[ok]) / (1 - least[ok])
            a, o = b.column("a").to_numpy()[ok], b.column("b").to_numpy()[ok]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, o)), pa.array(np.maximum(a, o)), pa.array(s.astype(np.float64))], names=["a", "b", "score"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vectors(shared.value)
        for b in whole_groups(batches, "born"):
            yield from _day_links(v, b)

    alone = own.where("not crowded").select("born", "unit", "name", "gender", "country", "mark", "year")
    near = alone.repartition("born").sortWithinPartitions("born").mapInArrow(blocks, "a bigint, b bigint, score double")
    links = Written(out.mapInArrow(score, "a bigint, b bigint, score double").unionByName(near).groupBy("a", "b").agg(F.max("score").alias("score")))
    for used in (held, posted):
        used.drop()
    return links.df


def only_bearers(profiles: DataFrame) -> DataFrame:
    """profiles as above -> (a, b, score): units that have neither birthday nor country, linked to the only bearer of their name.

    That is the one unit of that name with a birthday; where none has one, the smallest unit of that name. If several have,
    the name alone says nothing. A name of n units gives at most n links.
    """
    profiles = with_marks(profiles)
    to = F.min(F.struct(F.col("born").isNull().alias("undated"), "unit", "gender", "mark", "year")).alias("to")
    bearer = profiles.groupBy("name").agg(F.count("born").alias("dated"), to).where("dated <= 1").select("name", F.col("to.unit").alias("to"), *[F.col(f"to.{x}").alias(f"to_{x}") for x in ("gender", "mark", "year")])
    open_units = profiles.where("born is null and country is null").select("unit", "name", "gender", "mark", "year")
    linked = open_units.join(bearer, "name").where((F.col("unit") != F.col("to")))
    for x in ("gender", "mark", "year"):
        linked = linked.where(F.coalesce(F.col(x) == F.col(f"to_{x}"), F.lit(True)))
    return linked.select(F.least("unit", "to").alias("a"), F.greatest("unit", "to").alias("b"), F.lit(SAME_NAME).alias("score")).distinct()


def year_bearers(profiles: DataFrame) -> DataFrame:
    """profiles as above -> (a, b, score): units that have a year but no birthday, linked to the one unit of their name born in that year."""
    profiles = with_marks(profiles)
    to = F.min(F.struct("unit", "gender", "country", "mark")).alias("to")
    born = profiles.where("born is not null").groupBy("name", "year").agg(to, F.max("unit").alias("last")).where("to.unit = last").select("name", "year", F.col("to.unit").alias("to"), *[F.col(f"to.{x}").alias(f"to_{x}") for x in ("gender", "country", "mark")])
    linked = profiles.where("born is null and year is not null").join(born, ["name", "year"])
    for x in ("gender", "country", "mark"):
        linked = linked.where(F.coalesce(F.col(x) == F.col(f"to_{x}"), F.lit(True)))
    return linked.select(F.least("unit", "to").alias("a"), F.greatest("unit", "to").alias("b"), F.lit(SAME_NAME).alias("score")).distinct()


def _pair_scorer(idf: dict[str, float], spark):  # noqa: ANN001, ANN202
    """A function over batches of (x, y names; day, marked, place, sex: what both have) that adds the score of pairs without a link."""
    shared = spark.sparkContext.broadcast(idf)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vectors(shared.value)
        for b in batches:
            cos = v.cosines(b.column("x"), b.column("y"))
            day, marked, place, sex = (b.column(c).to_numpy(zero_copy_only=False) for c in ("day", "marked", "place", "sex"))
            least = least_cosine(day, marked, place, sex)
            # the scale of links, carried on below their bound; what is no link can't speak for a merge, so it has 0.5 at most
            s = np.clip(0.5 + 0.5 * (cos - least) / (1 - least), 0, 0.5)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("a", "b", "ua", "ub")), pa.array(s.astype(np.float64))], names=["a", "b", "ua", "ub", "score"])

    return score


#: Units of a component up to which it is clustered within one task.
WITHIN_TASK = 1_000


def average_linkage(links: DataFrame, units: DataFrame, threshold: float = 0.5, profiles: DataFrame | None = None, idf: dict[str, float] | None = None, within: int = WITHIN_TASK) -> DataFrame:
    """links(a, b, score), units(unit, born, gender, country; mark and year where known) -> (unit, cluster) of all units that have a link.

    In each round every cluster picks the neighbour of the highest average score over all pairs of their units; mutual
    choices merge, and a merged cluster has the evidence of its parts. A pair without a link counts with the similarity of
    its names, from profiles(unit, name) and idf, at most 0.5; without profiles it counts 0. Each such pair is scored once,
    when the clusters it lies in come to touch. Links between clusters whose evidence differs are dropped. Ties go to the
    smaller id. Ends when no choice is mutual.

    Nothing merges across connected components of the links. Those of up to `within` units go through their rounds inside
    one task each, larger ones as rounds over tables; the outcome is the same.
    """
    links = links.select("a", "b", "score")
    units = with_marks(units).select("unit", *EVIDENCE)
    of = Written(hash_to_min(links).select(F.col("id").alias("unit"), F.col("group_id").alias("comp"))).df
    sized = of.groupBy("comp").agg(F.count("*").alias("size"))
    large = Written(of.join(sized.where(F.col("size") > within), "comp").select("unit")).df
    out = None
    if not large.isEmpty():
        out = _linkage_rounds(links.join(large.select(F.col("unit").alias("a")), "a", "left_semi").select("a", "b", "score"), units, threshold, profiles, idf)
    placed = of.join(large, "unit", "left_anti") if out is not None else of
    named = placed.join(units, "unit")
    if profiles is not None:
        # names are of use only where there is a pair without link
        named = named.join(profiles.join(placed.join(sized.where("size > 2"), "comp").select("unit"), "unit", "left_semi").groupBy("unit").agg(F.collect_set("name").alias("names")), "unit", "left")
    else:
        named = named.withColumn("names", F.lit(None).cast("array<string>"))
    none = lambda t: F.lit(None).cast(t)
    members = named.select("comp", F.col("unit").alias("a"), none("bigint").alias("b"), none("double").alias("score"), *EVIDENCE, "names")
    edges = links.join(placed.withColumnRenamed("unit", "a"), "a").select("comp", "a", "b", "score", *[none(units.schema[x].dataType).alias(x) for x in EVIDENCE], none("array<string>").alias("names"))
    shared = links.sparkSession.sparkContext.broadcast(idf)

    def cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vectors(shared.value) if shared.value is not None else None
        for b in whole_groups(batches, "comp"):
            comps, lefts, rights, scores = (b.column(c).to_pylist() for c in ("comp", "a", "b", "score"))
            known = list(zip(*[b.column(x).to_pylist() for x in EVIDENCE], strict=True))
            names = b.column("names").to_pylist()
            unit, to, lo = [], [], 0
            for hi in [*(k for k in range(1, len(comps)) if comps[k] != comps[k - 1]), len(comps)]:
                k = lo
                while k < hi and rights[k] is None:
                    k += 1
                unit += lefts[lo:k]
                to += cluster_component(lefts[lo:k], known[lo:k], names[lo:k], list(zip(lefts[k:hi], rights[k:hi], scores[k:hi], strict=True)), threshold, v)
                lo = hi
            yield pa.RecordBatch.from_arrays([pa.array(unit, pa.int64()), pa.array(to, pa.int64())], names=["unit", "cluster"])

    small = members.unionByName(edges).repartition("comp").sortWithinPartitions("comp", F.col("b").asc_nulls_first(), "a").mapInArrow(cluster, "unit bigint, cluster bigint")
    return small if out is None else small.unionByName(out)


def cluster_component(units: list[int], known: list[tuple], names: list[list[str] | None], edges: list[tuple[int, int, float]], threshold: float, v: Vectors | None) -> list[int]:
    """The cluster of each of `units` (in order of their ids), by the rounds of `average_linkage`."""
    at = {u: i for i, u in enumerate(units)}
    members = {i: [i] for i in range(len(units))}
    evidence = dict(enumerate(known))
    near: dict[int, dict[int, float]] = {i: {} for i in members}  # totals over all pairs of two clusters
    for a, b, s in edges:
        near[at[a]][at[b]] = near[at[b]][at[a]] = s
    differ = lambda x, y: any(p is not None and q is not None and p != q for p, q in zip(x, y, strict=True))
    vectors: dict[str, dict[int, float]] = {}

    def vector(name: str) -> dict[int, float]:
        if name not in vectors:
            vectors[name] = dict(zip(*v.one(name), strict=True))
        return vectors[name]

    def unlinked(i: int, j: int) -> float:
        """The score of a pair without link, on the scale of links; what is no link can't speak for a merge, so it has 0.5 at most."""
        if v is None or not names[i] or not names[j]:
            return 0.0
        best = 0.0
        for x in map(vector, names[i]):
            for y in map(vector, names[j]):
                s, t = (x, y) if len(x) <= len(y) else (y, x)
                best = max(best, sum(w * t.get(g, 0.0) for g, w in s.items()))
        both = [p is not None and q is not None for p, q in zip(known[i], known[j], strict=True)]
        day, sex, place, mark = both[:4]
        least = float(least_cosine(day, mark, place, sex))
        return min(0.5, max(0.0, 0.5 + 0.5 * (best - least) / (1 - least)))

    while True:
        for c, own in near.items():
            for d in [d for d in own if differ(evidence[c], evidence[d])]:
                own.pop(d)
                near[d].pop(c)
        choice = {}
        for c, own in near.items():
            ways = [(round(x, 9), -d) for d, total in own.items() if (x := total / (len(members[c]) * len(members[d]))) >= threshold]
            if ways:
                choice[c] = -max(ways)[1]
        merged = {d: c for c, d in choice.items() if c < d and choice.get(d) == c}
        if not merged:
            break
        into = lambda c: merged.get(c, c)  # noqa: B023, E731
        parts: dict[int, list[int]] = {}
        for c in members:
            parts.setdefault(into(c), []).append(c)
        fused = {c: tuple(next((e for e in (evidence[p][k] for p in ps) if e is not None), None) for k in range(len(EVIDENCE))) for c, ps in parts.items()}
        after: dict[int, dict[int, float]] = {c: {} for c in parts}
        for c in near:
            for d in near[c]:
                x, y = into(c), into(d)
                if x >= y or y in after[x] or differ(fused[x], fused[y]):
                    continue
                total = 0.0
                for p in parts[x]:
                    for q in parts[y]:
                        total += near[p][q] if q in near[p] else sum(unlinked(i, j) for i in members[p] for j in members[q])
                after[x][y] = after[y][x] = total
        members = {c: [i for p in ps for i in members[p]] for c, ps in parts.items()}
        evidence, near = fused, after
    out = [0] * len(units)
    for c, own in members.items():
        for i in own:
            out[i] = units[c]
    return out


def _linkage_rounds(links: DataFrame, units: DataFrame, threshold: float, profiles: DataFrame | None, idf: dict[str, float] | None) -> DataFrame:
    """`average_linkage` as rounds over tables, for components of any size."""
    ends = links.select(F.explode(F.array("a", "b")).alias("unit")).distinct()
    state = Written(with_marks(units).join(ends, "unit").select("unit", F.col("unit").alias("cluster"), *EVIDENCE))
    edges = Written(links.select("a", "b", F.col("score").alias("total"), F.lit(1).cast("bigint").alias("n")))
    scorer = _pair_scorer(idf, links.sparkSession) if profiles is not None else None
    # what the last round merged, and the state and edges before it
    last = ()
    while True:
        c = state.df.groupBy("cluster").agg(*[F.max(x).alias(x) for x in EVIDENCE], F.count("*").alias("size"))
        known = lambda side: c.select(F.col("cluster").alias(side), *[F.col(x).alias(f"{side}_{x}") for x in (*EVIDENCE, "size")])  # noqa: B023, E731
        agree = F.lit(True)
        for x in EVIDENCE:
            agree = agree & F.coalesce(F.col(f"a_{x}") == F.col(f"b_{x}"), F.lit(True))
        open_edges = Written(edges.df.join(known("a"), "a").join(known("b"), "b").where(agree).select("a", "b", "total", "n", (F.col("a_size") * F.col("b_size")).alias("pairs")))
        edges.drop()
        edges = open_edges
        if last and scorer:
            more = _scores_between(edges.df.where("n < pairs"), *[x.df for x in last], profiles, scorer)
            full = Written(edges.df.unionByName(more).groupBy("a", "b").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("pairs").alias("pairs")))
            edges.drop()
            edges = full
        for used in last:
            used.drop()
        average = F.col("total") / F.col("pairs")
        ways = edges.df.where(average >= threshold).select(F.explode(F.array(F.struct(F.col("a").alias("at"), F.col("b").alias("to"), average.alias("avg")), F.struct(F.col("b").alias("at"), F.col("a").alias("to"), average.alias("avg")))).alias("x")).select("x.*")
        best = ways.groupBy("at").agg(F.max(F.struct(F.round("avg", 9).alias("avg"), (-F.col("to")).alias("minus"))).alias("best")).select("at", (-F.col("best.minus")).alias("to"))
        merged = Written(best.alias("p").join(best.alias("q"), (F.col("p.at") == F.col("q.to")) & (F.col("p.to") == F.col("q.at")) & (F.col("p.at") < F.col("p.to"))).select(F.col("p.to").alias("old"), F.col("p.at").alias("new")))
        if merged.df.isEmpty():
            return state.df.select("unit", "cluster")
        moved = state.df.join(merged.df.withColumnRenamed("old", "cluster"), "cluster", "left").select("unit", F.coalesce("new", "cluster").alias("cluster"), *EVIDENCE)
        next_state = Written(moved)
        side = lambda col: merged.df.select(F.col("old").alias(col), F.col("new").alias(f"{col}_new"))  # noqa: B023, E731
        renamed = edges.df.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("a_new", "a").alias("a"), F.coalesce("b_new", "b").alias("b"), "total", "n").where("a <> b")
        next_edges = Written(renamed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "total", "n").groupBy("a", "b").agg(F.sum("total").alias("total"), F.sum("n").alias("n")))
        last = (merged, state, edges)
        state, edges = next_state, next_edges


def _scores_between(lacking: DataFrame, merged: DataFrame, state: DataFrame, edges: DataFrame, profiles: DataFrame, scorer) -> DataFrame:  # noqa: ANN001
    """lacking(a, b, pairs) -> (a, b, total, n, pairs): the pairs of units between a and b that their edges don't count yet.

    merged(old, new), state and edges are those of the last round: its edges count all pairs of their two clusters, so what
    lacks lies between parts of a and b that had no edge then.
    """
    parts = merged.select("new", "old").unionByName(merged.select("new", F.col("new").alias("old")))
    of = lambda side: parts.select(F.col("new").alias(side), F.col("old").alias(f"{side}_old"))
    split = lacking.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("a_old", "a").alias("pa"), F.coalesce("b_old", "b").alias("pb"))
    had = edges.select(F.col("a").alias("lo"), F.col("b").alias("hi"))
    split = split.withColumns({"lo": F.least("pa", "pb"), "hi": F.greatest("pa", "pb")}).join(had, ["lo", "hi"], "left_anti")
    member = lambda u, p: state.select(F.col("unit").alias(f"u{u}"), F.col("cluster").alias(p), *[F.col(x).alias(f"{u}_{x}") for x in EVIDENCE])
    both = lambda x: F.col(f"a_{x}").isNotNull() & F.col(f"b_{x}").isNotNull()
    pairs = split.join(member("a", "pa"), "pa").join(member("b", "pb"), "pb").select("a", "b", "ua", "ub", both("born").alias("day"), both("mark").alias("marked"), both("country").alias("place"), both("gender").alias("sex"))
    named = lambda u, to: profiles.select(F.col("unit").alias(u), F.col("name").alias(to))
    spelled = pairs.join(named("ua", "x"), "ua").join(named("ub", "y"), "ub").select("a", "b", "ua", "ub", "x", "y", "day", "marked", "place", "sex")
    scored = spelled.mapInArrow(scorer, "a bigint, b bigint, ua bigint, ub bigint, score double").groupBy("a", "b", "ua", "ub").agg(F.max("score").alias("score"))
    return scored.groupBy("a", "b").agg(F.sum("score").alias("total"), F.count("*").alias("n")).withColumn("pairs", F.lit(None).cast("bigint"))
