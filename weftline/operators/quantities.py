"""Quantities stated in many units, in text, brought to one unit per quantity: millimetres and grams.

A size with a unit in its text is an anchor. A bare number is a candidate for every known conversion; which ones its
source uses is estimated: records of the same entity link sources, the ratio of a bare number to the entity's size in a
calibrated source is taken robustly and snapped to the nearest known conversion, and what is calibrated calibrates
further sources in turn (a graph of sources, walked from the anchors). Last, each value takes the conversion, of those
its source uses, that puts it into the range of anchored sizes. Where the rules of the data fix a unit by value
(body sizes over 50, weights up to 94), an exact check by those rules follows and holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.clean import let
from weftline.session import Written

# Units, in millimetres and grams.
MM = {"mm": "1", "cm": "10", "m": "1000", "in": "25.4", "ft": "304.8"}
GRAMS = {"g": "1", "kg": "1000", "lb": "453.59237", "st": "6350.29318"}
# Number words of heights.
WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11}
UNIT_WORDS = {
    "mm": r"mm|millimet(?:er|re)s?", "cm": r"cms?|centimet(?:er|re)s?", "in": r'in(?:ch(?:es)?)?|"|\'\'|zoll', "m": r"m|met(?:er|re)s?",
    "kg": r"kgs?|kilos?|kilogram(?:me)?s?", "g": r"gr?|grams?|grammes?", "lb": r"lbs?|pounds?|#",
}
NUM = r"(\d+(?:\.\d+)?)"
DEC = "decimal(18,6)"
#: A body size over this, or a weight up to that, is metric.
OVER_CM, UP_TO_KG = 50, 94


def _tidy(c: Column) -> Column:
    s = F.lower(F.btrim(F.regexp_replace(c, r"[\s ]+", " ")))
    s = F.translate(s, "’‘′`´”“″–—−", "'''''\"\"\"---")
    s = F.regexp_replace(s, r"(\d),(\d{1,2})(?!\d)", "$1.$2")
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"(\d) ?½", "$1.5"), r"(\d) ?¼", "$1.25"), r"(\d) ?¾", "$1.75")
    return F.regexp_replace(s, r"^(?:ca\.?|approx(?:\.|imately)?|about|circa|around|~|height|weight|roughly|ungefähr|env\.?)\s*:?\s*", "")


def _dec(s: Column, rx: str, group: int) -> Column:
    return F.regexp_extract(s, rx, group).try_cast(DEC)


def _half_up(amount: Column) -> Column:
    return F.round(amount, 0).cast("bigint")


def _lead(s: Column, unit: str) -> str:
    return rf"^{NUM} ?(?:{UNIT_WORDS[unit]})(?![a-z])"


def height_mm(text: Column) -> tuple[Column, Column]:
    """(millimetres, bare number): one of both is set; of a height given twice the first counts."""
    word = "|".join(WORDS)

    def parsed(s: Column) -> Column:
        feet = rf"^{NUM} ?(?:'(?!')|ft\.?|feet|foot) ?(?:{NUM} ?(?:in(?:ch(?:es)?)?|\"|'')?)?"
        dashed, m_cm, spelled = r"^([3-8])-(\d{1,2}(?:\.\d+)?)$", r"^([12]) ?m ?(\d{2})(?!\d)", rf"^({word}) (?:foot|feet|ft)(?: ({word}))?"
        number_word = F.create_map(*[F.lit(x) for kv in WORDS.items() for x in kv])
        mm = (
            F.when(s.rlike(feet), (_dec(s, feet, 1) * 12 + F.coalesce(_dec(s, feet, 2), F.lit(0))) * F.lit("25.4").cast(DEC))
            .when(s.rlike(dashed), (_dec(s, dashed, 1) * 12 + _dec(s, dashed, 2)) * F.lit("25.4").cast(DEC))
            .when(s.rlike(m_cm), _dec(s, m_cm, 1) * 1000 + _dec(s, m_cm, 2) * 10)
            .when(s.rlike(spelled), (F.try_element_at(number_word, F.regexp_extract(s, spelled, 1)) * 12 + F.coalesce(F.try_element_at(number_word, F.regexp_extract(s, spelled, 2)), F.lit(0))) * F.lit("25.4").cast(DEC))
        )
        for unit in ("mm", "cm", "in", "m"):
            mm = mm.when(s.rlike(_lead(s, unit)), _dec(s, _lead(s, unit), 1) * F.lit(MM[unit]).cast(DEC))
        return F.struct(mm.cast(DEC).alias("fixed"), F.when(s.rlike(rf"^{NUM}$"), s.try_cast(DEC)).alias("bare"))

    p = let(_tidy(text), parsed)
    return p["fixed"], p["bare"]


def weight_g(text: Column) -> tuple[Column, Column]:
    """(grams, bare number): one of both is set; of a weight given twice the first counts."""

    def parsed(s: Column) -> Column:
        stone = rf"^{NUM} ?(?:stones?|st)\.? ?(?:{NUM} ?(?:lbs?|pounds?)?)?"
        g = F.when(s.rlike(stone), (_dec(s, stone, 1) * 14 + F.coalesce(_dec(s, stone, 2), F.lit(0))) * F.lit(GRAMS["lb"]).cast("decimal(18,8)"))
        for unit in ("kg", "lb", "g"):
            g = g.when(s.rlike(_lead(s, unit)), _dec(s, _lead(s, unit), 1) * F.lit(GRAMS[unit]).cast("decimal(18,8)"))
        return F.struct(g.cast(DEC).alias("fixed"), F.when(s.rlike(rf"^{NUM}$"), s.try_cast(DEC)).alias("bare"))

    p = let(_tidy(text), parsed)
    return p["fixed"], p["bare"]


def _unit_of(word: Column) -> Column:
    return F.when(word.rlike(rf"^(?:{UNIT_WORDS['mm']})$"), "mm").when(word.rlike(rf"^(?:{UNIT_WORDS['cm']})$"), "cm").when(word.rlike(rf"^(?:{UNIT_WORDS['in']})$"), "in")


def body_sizes(raw: Column) -> Column:
    """A set of sizes -> array of (part, number, unit); unit is null where the text has none.

    Named parts in any order, or bust-waist-hips in order with any separator, a cup behind the first; places that are
    empty or stand-ins are skipped. A single number with a cup is a bra size and gives only the band.
    """
    unit = rf"(?:{UNIT_WORDS['mm']}|{UNIT_WORDS['cm']}|{UNIT_WORDS['in']})"
    empty, cup = r"none|null|n/a|\?+", rf" ?\(?(?!{unit}(?![a-z]))(?:[a-z]{{1,4}}|\?+)\)?"
    sep, own = r"(?: ?[-/x×,;:|] ?| )", rf"(?: ?({unit})(?![a-z])\.?)?"
    slot = rf"(\d+(?:\.\d+)?|{empty})?"
    behind = rf" ?\(?({unit})\)?\.?$"
    in_order = rf"^{slot}(?:{cup})?{own}(?:{sep}{slot}{own})?(?:{sep}{slot}{own})?$"
    names = {"bust": "bust|chest|b", "waist": "waist|w", "hips": "hips?|h"}
    labelled = {part: rf"(?:^|[^a-z])(?:{n}) ?[:=]? ?{NUM}(?:{cup}(?![a-z]))?{own}" for part, n in names.items()}

    def place(part: Column, number: Column, own_unit: Column, whole: Column) -> Column:
        return F.struct(part.alias("part"), number.try_cast(DEC).alias("number"), F.coalesce(_unit_of(own_unit), _unit_of(whole)).alias("unit"))

    def parsed(t: Column) -> Column:
        s, whole = t["set"], t["whole"]
        x = lambda rx, i: F.regexp_extract(s, rx, i)
        bra = s.rlike(rf"^{NUM}{cup}$")
        ordered = F.array(*[place(part, x(in_order, i), x(in_order, i + 1), whole) for part, i in ((F.when(bra, "band").otherwise("bust"), 1), (F.lit("waist"), 3), (F.lit("hips"), 5))])
        by_name = F.array(*[place(F.lit(part), x(rx, 1), x(rx, 2), whole) for part, rx in labelled.items()])
        is_named = s.rlike(r"bust|chest|waist|hips?|(?:^|[^a-z])[bwh] ?[:=]? ?\d")
        return F.filter(F.when(is_named, by_name).when(s.rlike(in_order), ordered), lambda p: p["number"].isNotNull())

    # a unit behind the last number holds for all that have none
    split = lambda s: F.struct(F.regexp_replace(s, behind, "").alias("set"), F.regexp_extract(s, behind, 1).alias("whole"))
    return let(let(_tidy(raw), split), parsed)


def _candidates(part: Column, conversions: dict[str, dict[str, str]]) -> Column:
    """The conversions of a row's part as an array of (unit, factor): a constant, so rows are never multiplied by them."""
    out = F.lit(None)
    for name, units in conversions.items():
        out = F.when(part == name, F.array(*[F.struct(F.lit(u).alias("unit"), F.lit(f).cast("decimal(18,8)").alias("factor")) for u, f in units.items()])).otherwise(out)
    return out


def calibrate(sizes: DataFrame, conversions: dict[str, dict[str, str]], tolerance: float = 0.06, support: float = 0.02) -> DataFrame:
    """Which conversions each source uses for its bare numbers.

    sizes(source, entity, part, fixed decimal, bare decimal): one of fixed and bare is set. conversions: part -> unit ->
    factor. -> (source, part, unit, votes). Links are made per entity and source, after pre-aggregation, so an entity or
    a source that holds a third of all rows is a few rows. A bare number votes for the conversion nearest to the ratio of
    the entity's known size (the median over calibrated sources) to it, if within `tolerance` in logarithms; units with
    fewer than `support` of a source's votes are noise. Rounds go on, outwards from the anchors, until one calibrates no
    further source; sources without links have no row.
    """
    known_units = sizes.sparkSession.createDataFrame([(p, u, float(f)) for p, us in conversions.items() for u, f in us.items()], "part string, unit string, factor double")
    by_entity = sizes.where("entity is not null").groupBy("source", "entity", "part").agg(F.expr("percentile_approx(cast(fixed as double), 0.5)").alias("fixed"), F.expr("percentile_approx(cast(bare as double), 0.5)").alias("bare"))
    held = Written(by_entity)
    anchors = held.df.where("fixed > 0").select("entity", "part", F.col("fixed").alias("size"))
    done = None
    while True:
        truth = anchors.groupBy("entity", "part").agg(F.expr("percentile_approx(size, 0.5)").alias("size"))
        open_rows = held.df.where("bare > 0")
        if done is not None:
            open_rows = open_rows.join(done.df.select("source", "part").distinct(), ["source", "part"], "left_anti")
        off = lambda c: F.abs(F.ln(F.col("size") / F.col("bare") / c["factor"].cast("double")))
        nearest = open_rows.join(truth, ["entity", "part"]).select("source", "part", F.array_min(F.transform(_candidates(F.col("part"), conversions), lambda c: F.struct(off(c).alias("off"), c["unit"].alias("unit")))).alias("best"))
        votes = nearest.where(F.col("best.off") <= tolerance).groupBy("source", "part", F.col("best.unit").alias("unit")).agg(F.count("*").alias("votes"))
        total = votes.groupBy("source", "part").agg(F.sum("votes").alias("all"))
        fresh = Written(votes.join(total, ["source", "part"]).where(F.col("votes") >= support * F.col("all")).select("source", "part", "unit", "votes"))
        if fresh.df.isEmpty():
            break
        done = fresh if done is None else Written(done.df.unionByName(fresh.df))
        # sources that use one conversion only carry it on
        single = done.df.groupBy("source", "part").agg(F.count("*").alias("n"), F.min("unit").alias("unit")).where("n = 1").join(F.broadcast(known_units), ["part", "unit"])
        carried = held.df.where("bare > 0").join(single, ["source", "part"]).select("entity", "part", (F.col("bare") * F.col("factor")).alias("size"))
        anchors = held.df.where("fixed > 0").select("entity", "part", F.col("fixed").alias("size")).unionByName(carried)
        if held.df.where("bare > 0").join(done.df.select("source", "part").distinct(), ["source", "part"], "left_anti").isEmpty():
            break
    return done.df if done is not None else sizes.sparkSession.createDataFrame([], "source string, part string, unit string, votes bigint")


def convert_sizes(sizes: DataFrame, conversions: dict[str, dict[str, str]], spread: float = 0.12) -> DataFrame:
    """sizes(row_id, source, entity, part, fixed, bare) -> (part, row_id, amount bigint), rounded half up.

    A bare number takes, of the conversions its source uses, the one that puts it nearest to the middle of the anchored
    sizes of its part; if none puts it into their range (widened by `spread`), any known conversion that does; else it has
    no amount.
    """
    used = calibrate(sizes, conversions).groupBy("source", "part").agg(F.collect_set("unit").alias("used"))
    span = sizes.where("fixed > 0").groupBy("part").agg(*[F.expr(f"percentile_approx(cast(fixed as double), {q}, 1000)").alias(n) for n, q in (("low", 0.001), ("mid", 0.5), ("high", 0.999))])
    # one row a part
    bare = sizes.where("bare > 0").join(F.broadcast(span), "part").join(used, ["source", "part"], "left")
    amount = lambda c: F.col("bare") * c["factor"]
    ranged = F.filter(_candidates(F.col("part"), conversions), lambda c: (amount(c) >= F.col("low") * (1 - spread)) & (amount(c) <= F.col("high") * (1 + spread)))
    foreign = lambda c: ~F.coalesce(F.array_contains("used", c["unit"]), F.lit(False))
    ways = F.transform(ranged, lambda c: F.struct(foreign(c).alias("foreign"), F.abs(F.ln(amount(c).cast("double") / F.col("mid"))).alias("off"), amount(c).alias("amount")))
    best = bare.select("part", "row_id", F.array_min(ways).alias("best")).where("best is not null")
    fixed = sizes.where("fixed > 0").select("part", "row_id", F.col("fixed").cast("decimal(38,14)").alias("amount"))
    both = fixed.unionByName(best.select("part", "row_id", F.col("best.amount").cast("decimal(38,14)").alias("amount")))
    return both.select("part", "row_id", _half_up(F.col("amount")).alias("amount"))
