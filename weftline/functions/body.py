"""Measurement strings as the calculator reads them, derived sizes, and classes by ladders and rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.clean import let

_NUMBER, _CUP, _BETWEEN = r"(\d+(?:\.\d+)?)", r"\(?([A-Za-z]+)\)?", "[-/]"
# A set of sizes: a number with its cup on either side, and waist and hips behind it or not.
_SET = rf"^(?:{_CUP})?{_NUMBER}(?:{_CUP})?(?:{_BETWEEN}{_NUMBER}{_BETWEEN}{_NUMBER}$)?"
# What is left of a set whose first number and cup were missing when it was put together.
_LOWER_HALF = rf"(?i)^NoneNone{_BETWEEN}{_NUMBER}{_BETWEEN}{_NUMBER}$"
# Cups, and inches between bust and band.
CUPS = {
    "AA": 0, "A": 1, "B": 2, "C": 3, "D": 4, "DD": 5, "E": 5, "DDD": 6, "EE": 6, "F": 6, "DDDD": 7, "G": 7, "FF": 8, "H": 8, "I": 9, "GG": 10, "J": 10, "K": 11, "HH": 12, "L": 12, "M": 13, "JJ": 14, "N": 14, "O": 15, "KK": 16,
    "P": 16, "Q": 17, "LL": 18, "R": 18,
}
# Upper bounds of body mass index and their classes, in general and by the Asian standard.
BMI_STEPS = [(16.5, "SEVERELY_UNDERWEIGHT"), (18.5, "UNDERWEIGHT"), (25, "HEALTHY"), (30, "OVERWEIGHT"), (35, "OBESE_CLASS_1"), (40, "OBESE_CLASS_2")]
BMI_STEPS_ASIAN = [(16.5, "SEVERELY_UNDERWEIGHT"), (18.5, "UNDERWEIGHT"), (23, "HEALTHY"), (25, "OVERWEIGHT"), (30, "OBESE_CLASS_1"), (35, "OBESE_CLASS_2")]


def parse_measurements(raw: Column) -> Column:
    """-> struct(shape, first, cup, waist, hips, units, kind): numbers as written, 0 as null; shape null where nothing fits.

    units: metric if all numbers present are over 50. kind: what the leading number is, bust or band.
    """

    def fields(s: Column) -> Column:
        part = lambda rx, *names: [F.regexp_extract(s, rx, i + 1).alias(n) for i, n in enumerate(names)]
        found = F.when(s.rlike(_LOWER_HALF), F.struct(F.lit("").alias("before"), F.lit("").alias("first"), F.lit("").alias("behind"), *part(_LOWER_HALF, "waist", "hips"))).when(s.rlike(_SET), F.struct(*part(_SET, "before", "first", "behind", "waist", "hips")))
        return let(found, shaped)

    def shaped(p: Column) -> Column:
        there = lambda n: p[n] != ""
        # between two cups a number is no longer the first of a set
        whole = there("waist") & ~(there("before") & there("behind"))
        cup = F.when(there("before"), "cup before").when(there("behind"), "cup behind").when(there("first"), "no cup").otherwise("no bust")
        shape = F.when(whole, F.concat(cup, F.lit(", waist and hips"))).when(there("before") | there("behind"), cup)
        sizes = {"first": p["first"], "cup": F.when(there("before"), p["before"]).otherwise(p["behind"]), **{n: F.when(whole, p[n]) for n in ("waist", "hips")}}
        return let(F.struct(shape.alias("shape"), *[F.when(shape.isNotNull(), c).alias(n) for n, c in sizes.items()]), typed)

    def typed(p: Column) -> Column:
        num = lambda n: F.nullif(F.nullif(p[n], F.lit("")).try_cast("double"), F.lit(0.0))
        return let(F.struct(p["shape"].alias("shape"), num("first").alias("first"), F.nullif(F.upper(p["cup"]), F.lit("")).alias("cup"), num("waist").alias("waist"), num("hips").alias("hips")), known)

    def known(p: Column) -> Column:
        present = F.array_compact(F.array(p["first"], p["waist"], p["hips"]))
        metric = (F.size(present) > 0) & F.forall(present, lambda v: v > 50)
        units = F.when(p["shape"].isNull(), None).when(metric, "metric").otherwise("imperial")
        kind = F.when(p["first"].isNull(), None).when(p["waist"].isNotNull() & p["hips"].isNotNull(), "bust").when(p["cup"].isNull(), "bust").otherwise("band")
        return F.struct(*[p[n].alias(n) for n in ("shape", "first", "cup", "waist", "hips")], units.alias("units"), kind.alias("kind"))

    return let(F.regexp_replace(raw, r"\s+", ""), fields)


def derived_sizes(p: Column) -> Column:
    """struct of `parse_measurements` -> struct(bust, band, waist, hips, difference) in inches."""
    per = F.when(p["units"] == "metric", 2.54).otherwise(1.0)
    cups = F.create_map(*[F.lit(x) for kv in CUPS.items() for x in kv])
    diff = F.when(p["cup"].isNotNull(), F.try_element_at(cups, p["cup"]))
    first = p["first"] / per
    bust = F.when(p["kind"] == "bust", first).when(p["kind"] == "band", first + diff)
    band = F.when(p["kind"] == "band", first).when(p["kind"] == "bust", first - diff)
    return F.struct(bust.alias("bust"), band.alias("band"), (p["waist"] / per).alias("waist"), (p["hips"] / per).alias("hips"), diff.alias("difference"))


def ladder(value: Column, steps: list[tuple[float, str]], last: str) -> Column:
    """The name of the first step whose bound is over the value, else the last name; null for null."""
    out = F.lit(last)
    for bound, name in reversed(steps):
        out = F.when(value < bound, name).otherwise(out)
    return F.when(value.isNotNull(), out)


def bmi(kilograms: Column, metres: Column) -> Column:
    """Body mass index, null where a size is missing or not positive."""
    return F.when((kilograms > 0) & (metres > 0), kilograms / (metres * metres))


def labels(rules: list[tuple[str, Column]]) -> Column:
    """All names whose rule holds, in the order of the rules."""
    return F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules]))


def bmi_class(value: Column, asian: Column) -> Column:
    """The class of a body mass index; null under 1 and for null."""
    known = F.when(value >= 1, value)
    return F.when(asian, ladder(known, BMI_STEPS_ASIAN, "SEVERELY_OBESE")).otherwise(ladder(known, BMI_STEPS, "SEVERELY_OBESE"))


def breast_kilograms(difference: Column) -> Column:
    """The weight that a cup stands for, 0 where there is none: a cubic in the difference of bust and band less one inch."""
    d = difference - 1
    # The coefficients, in pounds, and kilograms a pound as the chart has them
    pounds = F.lit(0.765) + F.lit(0.415) * d - F.lit(0.0168) * d * d + F.lit(0.00247) * d * d * d
    return F.when(F.coalesce(difference, F.lit(0)) == 0, F.lit(0.0)).otherwise(pounds * 0.453)


# The figure types of apparel measurements (FFIT) in inches, each as alternatives of intervals. excess: bust over
# hips; bust drop and hip drop: over the waist; ratio: hips to waist.
FIGURES = {
    "HOURGLASS": [{"excess": "(-3.6, 1]", "bust drop": "[9, )"}, {"excess": "(-3.6, 1]", "hip drop": "[10, )"}],
    "BOTTOM_HOURGLASS": [{"excess": "(-10, -3.6]", "hip drop": "[9, )", "ratio": "(, 1.193)"}],
    "TOP_HOURGLASS": [{"excess": "(1, 10)", "bust drop": "[9, )"}],
    "SPOON": [{"excess": "(, -2)", "hip drop": "[7, )", "ratio": "[1.193, )"}],
    "TRIANGLE": [{"excess": "(, -3.6]", "hip drop": "[0, 9)"}, {"bust drop": "(, 0)", "hip drop": "[0, )"}],
    "INVERTED_TRIANGLE": [{"excess": "[3.6, )", "bust drop": "(, 9)"}],
    "RECTANGLE": [{"excess": "(-3.6, 3.6)", "bust drop": "[0, 9)", "hip drop": "[0, 10)"}],
    "DIAMOND": [{"bust drop": "(, 0)", "hip drop": "(, 0)"}],
    "OVAL": [{"bust drop": "[0, )", "hip drop": "(, 0)"}],
}
#: Inches between bust and hips from which a body without a figure is called by what is over.
FAR = 10


def within(value: Column, interval: str) -> Column:
    """Whether a value lies in an interval such as "[9, )": square brackets hold their bound, an empty bound is none."""
    low, high = (x.strip() for x in interval[1:-1].split(","))
    out = F.lit(True)
    if low:
        out = out & ((value >= float(low)) if interval[0] == "[" else (value > float(low)))
    if high:
        out = out & ((value <= float(high)) if interval[-1] == "]" else (value < float(high)))
    return out


def figure_rules(bust: Column, waist: Column, hips: Column) -> list[tuple[str, Column]]:
    """The figure types as rules over sizes in inches; a body may have several or none."""
    measure = {"excess": bust - hips, "bust drop": bust - waist, "hip drop": hips - waist, "ratio": hips / waist}
    rules = []
    for name, ways in FIGURES.items():
        holds = F.lit(False)
        for way in ways:
            one = F.lit(True)
            for what, interval in way.items():
                one = one & within(measure[what], interval)
            holds = holds | one
        rules.append((name, holds))
    return rules


def uncovered(bust: Column, waist: Column, hips: Column) -> Column:
    """What is over where a body has no figure and bust and hips are far apart, else null."""
    none = F.size(labels(figure_rules(bust, waist, hips))) == 0
    return F.when(none & (bust - hips >= FAR), "bust far over hips").when(none & (hips - bust >= FAR), "hips far over bust")
