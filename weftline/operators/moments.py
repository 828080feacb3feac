"""Dates and moments written in many ways, in many zones, brought to one unambiguous form.

Everything is a built-in JVM expression. A text is cut into its date, its time of day and its zone; each part has a few
shapes. Times without zone are read in a zone history per source: the declared one where there is one, else the one of
the candidates under which the fewest local times would lie after the record's arrival (`estimate_zones`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.clean import let
from weftline.session import fixed_values

# Month names, full and short, in eight languages, without accents.
MONTHS = {
    1: "january jan januar janvier janv enero ene gennaio gen januari janeiro",
    2: "february feb februar fevrier fevr febrero febbraio februari fevereiro fev",
    3: "march mar marz maerz mrz mars marzo maart mrt marco",
    4: "april apr avril avr abril abr aprile",
    5: "may mai mayo maggio mag mei maio maj",
    6: "june jun juni juin junio giugno giu junho",
    7: "july jul juli juillet juil julio luglio lug julho",
    8: "august aug aout agosto ago augustus augusti",
    9: "september sep sept septembre septiembre settembre set setembro",
    10: "october oct oktober okt octobre octubre ottobre ott outubro out",
    11: "november nov novembre noviembre novembro",
    12: "december dec dezember dez decembre diciembre dic dicembre dezembro desember",
}
# Zone abbreviations with one usual meaning, as offsets.
ABBREVIATIONS = {
    "z": "+00:00", "utc": "+00:00", "gmt": "+00:00", "wet": "+00:00", "west": "+01:00", "bst": "+01:00", "cet": "+01:00", "met": "+01:00", "cest": "+02:00", "eet": "+02:00", "eest": "+03:00", "msk": "+03:00", "ist": "+05:30", "jst": "+09:00", "kst": "+09:00",
    "aest": "+10:00", "aedt": "+11:00", "acst": "+09:30", "acdt": "+10:30", "awst": "+08:00", "nzst": "+12:00", "nzdt": "+13:00", "est": "-05:00", "edt": "-04:00", "cst": "-06:00", "cdt": "-05:00", "mst": "-07:00", "mdt": "-06:00", "pst": "-08:00", "pdt": "-07:00", "akst": "-09:00", "akdt": "-08:00", "hst": "-10:00",
}

NTZ = "timestamp_ntz"


def _map(pairs: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _cleaned(c: Column) -> Column:
    """Lower case, without quotes, weekday, notes such as "(approx.)" and leading words such as "on"."""
    s = F.lower(F.btrim(F.regexp_replace(c, "[   \t\r\n]+", " "), F.lit(" '\"“”‘’`")))
    s = F.regexp_replace(s, r"\s*\((?:approx\.?|approximately|estimated|est\.|circa|ca\.|tbc|local|local time|\?)\)", "")
    s = F.regexp_replace(s, r"^(?:on|released|release|born|published|date|circa|ca?\.|approx\.?|about|since|since:|am|le|el|il|op|em|den)\s*:?\s+", "")
    s = F.regexp_replace(s, r"^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+", "")
    return F.btrim(F.translate(s, "áàâãäåéèêëíîïóôõöúûüç", "aaaaaaeeeeiiioooouuuc"))


def _int(c: Column) -> Column:
    return F.when(c != "", c).try_cast("int")


def _day(y: Column, m: Column, d: Column) -> Column:
    return F.try_make_timestamp_ntz(y, m, d, F.lit(0), F.lit(0), F.lit(0)).cast("date")


def _iso(ts: Column) -> Column:
    return F.concat(F.substring(ts.cast("string"), 1, 10), F.lit("T"), F.substring(ts.cast("string"), 12, 8), F.lit("Z"))


_END = r"(?=$|[ t,:\[(])"
# The shapes of a date at the start of a text, first come first served.
SHAPES = [
    ("ymd", r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})" + _END),
    ("compact", r"^(\d{4})()(\d{2})(\d{2})(?=$|[ t])"),
    ("digits", r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4}|\d{2})" + _END),
    ("day first", r"^(\d{1,2})(?:st|nd|rd|th|er|\.|º|o)?[ -]+(?:of |de |d')?([a-z]+)\.?,?[ -]+(?:de |del |of )?(\d{4})()" + _END),
    ("month first", r"^([a-z]+)\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})()" + _END),
    ("week", r"^(\d{4})-?w(\d{2})-?([1-7])()" + _END),
    ("ordinal", r"^(\d{4})-(\d{3})()()" + _END),
]
_CLOCK = r"^(\d{1,2})[:.h](\d{2})(?:[:.](\d{2})(?:[.,]\d+)?)?(?: ?uhr| ?h)? ?(?:([ap])\.?m\b\.?)?(?=$|[ z+\-\[(a-z])"
_BARE_CLOCK = r"^(\d{2})(\d{2})(\d{2})?()(?=$|[ z+\-])"


def _date(shape: Column, g: list[Column], order: Column, month: Column) -> Column:
    """The date of the groups of a shape."""
    n = [_int(x) for x in g]
    year2 = lambda c: F.when(F.length(c) == 2, _int(c) + F.when(_int(c) >= 30, 1900).otherwise(2000)).otherwise(_int(c))
    dm, md = _day(year2(g[3]), n[2], n[0]), _day(year2(g[3]), n[0], n[2])
    year_first = F.when(F.length(g[3]) == 2, _day(year2(g[0]), n[2], n[3]))
    digits = F.when(order == "MDY", F.coalesce(md, dm)).when(order == "DMY", F.coalesce(dm, md)).otherwise(F.coalesce(year_first, md, dm))
    jan4 = _day(n[0], F.lit(1), F.lit(4))
    by_week = F.date_add(F.date_sub(jan4, F.weekday(jan4)), (n[1] - 1) * 7 + n[2] - 1)
    by_week = F.when((n[1] >= 1) & (n[1] <= F.weekofyear(_day(n[0], F.lit(12), F.lit(28)))), by_week)
    nth = F.date_add(_day(n[0], F.lit(1), F.lit(1)), n[1] - 1)
    nth = F.when((n[1] >= 1) & (F.year(nth) == n[0]), nth)
    by_shape = {"ymd": _day(n[0], n[2], n[3]), "compact": _day(n[0], n[2], n[3]), "digits": digits, "day first": _day(n[2], F.try_element_at(month, g[1]), n[0]), "month first": _day(n[2], F.try_element_at(month, g[0]), n[1]), "week": by_week, "ordinal": nth}
    found = F.lit(None).cast("date")
    for name, value in by_shape.items():
        found = F.when(shape == name, value).otherwise(found)
    return let(found, lambda d: F.when(F.year(d) > 0, d))


def _moment(date: Column, rest: Column, text: Column, zone: Column) -> Column:
    """`date` with the time of day and zone in `rest`, in UTC."""
    def timed(r: str) -> Column:
        hour, half = _int(F.regexp_extract(rest, r, 1)), F.regexp_extract(rest, r, 4)
        hour = F.when(half == "", hour).when((hour < 1) | (hour > 12), None).when(half == "p", hour % 12 + 12).otherwise(hour % 12)
        minute, second = _int(F.regexp_extract(rest, r, 2)), F.coalesce(_int(F.regexp_extract(rest, r, 3)), F.lit(0))
        local = F.try_make_timestamp_ntz(F.year(date), F.month(date), F.dayofmonth(date), hour, minute, second)
        return F.struct(local.alias("local"), F.btrim(F.regexp_replace(rest, r, ""), F.lit(" []()")).alias("zone"))

    def zoned(t: Column) -> Column:
        offset = r"^(?:utc|gmt)?([+\-]\d{2}):?(\d{2})?$"
        # IANA names have capitals, so they are taken from the text as it came
        original = F.regexp_extract(text, r"([A-Z][A-Za-z]+/[A-Za-z_/\-]+)", 1)
        stated = (
            F.when(t["zone"].rlike(offset), F.concat(F.regexp_extract(t["zone"], offset, 1), F.lit(":"), F.rpad(F.regexp_extract(t["zone"], offset, 2), 2, "0")))
            .when(t["zone"].rlike(r"^[a-z]+/[a-z_/\-]+$"), F.when(original != "", original))
            .when(t["zone"] != "", F.try_element_at(_map(ABBREVIATIONS), t["zone"]))
            .otherwise(F.coalesce(zone, F.lit("UTC")))
        )
        return let(stated, lambda z: _iso(F.when(z.isNotNull(), F.convert_timezone(z, F.lit("UTC"), t["local"]))))

    form = F.when(rest.rlike(_CLOCK), timed(_CLOCK)).when(rest.rlike(_BARE_CLOCK), timed(_BARE_CLOCK))
    return let(form, lambda t: F.when(t.isNotNull(), zoned(t)))


def _epoch(s: Column) -> Column:
    """Plain long numbers: seconds, milliseconds, microseconds or nanoseconds since 1970, by their length."""
    size = F.length(F.regexp_extract(s, r"^-?(\d+)", 1))
    per = F.when(size <= 10, 1).when(size <= 13, 1_000).when(size <= 16, 1_000_000).otherwise(1_000_000_000).cast("decimal(20,0)")
    seconds = F.floor(F.regexp_extract(s, r"^(-?\d+)", 1).try_cast("decimal(20,0)") / per).cast("bigint")
    return let(seconds, lambda x: _iso(F.lit("1970-01-01 00:00:00").cast(NTZ) + F.make_dt_interval(F.floor(x / 86400).cast("int"), F.lit(0), F.lit(0), F.pmod(x, F.lit(86400).cast("bigint")).cast("decimal(18,6)"))))


def _partial(s: Column, month: Column) -> Column:
    """Less than a date: a year, or a year and a month."""
    x = lambda rx, i: F.regexp_extract(s, rx, i)
    year, y_m = r"^(\d{4})(?:[-/.](?:\?\?|xx|00)){0,2}\??$", r"^(\d{4})[-/.](\d{1,2})(?:[-/.](?:\?{1,2}|x{1,2}|00))?$"
    m_y, mon_y = r"^(\d{1,2})[-/.](\d{4})$", r"^([a-z]+)\.?,? (?:de |del )?(\d{4})$"
    both = lambda y, m: F.when((m >= 1) & (m <= 12) & (_int(y) > 0), F.concat(y, F.lit("-"), F.lpad(m.cast("string"), 2, "0")))
    return (
        F.when(s.rlike(year), F.when(_int(x(year, 1)) > 0, x(year, 1)))
        .when(s.rlike(y_m), both(x(y_m, 1), _int(x(y_m, 2))))
        .when(s.rlike(m_y), both(x(m_y, 2), _int(x(m_y, 1))))
        .when(s.rlike(mon_y), both(x(mon_y, 2), F.try_element_at(month, x(mon_y, 1))))
    )


def parse_moment(text: Column, date_order: Column, zone: Column) -> Column:
    """The normal form of `text`: `YYYY-MM-DDTHH:MM:SSZ`, `YYYY-MM-DD`, `YYYY-MM` or `YYYY`; null if it names no existing date.

    date_order: DMY, MDY or YMD, for digits that could be read either way; zone: for times without one (null: UTC).
    An hour that occurs twice is its first pass, a skipped one moves forward by the gap. Fractions are cut off.
    """
    month = _map({name: m for m, names in MONTHS.items() for name in names.split()})
    order = F.coalesce(F.upper(date_order), F.lit("YMD"))

    def dated(s: Column) -> Column:
        # each shape has its pattern as a literal, which is compiled once, however the shapes change from row to row
        found = F.lit(None)
        for name, pattern in reversed(SHAPES):
            rest = F.rtrim(F.ltrim(F.regexp_replace(s, pattern, ""), F.lit(" t,:")), F.lit(" ,"))
            found = F.when(s.rlike(pattern), F.struct(F.lit(name).alias("shape"), *[F.regexp_extract(s, pattern, i + 1).alias(f"g{i}") for i in range(4)], rest.alias("rest"))).otherwise(found)
        of_shape = let(found, lambda k: F.when(k.isNull(), _partial(s, month)).otherwise(shaped(s, k)))
        return F.when(s.rlike(r"^-?\d{9,19}(?:\.\d+)?$"), _epoch(s)).otherwise(of_shape)

    def shaped(s: Column, k: Column) -> Column:
        date = _date(k["shape"], [k[f"g{i}"] for i in range(4)], order, month)
        return let(F.struct(date.alias("date"), k["rest"].alias("rest")), lambda p: F.when(p["date"].isNull(), _partial(s, month)).when(p["rest"].rlike(r"^\d"), _moment(p["date"], p["rest"], text, zone)).otherwise(p["date"].cast("string")))

    # most texts are plain ISO dates
    plain = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date").cast("string"))
    return F.when(plain.isNotNull() & (text > "0001"), plain).when(text.isNotNull(), let(_cleaned(text), dated))


def plain_date(text: Column, date_order: Column) -> Column:
    """The date of a text that is nothing but one, in a frequent notation, as `parse_moment` reads it; null for all others, which are left to it."""
    at = lambda i, n: F.substring(text, i, n)
    on = lambda y, m, d: F.concat(y, F.lit("-"), m, F.lit("-"), d).try_cast("date")
    dm, md = on(at(7, 4), at(4, 2), at(1, 2)), on(at(7, 4), at(1, 2), at(4, 2))
    digits = F.when(F.upper(date_order) == "DMY", F.coalesce(dm, md)).otherwise(F.coalesce(md, dm))
    month = _map({name: f"{m:02}" for m, names in MONTHS.items() for name in names.split()})

    def named(pattern: str, day: int, word: int) -> Column:
        part = lambda i: F.regexp_extract(text, pattern, i)
        return on(part(3), F.try_element_at(month, F.lower(part(word))), F.lpad(part(day), 2, "0"))

    # no year 0; nothing here is needed twice, as it would run twice
    day_first, month_first = r"^(\d{1,2})[ -]([A-Za-z]+),?[ -]((?!0000)\d{4})\z", r"^([A-Za-z]+) (\d{1,2}),? ((?!0000)\d{4})\z"
    return (
        F.when(text.rlike(r"^(?!0000)\d{4}([-/.])\d{2}\1\d{2}\z"), on(at(1, 4), at(6, 2), at(9, 2)))
        .when(text.rlike(r"^(?!0000)\d{8}\z"), on(at(1, 4), at(5, 2), at(7, 2)))
        .when(text.rlike(r"^\d{2}([-/.])\d{2}\1(?!0000)\d{4}\z"), digits)
        .when(text.rlike(day_first), named(day_first, 1, 2))
        .when(text.rlike(month_first), named(month_first, 2, 1))
    )


def estimate_zones(df: DataFrame, source: str, local: str, arrived: str, candidates: list[str]) -> DataFrame:
    """df(source, local timestamp_ntz, arrived timestamp_ntz in UTC) -> (source, zone): the candidate history with the fewest violations.

    A moment converted with the right history does not lie after the arrival of its record; of the histories with as few
    violations the one with the least delay to arrival is chosen, then the first by name. A null source, moment or arrival
    tells nothing. The candidates are a stated, short list; per source only counts are gathered.
    """
    known = df.where(F.col(source).isNotNull() & F.col(local).isNotNull() & F.col(arrived).isNotNull())
    tried = known.select(source, local, arrived, F.explode(F.array([F.lit(z) for z in candidates])).alias("zone"))
    delay = F.timestamp_diff("SECOND", F.convert_timezone(F.col("zone"), F.lit("UTC"), F.col(local)), F.col(arrived))
    scored = tried.groupBy(source, "zone").agg(F.sum((delay < 0).cast("int")).alias("violations"), F.sum(F.greatest(delay, F.lit(0))).alias("delay"))
    best = Window.partitionBy(source).orderBy("violations", "delay", "zone")
    return scored.withColumn("rank", F.row_number().over(best)).where("rank = 1").select(source, "zone")


def zones_for(sites: DataFrame, observed: DataFrame | None = None) -> DataFrame:
    """sites(host, zone, date_order) -> the same, one row a host, gaps of `zone` filled by `estimate_zones` over observed(host, local, arrived)."""
    declared = sites.where("host is not null").groupBy("host").agg(F.min("zone").alias("zone"), F.min("date_order").alias("date_order"))
    if observed is None:
        return declared
    candidates = fixed_values(sites, "zone")
    open_hosts = declared.where("zone is null").select("host")
    if not candidates or open_hosts.isEmpty():
        return declared
    found = estimate_zones(observed.join(open_hosts, "host", "left_semi"), "host", "local", "arrived", candidates).withColumnRenamed("zone", "estimated")
    return declared.join(found, "host", "left").select("host", F.coalesce("zone", "estimated").alias("zone"), "date_order")


def normalise_moments(df: DataFrame, id_col: str, text_col: str, host_col: str, sites: DataFrame) -> DataFrame:
    """df -> (row_id, normal_form): one row per record whose text names a date; ids that arrive twice count once.

    sites(host, zone, date_order) is a dimension table with one row a host; hosts without a row are read as UTC and
    year-month-day. Null, blank and unusable texts give no row.
    """
    once = df.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(text_col).alias("text"), F.col(host_col).alias("host")).where("row_id is not null and text is not null").dropDuplicates(["row_id"])
    zoned = once.join(sites.select("host", "zone", "date_order"), "host", "left")
    return zoned.select("row_id", parse_moment(F.col("text"), F.col("date_order"), F.col("zone")).alias("normal_form")).where("normal_form is not null")
