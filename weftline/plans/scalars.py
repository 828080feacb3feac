"""Queries over scalar, list, address and incremental operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import body, text, urls
from weftline.functions.clean import int_id, url_key
from weftline.operators import relational as R
from weftline.operators.hierarchy import marked_above, resolve_tree
from weftline.plans.store import ONE, PEOPLE, PERFORMERS, RESULTS, RUNS, SCENES, SOURCES, TAGS, URLS, once
from weftline.session import table
from weftline.streaming import events as streams

QUERIES, ORACLES = {}, {}
MEASURES = ONE.format("measurements")


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def put(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


# --- text, numbers, dates ----------------------------------------------------------------------------------------------

@query("f1_clean", f"select id, nullif(trim(regexp_replace(name, '[\\s\\x{{00a0}}]+', ' ', 'g')), '') as value from {PERFORMERS}")
def f1_clean(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, sf, "performers", "name").select("id", text.clean(F.col("name")).alias("value"))


@query("f3_canon_text", f"select id, nullif(trim(regexp_replace(regexp_replace(replace(lower(strip_accents(name)), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), '\\s+', ' ', 'g')), '') as canon from {PERFORMERS}")
def f3_canon_text(spark: SparkSession, sf: str) -> DataFrame:
    """The form under which names are compared."""
    return once(spark, sf, "performers", "name").select("id", text.canon_text(F.col("name")).alias("canon"))


_D = "nullif(trim(regexp_replace(regexp_extract(date, '^([^T]*)', 1), '\\s+', ' ', 'g')), '')"
_TRIES = [("%Y-%m-%d", r"\d{4}-\d{1,2}-\d{1,2}"), ("%Y/%m/%d", r"\d{4}/\d{1,2}/\d{1,2}"), ("%d-%m-%Y", r"\d{1,2}-\d{1,2}-\d{4}"), ("%d/%m/%Y", r"\d{1,2}/\d{1,2}/\d{4}"), ("%m/%d/%Y", r"\d{1,2}/\d{1,2}/\d{4}"), ("%B %d, %Y", r"[A-Za-z]{3,} \d{1,2}, \d{4}"), ("%b %d, %Y", r"[A-Za-z]{3} \d{1,2}, \d{4}"), ("%d %B %Y", r"\d{1,2} [A-Za-z]{3,} \d{4}"), ("%d %b %Y", r"\d{1,2} [A-Za-z]{3} \d{4}"), ("%Y%m%d", r"\d{8}")]
_DATED = "coalesce(" + ", ".join(f"case when regexp_full_match(d, '{rx}') then try_strptime(d, '{f}') end" for f, rx in _TRIES) + ")"


@query("f5_parse_date", f"select id, strftime({_DATED}, '%Y-%m-%d') as day from (select id, {_D} as d from {SCENES})")
def f5_parse_date(spark: SparkSession, sf: str) -> DataFrame:
    """Dates by a fixed list of patterns, day before month."""
    return once(spark, sf, "scraped_scenes", "date").select("id", text.parse_date(F.col("date")).alias("day"))


@query("f6_int_prefix", f"select id, try_cast(nullif(regexp_extract(height, '(-?\\d+)', 1), '') as bigint) as number from {PEOPLE}")
def f6_int_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, sf, "scraped_performers", "height").select("id", text.int_prefix(F.col("height")).alias("number"))


@query("f9_title_from_filename", f"select id, nullif(array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(f, '\\.[^.]{{0,4}}$', ''), '[._\\-\\[\\]()\\s]+', ' ', 'g')), ' '), lambda w: w <> '' and not regexp_full_match(lower(w), '\\d{{1,4}}p') and lower(w) not in ({', '.join(repr(w) for w in text.NOISE)})), ' '), '') as title from (select id, replace(title, ' ', '.') || '.[1080p].WEB-DL.x264.mp4' as f from {SCENES} where title is not null)")
def f9_title_from_filename(spark: SparkSession, sf: str) -> DataFrame:
    """Titles out of the names files would have."""
    s = once(spark, sf, "scraped_scenes", "title").where("title is not null")
    name = F.concat(F.replace(F.col("title"), F.lit(" "), F.lit(".")), F.lit(".[1080p].WEB-DL.x264.mp4"))
    return s.select("id", text.title_from_filename(name).alias("title"))


@query("f10_local_path", f"select id, case when p = '' then '/' else p end as path from (select id, regexp_replace(url, '^https?://[^/]*', '', 'i') as p from {URLS})")
def f10_local_path(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, sf, "urls", "url").select("id", text.local_path(F.col("url")).alias("path"))


@query("f11_option_id", f"select id, 'o_' || substr(sha1(norm_key), 1, 10) as option from {URLS}")
def f11_option_id(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, sf, "urls", "norm_key").select("id", text.option_id("o", F.col("norm_key")).alias("option"))


@query("f13_column_id", f"select id, 's' || source_id || '_' || ordinal as col, regexp_extract('s' || source_id || '_' || ordinal, '^s(\\d+)_\\d+$', 1)::bigint as source from {RESULTS}")
def f13_column_id(spark: SparkSession, sf: str) -> DataFrame:
    """Column ids, and the source read back out of them."""
    c = F.concat(F.lit("s"), F.col("source_id").cast("string"), F.lit("_"), F.col("ordinal").cast("string"))
    return once(spark, sf, "results", "source_id", "ordinal").select("id", c.alias("col"), F.regexp_extract(c, r"^s(\d+)_\d+$", 1).cast("bigint").alias("source"))


@query("f17_gender_word", f"select id, case when w in ('MALE', 'FEMALE', 'TRANSGENDER_MALE', 'TRANSGENDER_FEMALE', 'INTERSEX', 'NON_BINARY') then w end as gender from (select id, upper(regexp_replace(trim(gender), '[\\s\\-]+', '_', 'g')) as w from {PERFORMERS})")
def f17_gender_word(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, sf, "performers", "gender").select("id", text.gender_word(F.col("gender")).alias("gender"))


@query("f18_alias_split", f"select id, array_to_string(list_filter(list_transform(string_split(aliases, ','), lambda x: trim(x, ' ')), lambda x: x <> ''), '|') as aliases from {PERFORMERS} where aliases is not null")
def f18_alias_split(spark: SparkSession, sf: str) -> DataFrame:
    """Plain comma lists (packed ones of any kind: p2)."""
    parts = F.filter(F.transform(F.split("aliases", ","), lambda x: F.trim(x)), lambda x: x != "")
    return once(spark, sf, "performers", "aliases").where("aliases is not null").select("id", F.array_join(parts, "|").alias("aliases"))


@query("f21_choice_list", f"select id, array_length(list_distinct(list_filter(list_transform(regexp_split_to_array(aliases, '[,;\\n]'), lambda x: trim(x, ' ')), lambda x: x <> '')))::int as choices from {TAGS} where aliases is not null")
def f21_choice_list(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, sf, "tags", "aliases").where("aliases is not null").select("id", F.size(text.split_list(F.col("aliases"), ",;\\n")).alias("choices"))


@query("f27_units", f"select id, nullif(regexp_extract(height, '(\\d+ ?cm)', 1), '') as metric, nullif(regexp_extract(height, '(\\d+ ft \\d+ in)', 1), '') as imperial from {PEOPLE}")
def f27_units(spark: SparkSession, sf: str) -> DataFrame:
    """The stretch of a text that states a unit (values in one unit: p4)."""
    pick = lambda rx: F.nullif(F.regexp_extract("height", rx, 1), F.lit(""))
    return once(spark, sf, "scraped_performers", "height").select("id", pick(r"(\d+ ?cm)").alias("metric"), pick(r"(\d+ ft \d+ in)").alias("imperial"))


@query("f29_redact", f"select id, regexp_replace(regexp_replace(regexp_replace(u, '((?:api[_-]?key|apikey|token|password|secret)[\"'']?\\s*[:=]\\s*[\"'']?)[^\\s\"''&,;]+', '\\1<redacted>', 'gi'), '(authorization\\s*:\\s*(?:bearer|basic)\\s+)\\S+', '\\1<redacted>', 'gi'), '(://[^/:@\\s]+:)[^@/\\s]+(@)', '\\1<redacted>\\2', 'gi') as line from (select id, 'GET ' || url || ' token=' || sha1(url) || ' ok' as u from {URLS})")
def f29_redact(spark: SparkSession, sf: str) -> DataFrame:
    """Log lines without credentials."""
    line = F.concat(F.lit("GET "), F.col("url"), F.lit(" token="), F.sha1("url"), F.lit(" ok"))
    return once(spark, sf, "urls", "url").select("id", text.redact(line).alias("line"))


@query("f31_first_meaningful", f"select id, coalesce(case when not regexp_full_match(lower(trim(country)), '(no (data|director|information)|unknown|none|n/?a|-|\\?)?') then country end, case when not regexp_full_match(lower(trim(gender)), '(no (data|director|information)|unknown|none|n/?a|-|\\?)?') then gender end) as value from {PERFORMERS}")
def f31_first_meaningful(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, sf, "performers", "country", "gender").select("id", text.first_meaningful(F.col("country"), F.col("gender")).alias("value"))


_M = "regexp_replace(raw, '\\s+', '', 'g')"
_N, _C = "(\\d+(?:\\.\\d+)?)", "\\(?([A-Za-z]+)\\)?"
_SHAPES = [("no bust, waist and hips", f"^NoneNone[-/]{_N}[-/]{_N}$", "i", (0, 0, 1, 2)), ("cup behind, waist and hips", f"^{_N}{_C}[-/]{_N}[-/]{_N}$", "c", (1, 2, 3, 4)), ("cup before, waist and hips", f"^{_C}{_N}[-/]{_N}[-/]{_N}$", "c", (2, 1, 3, 4)), ("no cup, waist and hips", f"^{_N}[-/]{_N}[-/]{_N}$", "c", (1, 0, 2, 3)), ("cup behind", f"^{_N}{_C}", "c", (1, 2, 0, 0)), ("cup before", f"^{_C}{_N}", "c", (2, 1, 0, 0))]


def _pick(k: int, kind: str = "double") -> str:
    cases = " ".join(f"when shape = '{n}' then " + (f"regexp_extract(t, '{rx}', {g[k]}, '{o}')" if g[k] else "null") for n, rx, o, g in _SHAPES)
    return f"nullif(try_cast(nullif(case {cases} end, '') as double), 0)" if kind == "double" else f"upper(nullif(case {cases} end, ''))"


_PARSED = f"(select id, shape, {_pick(0)} as first, {_pick(1, 's')} as cup, {_pick(2)} as waist, {_pick(3)} as hips from (select id, t, case " + " ".join(f"when regexp_matches(t, '{rx}', '{o}') then '{n}'" for n, rx, o, _ in _SHAPES) + f" end as shape from (select id, {_M} as t from {MEASURES} where raw is not null)))"
_UNITS = "case when shape is null then null when (first is not null or waist is not null or hips is not null) and coalesce(first, 99) > 50 and coalesce(waist, 99) > 50 and coalesce(hips, 99) > 50 then 'metric' else 'imperial' end"
_KIND = "case when first is null then null when waist is not null and hips is not null then 'bust' when cup is null then 'bust' else 'band' end"


@query("f33_measurements", f"select id, shape, first, cup, waist, hips, {_UNITS} as units, {_KIND} as kind from {_PARSED}")
def f33_measurements(spark: SparkSession, sf: str) -> DataFrame:
    """Measurement strings as the calculator reads them."""
    m = once(spark, sf, "measurements", "raw").where("raw is not null")
    return m.select("id", body.parse_measurements(F.col("raw")).alias("p")).select("id", "p.*")


_CUP = "case cup " + " ".join(f"when '{c}' then {n}" for c, n in body.CUPS.items()) + " end"


@query("f32_derived_sizes", f"select id, round(case kind when 'bust' then first / per when 'band' then first / per + diff end, 4) as bust, round(case kind when 'band' then first / per when 'bust' then first / per - diff end, 4) as band, round(waist / per, 4) as waist, round(hips / per, 4) as hips from (select *, case when units = 'metric' then 2.54 else 1 end as per, {_CUP} as diff, from (select *, {_UNITS} as units, {_KIND} as kind from {_PARSED})) where shape is not null")
def f32_derived_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes in inches, bust from band and band from bust by the cup."""
    m = once(spark, sf, "measurements", "raw").where("raw is not null").select("id", body.parse_measurements(F.col("raw")).alias("p")).where("p.shape is not null")
    d = m.select("id", body.derived_sizes(F.col("p")).alias("d"))
    return d.select("id", *[F.round(F.col(f"d.{c}"), 4).alias(c) for c in ("bust", "band", "waist", "hips")])


_BMI = "w / ((h / 100.0) * (h / 100.0))"


def _steps(steps: list[tuple[float, str]]) -> str:
    return "case when " + _BMI + " < 1 then null " + " ".join(f"when {_BMI} < {bound} then '{name}'" for bound, name in steps) + " else 'SEVERELY_OBESE' end"


@query("f35_bmi_class", f"select id, round({_BMI}, 3) as bmi, {_steps(body.BMI_STEPS)} as class, {_steps(body.BMI_STEPS_ASIAN)} as asian from (select id, try_cast(regexp_extract(height, '^\\s*(\\d+) ?cm', 1, 'i') as double) as h, try_cast(regexp_extract(weight, '^\\s*(\\d+) ?kg', 1, 'i') as double) as w from {PEOPLE}) where h > 0 and w > 0")
def f35_bmi_class(spark: SparkSession, sf: str) -> DataFrame:
    """Body mass index and its class by both standards, where both sizes are metric in text."""
    pick = lambda c, u: F.regexp_extract(c, rf"(?i)^\s*(\d+) ?{u}", 1).try_cast("double")
    p = once(spark, sf, "scraped_performers", "height", "weight").select("id", pick("height", "cm").alias("h"), pick("weight", "kg").alias("w")).where("h > 0 and w > 0")
    b = body.bmi(F.col("w"), F.col("h") / 100)
    return p.select("id", F.round(b, 3).alias("bmi"), body.bmi_class(b, F.lit(False)).alias("class"), body.bmi_class(b, F.lit(True)).alias("asian"))


_FIGURES = {
    "HOURGLASS": "b - h <= 1 and h - b < 3.6 and (b - w >= 9 or h - w >= 10)", "BOTTOM_HOURGLASS": "h - b >= 3.6 and h - b < 10 and h - w >= 9 and h / w < 1.193", "TOP_HOURGLASS": "b - h > 1 and b - h < 10 and b - w >= 9",
    "SPOON": "h - b > 2 and h - w >= 7 and h / w >= 1.193", "TRIANGLE": "(h - b >= 3.6 and h - w >= 0 and h - w < 9) or (b - w < 0 and h - w >= 0)", "INVERTED_TRIANGLE": "b - h >= 3.6 and b - w < 9",
    "RECTANGLE": "h - b < 3.6 and b - h < 3.6 and b - w >= 0 and b - w < 9 and h - w >= 0 and h - w < 10", "DIAMOND": "h - w < 0 and b - w < 0", "OVAL": "h - w < 0 and b - w >= 0",
}
_SIZED = f"(select id, first / per as b, waist / per as w, hips / per as h, {_CUP} as diff from (select *, case when {_UNITS} = 'metric' then 2.54 else 1 end as per from {_PARSED}) where first is not null and waist is not null and hips is not null)"


@query("f36_figures", f"select id, labels, case when labels = '' and b - h >= 10 then 'bust far over hips' when labels = '' and h - b >= 10 then 'hips far over bust' end as gap from (select *, array_to_string(list_filter([{', '.join(f'case when {rule} then {name!r} end' for name, rule in _FIGURES.items())}], lambda x: x is not null), ',') as labels from {_SIZED})")
def f36_figures(spark: SparkSession, sf: str) -> DataFrame:
    """All figure types whose rule holds, and the gap a body without any falls into."""
    m = once(spark, sf, "measurements", "raw").where("raw is not null").select("id", body.parse_measurements(F.col("raw")).alias("p")).where("p.first is not null and p.waist is not null and p.hips is not null")
    d = m.select("id", body.derived_sizes(F.col("p")).alias("d")).select("id", "d.*")
    sizes = F.col("bust"), F.col("waist"), F.col("hips")
    return d.select("id", F.array_join(body.labels(body.figure_rules(*sizes)), ",").alias("labels"), body.uncovered(*sizes).alias("gap"))


@query("f34_breast_weight", f"select id, round(case when coalesce(diff, 0) = 0 then 0 else (0.765 + 0.415 * (diff - 1) - 0.0168 * (diff - 1) ** 2 + 0.00247 * (diff - 1) ** 3) * 0.453 end, 4) as kilograms from {_SIZED}")
def f34_breast_weight(spark: SparkSession, sf: str) -> DataFrame:
    """The weight a cup stands for."""
    m = once(spark, sf, "measurements", "raw").where("raw is not null").select("id", body.parse_measurements(F.col("raw")).alias("p")).where("p.first is not null and p.waist is not null and p.hips is not null")
    return m.select("id", F.round(body.breast_kilograms(body.derived_sizes(F.col("p"))["difference"]), 4).alias("kilograms"))


# --- lists, addresses, payloads ----------------------------------------------------------------------------------------

_HOSTPATH = "regexp_replace(regexp_replace(regexp_replace(url, '^https?://', '', 'i'), '#.*$', ''), '\\?.*$', '')"
_KEPT = "list_sort(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '' and lower(regexp_extract(x, '^([^=]*)', 1)) not in ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'utm_id', 'gclid', 'fbclid', 'msclkid', 'mc_cid', 'mc_eid', 'igshid', 'ref', 'referrer', 'referer', 'aff', 'affiliate', 'affiliate_id', 'partner', 'partnerid', 'nats', 'ats', 'utm_reader', 'trk')))"


@query("x2_url_key", f"select id, h || p || case when q <> '' then '?' || q else '' end as key from (select id, regexp_replace(regexp_replace(lower(regexp_extract(hp, '^([^/]*)', 1)), '^www\\.', ''), ':(80|443)$', '') as h, case when regexp_replace(regexp_replace(regexp_extract(hp, '^[^/]*(.*)$', 1), '/+', '/', 'g'), '/$', '') = '' then '/' else regexp_replace(regexp_replace(regexp_extract(hp, '^[^/]*(.*)$', 1), '/+', '/', 'g'), '/$', '') end as p, array_to_string({_KEPT}, '&') as q from (select id, url, {_HOSTPATH} as hp from {URLS} where url is not null))")
def x2_url_key(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses under which two are the same page."""
    return once(spark, sf, "urls", "url").where("url is not null").select("id", url_key(F.col("url")).alias("key"))


@query("x3_site_rules", f"select id, 'https://' || lower(regexp_extract(u, '^https?://([^/?#]*)', 1)) || regexp_replace(regexp_extract(u, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '') || case when regexp_extract(u, '(\\?[^#]*)', 1) = '?' then '' else regexp_extract(u, '(\\?[^#]*)', 1) end as url, lower(regexp_extract(u, '^https?://([^/?#]*)', 1)) as domain from (select id, case when regexp_matches(url, '^https?://') then url else 'https://' || url end as u from {URLS} where url is not null)")
def x3_site_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses as their sites write them; no site with rules of its own is among these, so the general rules show."""
    u = once(spark, sf, "urls", "url").where("url is not null").select("id", urls.by_site_rules(F.col("url")).alias("r"))
    return u.select("id", "r.url", "r.domain")


@query("x4_urls_in_text", "select doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') as urls from (select doc_id, list_transform(regexp_extract_all(text, '(?i)https?://[^\\s\"''<>)\\]}]+'), lambda u: regexp_replace(u, '[.,;:!?)]+$', '')) as l from documents where contains(lower(text), 'http'))")
def x4_urls_in_text(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "text").where(F.contains(F.lower("text"), F.lit("http")))
    return d.select("doc_id", F.array_join(urls.in_text(F.col("text")), " ").alias("urls"))


@query("x5_payload_fields", f"select id, json_extract_string(raw_json, '$.title') as title, json_extract_string(raw_json, '$.code') as code from {RESULTS} where raw_json is not null")
def x5_payload_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Fields out of payloads: one parse for all."""
    r = once(spark, sf, "results", "raw_json").where("raw_json is not null").select("id", F.from_json("raw_json", "title string, code string").alias("p"))
    return r.select("id", "p.title", "p.code")


@query("x9_payload_keys", f"select id, array_to_string(list_sort(json_keys(raw_json)), ',') as keys from {RESULTS} where raw_json is not null")
def x9_payload_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The keys of each payload, in order: what a canonical encoding sorts by."""
    r = once(spark, sf, "results", "raw_json").where("raw_json is not null")
    return r.select("id", F.array_join(F.array_sort(F.json_object_keys("raw_json")), ",").alias("keys"))


@query("x19_dedupe_keep_case", f"select run_id, k, arg_min(url, struct_pack(a := case when path <> lower(path) and path <> upper(path) then 0 else 1 end, b := id)) as url, count(*) as spellings from (select id, run_id, url, lower(url) as k, regexp_extract(url, '^(?:[A-Za-z]+://[^/?#]*)?([^?#]*)', 1) as path from {URLS} where url is not null) group by run_id, k")
def x19_dedupe_keep_case(spark: SparkSession, sf: str) -> DataFrame:
    """One spelling of each address of a run, mixed case preferred, then the first."""
    u = once(spark, sf, "urls", "run_id", "url").where("url is not null").withColumn("k", F.lower("url"))
    return u.groupBy("run_id", "k").agg(F.min_by("url", F.struct((~urls.mixed_case(F.col("url"))).cast("int"), "id")).alias("url"), F.count("*").alias("spellings"))


@query("proj11_safe_urls", f"select id, coalesce(regexp_matches(trim(url), '^https?://[^/?#\\s]+', 'i'), false) as safe from {URLS}")
def proj11_safe_urls(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, sf, "urls", "url").select("id", urls.is_safe(F.col("url")).alias("safe"))


@query("o5_url_sort", f"select run_id, id, row_number() over (partition by run_id order by host, norm_key, id) as place from {URLS} where run_id is not null and norm_key is not null and host is not null")
def o5_url_sort(spark: SparkSession, sf: str) -> DataFrame:
    """The place of each page of a run by domain, then address: one row a page, counted in slices of domains, so that no run is gathered."""
    u = once(spark, sf, "urls", "run_id", "norm_key", "host").where("run_id is not null and norm_key is not null and host is not null")
    return R.rank_in_slices(u, ["run_id"], [F.col("host")], [F.col("norm_key"), F.col("id")], "place").select("run_id", "id", "place")


@query("f12_answers_to", f"select p.id, count(*) as answers from {PERFORMERS} p join (select distinct id, lower(trim(unnest(string_split(aliases, ',')))) as a from performers where aliases is not null) x on x.a = lower(p.name) and x.id <> p.id group by p.id")
def f12_answers_to(spark: SparkSession, sf: str) -> DataFrame:
    """How many other records have a record's name among their aliases."""
    a = table(spark, sf, "performers").where("aliases is not null").select(F.col("id").alias("other"), F.explode(F.transform(F.split("aliases", ","), lambda x: F.lower(F.trim(x)))).alias("key")).distinct()
    p = once(spark, sf, "performers", "name").select("id", F.lower("name").alias("key"))
    # aliases are counted by name first, and a record's own taken off: no name meets all its aliases row by row
    n = a.groupBy("key").agg(F.count("*").alias("n"))
    own = a.select(F.col("other").alias("id"), "key", F.lit(1).alias("own"))
    answers = F.col("n") - F.coalesce("own", F.lit(0))
    return p.join(n, "key").join(own, ["id", "key"], "left").where(answers > 0).select("id", answers.alias("answers"))


@query("f16_signature", f"select id, case when trim(coalesce(stored_id, '')) in ('', '0', '-', 'n/a', 'None', 'null', 'unknown') then 'name:' || lower(name) else 'id:' || regexp_replace(trim(lower(stored_id), ' ' || chr(9)), '^#?0*|\\.0+$', '', 'g') end as signature from {PERFORMERS} where name is not null")
def f16_signature(spark: SparkSession, sf: str) -> DataFrame:
    """The key a selection is carried by: the stored id, else the name."""
    p = once(spark, sf, "performers", "stored_id", "name").where("name is not null")
    sid = int_id(F.col("stored_id"))
    return p.select("id", F.when(sid.isNotNull(), F.concat(F.lit("id:"), sid)).otherwise(F.concat(F.lit("name:"), F.lower("name"))).alias("signature"))


# --- iterative and incremental -----------------------------------------------------------------------------------------

@query("t1_waves", f"with recursive l as (select distinct id, parent_source_id as p from sources), w(id, depth) as (select id, 0 from l where p is null union all select l.id, w.depth + 1 from l join w on l.p = w.id) select id, depth from w")
def t1_waves(spark: SparkSession, sf: str) -> DataFrame:
    """The wave in which discovery from the sources without parent meets each source: its level, found without waves."""
    s = once(spark, sf, "sources", "parent_source_id")
    tree = resolve_tree(s.select("id", F.col("parent_source_id").alias("parent"))).where("level >= 0")
    seeds = s.where("parent_source_id is null").select(F.col("id").alias("root"))
    return tree.join(seeds, "root", "left_semi").select("id", F.col("level").alias("depth"))


@query("t5_cascade", f"with recursive l as (select distinct id, parent_source_id as p, status from sources), d(id) as (select id from l where status = 'ERROR' union select l.id from l join d on l.p = d.id) select id from d")
def t5_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Sources that fall with a failed one above them."""
    s = once(spark, sf, "sources", "parent_source_id", "status")
    return marked_above(s.select("id", F.col("parent_source_id").alias("parent"), (F.col("status") == "ERROR").alias("marked")))


@query("t5_vouched")
def t5_vouched(spark: SparkSession, sf: str) -> DataFrame:
    """Sources that fall with a failed one above them in their run, but for those whose page a source that does not fall came up with."""
    s = once(spark, sf, "sources", "run_id", "parent_source_id", "status", "url", "url_key")
    s = s.select("id", "run_id", F.col("parent_source_id").alias("parent"), "status", url_key(F.coalesce(F.nullif(F.trim("url_key"), F.lit("")), F.col("url"))).alias("page"))
    r = once(spark, sf, "results", "source_id").select(F.col("id").alias("discovered_by_result_id"), F.col("source_id").alias("voucher"))
    u = once(spark, sf, "urls", "run_id", "norm_key", "discovered_by_result_id").where("norm_key is not null")
    mentioned = u.join(r, "discovered_by_result_id").where("voucher is not null").select("run_id", url_key(F.col("norm_key")).alias("page"), "voucher").distinct()
    return R.fall_unless_vouched(s.select("id", "run_id", "parent", "page", F.coalesce(F.col("status") == "ERROR", F.lit(False)).alias("failed")), mentioned)


@query("t6_unmarked", f"select id from {SCENES} s where not exists (select 1 from result_images i where i.result_id = s.result_id)")
def t6_unmarked(spark: SparkSession, sf: str) -> DataFrame:
    """Records that the ledger of what was processed does not have."""
    done = table(spark, sf, "result_images").select("result_id")
    return once(spark, sf, "scraped_scenes", "result_id").join(done, "result_id", "left_anti").select("id")


@query("t9_stale", f"select id, scene_id from {RUNS} where finished_at is null and coalesce(heartbeat_at, started_at) < (select max(loaded_at) from runs) - interval 6 hour")
def t9_stale(spark: SparkSession, sf: str) -> DataFrame:
    """Runs that never finished and whose last sign of life is six hours before the newest arrival."""
    now = table(spark, sf, "runs").agg(F.max("loaded_at").alias("now"))
    r = once(spark, sf, "runs", "scene_id", "started_at", "finished_at", "heartbeat_at").where("finished_at is null")
    return r.join(F.broadcast(now)).where(F.coalesce("heartbeat_at", "started_at") < F.col("now") - F.expr("interval 6 hours")).select("id", "scene_id")


@query("t16_preflight", f"""with m as (select id, host || '/' || title as target, host || '/' || coalesce(studio_name, 'none') || '/' || title as source from {SCENES} where title is not null and host is not null), o as (select target, min(id) as owner from m group by target)
select m.id, case when m.source = m.target then 'ALREADY_THERE' when o.owner <> m.id then 'CONFLICT' else 'MOVE' end as plan, o.owner from m join o using (target)""")
def t16_preflight(spark: SparkSession, sf: str) -> DataFrame:
    """A move planned per file: the first to claim a target has it, the others conflict."""
    s = once(spark, sf, "scraped_scenes", "host", "title", "studio_name").where("title is not null and host is not null")
    m = s.select("id", F.concat_ws("/", "host", "title").alias("target"), F.concat_ws("/", "host", F.coalesce("studio_name", F.lit("none")), "title").alias("source"))
    o = m.groupBy("target").agg(F.min("id").alias("owner"))
    plan = F.when(F.col("source") == F.col("target"), "ALREADY_THERE").when(F.col("owner") != F.col("id"), "CONFLICT").otherwise("MOVE")
    return m.join(o, "target").select("id", plan.alias("plan"), "owner")


@query("t17_tumbling", "select strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M') as hour, event_type, count(*) as events, round(sum(value), 2) as total from events group by 1, 2")
def t17_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    """Event counts by hour: the batch form of the streaming aggregate."""
    return streams.hourly(table(spark, sf, "events")).select(F.date_format("hour", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "events", F.round("total", 2).alias("total"))


@query("t17_sessions", """select user_id, count(*) as sessions, max(n) as longest from (select user_id, s, count(*) as n from (select user_id, sum(new) over (partition by user_id order by ts, event_id) as s from (select *, case when lag(ts) over (partition by user_id order by ts, event_id) is null or ts - lag(ts) over (partition by user_id order by ts, event_id) >= interval 30 minute then 1 else 0 end as new from events)) group by 1, 2) group by 1""")
def t17_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of each user, ended by half an hour of silence."""
    s = table(spark, sf, "events").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@query("s20_owner_lookup", f"select s.id, r.id as result_id, r.source_id from {SCENES} s left join {RESULTS} r on r.id = s.result_id")
def s20_owner_lookup(spark: SparkSession, sf: str) -> DataFrame:
    r = once(spark, sf, "results", "source_id").select(F.col("id").alias("result_id"), F.col("id").alias("found"), "source_id")
    return once(spark, sf, "scraped_scenes", "result_id").join(r, "result_id", "left").select("id", F.col("found").alias("result_id"), "source_id")


@query("d3_keep_old", f"select s.id, coalesce(s.error, 'none') as error, coalesce(s.finished_at, s.started_at) is not null as dated from {SOURCES} s")
def d3_keep_old(spark: SparkSession, sf: str) -> DataFrame:
    """Updates that keep the old value where they have none."""
    return once(spark, sf, "sources", "error", "finished_at", "started_at").select("id", F.coalesce("error", F.lit("none")).alias("error"), F.coalesce("finished_at", "started_at").isNotNull().alias("dated"))
