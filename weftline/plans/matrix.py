"""Queries of the review matrix: columns, cells and labels, comparison keys, selections, change plans and the frontier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.functions.clean import int_id
from weftline.operators import relational as R
from weftline.plans.registry import registry
from weftline.plans.scalars import _DATED
from weftline.plans.store import PEOPLE, PERFORMERS, RESULTS, RIMAGES, RUNS, SCENES, SOURCES, TAGS, URLS, once
from weftline.session import table

QUERIES, ORACLES, query = registry()

_CANON = "nullif(trim(regexp_replace(regexp_replace(replace(lower(strip_accents({0})), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), '\\s+', ' ', 'g')), '')"
_CLEAN = "nullif(trim(regexp_replace({0}, '[\\s\\x{{00a0}}]+', ' ', 'g')), '')"
_COLUMNS = f"(select r.id as result_id, r.source_id, s.run_id, s.depth, r.ordinal, s.name, coalesce(s.attribution, '') <> 'CERTAIN' as rejected, 's' || r.source_id || '_' || r.ordinal as col, r.raw_json from {RESULTS} r join {SOURCES} s on s.id = r.source_id where s.run_id is not null)"


def _columns(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    """The columns of each run's matrix: one a result, with its source; those of a source that isn't certain are rejected."""
    r = once(spark, sf, "results", "source_id", "ordinal", *more).withColumnRenamed("id", "result_id")
    s = once(spark, sf, "sources", "run_id", "depth", "name", "attribution").where("run_id is not null").withColumnRenamed("id", "source_id")
    rejected = (F.coalesce("attribution", F.lit("")) != "CERTAIN").alias("rejected")
    col = F.concat(F.lit("s"), F.col("source_id").cast("string"), F.lit("_"), F.col("ordinal").cast("string")).alias("col")
    return r.join(s, "source_id").select("result_id", "source_id", "run_id", "depth", "ordinal", "name", rejected, col, *more)


# --- columns and rows --------------------------------------------------------------------------------------------------

@query("proj3_columns", f"select run_id, col, rejected, row_number() over (partition by run_id order by rejected, source_id, ordinal, result_id) as place from {_COLUMNS}")
def proj3_columns(spark: SparkSession, sf: str) -> DataFrame:
    """The columns of each run in their order, rejected ones last. Runs of any size: places are counted in slices of sources."""
    c = _columns(spark, sf)
    placed = R.rank_in_slices(c, ["run_id"], [F.col("rejected"), F.expr("source_id div 100000")], [F.col("source_id"), F.col("ordinal"), F.col("result_id")], "place")
    return placed.select("run_id", "col", "rejected", "place")


@query("proj4_rejected", f"select run_id, count(*) as listed, count(*) filter (not rejected) as contributing from {_COLUMNS} group by run_id")
def proj4_rejected(spark: SparkSession, sf: str) -> DataFrame:
    """Rejected columns stay listed but contribute to no row."""
    return _columns(spark, sf).groupBy("run_id").agg(F.count("*").alias("listed"), F.count_if(~F.col("rejected")).alias("contributing"))


@query("proj5_column_names", f"select result_id, name || case when ordinal > 0 then ' #' || (ordinal + 1) else '' end as label from {_COLUMNS} where name is not null")
def proj5_column_names(spark: SparkSession, sf: str) -> DataFrame:
    """A column is called by its source, and numbered from the second result on."""
    c = _columns(spark, sf).where("name is not null")
    return c.select("result_id", F.concat(F.col("name"), F.when(F.col("ordinal") > 0, F.concat(F.lit(" #"), (F.col("ordinal") + 1).cast("string"))).otherwise("")).alias("label"))


@query("proj6_rows", f"select run_id, field, count(*) as cells, count(distinct value) as options from (select run_id, rejected, json_extract_string(raw_json, '$.title') as title, json_extract_string(raw_json, '$.code') as code, json_extract_string(raw_json, '$.url') as url from {_COLUMNS}) unpivot (value for field in (title, code, url)) where not rejected and trim(value) <> '' group by run_id, field")
def proj6_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of each run's matrix: a field that no contributing column has a value for has none."""
    c = _columns(spark, sf, "raw_json").where("not rejected").select("run_id", F.from_json("raw_json", "title string, code string, url string").alias("p")).select("run_id", "p.*")
    cells = c.unpivot("run_id", ["title", "code", "url"], "field", "value").where("trim(value) <> ''")
    return cells.groupBy("run_id", "field").agg(F.count("*").alias("cells"), F.count_distinct("value").alias("options"))


@query("proj7_filled", f"select id, (select count(*) from (select unnest(json_keys(raw_json)) as k) where coalesce(json_extract_string(raw_json, '$.' || k), '') <> '')::int as filled, json_extract_string(raw_json, '$.url') is null as no_url from {RESULTS} where raw_json is not null")
def proj7_filled(spark: SparkSession, sf: str) -> DataFrame:
    """How many fields of each payload have a value, and whether the one for its address has none."""
    m = F.from_json("raw_json", "map<string,string>")
    r = once(spark, sf, "results", "raw_json").where("raw_json is not null").select("id", m.alias("m"))
    return r.select("id", F.size(F.map_filter("m", lambda _, v: F.coalesce(v, F.lit("")) != "")).alias("filled"), F.try_element_at("m", F.lit("url")).isNull().alias("no_url"))


@query("proj1_fields", f"select 'scene' as kind, id, field, value from (select id, title, code, date, studio_name as studio, duration::varchar as duration from {SCENES}) unpivot (value for field in (title, code, date, studio, duration)) where trim(value) <> '' union all select 'performer', id, field, value from (select id, name, height, weight, eye_color from {PEOPLE}) unpivot (value for field in (name, height, weight, eye_color)) where trim(value) <> ''")
def proj1_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Both kinds of records by the catalogue of their fields: one row a field that has a value."""
    s = once(spark, sf, "scraped_scenes", "title", "code", "date", "studio_name", "duration").withColumnRenamed("studio_name", "studio").withColumn("duration", F.col("duration").cast("string"))
    p = once(spark, sf, "scraped_performers", "name", "height", "weight", "eye_color")
    out = [df.unpivot("id", [c for c in df.columns if c != "id"], "field", "value").where("trim(value) <> ''").select(F.lit(kind).alias("kind"), "id", "field", "value") for kind, df in (("scene", s), ("performer", p))]
    return out[0].unionByName(out[1])


@query("proj2_unknown_fields", f"select id, key as field, upper(substr(replace(key, '_', ' '), 1, 1)) || substr(replace(key, '_', ' '), 2) as label, 900 + row_number() over (partition by id order by key) - 1 as place, json_extract_string(raw_json, '$.' || key) as value from (select id, raw_json, unnest(json_keys(raw_json)) as key from {RESULTS}) where key not in ('title', 'code')")
def proj2_unknown_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of a payload that the catalogue does not know: read-only rows behind all others."""
    r = once(spark, sf, "results", "raw_json").select("id", F.map_entries(F.from_json("raw_json", "map<string,string>")).alias("m"))
    extra = F.array_sort(F.filter("m", lambda e: ~e["key"].isin("title", "code")))
    x = r.select("id", F.posexplode(extra).alias("k", "e"))
    words = F.replace(F.col("e.key"), F.lit("_"), F.lit(" "))
    return x.select("id", F.col("e.key").alias("field"), F.concat(F.upper(F.substring(words, 1, 1)), F.expr("substr(replace(e.key, '_', ' '), 2)")).alias("label"), (F.lit(900) + F.col("k")).cast("bigint").alias("place"), F.col("e.value").alias("value"))


@query("j5_column_labels", f"select c.result_id, c.name || case when p.n is not null then ' — ' || p.n || case when p.d is not null then ' (' || p.d || ')' else '' end else '' end as label from {_COLUMNS} c left join (select result_id, arg_min(name, id) as n, arg_min(coalesce(disambiguation, ''), id) as d0, nullif(arg_min(coalesce(disambiguation, ''), id), '') as d from {PERFORMERS} where name is not null group by 1) p on p.result_id = c.result_id where c.name is not null")
def j5_column_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Columns labelled with the first performer their result found."""
    p = once(spark, sf, "performers", "result_id", "name", "disambiguation").where("name is not null and result_id is not null")
    p = p.groupBy("result_id").agg(F.min_by("name", "id").alias("n"), F.min_by(F.coalesce("disambiguation", F.lit("")), "id").alias("d"))
    found = F.when(F.col("n").isNotNull(), F.concat(F.lit(" — "), F.col("n"), F.when(F.col("d") != "", F.concat(F.lit(" ("), F.col("d"), F.lit(")"))).otherwise(""))).otherwise("")
    return _columns(spark, sf).where("name is not null").join(p, "result_id", "left").select("result_id", F.concat("name", found).alias("label"))


@query("j22_image_cells", f"select c.result_id, i.first_id from (select result_id from {_COLUMNS} where not rejected) c left join (select result_id, arg_min(id, ordinal * 1000000000000 + id) as first_id from {RIMAGES} where coalesce(image_url, image_sha256) is not null and result_id is not null and ordinal is not null group by 1) i on i.result_id = c.result_id")
def j22_image_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The first image of each contributing column, or none."""
    i = once(spark, sf, "result_images", "result_id", "ordinal", "image_url", "image_sha256").where("coalesce(image_url, image_sha256) is not null and result_id is not null and ordinal is not null")
    firsts = i.groupBy("result_id").agg(F.min_by("id", F.struct("ordinal", "id")).alias("first_id"))
    return _columns(spark, sf).where("not rejected").select("result_id").join(firsts, "result_id", "left")


@query("x8_image_refs", f"select id, coalesce('blob:' || nullif(lower(trim(image_sha256)), ''), nullif(trim(image_url), '')) as ref from {RIMAGES} where coalesce(nullif(lower(trim(image_sha256)), ''), nullif(trim(image_url), '')) is not null")
def x8_image_refs(spark: SparkSession, sf: str) -> DataFrame:
    """Images as they stand in a payload once they are stored apart: by content, else by address."""
    ref = F.coalesce(F.concat(F.lit("blob:"), F.nullif(F.lower(F.trim("image_sha256")), F.lit(""))), F.nullif(F.trim("image_url"), F.lit("")))
    return once(spark, sf, "result_images", "image_sha256", "image_url").select("id", ref.alias("ref")).where("ref is not null")


# --- keys, values, selections ------------------------------------------------------------------------------------------

def scalar_key(field: str, value: Column) -> Column:
    """The key under which two values of a field are the same: of a date its day, of a size its number, of a long text its start."""
    canon = text.canon_text(value)
    if field == "date":
        return F.coalesce(text.parse_date(value), canon)
    if field in ("height", "weight"):
        return F.coalesce(text.int_prefix(value).cast("string"), canon)
    return F.substring(canon, 1, 4000) if field == "details" else canon


_D = "nullif(trim(regexp_replace(regexp_extract(date, '^([^T]*)', 1), '\\s+', ' ', 'g')), '')"
_DAY = f"strftime({_DATED.replace(' d)', ' d)')}, '%Y-%m-%d')"


@query("f7_scalar_keys", f"select 'date' as field, id, coalesce({_DAY}, {_CANON.format('date')}) as key from (select id, date, {_D} as d from {SCENES} where date is not null) union all select 'height', id, coalesce(nullif(regexp_extract(height, '(-?\\d+)', 1), '')::bigint::varchar, {_CANON.format('height')}) from {PEOPLE} where height is not null union all select 'title', id, {_CANON.format('title')} from {SCENES} where title is not null")
def f7_scalar_keys(spark: SparkSession, sf: str) -> DataFrame:
    s, p = once(spark, sf, "scraped_scenes", "title", "date"), once(spark, sf, "scraped_performers", "height")
    out = None
    for df, field in ((s, "date"), (p, "height"), (s, "title")):
        one = df.where(F.col(field).isNotNull()).select(F.lit(field).alias("field"), "id", scalar_key(field, F.col(field)).alias("key"))
        out = one if out is None else out.unionByName(one)
    return out


@query("f8_display", f"select id, coalesce({_DAY}, {_CLEAN.format('date')}) as shown from (select id, date, {_D} as d from {SCENES} where date is not null)")
def f8_display(spark: SparkSession, sf: str) -> DataFrame:
    """Dates as they are shown: ISO where they can be read, else as they came."""
    s = once(spark, sf, "scraped_scenes", "date").where("date is not null")
    return s.select("id", F.coalesce(text.parse_date(F.col("date")), text.clean(F.col("date"))).alias("shown"))


@query("f19_update_values", f"select 'date' as field, id, coalesce({_DAY}, '') as value from (select id, date, {_D} as d from {SCENES} where date is not null) union all select 'duration', id, coalesce(try_cast(duration as integer)::varchar, '') from {SCENES} union all select 'title', id, coalesce({_CLEAN.format('title')}, '') from {SCENES}")
def f19_update_values(spark: SparkSession, sf: str) -> DataFrame:
    """What an update writes: dates as days, numbers as whole numbers, text without doubled blanks, nothing as empty."""
    s = once(spark, sf, "scraped_scenes", "title", "date", "duration")
    values = {"date": text.parse_date(F.col("date")), "duration": F.col("duration").cast("int").cast("string"), "title": text.clean(F.col("title"))}
    out = None
    for field, value in values.items():
        one = (s.where("date is not null") if field == "date" else s).select(F.lit(field).alias("field"), "id", F.coalesce(value, F.lit("")).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


@query("a14_entity_default", f"with e as (select source_id, {_CANON.format('name')} as k, bool_or(trim(coalesce(stored_id, '')) not in ('', '0', '-', 'n/a', 'None', 'null', 'unknown')) as known from {PERFORMERS} where source_id is not null and {_CANON.format('name')} is not null group by 1, 2) select source_id, count(*) as options, count(*) filter (known) as listed, case when count(*) filter (known) = 1 then min(k) filter (known) end as single from e group by source_id")
def a14_entity_default(spark: SparkSession, sf: str) -> DataFrame:
    """Defaults of an entity row: in a list all options that exist, where one may be chosen the only one that does."""
    p = once(spark, sf, "performers", "source_id", "name", "stored_id").where("source_id is not null").withColumn("k", text.canon_text(F.col("name"))).where("k is not null")
    known = F.bool_or(~F.trim(F.coalesce("stored_id", F.lit(""))).isin("", "0", "-", "n/a", "None", "null", "unknown"))
    e = p.groupBy("source_id", "k").agg(known.alias("known"))
    n = F.count_if("known")
    return e.groupBy("source_id").agg(F.count("*").alias("options"), n.alias("listed"), F.when(n == 1, F.min(F.when(F.col("known"), F.col("k")))).alias("single"))


@query("x10_snapshots", f"select id, '{{' || array_to_string(list_filter([case when trim(title) <> '' then '\"title\":' || to_json(title) end, case when trim(code) <> '' then '\"code\":' || to_json(code) end, case when trim(studio_name) <> '' then '\"studio\":' || to_json(studio_name) end, case when duration <> 0 then '\"duration\":' || duration end], lambda x: x is not null), ',') || '}}' as snapshot from {SCENES}")
def x10_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """A record as one flat object without what is empty."""
    s = once(spark, sf, "scraped_scenes", "title", "code", "studio_name", "duration")
    kept = lambda c: F.when(F.trim(c) != "", F.col(c))
    flat = F.struct(kept("title").alias("title"), kept("code").alias("code"), kept("studio_name").alias("studio"), F.when(F.col("duration") != 0, F.col("duration")).alias("duration"))
    return s.select("id", F.to_json(flat).alias("snapshot"))


@query("x12_selections", f"with o as (select distinct result_id, lower(trim(title)) as k from {SCENES} where trim(title) <> '' and result_id is not null), d as (select result_id, case when count(*) = 1 then min(k) end as fallback from o group by 1), w as (select result_id, arg_max(lower(trim(coalesce(title, code, ''))), id) as wanted from {SCENES} where result_id is not null group by 1) select w.result_id, w.wanted, coalesce(o.k, d.fallback) as chosen from w left join o on o.result_id = w.result_id and o.k = w.wanted left join d on d.result_id = w.result_id")
def x12_selections(spark: SparkSession, sf: str) -> DataFrame:
    """A selection held against the options there are: one that is no option gives way to the default."""
    s = once(spark, sf, "scraped_scenes", "result_id", "title", "code").where("result_id is not null")
    o = s.where("trim(title) <> ''").select("result_id", F.lower(F.trim("title")).alias("wanted")).distinct()
    d = o.groupBy("result_id").agg(F.when(F.count("*") == 1, F.min("wanted")).alias("fallback"))
    w = s.groupBy("result_id").agg(F.max_by(F.lower(F.trim(F.coalesce("title", "code", F.lit("")))), "id").alias("wanted"))
    return w.join(o.withColumn("k", F.col("wanted")), ["result_id", "wanted"], "left").join(d, "result_id", "left").select("result_id", "wanted", F.coalesce("k", "fallback").alias("chosen"))


_SIGN = "case when trim(coalesce(stored_id, '')) in ('', '0', '-', 'n/a', 'None', 'null', 'unknown') then 'name:' || lower(name) else 'id:' || regexp_replace(trim(lower(stored_id), ' ' || chr(9)), '^#?0*|\\.0+$', '', 'g') end"


@query("x13_carried", f"with s as (select id, {_SIGN} as g from {PERFORMERS} where name is not null) select s.id as old_id, n.new_id from s join (select g, max(id) as new_id from s group by g) n using (g) where s.id <> n.new_id")
def x13_carried(spark: SparkSession, sf: str) -> DataFrame:
    """Chosen records carried over a rebuild by what they stand for: each goes to the latest of its signature."""
    p = once(spark, sf, "performers", "stored_id", "name").where("name is not null")
    sid = int_id(F.col("stored_id"))
    s = p.select("id", F.when(sid.isNotNull(), F.concat(F.lit("id:"), sid)).otherwise(F.concat(F.lit("name:"), F.lower("name"))).alias("g"))
    return s.join(s.groupBy("g").agg(F.max("id").alias("new_id")), "g").where("id <> new_id").select(F.col("id").alias("old_id"), "new_id")


@query("x15_create_or_link", f"with p as (select id, {_CANON.format('name')} as canon, coalesce({_CANON.format('disambiguation')}, '') as dis from {PERFORMERS}), t as (select {_CANON.format('name')} as canon, count(*) as n, min(id) as tag from {TAGS} group by 1) select p.canon, p.dis, min(p.id) as first_id, count(*) as asked, any_value(t.tag) as linked, case when any_value(t.tag) is null then 'CREATE' else 'LINK' end as action from p left join t on t.canon = p.canon where p.canon is not null group by 1, 2")
def x15_create_or_link(spark: SparkSession, sf: str) -> DataFrame:
    """Names asked for, once each with what tells their bearers apart: linked where the name is known, else created once."""
    p = once(spark, sf, "performers", "name", "disambiguation").select("id", text.canon_text(F.col("name")).alias("canon"), F.coalesce(text.canon_text(F.col("disambiguation")), F.lit("")).alias("dis")).where("canon is not null")
    asked = p.groupBy("canon", "dis").agg(F.min("id").alias("first_id"), F.count("*").alias("asked"))
    t = once(spark, sf, "tags", "name").select(text.canon_text(F.col("name")).alias("canon"), "id").where("canon is not null").groupBy("canon").agg(F.min("id").alias("linked"))
    return asked.join(t, "canon", "left").select("canon", "dis", "first_id", "asked", "linked", F.when(F.col("linked").isNull(), "CREATE").otherwise("LINK").alias("action"))


_LIST = "list_filter(list_transform(string_split(coalesce(aliases, ''), ','), lambda x: trim(x, ' ')), lambda x: x <> '')"


@query("x16_marker", f"select id, array_to_string(case when list_contains(l, 'reviewed') then l else list_append(l, 'reviewed') end, '|') as tags from (select id, {_LIST} as l from {TAGS})")
def x16_marker(spark: SparkSession, sf: str) -> DataFrame:
    """A marker added to a set of tags that lacks it."""
    l = F.filter(F.transform(F.split(F.coalesce("aliases", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    t = once(spark, sf, "tags", "aliases").select("id", l.alias("l"))
    return t.select("id", F.array_join(F.when(F.array_contains("l", "reviewed"), F.col("l")).otherwise(F.array_append("l", "reviewed")), "|").alias("tags"))


@query("u5_opposite", f"select id, array_to_string(list_append(list_filter(l, lambda x: lower(x) not in ('slow', 'fast')), 'fast'), '|') as tags from (select id, list_distinct([]::varchar[]) as e, regexp_split_to_array(name, ' ') as l from {TAGS} where name is not null)")
def u5_opposite(spark: SparkSession, sf: str) -> DataFrame:
    """A tag put in the place of its opposite: what is unwanted goes, what is wanted comes last, once."""
    t = once(spark, sf, "tags", "name").where("name is not null")
    kept = F.filter(F.split("name", " "), lambda x: ~F.lower(x).isin("slow", "fast"))
    return t.select("id", F.array_join(F.array_append(kept, F.lit("fast")), "|").alias("tags"))


@query("proj12_scene_pages", f"select id, run_id, norm_key from {URLS} where role = 'scene' and origin = 'payload' and norm_key is not null")
def proj12_scene_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses that may be offered as values: those of the record itself, out of a payload."""
    return once(spark, sf, "urls", "run_id", "norm_key", "role", "origin").where("role = 'scene' and origin = 'payload' and norm_key is not null").select("id", "run_id", "norm_key")


@query("x9_canonical", f"select id, '{{' || array_to_string(list_transform(list_sort(json_keys(raw_json)), lambda k: to_json(k) || ':' || coalesce(to_json(json_extract_string(raw_json, '$.' || k)), 'null')), ',') || '}}' as canonical from {RESULTS} where raw_json is not null")
def x9_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads encoded with sorted keys and without blanks, so that equal ones are equal texts."""
    r = once(spark, sf, "results", "raw_json").where("raw_json is not null").select("id", F.array_sort(F.map_entries(F.from_json("raw_json", "map<string,string>"))).alias("m"))
    one = lambda x: F.expr("null") if x is None else F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "")
    parts = F.transform("m", lambda e: F.concat(one(e["key"]), F.lit(":"), F.when(e["value"].isNull(), "null").otherwise(one(e["value"]))))
    return r.select("id", F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")).alias("canonical"))


@query("x11_flattened", f"select kind, id, value from (select 'title' as kind, id, json_extract_string(raw_json, '$.title') as value from {RESULTS} union all select 'code', id, json_extract_string(raw_json, '$.code') from {RESULTS} union all select 'url', id, json_extract_string(raw_json, '$.url') from {RESULTS} union all select 'studio', result_id, studio_name from {SCENES} union all select 'performer', result_id, name from {PERFORMERS}) where trim(value) <> '' and id is not null")
def x11_flattened(spark: SparkSession, sf: str) -> DataFrame:
    """All entities a result mentions, of every kind, one row each."""
    r = once(spark, sf, "results", "raw_json").select("id", F.from_json("raw_json", "title string, code string, url string").alias("p")).select("id", "p.*").unpivot("id", ["title", "code", "url"], "kind", "value")
    parts = [r, *(once(spark, sf, t, "result_id", c).select(F.col("result_id").alias("id"), F.lit(kind).alias("kind"), F.col(c).alias("value")) for t, c, kind in (("scraped_scenes", "studio_name", "studio"), ("performers", "name", "performer")))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("trim(value) <> '' and id is not null").select("kind", "id", "value")


# --- lookups -----------------------------------------------------------------------------------------------------------

@query("s9_name_index", f"""with q as (select distinct trim(name) as question from {PEOPLE} where trim(name) <> ''), n as (select q.question, p.id, 'name' as via from q join {PERFORMERS} p on p.name = q.question),
a as (select distinct x.question, y.id, 'alias' as via from (select question from q where question not in (select question from n)) x join (select id, trim(unnest(string_split(aliases, ','))) as alias from {PERFORMERS} where aliases is not null) y on y.alias = x.question)
select question, id, via, k as place from (select *, row_number() over (partition by question order by id) as k from (select * from n union all select * from a)) where k <= 10""")
def s9_name_index(spark: SparkSession, sf: str) -> DataFrame:
    """Who answers to a name: by name, and only where nobody does by alias; ten at most for each question, which is the feature."""
    q = table(spark, sf, "scraped_performers").where("id is not null and trim(name) <> ''").select(F.trim("name").alias("question")).distinct()
    p = once(spark, sf, "performers", "name", "aliases")
    n = q.join(p.select(F.col("name").alias("question"), "id"), "question").withColumn("via", F.lit("name"))
    aliases = p.where("aliases is not null").select("id", F.explode(F.transform(F.split("aliases", ","), lambda x: F.trim(x))).alias("question")).distinct()
    a = q.join(n.select("question"), "question", "left_anti").join(aliases, "question").select("question", "id", F.lit("alias").alias("via"))
    return R.top_per(n.select("question", "id", "via").unionByName(a), ["question"], [F.col("id")], 10).select("question", "id", "via", F.col("rank").cast("bigint").alias("place"))


@query("j9_match_stages", f"""with q as (select id, {_CANON.format('name')} as canon from {PEOPLE}), n as (select {_CANON.format('name')} as canon, min(id) as one from {PERFORMERS} group by 1), a as (select canon, min(id) as one from (select id, {_CANON.format('al')} as canon from (select id, unnest(string_split(aliases, ',')) as al from {PERFORMERS} where aliases is not null)) where canon is not null group by 1)
select q.id, coalesce(n.one, a.one) as match_id, case when n.one is not null then 'name' when a.one is not null then 'alias' else 'create' end as stage from q left join n on n.canon = q.canon left join a on a.canon = q.canon""")
def j9_match_stages(spark: SparkSession, sf: str) -> DataFrame:
    """Records matched by name, else by alias, else to be created."""
    q = once(spark, sf, "scraped_performers", "name").select("id", text.canon_text(F.col("name")).alias("canon"))
    p = once(spark, sf, "performers", "name", "aliases")
    names = p.select(text.canon_text(F.col("name")).alias("canon"), "id")
    aliases = p.where("aliases is not null").select("id", F.explode(F.split("aliases", ",")).alias("al")).select(text.canon_text(F.col("al")).alias("canon"), "id")
    return R.priority_match(q, "canon", [(names, "name"), (aliases, "alias")]).select("id", "match_id", F.coalesce("stage", F.lit("create")).alias("stage"))


@query("s29_get_or_create", f"with w as (select lower(trim(studio_name)) as key, arg_min(trim(studio_name), id) as name, count(*) as uses from {SCENES} where trim(studio_name) <> '' group by 1), t as (select lower(name) as key, min(id) as id from {TAGS} where name is not null group by 1) select w.key, w.name, w.uses, t.id, t.id is null as created from w left join t using (key)")
def s29_get_or_create(spark: SparkSession, sf: str) -> DataFrame:
    """Members of a dimension found by name whatever the case; those that are missing are created once, as first spelled."""
    w = once(spark, sf, "scraped_scenes", "studio_name").where("trim(studio_name) <> ''").groupBy(F.lower(F.trim("studio_name")).alias("key")).agg(F.min_by(F.trim("studio_name"), "id").alias("name"), F.count("*").alias("uses"))
    t = once(spark, sf, "tags", "name").where("name is not null").groupBy(F.lower("name").alias("key")).agg(F.min("id").alias("id"))
    return w.join(t, "key", "left").select("key", "name", "uses", "id", F.col("id").isNull().alias("created"))


@query("s11_pruned_fields", f"select id, name, aliases from {TAGS}")
def s11_pruned_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Of the columns asked for, those the table has: the others are left out of the scan, not an error."""
    has = table(spark, sf, "tags").columns
    return once(spark, sf, "tags", *[c for c in ("name", "aliases", "ignore_auto_tag", "child_count") if c in has])


@query("s12_pages", f"select (k - 1) // 100 as page, count(*) as records, min(id) as first_id, count(*) < 100 as last from (select id, row_number() over (order by id) as k from {RUNS}) group by 1")
def s12_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A scan in pages of a hundred records in order of ids; a short page is the last. Places come from slices, not from one task."""
    r = R.rank_in_slices(once(spark, sf, "runs"), [], [F.expr("id div 100000")], [F.col("id")], "k")
    return r.groupBy(F.expr("(k - 1) div 100").alias("page")).agg(F.count("*").alias("records"), F.min("id").alias("first_id"), (F.count("*") < 100).alias("last"))


@query("s23_suggestions", f"select id, replace(name, '-', ' ') as label from {TAGS} where name is not null and not starts_with(description, 'Scenes with a ')")
def s23_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    """Suggestions without the rows a service puts in as a prompt; dashes of a question are blanks."""
    t = once(spark, sf, "tags", "name", "description").where(F.col("name").isNotNull() & ~F.col("description").startswith("Scenes with a "))
    return t.select("id", F.replace("name", F.lit("-"), F.lit(" ")).alias("label"))


@query("s25_query_criteria", f"select id, regexp_extract(p, '^([^=]*)', 1) as key, url_decode(replace(regexp_extract(p, '^[^=]*=?(.*)$', 1), '+', ' ')) as value from (select id, unnest(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&')) as p from {URLS} where url like '%?%') where p <> ''")
def s25_query_criteria(spark: SparkSession, sf: str) -> DataFrame:
    """The parameters of each address, decoded; what cannot be decoded stays as it is."""
    u = once(spark, sf, "urls", "url").where("url like '%?%'").select("id", F.explode(F.split(F.regexp_extract("url", r"\?([^#]*)", 1), "&")).alias("p")).where("p <> ''")
    raw = F.regexp_extract("p", "^[^=]*=?(.*)$", 1)
    return u.select("id", F.regexp_extract("p", "^([^=]*)", 1).alias("key"), F.coalesce(F.try_url_decode(raw), raw).alias("value"))


# --- frontier ----------------------------------------------------------------------------------------------------------

_PARENTS = f"(select u.id, u.run_id, u.norm_key, u.state, s.id as parent, s.type, s.depth as parent_depth from {URLS} u join {RESULTS} r on r.id = u.discovered_by_result_id join {SOURCES} s on s.id = r.source_id)"


def _parents(spark: SparkSession, sf: str) -> DataFrame:
    u = once(spark, sf, "urls", "run_id", "norm_key", "state", "discovered_by_result_id")
    r = once(spark, sf, "results", "source_id").withColumnRenamed("id", "discovered_by_result_id")
    s = once(spark, sf, "sources", "type", "depth").select(F.col("id").alias("source_id"), "type", F.col("depth").alias("parent_depth"))
    return u.join(r, "discovered_by_result_id").join(s, "source_id").withColumnRenamed("source_id", "parent")


@query("j21_frontier_parents", f"select id, parent, parent_depth from {_PARENTS} where state = 'PENDING'")
def j21_frontier_parents(spark: SparkSession, sf: str) -> DataFrame:
    """Open pages with the source whose result named them."""
    return _parents(spark, sf).where("state = 'PENDING'").select("id", "parent", "parent_depth")


@query("t3_emission", f"select run_id, norm_key, min(case when type = 'BOX' then 0 else coalesce(parent_depth, 0) + 1 end)::int as depth, count(*) as mentions, min(id) as first_id from {_PARENTS} where run_id is not null and norm_key is not null group by 1, 2")
def t3_emission(spark: SparkSession, sf: str) -> DataFrame:
    """What a wave adds to the frontier: each page of a run once, at the least depth any of its mentions gives it, all mentions counted."""
    p = _parents(spark, sf).where("run_id is not null and norm_key is not null")
    depth = F.when(F.col("type") == "BOX", 0).otherwise(F.coalesce("parent_depth", F.lit(0)) + 1)
    return p.groupBy("run_id", "norm_key").agg(F.min(depth).cast("int").alias("depth"), F.count("*").alias("mentions"), F.min("id").alias("first_id"))


@query("t2_fast_and_full", f"select r.id as run_id, r.mode, count(*) filter (r.mode = 'FULL' or u.depth = 0) as now, count(*) filter (r.mode <> 'FULL' and coalesce(u.depth, 1) > 0) as later from {URLS} u join {RUNS} r on r.id = u.run_id where r.mode is not null group by 1, 2")
def t2_fast_and_full(spark: SparkSession, sf: str) -> DataFrame:
    """Pages a run asks at once and those it leaves open: a fast run takes the first depth only."""
    r = once(spark, sf, "runs", "mode").where("mode is not null").withColumnRenamed("id", "run_id")
    u = once(spark, sf, "urls", "run_id", "depth").join(r, "run_id")
    full = F.col("mode") == "FULL"
    return u.groupBy("run_id", "mode").agg(F.count_if(full | (F.col("depth") == 0)).alias("now"), F.count_if(~full & (F.coalesce("depth", F.lit(1)) > 0)).alias("later"))


@query("t4_deadline", f"select run_id, id, case when coalesce(sum(d) over (partition by run_id order by id rows between unbounded preceding and 1 preceding), 0) <= 60000 then 'DONE' else 'SKIPPED_TIME' end as verdict from (select run_id, id, coalesce(duration_ms, 0) as d from {SOURCES} where run_id is not null)")
def t4_deadline(spark: SparkSession, sf: str) -> DataFrame:
    """Calls of a run that begin before its budget of time is used up; the others are skipped. Sums run over slices, so no run is gathered."""
    s = once(spark, sf, "sources", "run_id", "duration_ms").where("run_id is not null").select("run_id", "id", F.coalesce("duration_ms", F.lit(0)).alias("d"))
    t = R.rank_in_slices(s, ["run_id"], [F.expr("id div 100000")], [F.col("id")], total=F.col("d"), sum_as="upto")
    return t.select("run_id", "id", F.when(F.col("upto") - F.col("d") <= 60_000, "DONE").otherwise("SKIPPED_TIME").alias("verdict"))


@query("o9_source_cap", f"select run_id, least(count(*), 12) as planned, greatest(count(*) - 12, 0) as left_over from {SOURCES} where run_id is not null group by 1")
def o9_source_cap(spark: SparkSession, sf: str) -> DataFrame:
    """Calls a run plans under a cap of twelve, and how many that leaves over."""
    n = F.count("*")
    return once(spark, sf, "sources", "run_id").where("run_id is not null").groupBy("run_id").agg(F.least(n, F.lit(12)).alias("planned"), F.greatest(n - 12, F.lit(0)).alias("left_over"))


@query("o10_first_urls", f"select run_id, id, k as place from (select run_id, id, row_number() over (partition by run_id order by id) as k from {URLS} where run_id is not null and role = 'scene') where k <= 10")
def o10_first_urls(spark: SparkSession, sf: str) -> DataFrame:
    """The first ten addresses of each new record: a cap that is the feature."""
    u = once(spark, sf, "urls", "run_id", "role").where("run_id is not null and role = 'scene'").drop("role")
    return R.top_per(u, ["run_id"], [F.col("id")], 10).select("run_id", "id", F.col("rank").cast("bigint").alias("place"))


@query("t12_top_up", f"select r.id, coalesce(r.source_count, 0) + coalesce(n.fresh, 0) as total, coalesce(r.error_count, 0) + coalesce(n.failed, 0) as failed from {RUNS} r left join (select run_id, count(*) as fresh, count(*) filter (error is not null) as failed from {SOURCES} group by 1) n on n.run_id = r.id where r.mode = 'FULL'")
def t12_top_up(spark: SparkSession, sf: str) -> DataFrame:
    """Counters of a run that goes on: what is stored, and what came since."""
    n = once(spark, sf, "sources", "run_id", "error").groupBy(F.col("run_id").alias("id")).agg(F.count("*").alias("fresh"), F.count("error").alias("bad"))
    r = once(spark, sf, "runs", "mode", "source_count", "error_count").where("mode = 'FULL'")
    up = lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return r.join(n, "id", "left").select("id", up("source_count", "fresh").alias("total"), up("error_count", "bad").alias("failed"))


@query("o4_entity_order", f"select source_id, id, k as place from (select source_id, id, row_number() over (partition by source_id order by stored_id is null, lower(name) nulls last, id) as k from {PERFORMERS} where source_id is not null) where k <= 5")
def o4_entity_order(spark: SparkSession, sf: str) -> DataFrame:
    """The first five entities of a row as they are shown: those that exist, then by name."""
    p = once(spark, sf, "performers", "source_id", "stored_id", "name").where("source_id is not null")
    return R.top_per(p, ["source_id"], [F.col("stored_id").isNull(), F.asc_nulls_last(F.lower("name")), F.col("id")], 5).select("source_id", "id", F.col("rank").cast("bigint").alias("place"))


@query("o6_plan_head", f"select id, title, code from {SCENES} where title is not null order by title, code nulls last, id limit 50")
def o6_plan_head(spark: SparkSession, sf: str) -> DataFrame:
    """The head of a plan in its order: by title, then by file."""
    return once(spark, sf, "scraped_scenes", "title", "code").where("title is not null").orderBy("title", F.asc_nulls_last("code"), "id").limit(50)


@query("w6_keep_position", f"select run_id, k, min(id) as place, coalesce(arg_min(url, id) filter (mixed), arg_min(url, id)) as url from (select id, run_id, url, lower(url) as k, regexp_extract(url, '^(?:[A-Za-z]+://[^/?#]*)?([^?#]*)', 1) as path, regexp_extract(url, '^(?:[A-Za-z]+://[^/?#]*)?([^?#]*)', 1) <> lower(regexp_extract(url, '^(?:[A-Za-z]+://[^/?#]*)?([^?#]*)', 1)) and regexp_extract(url, '^(?:[A-Za-z]+://[^/?#]*)?([^?#]*)', 1) <> upper(regexp_extract(url, '^(?:[A-Za-z]+://[^/?#]*)?([^?#]*)', 1)) as mixed from {URLS} where url is not null and run_id is not null) group by run_id, k")
def w6_keep_position(spark: SparkSession, sf: str) -> DataFrame:
    """Doubled addresses of a run folded into one: it stands where the first stood, spelled as the first in mixed case."""
    from weftline.functions.urls import mixed_case

    u = once(spark, sf, "urls", "run_id", "url").where("url is not null and run_id is not null").withColumns({"k": F.lower("url"), "mixed": mixed_case(F.col("url"))})
    return u.groupBy("run_id", "k").agg(F.min("id").alias("place"), F.min_by("url", F.struct((~F.col("mixed")).alias("m"), "id")).alias("url"))


@query("w8_primary", f"select result_id, arg_min(id, coalesce(ordinal, 999999) * 1000000000000 + id) as id, count(*) as files from {RIMAGES} where result_id is not null group by 1")
def w8_primary(spark: SparkSession, sf: str) -> DataFrame:
    """The first of each record's files, and how many there are."""
    i = once(spark, sf, "result_images", "result_id", "ordinal").where("result_id is not null")
    return i.groupBy("result_id").agg(F.min_by("id", F.struct(F.coalesce("ordinal", F.lit(999_999)).alias("o"), "id")).alias("id"), F.count("*").alias("files"))
