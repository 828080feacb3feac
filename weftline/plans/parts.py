"""Queries of smaller parts: predicates, lookups, orders, request shapes, selections, progress and body sizes; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import body, urls
from weftline.functions.clean import endpoint_id, int_id, uuid_id
from weftline.operators import relational as R
from weftline.plans.registry import registry
from weftline.plans.scalars import _FIGURES, _PARSED, _SIZED, MEASURES
from weftline.plans.store import PERFORMERS, RESULTS, RIMAGES, RUNS, SCENES, SOURCES, TAGS, URLS, once
from weftline.session import fixed_values, table

QUERIES, ORACLES, query = registry()


# --- predicates and lookups --------------------------------------------------------------------------------------------

def assembled(df: DataFrame, **wanted: list | None) -> DataFrame:
    """df under a predicate put together from what is given: a list asks for one of its values, None asks for nothing."""
    for column, values in wanted.items():
        if values is not None:
            df = df.where(F.col(column).isin(values))
    return df


@query("proj10_assembled", f"select id, mode, status from {RUNS} where mode in ('FULL') and status in ('REVIEWABLE', 'FAILED')")
def proj10_assembled(spark: SparkSession, sf: str) -> DataFrame:
    """A list of runs by optional modes, states and kinds; the predicates reach the scan."""
    return assembled(once(spark, sf, "runs", "mode", "status"), mode=["FULL"], status=["REVIEWABLE", "FAILED"], id=None)


@query("proj15_known_hosts", f"select id, coalesce(regexp_replace(lower(host), '^www\\.', '') in (select host from sites), false) as known from {URLS}")
def proj15_known_hosts(spark: SparkSession, sf: str) -> DataFrame:
    """Whether an address is of a known site; the sites are a fixed table."""
    hosts = fixed_values(table(spark, sf, "sites"), "host")
    return once(spark, sf, "urls", "host").select("id", F.coalesce(F.regexp_replace(F.lower("host"), r"^www\.", "").isin(hosts), F.lit(False)).alias("known"))


@query("proj16_mixed_case", f"select id, p <> lower(p) and p <> upper(p) as mixed from (select id, regexp_extract(url, '^(?:[A-Za-z]+://[^/?#]*)?([^?#]*)', 1) as p from {URLS} where url is not null)")
def proj16_mixed_case(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, sf, "urls", "url").where("url is not null").select("id", urls.mixed_case(F.col("url")).alias("mixed"))


@query("proj23_unmarked", "select event_id, json_extract(props, '$.organized') is null as unmarked, json_extract(props, '$.k') is not null as keyed from events")
def proj23_unmarked(spark: SparkSession, sf: str) -> DataFrame:
    """Records without an entry in their map count as unmarked, those without a map as well."""
    m = F.from_json("props", "map<string,string>")
    there = lambda k: F.try_element_at(m, F.lit(k)).isNotNull()
    return table(spark, sf, "events").select("event_id", (~F.coalesce(there("organized"), F.lit(False))).alias("unmarked"), F.coalesce(there("k"), F.lit(False)).alias("keyed"))


@query("s18_regex_scan", f"select id, name from {TAGS} where regexp_matches(name, '^[A-Z][a-z]+ [a-z]{{4,}}$')")
def s18_regex_scan(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, sf, "tags", "name").where(F.col("name").rlike("^[A-Z][a-z]+ [a-z]{4,}$"))


@query("s27_job_status", f"select id, status, finished_at is null as running from {RUNS} where job_id = '1001'")
def s27_job_status(spark: SparkSession, sf: str) -> DataFrame:
    """One job, or no row."""
    return once(spark, sf, "runs", "status", "finished_at", "job_id").where("job_id = '1001'").select("id", "status", F.col("finished_at").isNull().alias("running"))


@query("s31_member_lookup", f"select id, lower(name) as name from {TAGS} where lower(name) in (select lower(studio_name) from scraped_scenes) or (id between 10 and 30 and name is not null)")
def s31_member_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Members of a dimension by name or by id."""
    t = once(spark, sf, "tags", "name").where("name is not null").select("id", F.lower("name").alias("name"))
    asked = table(spark, sf, "scraped_scenes").select(F.lower("studio_name").alias("name"))
    return t.join(asked, "name", "left_semi").unionByName(t.where("id between 10 and 30")).distinct().select("id", "name")


@query("s7_registry", f"select host, string_agg(distinct method, ',' order by method) as methods, string_agg(distinct type, ',' order by type) as types, count(distinct url_key) as pages, count(scraper_id) as named from {SOURCES} group by host")
def s7_registry(spark: SparkSession, sf: str) -> DataFrame:
    """What is known of each handler; calls without a host are one row."""
    s = once(spark, sf, "sources", "host", "method", "type", "url_key", "scraper_id")
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return s.groupBy("host").agg(listed("method").alias("methods"), listed("type").alias("types"), F.count_distinct("url_key").alias("pages"), F.count("scraper_id").alias("named"))


@query("j25_unused_images", "select count(*) as images, count(*) filter (sha256 not in (select lower(trim(image_sha256)) from result_images where image_sha256 is not null union select row_key from purge_log where table_name = 'images' and row_key is not null)) as unused from (select distinct sha256 from images where sha256 is not null)")
def j25_unused_images(spark: SparkSession, sf: str) -> DataFrame:
    """Images that neither of two tables refers to: one anti join against their union."""
    i = table(spark, sf, "images").where("sha256 is not null").select("sha256").distinct()
    refs = table(spark, sf, "result_images").select(F.lower(F.trim("image_sha256")).alias("sha256")).unionByName(table(spark, sf, "purge_log").where("table_name = 'images'").select(F.col("row_key").alias("sha256")))
    used = refs.where("sha256 is not null").distinct().withColumn("used", F.lit(True))
    return i.join(used, "sha256", "left").agg(F.count("*").alias("images"), F.count_if(F.col("used").isNull()).alias("unused"))


@query("j27_requests", f"select id, case method when 'URL' then 'url:' || coalesce(url_key, '') when 'NAME' then 'query:' || coalesce(name, '') when 'FRAGMENT' then 'scene:' || coalesce(scene_id, 0) else 'unknown' end as request from {SOURCES}")
def j27_requests(spark: SparkSession, sf: str) -> DataFrame:
    """A call's input in the one shape its method takes."""
    m, e = F.col("method"), F.lit("")
    shape = F.when(m == "URL", F.concat(F.lit("url:"), F.coalesce("url_key", e))).when(m == "NAME", F.concat(F.lit("query:"), F.coalesce("name", e))).when(m == "FRAGMENT", F.concat(F.lit("scene:"), F.coalesce("scene_id", F.lit(0)).cast("string"))).otherwise("unknown")
    return once(spark, sf, "sources", "method", "url_key", "name", "scene_id").select("id", shape.alias("request"))


# --- groups, orders, selections ----------------------------------------------------------------------------------------

_INT = "nullif(regexp_extract(lower(trim(stored_id, ' ' || chr(9))), '^#?0*([1-9][0-9]*)(?:\\.0+)?$', 1), '')"


@query("a13_by_stored_id", f"select sid, min(id) as first_id, count(*) as absorbed, count(distinct lower(name)) as names from (select id, name, {_INT} as sid from {PERFORMERS}) where sid is not null group by 1")
def a13_by_stored_id(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions that resolve to one stored record: the first, how many it absorbs, and under how many names."""
    p = once(spark, sf, "performers", "name", "stored_id").withColumn("sid", int_id(F.col("stored_id"))).where(F.col("sid").rlike("^[0-9]+$"))
    return p.groupBy("sid").agg(F.min("id").alias("first_id"), F.count("*").alias("absorbed"), F.count_distinct(F.lower("name")).alias("names"))


@query("a7_union", f"select source_id, count(distinct e || '|' || r) as pairs from (select p.source_id, regexp_replace(lower(regexp_replace(trim(s.endpoint), '^[A-Za-z]+://', '')), '/+(graphql)?/*$', '') as e, regexp_replace(regexp_replace(lower(trim(p.remote_site_id, ' ' || chr(9))), '^urn:uuid:|^uuid:', ''), '[{{}}\\-\\s]', '', 'g') as r from {PERFORMERS} p join {SOURCES} s on s.id = p.source_id where s.endpoint is not null) where regexp_matches(r, '^[0-9a-f]{{32}}$') and not regexp_matches(r, '^0+$') group by 1")
def a7_union(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs of box and foreign id that the mentions of a source hold, each once however it is written."""
    p = once(spark, sf, "performers", "source_id", "remote_site_id").withColumn("r", uuid_id(F.col("remote_site_id"))).where(F.col("r").rlike("^[0-9a-f]{32}$"))
    s = once(spark, sf, "sources", "endpoint").where("endpoint is not null").select(F.col("id").alias("source_id"), endpoint_id(F.col("endpoint")).alias("e"))
    return p.join(s, "source_id").groupBy("source_id").agg(F.count_distinct("e", "r").alias("pairs"))


@query("o3_graph_order", f"select run_id, id, row_number() over (partition by run_id order by coalesce(depth, -1), id) as place from {SOURCES} where run_id is not null")
def o3_graph_order(spark: SparkSession, sf: str) -> DataFrame:
    """The calls of a run by depth, then in order of discovery; counted in slices, so that no run is gathered."""
    s = once(spark, sf, "sources", "run_id", "depth").where("run_id is not null").withColumn("depth", F.coalesce("depth", F.lit(-1)))
    return R.rank_in_slices(s, ["run_id"], [F.col("depth"), F.expr("id div 100000")], [F.col("id")], "place").select("run_id", "id", "place")


@query("x17_flags", f"select id, array_to_string(list_transform(string_split(title, ' '), lambda w, i: w || ':' || (i = 2)::varchar), ' ') as flags from {SCENES} where title is not null")
def x17_flags(spark: SparkSession, sf: str) -> DataFrame:
    """A flag set on one item of a list, all others as they were."""
    s = once(spark, sf, "scraped_scenes", "title").where("title is not null")
    return s.select("id", F.array_join(F.transform(F.split("title", " "), lambda w, i: F.concat(w, F.lit(":"), (i == 1).cast("string"))), " ").alias("flags"))


@query("x18_exclusive", f"select host, code, max(id) as chosen, count(*) - 1 as rivals from {SCENES} where host is not null and code is not null group by 1, 2")
def x18_exclusive(spark: SparkSession, sf: str) -> DataFrame:
    """Of items with one key only one can be chosen: the last choice takes it from its rivals."""
    s = once(spark, sf, "scraped_scenes", "host", "code").where("host is not null and code is not null")
    return s.groupBy("host", "code").agg(F.max("id").alias("chosen"), (F.count("*") - 1).alias("rivals"))


@query("x23_progress", f"select r.id, coalesce(s.n, 0) as sources, coalesce(s.ok, 0) as ok, coalesce(s.bad, 0) as errors, coalesce(t.n, 0) as results, coalesce(u.n, 0) as pages, s.deepest as depth, date_diff('second', r.started_at, r.finished_at) as seconds from {RUNS} r left join (select run_id, count(*) as n, count(*) filter (status = 'OK') as ok, count(error) as bad, max(depth) as deepest from {SOURCES} group by 1) s on s.run_id = r.id left join (select run_id, count(*) as n from {RESULTS} group by 1) t on t.run_id = r.id left join (select run_id, count(*) as n from {URLS} group by 1) u on u.run_id = r.id")
def x23_progress(spark: SparkSession, sf: str) -> DataFrame:
    """How far each run came. Each child table is counted before it is joined."""
    s = once(spark, sf, "sources", "run_id", "status", "error", "depth").groupBy(F.col("run_id").alias("id")).agg(F.count("*").alias("sources"), F.count_if(F.col("status") == "OK").alias("ok"), F.count("error").alias("errors"), F.max("depth").alias("depth"))
    n = lambda t, name: once(spark, sf, t, "run_id").groupBy(F.col("run_id").alias("id")).agg(F.count("*").alias(name))
    r = once(spark, sf, "runs", "started_at", "finished_at").select("id", F.timestamp_diff("SECOND", "started_at", "finished_at").alias("seconds"))
    out = r.join(s, "id", "left").join(n("results", "results"), "id", "left").join(n("urls", "pages"), "id", "left")
    return out.select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("sources", "ok", "errors", "results", "pages")], "depth", "seconds")


@query("w7_first_match", "select sha256, case when bytes < 1000 then 'tiny' when bytes < 10000 then 'small' when bytes < 100000 then 'middling' else 'large' end as size from (select sha256, max(bytes) as bytes from images where sha256 is not null group by 1) where bytes is not null")
def w7_first_match(spark: SparkSession, sf: str) -> DataFrame:
    """The first step of a ladder that holds."""
    i = table(spark, sf, "images").where("sha256 is not null").groupBy("sha256").agg(F.max("bytes").alias("bytes")).where("bytes is not null")
    return i.select("sha256", body.ladder(F.col("bytes"), [(1000, "tiny"), (10_000, "small"), (100_000, "middling")], "large").alias("size"))


# --- updates -----------------------------------------------------------------------------------------------------------

#: Changes of a table's form, in order of their version: the column each adds, and its value for rows that were there.
STEPS = [(1, "retries", "0"), (2, "label", "lower(status)"), (3, "open", "finished_at is null")]


def migrate(df: DataFrame, version: int, steps: list[tuple[int, str, str]] = STEPS) -> DataFrame:
    """df in its newest form: steps beyond its version, forwards only, each once; a column that is there stays as it is."""
    for number, column, value in sorted(steps):
        if number > version and column not in df.columns:
            df = df.withColumn(column, F.expr(value))
    return df


@query("d11_migrated", f"select id, lower(status) as label, finished_at is null as open from {RUNS}")
def d11_migrated(spark: SparkSession, sf: str) -> DataFrame:
    return migrate(once(spark, sf, "runs", "status", "finished_at"), version=1).select("id", "label", "open")


@query("d12_url_counts", f"select run_id, count(*) as pages, count(distinct norm_key) as distinct_pages from {URLS} where run_id is not null group by 1")
def d12_url_counts(spark: SparkSession, sf: str) -> DataFrame:
    u = once(spark, sf, "urls", "run_id", "norm_key").where("run_id is not null")
    return u.groupBy("run_id").agg(F.count("*").alias("pages"), F.count_distinct("norm_key").alias("distinct_pages"))


@query("d9_result_columns", f"select 's' || source_id || '_' || ordinal as col, id, run_id from {RESULTS} where run_id = 5 and source_id is not null")
def d9_result_columns(spark: SparkSession, sf: str) -> DataFrame:
    """The columns of one run; the predicate reaches the scan."""
    r = once(spark, sf, "results", "run_id", "source_id", "ordinal").where("run_id = 5 and source_id is not null")
    return r.select(F.concat(F.lit("s"), F.col("source_id").cast("string"), F.lit("_"), F.col("ordinal").cast("string")).alias("col"), "id", "run_id")


@query("k13_moves", f"with f as (select id, host, lower(title) as name, studio_name from {SCENES} where title is not null and host is not null), g as (select host, name, count(*) as n, min(id) as keeper from f group by 1, 2) select f.id, case when g.n = 1 then 'KEEP' when f.id = g.keeper then 'PRIMARY' else 'DESTROY' end as state from f join g on g.host = f.host and g.name = f.name")
def k13_moves(spark: SparkSession, sf: str) -> DataFrame:
    """Of doubled files the first becomes the primary one, the others go."""
    f = once(spark, sf, "scraped_scenes", "host", "title").where("title is not null and host is not null").select("id", "host", F.lower("title").alias("name"))
    g = f.groupBy("host", "name").agg(F.count("*").alias("n"), F.min("id").alias("keeper"))
    return f.join(g, ["host", "name"]).select("id", F.when(F.col("n") == 1, "KEEP").when(F.col("id") == F.col("keeper"), "PRIMARY").otherwise("DESTROY").alias("state"))


@query("k12_survivors", f"select u.run_id, count(*) as pages from {URLS} u where not exists (select 1 from {RUNS} r where r.purged = 1 and r.id = u.run_id) and u.run_id is not null group by 1")
def k12_survivors(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of each run's pages once purged runs are gone."""
    from weftline.sources import sinks

    gone = once(spark, sf, "runs", "purged").where("purged = 1").select(F.col("id").alias("run_id"))
    return sinks.purge(once(spark, sf, "urls", "run_id").where("run_id is not null"), gone, "run_id").groupBy("run_id").agg(F.count("*").alias("pages"))


@query("k5_new_records", f"select lower(trim(studio_name)) as name, min(id) as first_id, least(count(distinct host), 10) as sites from {SCENES} where trim(studio_name) <> '' group by 1")
def k5_new_records(spark: SparkSession, sf: str) -> DataFrame:
    """New records of a batch, once a name, with ten sites each at most."""
    s = once(spark, sf, "scraped_scenes", "studio_name", "host").where("trim(studio_name) <> ''")
    return s.groupBy(F.lower(F.trim("studio_name")).alias("name")).agg(F.min("id").alias("first_id"), F.least(F.count_distinct("host"), F.lit(10)).alias("sites"))


@query("k9_changed_lists", f"select run_id, count(*) as pages, count(*) filter (regexp_replace(lower(url), '^https?://(www\\.)?', '') <> norm_key) as changed from {URLS} where run_id is not null and url is not null and norm_key is not null group by 1 having count(*) filter (regexp_replace(lower(url), '^https?://(www\\.)?', '') <> norm_key) > 0")
def k9_changed_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Lists of addresses that are written anew: only those in which one changes."""
    u = once(spark, sf, "urls", "run_id", "url", "norm_key").where("run_id is not null and url is not null and norm_key is not null")
    changed = F.count_if(F.regexp_replace(F.lower("url"), r"^https?://(www\.)?", "") != F.col("norm_key"))
    return u.groupBy("run_id").agg(F.count("*").alias("pages"), changed.alias("changed")).where("changed > 0")


# --- body sizes --------------------------------------------------------------------------------------------------------

def _sizes(spark: SparkSession, sf: str) -> DataFrame:
    m = once(spark, sf, "measurements", "raw").where("raw is not null").select("id", body.parse_measurements(F.col("raw")).alias("p"))
    return m.select("id", "p", body.derived_sizes(F.col("p")).alias("d"))


# Inches of hips at which a step begins.
HIP_STEPS = [28, 32, 40, 44, 48]


@query("f39_steps", f"select id, {' + '.join(f'(h >= {x})::int' for x in HIP_STEPS)} as hip_step, case when w / h <= 0.64 then 'full' when w / h < 0.8 then 'even' else 'slight' end as shape from {_SIZED}")
def f39_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Which step of a ladder hips reach, and the class of waist to hips."""
    s = _sizes(spark, sf).where("p.first is not null and p.waist is not null and p.hips is not null").select("id", "d.*")
    step = F.lit(0)
    for x in HIP_STEPS:
        step = step + (F.col("hips") >= x).cast("int")
    ratio = F.col("waist") / F.col("hips")
    return s.select("id", step.alias("hip_step"), F.when(ratio <= 0.64, "full").when(ratio < 0.8, "even").otherwise("slight").alias("shape"))


@query("f47_composed", f"select id, case when waist is not null and hips is not null then coalesce(first::varchar, '') || coalesce(cup, '') || '-' || waist || '-' || hips else coalesce(first::varchar, '') || coalesce(cup, '') end as composed from {_PARSED} where shape is not null")
def f47_composed(spark: SparkSession, sf: str) -> DataFrame:
    """A set of sizes in one notation, whole or as far as it goes."""
    p = _sizes(spark, sf).where("p.shape is not null").select("id", "p.*")
    head = F.concat(F.coalesce(F.col("first").cast("string"), F.lit("")), F.coalesce("cup", F.lit("")))
    return p.select("id", F.when(F.col("waist").isNotNull() & F.col("hips").isNotNull(), F.concat_ws("-", head, F.col("waist").cast("string"), F.col("hips").cast("string"))).otherwise(head).alias("composed"))


_ANY = " or ".join(f"({rule})" for rule in _FIGURES.values())


@query("f50_figure_status", f"select m.id, case when s.id is null then 'MISSING' when {_ANY} then 'FOUND' else 'NO_SHAPE' end as status from (select id from {MEASURES} where raw is not null) m left join {_SIZED} s on s.id = m.id")
def f50_figure_status(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a body has a figure, has none though all its sizes are there, or lacks sizes."""
    s = _sizes(spark, sf).select("id", (F.col("p.first").isNull() | F.col("p.waist").isNull() | F.col("p.hips").isNull()).alias("lacks"), "d.*")
    n = F.size(body.labels(body.figure_rules(F.col("bust"), F.col("waist"), F.col("hips"))))
    return s.select("id", F.when(F.coalesce("lacks", F.lit(True)), "MISSING").when(n > 0, "FOUND").otherwise("NO_SHAPE").alias("status"))


@query("x22_vocabulary", f"select word, length(word) as letters from (select unnest({list(_FIGURES)}) as word)")
def x22_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """The words that figures are labelled with, out of the table that defines them."""
    return spark.createDataFrame([(w, len(w)) for w in body.FIGURES], "word string, letters bigint")
