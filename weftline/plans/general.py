"""Queries of general forms (grouping sets, frames, interval joins, multisets, own functions), of moving files, of
keeping tags in step, of updates, and of further scalar functions; each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.functions.clean import endpoint_id, uuid_id
from weftline.operators import multivalue
from weftline.operators import relational as R
from weftline.plans.matrix import _CANON, _CLEAN
from weftline.plans.registry import registry
from weftline.plans.store import PEOPLE, PERFORMERS, RESULTS, RIMAGES, RUNS, SCENES, SOURCES, TAGS, URLS, once
from weftline.session import table
from weftline.sources import sinks

QUERIES, ORACLES, query = registry()


# --- general forms -----------------------------------------------------------------------------------------------------

@query("a28_cube", "select o_orderstatus, o_orderpriority, grouping_id(o_orderstatus, o_orderpriority) as level, count(*) as orders from orders group by cube (o_orderstatus, o_orderpriority)")
def a28_cube(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.grouping_id().alias("level"), F.count("*").alias("orders"))


@query("a28_grouping_sets", "select l_returnflag, l_linestatus, l_linenumber, count(*) as lines, round(sum(l_quantity), 2) as quantity from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_linenumber), ())")
def a28_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem")
    a, b, c = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber")
    return l.groupingSets([[a, b], [c], []], a, b, c).agg(F.count("*").alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("a28_percentiles", "select event_type, round(quantile_cont(value, 0.5), 4) as middle, round(quantile_cont(value, 0.95), 4) as high, round(stddev_samp(value), 4) as spread from events group by 1")
def a28_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Exact percentiles: counts of distinct values travel, not rows."""
    e = table(spark, sf, "events").groupBy("event_type")
    return e.agg(F.round(F.percentile("value", 0.5), 4).alias("middle"), F.round(F.percentile("value", 0.95), 4).alias("high"), F.round(F.stddev_samp("value"), 4).alias("spread"))


@query("a28_approximate", "select event_type, true as near_distinct, true as near_middle from events group by 1")
def a28_approximate(spark: SparkSession, sf: str) -> DataFrame:
    """Sketches beside the exact figures: distinct users within a tenth, the middle value within a twentieth of the range."""
    e = table(spark, sf, "events").groupBy("event_type")
    n, m = F.count_distinct("user_id"), F.percentile("value", 0.5)
    near_n = F.abs(F.approx_count_distinct("user_id", 0.02) - n) <= F.greatest(n * 0.1, F.lit(2))
    near_m = F.abs(F.percentile_approx("value", 0.5, 1_000) - m) <= (F.max("value") - F.min("value")) * 0.05
    return e.agg(near_n.alias("near_distinct"), near_m.alias("near_middle"))


@query("w9_frames", "select event_id, round(sum(value) over (partition by user_id order by ts, event_id rows between 2 preceding and current row), 2) as last_three, count(*) over (partition by user_id order by floor(epoch(ts))::bigint range between 3600 preceding and current row) as last_hour, lead(event_id) over (partition by user_id order by ts, event_id) as next, round(percent_rank() over (partition by user_id order by ts, event_id), 6) as share, round(cume_dist() over (partition by user_id order by ts, event_id), 6) as upto, first_value(event_id) over (partition by user_id order by ts, event_id) as first_id from (select * from events where true)")
def w9_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of rows and of time, looking ahead, and shares of an order."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    second = F.unix_timestamp(F.col("ts").cast("timestamp"))
    hour = Window.partitionBy("user_id").orderBy("s").rangeBetween(-3600, 0)
    return table(spark, sf, "events").withColumn("s", second).select(
        "event_id", F.round(F.sum("value").over(w.rowsBetween(-2, 0)), 2).alias("last_three"), F.count("*").over(hour).alias("last_hour"), F.lead("event_id").over(w).alias("next"),
        F.round(F.percent_rank().over(w), 6).alias("share"), F.round(F.cume_dist().over(w), 6).alias("upto"), F.first("event_id").over(w).alias("first_id"),
    )


@query("j28_interval", "select p.event_id as purchase, count(*) as clicks, min(c.event_id) as first_click from events p join events c on c.user_id = p.user_id and c.event_type = 'click' and c.ts between p.ts - interval 30 minute and p.ts where p.event_type = 'purchase' group by 1")
def j28_interval(spark: SparkSession, sf: str) -> DataFrame:
    """Clicks in the half hour before each purchase. Rows meet in the half hours an interval can touch, so a busy user is many keys."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 1800).alias("slot"))
    p = e.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase"), "user_id", F.col("ts").alias("at"), F.explode(F.array(F.col("slot") - 1, F.col("slot"))).alias("slot"))
    c = e.where("event_type = 'click'").select("event_id", "user_id", "ts", "slot")
    hits = p.join(c, ["user_id", "slot"]).where((F.col("ts") <= F.col("at")) & (F.col("ts") >= F.col("at") - F.expr("interval 30 minutes")))
    return hits.groupBy("purchase").agg(F.count("*").alias("clicks"), F.min("event_id").alias("first_click"))


@query("j28_full_outer", "select coalesce(a.user_id, b.user_id) as user_id, a.n as clicks, b.n as purchases from (select user_id, count(*) as n from events where event_type = 'click' group by 1) a full join (select user_id, count(*) as n from events where event_type = 'purchase' group by 1) b on a.user_id = b.user_id")
def j28_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    side = lambda kind, n: e.where(F.col("event_type") == kind).groupBy("user_id").agg(F.count("*").alias(n))
    return side("click", "clicks").join(side("purchase", "purchases"), "user_id", "full_outer")


@query("u9_intersect_all", f"select n, count(*) as times from (select lower(name) as n from {PERFORMERS} where name is not null intersect all select lower(name) from {PEOPLE} where name is not null) group by 1")
def u9_intersect_all(spark: SparkSession, sf: str) -> DataFrame:
    """Names as often as both tables have them."""
    names = lambda t: once(spark, sf, t, "name").where("name is not null").select(F.lower("name").alias("n"))
    return names("performers").intersectAll(names("scraped_performers")).groupBy("n").agg(F.count("*").alias("times"))


@query("u9_except_all", f"select n, count(*) as times from (select lower(name) as n from {PERFORMERS} where name is not null except all select lower(name) from {PEOPLE} where name is not null) group by 1")
def u9_except_all(spark: SparkSession, sf: str) -> DataFrame:
    """Names as often as one table has them more than the other."""
    names = lambda t: once(spark, sf, t, "name").where("name is not null").select(F.lower("name").alias("n"))
    return names("performers").exceptAll(names("scraped_performers")).groupBy("n").agg(F.count("*").alias("times"))


@query("t17_sliding", "select strftime(w, '%Y-%m-%d %H:%M') as since, count(*) as events from (select unnest([time_bucket(interval 30 minute, ts), time_bucket(interval 30 minute, ts) - interval 30 minute]) as w from events) group by 1")
def t17_sliding(spark: SparkSession, sf: str) -> DataFrame:
    """Events in windows of an hour that begin every half hour."""
    per = table(spark, sf, "events").groupBy(F.window("ts", "1 hour", "30 minutes")).agg(F.count("*").alias("events"))
    return per.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("since"), "events")


@query("t17_late", f"select id from {URLS} u where loaded_at > (select max(found_at) from urls) - interval 20 day and found_at < loaded_at - interval 1 day")
def t17_late(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions that arrived more than a day after what they describe, of the last twenty days: what a watermark of a day drops."""
    u = table(spark, sf, "urls")
    last = u.agg(F.max("found_at").alias("last")).first()["last"]
    first = u.where("id is not null").groupBy("id").agg(F.min(F.struct("loaded_at", "found_at")).alias("x")).select("id", "x.*")
    return first.where((F.col("loaded_at") > F.lit(last) - F.expr("interval 20 days")) & (F.col("found_at") < F.col("loaded_at") - F.expr("interval 1 day"))).select("id")


@query("q12_functions", "select event_type, round(sum(value) * 2 / count(*), 3) as doubled, count(*)::bigint as events, 3 as parts from events group by 1")
def q12_functions(spark: SparkSession, sf: str) -> DataFrame:
    """A user's own functions in SQL: one on batches of values, one on groups, one that returns rows."""
    from pyspark.sql.functions import PandasUDFType, pandas_udf, udtf

    twice = pandas_udf(lambda v: v * 2, "double", PandasUDFType.SCALAR)
    middle = pandas_udf(lambda v: float(v.mean()), "double", PandasUDFType.GROUPED_AGG)

    @udtf(returnType="part string")
    class Parts:
        def eval(self, s: str):  # noqa: ANN202
            for x in (s or "").split(","):
                yield (x,)

    spark.udf.register("own_twice", twice)
    spark.udf.register("own_mean", middle)
    spark.udtf.register("own_parts", Parts)
    table(spark, sf, "events").createOrReplaceTempView("own_events")
    return spark.sql("select m.event_type, round(m.doubled, 3) as doubled, c.events, (select cast(count(*) as int) from own_parts('a,b,c')) as parts from (select event_type, own_mean(d) as doubled from (select event_type, own_twice(value) as d from own_events) group by event_type) m join (select event_type, count(*) as events from own_events group by event_type) c on c.event_type = m.event_type")


# --- files -------------------------------------------------------------------------------------------------------------

@query("j17_sidecars", f"with f as (select id, host, lower(code) as stem, studio_name is not null as media from {SCENES} where code is not null and host is not null), m as (select host, stem, count(*) as media, min(id) as first_media from f where media group by 1, 2) select f.id, m.media, m.first_media from f join m on m.host = f.host and m.stem = f.stem where not f.media")
def j17_sidecars(spark: SparkSession, sf: str) -> DataFrame:
    """Files beside a media file of their directory and stem: the first such media file, and how many there are; no pairs of a group."""
    f = once(spark, sf, "scraped_scenes", "host", "code", "studio_name").where("code is not null and host is not null").select("id", "host", F.lower("code").alias("stem"), F.col("studio_name").isNotNull().alias("is_media"))
    m = f.where("is_media").groupBy("host", "stem").agg(F.count("*").alias("media"), F.min("id").alias("first_media"))
    return f.where("not is_media").join(m, ["host", "stem"]).select("id", "media", "first_media")


_PATH = "regexp_replace(regexp_replace(regexp_replace(url, '^https?://', '', 'i'), '[?#].*$', ''), '/+', '/', 'g')"


def _path(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "(?i)^https?://", ""), "[?#].*$", ""), "/+", "/")


@query("proj20_within_roots", f"select id, coalesce(p = 'clapperlog.test' or starts_with(p, 'clapperlog.test/') or p = 'castfolio.test/movies' or starts_with(p, 'castfolio.test/movies/'), false) as within from (select id, regexp_replace({_PATH}, '/$', '') as p from {URLS})")
def proj20_within_roots(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a path is one of the roots or lies below one; a root's name as the start of another name is no root."""
    p = F.regexp_replace(_path(F.col("url")), "/$", "")
    inside = F.lit(False)
    for root in ("clapperlog.test", "castfolio.test/movies"):
        inside = inside | (F.col("p") == root) | F.col("p").startswith(root + "/")
    return once(spark, sf, "urls", "url").select("id", p.alias("p")).select("id", F.coalesce(inside, F.lit(False)).alias("within"))


@query("f52_same_directory", f"select id, regexp_replace(p, '/[^/]*$', '') = regexp_replace(norm_key, '/[^/]*$', '') as same from (select id, lower({_PATH}) as p, lower(norm_key) as norm_key from {URLS} where url is not null and norm_key is not null)")
def f52_same_directory(spark: SparkSession, sf: str) -> DataFrame:
    u = once(spark, sf, "urls", "url", "norm_key").where("url is not null and norm_key is not null")
    parent = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    return u.select("id", (parent(F.lower(_path(F.col("url")))) == parent(F.lower("norm_key"))).alias("same"))


_FILES = f"(select id, host || '/' || coalesce(studio_name, '') as dir, lower(title) as name, host || '/sorted' as to_dir from {SCENES} where title is not null and host is not null)"


def _files(spark: SparkSession, sf: str) -> DataFrame:
    s = once(spark, sf, "scraped_scenes", "host", "studio_name", "title").where("title is not null and host is not null")
    return s.select("id", F.concat("host", F.lit("/"), F.coalesce("studio_name", F.lit(""))).alias("dir"), F.lower("title").alias("name"), F.concat("host", F.lit("/sorted")).alias("to_dir"))


@query("j23_owner_files", f"with f as {_FILES}, o as (select to_dir, name, min(id) as owner from f group by 1, 2) select f.id, o.owner, f.id = o.owner as own from f join o on o.to_dir = f.to_dir and o.name = f.name")
def j23_owner_files(spark: SparkSession, sf: str) -> DataFrame:
    """The record whose file has a target path already; being the owner oneself is no conflict."""
    f = _files(spark, sf)
    return f.join(f.groupBy("to_dir", "name").agg(F.min("id").alias("owner")), ["to_dir", "name"]).select("id", "owner", (F.col("id") == F.col("owner")).alias("own"))


@query("k18_sidecar_moves", f"with f as {_FILES}, t as (select to_dir, name, min(id) as taken from f group by 1, 2) select f.id, case when f.dir = f.to_dir then 'ALREADY_THERE' when t.taken < f.id then 'SKIPPED' else 'MOVED' end as state from f join t on t.to_dir = f.to_dir and t.name = f.name")
def k18_sidecar_moves(spark: SparkSession, sf: str) -> DataFrame:
    """What becomes of each file that is to move: a target that an earlier one takes is not written over."""
    f = _files(spark, sf)
    t = f.groupBy("to_dir", "name").agg(F.min("id").alias("taken"))
    state = F.when(F.col("dir") == F.col("to_dir"), "ALREADY_THERE").when(F.col("taken") < F.col("id"), "SKIPPED").otherwise("MOVED")
    return f.join(t, ["to_dir", "name"]).select("id", state.alias("state"))


@query("s21_files_of", f"select s.id, s.title, s.code, r.source_id from {SCENES} s join {RESULTS} r on r.id = s.result_id where s.id in (select id from {SCENES} where host = 'clapperlog.test')")
def s21_files_of(spark: SparkSession, sf: str) -> DataFrame:
    """All files of a list of records in one scan."""
    s = once(spark, sf, "scraped_scenes", "title", "code", "host", "result_id").where("host = 'clapperlog.test'")
    return s.join(once(spark, sf, "results", "source_id").withColumnRenamed("id", "result_id"), "result_id").select("id", "title", "code", "source_id")


@query("a25_sums", f"select host, count(*) as files, count(distinct lower(title)) as targets, count(*) - count(distinct lower(title)) as conflicts from {SCENES} where title is not null and host is not null group by grouping sets ((host), ())")
def a25_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Files and conflicts for each directory, and over all under null."""
    s = once(spark, sf, "scraped_scenes", "host", "title").where("title is not null and host is not null")
    t = F.count_distinct(F.lower("title"))
    return s.rollup("host").agg(F.count("*").alias("files"), t.alias("targets"), (F.count("*") - t).alias("conflicts"))


# --- tags in step ------------------------------------------------------------------------------------------------------

_TL = "list_filter(list_transform(string_split(coalesce(aliases, ''), ','), lambda x: trim(x, ' ')), lambda x: x <> '')"


def _alias_list() -> Column:
    return F.filter(F.transform(F.split(F.coalesce("aliases", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


@query("k6_add_and_remove", f"select id, array_to_string(list_filter(l, lambda x: x <> coalesce(category, '')), '|') as removed, array_to_string(case when category is null or list_contains(l, category) then l else list_append(l, category) end, '|') as added from (select id, category, {_TL} as l from {TAGS})")
def k6_add_and_remove(spark: SparkSession, sf: str) -> DataFrame:
    """One element added to, and removed from, a list column."""
    t = once(spark, sf, "tags", "aliases", "category").select("id", "category", _alias_list().alias("l"))
    c = F.col("category")
    return t.select("id", F.array_join(F.filter("l", lambda x: x != F.coalesce(c, F.lit(""))), "|").alias("removed"), F.array_join(F.when(c.isNull() | F.array_contains("l", c), F.col("l")).otherwise(F.array_append("l", c)), "|").alias("added"))


@query("k7_batch_insert", f"select lower(trim(title)) as name, min(id) as id, count(*) as asked from {SCENES} s where trim(title) <> '' and lower(trim(title)) not in (select lower(name) from tags where name is not null) group by 1")
def k7_batch_insert(spark: SparkSession, sf: str) -> DataFrame:
    """New names of a batch, once each, without blank ones and those that are there."""
    s = once(spark, sf, "scraped_scenes", "title").where("trim(title) <> ''").select(F.lower(F.trim("title")).alias("name"), "id")
    there = table(spark, sf, "tags").where("name is not null").select(F.lower("name").alias("name"))
    return s.join(there, "name", "left_anti").groupBy("name").agg(F.min("id").alias("id"), F.count("*").alias("asked"))


@query("k8_foreign_ids", f"select s.id, s.remote is not null and s.endpoint is not null as appended from (select p.id, nullif(regexp_replace(regexp_replace(lower(trim(p.remote_site_id, ' ' || chr(9))), '^urn:uuid:|^uuid:', ''), '[{{}}\\-\\s]', '', 'g'), '') as r0, case when regexp_matches(regexp_replace(regexp_replace(lower(trim(p.remote_site_id, ' ' || chr(9))), '^urn:uuid:|^uuid:', ''), '[{{}}\\-\\s]', '', 'g'), '^[0-9a-f]{{32}}$') and not regexp_matches(regexp_replace(p.remote_site_id, '[^0-9a-fA-F]', '', 'g'), '^0+$') then 1 end as remote, q.endpoint from {PERFORMERS} p left join {SOURCES} q on q.id = p.source_id where regexp_matches(lower(p.remote_site_id), '[0-9a-f]{{8}}')) s")
def k8_foreign_ids(spark: SparkSession, sf: str) -> DataFrame:
    """A missing foreign id appended to a record's list of (box, id), once however often it is handed in."""
    p = once(spark, sf, "performers", "source_id", "remote_site_id").where(F.lower("remote_site_id").rlike("[0-9a-f]{8}"))
    s = once(spark, sf, "sources", "endpoint").select(F.col("id").alias("source_id"), "endpoint")
    remote = F.when(F.col("endpoint").isNotNull(), uuid_id(F.col("remote_site_id")))
    one = sinks.add_foreign_id(F.lit(None).cast("array<struct<endpoint:string,foreign_id:string>>"), "box", remote)
    return p.join(s, "source_id", "left").select("id", one.alias("once")).select("id", F.coalesce(F.size(sinks.add_foreign_id(F.col("once"), "box", F.get("once", F.lit(0))["foreign_id"])) == 1, F.lit(False)).alias("appended"))


@query("a21_transfer", f"with w as (select lower(trim(studio_name)) as key, count(*) as n from {SCENES} group by 1), t as (select distinct lower(name) as key from tags where name is not null) select count(*) filter (w.key <> '' and t.key is null) as created, count(*) filter (w.key <> '' and t.key is not null) as updated, count(*) filter (w.key is null or w.key = '') as skipped, count(*) as total from w left join t on t.key = w.key")
def a21_transfer(spark: SparkSession, sf: str) -> DataFrame:
    """How a batch of names went: created, updated, skipped."""
    w = once(spark, sf, "scraped_scenes", "studio_name").groupBy(F.lower(F.trim("studio_name")).alias("key")).agg(F.count("*").alias("n"))
    t = table(spark, sf, "tags").where("name is not null").select(F.lower("name").alias("key")).distinct().withColumn("there", F.lit(True))
    x = w.join(t, "key", "left")
    named = F.coalesce(F.col("key") != "", F.lit(False))
    return x.agg(F.count_if(named & F.col("there").isNull()).alias("created"), F.count_if(named & F.col("there").isNotNull()).alias("updated"), F.count_if(~named).alias("skipped"), F.count("*").alias("total"))


@query("f42_out_of_step", f"with g as (select lower(name) as key, min(id) as first_id from {TAGS} where name is not null group by 1) select a.id, coalesce(a.description, '') is distinct from coalesce(b.description, '') as text_differs, list_sort(a.l) is distinct from list_sort(b.l) as aliases_differ from (select id, name, description, {_TL} as l from {TAGS}) a join g on g.key = lower(a.name) join (select id, description, {_TL} as l from {TAGS}) b on b.id = g.first_id where a.id <> b.id")
def f42_out_of_step(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a record differs, in text or in its set of aliases, from the first of its name."""
    t = once(spark, sf, "tags", "name", "description", "aliases").where("name is not null").select("id", F.lower("name").alias("key"), F.coalesce("description", F.lit("")).alias("text"), F.array_sort(_alias_list()).alias("l"))
    b = R.first_per(t, ["key"], [F.col("id")]).select("key", F.col("id").alias("first_id"), F.col("text").alias("b_text"), F.col("l").alias("b_l"))
    return t.join(b, "key").where("id <> first_id").select("id", (F.col("text") != F.col("b_text")).alias("text_differs"), (F.col("l") != F.col("b_l")).alias("aliases_differ"))


@query("t8_diff_only", f"with o as (select id, {_TL} as old, list_distinct(list_transform({_TL}, lambda x: lower(x))) as new from {TAGS}) select id, array_to_string(list_sort(list_filter(new, lambda x: not list_contains(old, x))), '|') as added, array_to_string(list_sort(list_distinct(list_filter(old, lambda x: not list_contains(new, x)))), '|') as removed from o where len(list_filter(new, lambda x: not list_contains(old, x))) + len(list_filter(old, lambda x: not list_contains(new, x))) > 0")
def t8_diff_only(spark: SparkSession, sf: str) -> DataFrame:
    """What a change hook writes: what is to be added and removed, and nothing where that is nothing, so that it does not wake itself."""
    t = once(spark, sf, "tags", "aliases").select("id", _alias_list().alias("old")).withColumn("new", F.array_distinct(F.transform("old", lambda x: F.lower(x))))
    d = t.select("id", F.array_sort(F.array_except("new", "old")).alias("a"), F.array_sort(F.array_except("old", "new")).alias("r"))
    return d.where((F.size("a") > 0) | (F.size("r") > 0)).select("id", F.array_join("a", "|").alias("added"), F.array_join("r", "|").alias("removed"))


@query("proj18_marked", "select event_id, coalesce(json_extract_string(props, '$.k') = '7', false) as processed from events")
def proj18_marked(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a record's map holds the marker of the present version, compared as text."""
    m = F.from_json("props", "map<string,string>")
    return table(spark, sf, "events").select("event_id", F.coalesce(F.try_element_at(m, F.lit("k")) == "7", F.lit(False)).alias("processed"))


@query("proj19_relevant", f"select id, len(list_intersect(json_keys(raw_json), ['url', 'performers'])) > 0 as relevant from {RESULTS} where raw_json is not null")
def proj19_relevant(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a change touches any of the fields that matter."""
    r = once(spark, sf, "results", "raw_json").where("raw_json is not null")
    return r.select("id", F.arrays_overlap(F.json_object_keys("raw_json"), F.array(F.lit("url"), F.lit("performers"))).alias("relevant"))


# --- updates -----------------------------------------------------------------------------------------------------------

@query("d1_upsert", f"select coalesce(n.host, o.host) as host, coalesce(n.methods, o.kind) as value, n.host is not null as touched from sites o full join (select host, max(method) as methods from {SOURCES} where host is not null and status = 'OK' group by 1) n on n.host = o.host")
def d1_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Rows put in or, where their key is there, put over the old ones."""
    o = table(spark, sf, "sites").select("host", "kind")
    n = once(spark, sf, "sources", "host", "method", "status").where("host is not null and status = 'OK'").groupBy("host").agg(F.max("method").alias("methods"))
    return o.join(n, "host", "full_outer").select("host", F.coalesce("methods", "kind").alias("value"), F.col("methods").isNotNull().alias("touched"))


@query("d5_guarded_insert", f"select run_id, key, min(id) as id, count(*) as attempts from (select id, run_id, method || '|' || coalesce(scraper_id, endpoint, '') || '|' || coalesce(url_key, '') as key from {SOURCES} where run_id is not null) group by 1, 2")
def d5_guarded_insert(spark: SparkSession, sf: str) -> DataFrame:
    """Calls of a run, each once by its method, handler and page: a second attempt is ignored."""
    key = F.concat_ws("|", "method", F.coalesce("scraper_id", "endpoint", F.lit("")), F.coalesce("url_key", F.lit("")))
    s = once(spark, sf, "sources", "run_id", "method", "scraper_id", "endpoint", "url_key").where("run_id is not null and method is not null").select("id", "run_id", key.alias("key"))
    return s.groupBy("run_id", "key").agg(F.min("id").alias("id"), F.count("*").alias("attempts"))


@query("d6_image_rows", f"select result_id, count(*) as kept from {RIMAGES} where result_id is not null and (trim(image_url) <> '' or trim(image_sha256) <> '') group by 1")
def d6_image_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Images of a result that are put in: blank ones are not."""
    i = once(spark, sf, "result_images", "result_id", "image_url", "image_sha256").where("result_id is not null")
    return i.where("trim(image_url) <> '' or trim(image_sha256) <> ''").groupBy("result_id").agg(F.count("*").alias("kept"))


@query("d8_pending", f"select id, run_id, depth from {URLS} where state = 'PENDING' and role = 'scene' and depth = 1 order by id")
def d8_pending(spark: SparkSession, sf: str) -> DataFrame:
    """The open pages of one depth; the predicates reach the scan."""
    return once(spark, sf, "urls", "run_id", "depth", "state", "role").where("state = 'PENDING' and role = 'scene' and depth = 1").select("id", "run_id", "depth")


@query("d10_audit", f"select run_id, count(*) as entries, count(distinct norm_key) as pages, min(id) as first_id from {URLS} where state = 'DONE' and run_id is not null group by 1")
def d10_audit(spark: SparkSession, sf: str) -> DataFrame:
    """The record of what was applied: ids and counts, never values."""
    u = once(spark, sf, "urls", "run_id", "norm_key", "state").where("state = 'DONE' and run_id is not null")
    return u.groupBy("run_id").agg(F.count("*").alias("entries"), F.count_distinct("norm_key").alias("pages"), F.min("id").alias("first_id"))


@query("t11_replaced", f"select id from (select id, status, max(id) over (partition by scene_id) as last from {RUNS} where scene_id is not null) where id = last or status not in ('REVIEWABLE', 'NO_RESULTS', 'RUNNING', 'FAILED')")
def t11_replaced(spark: SparkSession, sf: str) -> DataFrame:
    """Runs that remain once the latest of each record replaces what was open before it."""
    r = once(spark, sf, "runs", "scene_id", "status").where("scene_id is not null")
    last = r.groupBy("scene_id").agg(F.max("id").alias("last"))
    return r.join(last, "scene_id").where((F.col("id") == F.col("last")) | ~F.col("status").isin("REVIEWABLE", "NO_RESULTS", "RUNNING", "FAILED")).select("id")


@query("t13_compaction", f"with dead as (select id from {RUNS} where purged = 1 or status = 'FAILED') select 'runs' as name, count(*) as removed from dead union all select 'sources', count(*) from {SOURCES} where run_id in (select id from dead) union all select 'results', count(*) from {RESULTS} where run_id in (select id from dead)")
def t13_compaction(spark: SparkSession, sf: str) -> DataFrame:
    """What a clean-up removes: dead runs with all that hangs on them."""
    dead = once(spark, sf, "runs", "purged", "status").where("purged = 1 or status = 'FAILED'").select(F.col("id").alias("run_id"))
    out = dead.agg(F.lit("runs").alias("name"), F.count("*").alias("removed"))
    for t in ("sources", "results"):
        out = out.unionByName(once(spark, sf, t, "run_id").join(dead, "run_id", "left_semi").agg(F.lit(t).alias("name"), F.count("*").alias("removed")))
    return out


@query("a19_tallies", f"select type, status, count(*) as calls, cast(sum(result_count) as bigint) as results, cast(sum(duration_ms) // 1000 as bigint) as seconds from {SOURCES} group by 1, 2")
def a19_tallies(spark: SparkSession, sf: str) -> DataFrame:
    s = once(spark, sf, "sources", "type", "status", "result_count", "duration_ms")
    return s.groupBy("type", "status").agg(F.count("*").alias("calls"), F.sum("result_count").alias("results"), F.expr("sum(duration_ms) div 1000").alias("seconds"))


@query("a26_diagnostics", f"select (select count(*) from {RUNS}) as runs, (select count(*) from {SOURCES}) as sources, (select count(*) from {URLS}) as urls, (select count(distinct status) from {RUNS}) as statuses, (select count(*) from sites) as sites")
def a26_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """The state of the store in one record."""
    one = lambda t, *aggs: table(spark, sf, t).agg(*aggs).withColumn("k", F.lit(1))
    n = one("runs", F.count_distinct("id").alias("runs"), F.count_distinct("status").alias("statuses")).join(one("sources", F.count_distinct("id").alias("sources")), "k")
    return n.join(one("urls", F.count_distinct("id").alias("urls")), "k").join(one("sites", F.count("*").alias("sites")), "k").drop("k")


@query("a27_briefs", f"select r.id, r.mode, r.status, s.n as sources, s.ok from {RUNS} r join (select run_id, count(*) as n, count(*) filter (status = 'OK') as ok from {SOURCES} group by 1) s on s.run_id = r.id")
def a27_briefs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs in brief: few columns, and figures of their sources."""
    s = once(spark, sf, "sources", "run_id", "status").groupBy(F.col("run_id").alias("id")).agg(F.count("*").alias("sources"), F.count_if(F.col("status") == "OK").alias("ok"))
    return once(spark, sf, "runs", "mode", "status").join(s, "id").select("id", "mode", "status", "sources", "ok")


@query("o11_report", f"""with o as (select norm_key as key, max(state) as content from {URLS} where depth = 0 and norm_key is not null group by 1), n as (select norm_key as key, max(state) as content from {URLS} where depth > 0 and norm_key is not null group by 1)
select change, count(*) as pages, case change when 'new' then 0 when 'content' then 2 when 'removed' then 3 else 4 end as place from (select case when o.key is null then 'new' when n.key is null then 'removed' when o.content is not distinct from n.content then 'unchanged' else 'content' end as change from o full join n using (key)) group by 1""")
def o11_report(spark: SparkSession, sf: str) -> DataFrame:
    """Changes between two snapshots in the order of a report."""
    u = once(spark, sf, "urls", "norm_key", "state", "depth").where("norm_key is not null")
    side = lambda cond: u.where(cond).groupBy(F.col("norm_key").alias("key")).agg(F.max("state").alias("content"))
    d = R.snapshot_diff(side("depth = 0"), side("depth > 0"), "key", "content").groupBy("change").agg(F.count("*").alias("pages"))
    order = F.when(F.col("change") == "new", 0).when(F.col("change") == "content", 2).when(F.col("change") == "removed", 3).otherwise(4)
    return d.select("change", "pages", order.alias("place"))


# --- scalar functions --------------------------------------------------------------------------------------------------

@query("f2_plain_letters", f"select id, strip_accents(name) as plain from {PERFORMERS} where name is not null")
def f2_plain_letters(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, sf, "performers", "name").where("name is not null").select("id", text.strip_accents(F.col("name")).alias("plain"))


@query("f4_canon_names", f"select id, {_CANON.format('name')} as canon, {_CANON.format('disambiguation')} as dis from {PERFORMERS}")
def f4_canon_names(spark: SparkSession, sf: str) -> DataFrame:
    p = once(spark, sf, "performers", "name", "disambiguation")
    return p.select("id", text.canon_text(F.col("name")).alias("canon"), text.canon_text(F.col("disambiguation")).alias("dis"))


@query("f15_source_keys", f"select id, method || '|' || coalesce(case when endpoint is not null then regexp_replace(lower(regexp_replace(trim(endpoint), '^[A-Za-z]+://', '')), '/+(graphql)?/*$', '') end, '') || '|' || coalesce(scraper_id, '') || '|' || coalesce(url_key, '') as key from {SOURCES} where method is not null")
def f15_source_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The key under which two calls are the same."""
    s = once(spark, sf, "sources", "method", "endpoint", "scraper_id", "url_key").where("method is not null")
    return s.select("id", F.concat_ws("|", "method", F.coalesce(endpoint_id(F.col("endpoint")), F.lit("")), F.coalesce("scraper_id", F.lit("")), F.coalesce("url_key", F.lit(""))).alias("key"))


@query("f18_aliases_all", f"select row_id, count(*) as names, max(pos)::int as last from (select id as row_id, unnest(range(1, len(l) + 1)) as pos from (select id, list_filter(list_transform(string_split(aliases, '|'), lambda x: trim(x, ' ')), lambda x: x <> '') as l from {TAGS} where regexp_full_match(aliases, '[a-z ]+( \\| [a-z ]+)+'))) group by 1")
def f18_aliases_all(spark: SparkSession, sf: str) -> DataFrame:
    """Names in lists with bars, split by the operator for lists of any kind."""
    t = table(spark, sf, "tags").where(F.col("aliases").rlike(r"^[a-z ]+( \| [a-z ]+)+$"))
    return multivalue.split_packed(t, "id", "aliases").groupBy("row_id").agg(F.count("*").alias("names"), F.max("pos").cast("int").alias("last"))


@query("f20_numbers", f"select id, case when n = floor(n) then n::bigint::varchar else n::varchar end as number, case when weight is not null and n is null then 'no number' end as problem from (select id, weight, try_cast(case when regexp_full_match(trim(weight), '-?\\d+(\\.\\d+)?') then trim(weight) end as double) as n from {PEOPLE})")
def f20_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Settings as numbers: whole where they can be, and what is wrong where they are none."""
    n = F.when(F.trim("weight").rlike(r"^-?\d+(\.\d+)?$"), F.trim("weight")).try_cast("double")
    p = once(spark, sf, "scraped_performers", "weight").withColumn("n", n)
    whole = F.when(F.col("n") == F.floor("n"), F.col("n").cast("bigint").cast("string")).otherwise(F.col("n").cast("string"))
    return p.select("id", whole.alias("number"), F.when(F.col("weight").isNotNull() & F.col("n").isNull(), "no number").alias("problem"))


@query("f22_patterns", f"select id, case when len(l) = 0 then '*.*' else array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') end as patterns from (select id, list_filter(list_transform(regexp_split_to_array(coalesce(aliases, ''), '[,\\n]'), lambda x: trim(x, ' ')), lambda x: x <> '') as l from {TAGS})")
def f22_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """A list of patterns, each once; the usual one where there is none."""
    l = text.split_list(F.coalesce("aliases", F.lit("")), ",\\n")
    return once(spark, sf, "tags", "aliases").select("id", F.when(F.size(l) == 0, "*.*").otherwise(F.array_join(l, "|")).alias("patterns"))


@query("f25_long_dates", "select id, strftime(coalesce(try_strptime(d, '%B %d, %Y'), try_strptime(d, '%b %d, %Y')), '%Y-%m-%d') as day from (select id, nullif(regexp_extract(date, '^([A-Za-z]{3,} \\d{1,2}, \\d{4})', 1), '') as d from " + SCENES + " where date is not null)")
def f25_long_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Dates with the month's name first, whatever follows them."""
    d = F.nullif(F.regexp_extract("date", r"^([A-Za-z]{3,} \d{1,2}, \d{4})", 1), F.lit(""))
    return once(spark, sf, "scraped_scenes", "date").where("date is not null").select("id", text.parse_date(d).alias("day"))


@query("f30_errors", f"select id, substr(trim(regexp_replace(error, '\\s+', ' ', 'g')), 1, 600) as shown from {SOURCES} where error is not null")
def f30_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Errors in one line without credentials, six hundred characters at most."""
    e = once(spark, sf, "sources", "error").where("error is not null")
    return e.select("id", F.substring(text.redact(F.trim(F.regexp_replace("error", r"\s+", " "))), 1, 600).alias("shown"))


@query("f44_braces", f"select id, array_to_string(list_transform(regexp_extract_all(raw_json, '\"(?:[^\"\\\\]|\\\\.)*\"|[^\"]+'), lambda x: case when starts_with(x, '\"') then x else translate(x, '{{}}', '()') end), '') as coded from {RESULTS} where raw_json is not null")
def f44_braces(spark: SparkSession, sf: str) -> DataFrame:
    """Braces written as brackets, but for those inside strings."""
    parts = F.regexp_extract_all(F.col("raw_json"), F.lit(r'"(?:[^"\\]|\\.)*"|[^"]+'), 0)
    coded = F.transform(parts, lambda x: F.when(x.startswith('"'), x).otherwise(F.translate(x, "{}", "()")))
    return once(spark, sf, "results", "raw_json").where("raw_json is not null").select("id", F.array_join(coded, "").alias("coded"))


@query("f45_short_urls", f"select id, case when len(p) > 40 then substr(p, 1, 39) || '…' else p end as shown from (select id, regexp_replace(regexp_replace(url, '^https?://(www\\.)?', '', 'i'), '/$', '') as p from {URLS} where regexp_matches(trim(url), '^https?://[^/?#\\s]+', 'i'))")
def f45_short_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Safe addresses as they are shown: without scheme, shortened."""
    from weftline.functions.urls import is_safe

    p = F.regexp_replace(F.regexp_replace("url", r"(?i)^https?://(www\.)?", ""), "/$", "")
    u = once(spark, sf, "urls", "url").where(is_safe(F.col("url"))).select("id", p.alias("p"))
    return u.select("id", F.when(F.length("p") > 40, F.concat(F.substring("p", 1, 39), F.lit("…"))).otherwise(F.col("p")).alias("shown"))


@query("f46_stamps", f"select id, strftime(started_at, '%Y-%m-%dT%H:%M:%SZ') as stamp, strftime(started_at, '%Y-%m-%dT%H:%M:%SZ') < strftime(finished_at, '%Y-%m-%dT%H:%M:%SZ') as earlier from {RUNS} where started_at is not null")
def f46_stamps(spark: SparkSession, sf: str) -> DataFrame:
    """Moments as text that sorts as they do."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    r = once(spark, sf, "runs", "started_at", "finished_at").where("started_at is not null")
    return r.select("id", stamp("started_at").alias("stamp"), (stamp("started_at") < stamp("finished_at")).alias("earlier"))


@query("f48_ordinal_days", "select id, regexp_replace(birthdate, '(\\d+)(st|nd|rd|th)', '\\1', 'g') as day from " + PERFORMERS + " where birthdate is not null")
def f48_ordinal_days(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, sf, "performers", "birthdate").where("birthdate is not null").select("id", F.regexp_replace("birthdate", r"(\d+)(st|nd|rd|th)", "$1").alias("day"))


@query("f51_lines", f"select id, type || ' ' || coalesce(name, '?') || ': ' || case when error is not null then 'failed' when result_count = 1 then '1 result' else coalesce(result_count, 0) || ' results' end as line from {SOURCES} where type is not null")
def f51_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A call in one line for people."""
    n = F.coalesce("result_count", F.lit(0))
    said = F.when(F.col("error").isNotNull(), "failed").when(F.col("result_count") == 1, "1 result").otherwise(F.concat(n.cast("string"), F.lit(" results")))
    return once(spark, sf, "sources", "type", "name", "error", "result_count").where("type is not null").select("id", F.concat("type", F.lit(" "), F.coalesce("name", F.lit("?")), F.lit(": "), said).alias("line"))


@query("k14_log_lines", f"select id, regexp_replace(l, '((?:api[_-]?key|apikey|token|password|secret)[\"'']?\\s*[:=]\\s*[\"'']?)[^\\s\"''&,;]+', '\\1<redacted>', 'gi') as line from (select id, {_CLEAN.format('name')} || ' apikey=' || sha1(name) as l from {SOURCES} where name is not null)")
def k14_log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a log before they are written."""
    s = once(spark, sf, "sources", "name").where("name is not null")
    return s.select("id", text.redact(F.concat(text.clean(F.col("name")), F.lit(" apikey="), F.sha1("name"))).alias("line"))


@query("k15_outputs", f"select id, '{{\"output\":{{\"id\":' || id || case when status is not null then ',\"status\":' || to_json(status) else '' end || case when mode is not null then ',\"mode\":' || to_json(mode) else '' end || case when source_count is not null then ',\"sources\":' || source_count else '' end || '}}}}' as output from {RUNS}")
def k15_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Results as the objects a caller reads."""
    r = once(spark, sf, "runs", "status", "mode", "source_count").withColumnRenamed("source_count", "sources")
    return r.select("id", F.to_json(F.struct(F.struct("id", "status", "mode", "sources").alias("output"))).alias("output"))
