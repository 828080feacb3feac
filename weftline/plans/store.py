"""Queries over the run store: scans, joins, counts, windows, sorts and sets, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators import relational as R
from weftline.session import fixed_values, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    """Registers a query under its name, with the SQL it is compared with."""

    def put(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def once(spark: SparkSession, sf: str, name: str, *cols: str) -> DataFrame:
    """Records of a table, each id once: a record that arrives again has the same content but its arrival."""
    return table(spark, sf, name).select("id", *cols).where("id is not null").distinct()


#: The SQL twin of `once`.
ONE = "(select * from (select *, row_number() over (partition by id order by loaded_at) as rn_ from {0}) where rn_ = 1)"
RUNS, SOURCES, RESULTS, URLS, RIMAGES, PERFORMERS, TAGS, SCENES, PEOPLE = (ONE.format(t) for t in ("runs", "sources", "results", "urls", "result_images", "performers", "tags", "scraped_scenes", "scraped_performers"))


# --- scans and filters -------------------------------------------------------------------------------------------------

@query("s4_point_lookup", f"select id, scene_id, status, mode from {RUNS} where id = 17")
def s4_point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """One entity by its id; the predicate reaches the scan."""
    return once(spark, sf, "runs", "scene_id", "status", "mode").where("id = 17")


@query("s5_batch_lookup", f"select id, name, host from {SOURCES} where id in (select source_id from {RESULTS})")
def s5_batch_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Entities of a list of ids, brief columns: a semi join, no limit on the list."""
    ids = table(spark, sf, "results").select(F.col("source_id").alias("id"))
    return once(spark, sf, "sources", "name", "host").join(ids, "id", "left_semi")


@query("s6_registry_scan", "select endpoint, name from sites where endpoint is not null and trim(endpoint) <> ''")
def s6_registry_scan(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "sites").where("trim(endpoint) <> ''").select("endpoint", "name")


@query("s7_capabilities", f"select host, string_agg(distinct method, ',' order by method) as methods, count(*) as sources from {SOURCES} where host is not null group by host")
def s7_capabilities(spark: SparkSession, sf: str) -> DataFrame:
    """Each source's kinds of call, sorted and distinct."""
    s = once(spark, sf, "sources", "host", "method").where("host is not null")
    return s.groupBy("host").agg(F.array_join(F.array_sort(F.collect_set("method")), ",").alias("methods"), F.count("*").alias("sources"))


@query("s13_soft_deleted", "select sha256, mime, bytes from (select sha256, any_value(mime) as mime, any_value(bytes) as bytes from images group by sha256) i where not exists (select 1 from purge_log p where p.table_name = 'images' and p.row_key = i.sha256)")
def s13_soft_deleted(spark: SparkSession, sf: str) -> DataFrame:
    """A dimension without the members that were deleted."""
    gone = table(spark, sf, "purge_log").where("table_name = 'images'").select(F.col("row_key").alias("sha256"))
    return table(spark, sf, "images").select("sha256", "mime", "bytes").dropDuplicates(["sha256"]).join(gone, "sha256", "left_anti")


@query("s17_build_side", "select key, id, name from (select lower(name) as key, id, name, row_number() over (partition by lower(name) order by loaded_at desc, id desc) as r from tags where name is not null) where r = 1")
def s17_build_side(spark: SparkSession, sf: str) -> DataFrame:
    """The build side of a lookup by name; the last row of a name wins."""
    t = table(spark, sf, "tags").where("name is not null").select(F.lower("name").alias("key"), "id", "name", "loaded_at")
    return R.latest_per(t, ["key"], ["loaded_at", "id"]).select("key", "id", "name")


@query("s18_prefix_scan", f"select id, name from {TAGS} where starts_with(description, 'Scenes with')")
def s18_prefix_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Rows by the start of a text: pushed down as StringStartsWith."""
    return once(spark, sf, "tags", "name", "description").where(F.col("description").startswith("Scenes with")).select("id", "name")


@query("proj1_unpivot", f"select id, field, value from {SCENES} unpivot (value for field in (title, code, studio_name)) where trim(value) <> ''")
def proj1_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    """A record as one row per field that has a value."""
    s = once(spark, sf, "scraped_scenes", "title", "code", "studio_name")
    return s.unpivot("id", ["title", "code", "studio_name"], "field", "value").where("trim(value) <> ''")


@query("proj9_derived_flags", f"select id, status in ('REVIEWABLE', 'PARTIAL') and purged = 0 as reviewable, purged = 0 and mode <> 'FULL' and status in ('REVIEWABLE', 'NO_RESULTS') as can_extend from {RUNS}")
def proj9_derived_flags(spark: SparkSession, sf: str) -> DataFrame:
    r = once(spark, sf, "runs", "status", "purged", "mode")
    live = F.col("purged") == 0
    return r.select("id", (F.col("status").isin("REVIEWABLE", "PARTIAL") & live).alias("reviewable"), (live & (F.col("mode") != "FULL") & F.col("status").isin("REVIEWABLE", "NO_RESULTS")).alias("can_extend"))


# --- joins -------------------------------------------------------------------------------------------------------------

@query("j1_results_sources", f"select r.id as result_id, s.id as source_id, s.run_id, s.depth, r.ordinal, s.name from {RESULTS} r join {SOURCES} s on s.id = r.source_id")
def j1_results_sources(spark: SparkSession, sf: str) -> DataFrame:
    r = once(spark, sf, "results", "source_id", "ordinal").withColumnRenamed("id", "result_id")
    s = once(spark, sf, "sources", "run_id", "depth", "name").withColumnRenamed("id", "source_id")
    return r.join(s, "source_id").select("result_id", "source_id", "run_id", "depth", "ordinal", "name")


@query("j2_image_lists", f"select i.result_id, string_agg(coalesce(i.image_url, i.image_sha256, '?'), '|' order by i.ordinal, i.id) as images from {RIMAGES} i join {RESULTS} r on r.id = i.result_id group by i.result_id")
def j2_image_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Images of each result in their order."""
    i = once(spark, sf, "result_images", "result_id", "ordinal", "image_url", "image_sha256")
    r = table(spark, sf, "results").select(F.col("id").alias("result_id"))
    per = i.join(r, "result_id", "left_semi").groupBy("result_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "id", F.coalesce("image_url", "image_sha256", F.lit("?")).alias("u")))).alias("l"))
    return per.select("result_id", F.array_join(F.transform("l", lambda x: x["u"]), "|").alias("images"))


@query("j3_vouching_sources", f"select u.norm_key, count(distinct r.source_id) as sources from {URLS} u join {RESULTS} r on r.id = u.discovered_by_result_id where u.norm_key is not null group by u.norm_key")
def j3_vouching_sources(spark: SparkSession, sf: str) -> DataFrame:
    """How many sources vouch for each page."""
    u = once(spark, sf, "urls", "norm_key", "discovered_by_result_id").where("norm_key is not null")
    r = once(spark, sf, "results", "source_id").select(F.col("id").alias("discovered_by_result_id"), "source_id")
    return u.join(r, "discovered_by_result_id").groupBy("norm_key").agg(F.count_distinct("source_id").alias("sources"))


@query("j4_runs_left_results", f"select r.id, r.status, coalesce(c.n, 0) as results from {RUNS} r left join (select run_id, count(*) as n from {RESULTS} group by run_id) c on c.run_id = r.id")
def j4_runs_left_results(spark: SparkSession, sf: str) -> DataFrame:
    n = once(spark, sf, "results", "run_id").groupBy(F.col("run_id").alias("id")).agg(F.count("*").alias("n"))
    return once(spark, sf, "runs", "status").join(n, "id", "left").select("id", "status", F.coalesce("n", F.lit(0)).alias("results"))


@query("j6_parent_column", f"select s.id, s.parent_source_id, p.result_id from {SOURCES} s left join (select source_id, id as result_id from (select source_id, id, row_number() over (partition by source_id order by ordinal, id) as k from {RESULTS}) where k = 1) p on p.source_id = s.parent_source_id")
def j6_parent_column(spark: SparkSession, sf: str) -> DataFrame:
    """Each source with the first result of its parent."""
    firsts = R.first_per(once(spark, sf, "results", "source_id", "ordinal"), ["source_id"], [F.col("ordinal"), F.col("id")])
    p = firsts.select(F.col("source_id").alias("parent_source_id"), F.col("id").alias("result_id"))
    return once(spark, sf, "sources", "parent_source_id").join(p, "parent_source_id", "left").select("id", "parent_source_id", "result_id")


@query("j7_url_patterns", f"select u.id, s.host as handler from {URLS} u join sites s on contains(lower(u.url), lower(s.host))")
def j7_url_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """URLs with every handler whose pattern they contain. The patterns are a fixed table of 28 rows, tried per URL inside one expression."""
    patterns = fixed_values(table(spark, sf, "sites"), "host")
    u = once(spark, sf, "urls", "url")
    hits = F.filter(F.array(*[F.lit(p) for p in patterns]), lambda p: F.contains(F.lower("url"), F.lower(p)))
    return u.select("id", F.explode(hits).alias("handler"))


@query("j9_three_stage_match", f"""select m.id, m.name, coalesce(a.id, b.id) as match_id, case when a.id is not null then 'name' when b.id is not null then 'studio' else 'none' end as stage
from {SCENES} s join lateral (select s.id, lower(trim(s.studio_name)) as name) m on true
left join (select lower(name) as key, min(id) as id from tags where name is not null group by 1) a on a.key = lower(s.title)
left join (select lower(split_part(name, ' ', 1)) as key, min(id) as id from tags where name is not null group by 1) b on b.key = lower(split_part(s.title, ' ', 1))""")
def j9_three_stage_match(spark: SparkSession, sf: str) -> DataFrame:
    """Titles matched to tags by whole name, then by first word, else by none."""
    s = once(spark, sf, "scraped_scenes", "title", "studio_name").select("id", F.lower(F.trim("studio_name")).alias("name"), F.lower("title").alias("k1"), F.lower(F.substring_index("title", " ", 1)).alias("k2"))
    t = table(spark, sf, "tags").where("name is not null")
    a = R.priority_match(s, "k1", [(t.select(F.lower("name").alias("k1"), "id"), "name")])
    b = t.groupBy(F.lower(F.substring_index("name", " ", 1)).alias("k2")).agg(F.min("id").alias("second"))
    both = a.join(b, "k2", "left")
    stage = F.when(F.col("match_id").isNotNull(), "name").when(F.col("second").isNotNull(), "studio").otherwise("none")
    return both.select("id", "name", F.coalesce("match_id", "second").alias("match_id"), stage.alias("stage"))


@query("j10_alias_conflicts", f"select distinct a.id, a.alias from (select id, name, lower(trim(unnest(string_split(aliases, ',')))) as alias from {TAGS} where aliases is not null) a where a.alias in (select lower(name) from tags where name is not null)")
def j10_alias_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Aliases that are the name of a tag already, the tag's own included."""
    a = once(spark, sf, "tags", "aliases").where("aliases is not null").select("id", F.explode(F.transform(F.split("aliases", ","), lambda x: F.lower(F.trim(x)))).alias("alias"))
    names = table(spark, sf, "tags").where("name is not null").select(F.lower("name").alias("alias"))
    return a.join(names, "alias", "left_semi").distinct().select("id", "alias")


@query("j11_unique_match", f"""select q.id, q.name, coalesce(c.n, 0) as matches, case when c.n = 1 then c.one end as match_id from {PEOPLE} q
left join (select lower(name) as key, count(distinct id) as n, min(id) as one from performers where name is not null group by 1) c on c.key = lower(q.name)""")
def j11_unique_match(spark: SparkSession, sf: str) -> DataFrame:
    """A name resolved only where exactly one record answers to it."""
    q = once(spark, sf, "scraped_performers", "name").withColumn("key", F.lower("name"))
    p = table(spark, sf, "performers").select(F.lower("name").alias("key"), "id")
    return R.unique_match(q, p, "key").select("id", "name", "matches", "match_id")


@query("j12_possible_duplicates", "select a.id, b.first_id from (select distinct id, lower(name) as key from performers where name is not null) a join (select lower(name) as key, min(id) as first_id from performers where name is not null group by 1) b on a.key = b.key where a.id <> b.first_id")
def j12_possible_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Records with the first record of the same name."""
    p = table(spark, sf, "performers").where("name is not null").select("id", F.lower("name").alias("key")).distinct()
    return p.join(p.groupBy("key").agg(F.min("id").alias("first_id")), "key").where("id <> first_id").select("id", "first_id")


@query("j13_orphan_images", "select sha256 from (select distinct sha256 from images where sha256 is not null) i where not exists (select 1 from result_images r where lower(trim(r.image_sha256)) = i.sha256)")
def j13_orphan_images(spark: SparkSession, sf: str) -> DataFrame:
    """Images that no result refers to: an anti join that nulls cannot empty."""
    i = table(spark, sf, "images").where("sha256 is not null").select("sha256").distinct()
    return R.orphans(i, "sha256", table(spark, sf, "result_images").select(F.lower(F.trim("image_sha256"))))


@query("j14_insert_or_ignore", f"select run_id, norm_key, id from (select run_id, norm_key, id, row_number() over (partition by run_id, norm_key order by id) as k from {URLS} where role = 'scene') u where k = 1 and not exists (select 1 from {URLS} s where s.role = 'performer' and s.run_id is not distinct from u.run_id and s.norm_key is not distinct from u.norm_key)")
def j14_insert_or_ignore(spark: SparkSession, sf: str) -> DataFrame:
    """New mentions whose page the run does not have yet, the first of each."""
    u = once(spark, sf, "urls", "run_id", "norm_key", "role")
    key = ["run_id", "norm_key"]
    return R.new_only(u.where("role = 'scene'").drop("role"), u.where("role = 'performer'"), key, [F.col("id")]).select("run_id", "norm_key", "id")


@query("j15_not_attempted", f"select h.host, r.id as run_id from (select id from {RUNS} where mode = 'FAST') r join lateral (select host from sites where kind = 'BOX') h on true where not exists (select 1 from {SOURCES} s where s.run_id = r.id and s.host = h.host)")
def j15_not_attempted(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes that a fast run has not asked. The boxes are listed per run inside one expression, not joined."""
    boxes = fixed_values(table(spark, sf, "sites").where("kind = 'BOX'"), "host")
    runs = once(spark, sf, "runs", "mode").where("mode = 'FAST'").select(F.col("id").alias("run_id"), F.explode(F.array(*[F.lit(b) for b in boxes])).alias("host"))
    asked = table(spark, sf, "sources").select("run_id", "host").distinct()
    return runs.join(asked, ["run_id", "host"], "left_anti").select("host", "run_id")


@query("j17_code_siblings", f"with f as (select id, host, split_part(code, '-', 2) as stem from {SCENES} where code like '%-%' and host is not null) select f.id, g.first_id, g.files from f join (select host, stem, min(id) as first_id, count(*) as files from f group by 1, 2) g on g.host = f.host and g.stem = f.stem where g.files > 1")
def j17_code_siblings(spark: SparkSession, sf: str) -> DataFrame:
    """Files of one place whose names have the same stem: each with the first of them and their number; the pairs of a group are never made."""
    s = once(spark, sf, "scraped_scenes", "host", "code").where(F.col("code").contains("-") & F.col("host").isNotNull()).select("id", "host", F.split("code", "-")[1].alias("stem"))
    g = s.groupBy("host", "stem").agg(F.min("id").alias("first_id"), F.count("*").alias("files")).where("files > 1")
    return s.join(g, ["host", "stem"]).select("id", "first_id", "files")


@query("j19_band_join", f"select id, duration, case when duration < 600 then 'clip' when duration < 1800 then 'short' when duration < 3600 then 'feature' else 'long' end as band from {SCENES} where duration is not null")
def j19_band_join(spark: SparkSession, sf: str) -> DataFrame:
    from weftline.functions.body import ladder

    s = once(spark, sf, "scraped_scenes", "duration").where("duration is not null")
    return s.select("id", "duration", ladder(F.col("duration"), [(600, "clip"), (1800, "short"), (3600, "feature")], "long").alias("band"))


@query("j20_url_graph", f"select u.id, u.norm_key, coalesce(s.name, 'scene') as found_by from {URLS} u left join {RESULTS} r on r.id = u.discovered_by_result_id left join {SOURCES} s on s.id = r.source_id")
def j20_url_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Each URL with the source it was found by."""
    u = once(spark, sf, "urls", "norm_key", "discovered_by_result_id")
    r = once(spark, sf, "results", "source_id").withColumnRenamed("id", "discovered_by_result_id")
    s = once(spark, sf, "sources", "name").withColumnRenamed("id", "source_id")
    return u.join(r, "discovered_by_result_id", "left").join(s, "source_id", "left").select("id", "norm_key", F.coalesce("name", F.lit("scene")).alias("found_by"))


@query("j24_zip", f"select id, unnest(range(1, len(w) + 1))::int as pos, unnest(w) as word, unnest(list_transform(w, lambda x: len(x)))::int as letters from (select id, string_split(title, ' ') as w from {SCENES} where title is not null)")
def j24_zip(spark: SparkSession, sf: str) -> DataFrame:
    """Two lists joined by position."""
    s = once(spark, sf, "scraped_scenes", "title").where("title is not null").withColumn("w", F.split("title", " "))
    z = s.select("id", F.posexplode(F.arrays_zip("w", F.transform("w", F.length).alias("n"))).alias("pos", "z"))
    return z.select("id", (F.col("pos") + 1).alias("pos"), F.col("z.w").alias("word"), F.col("z.n").alias("letters"))


@query("j28_asof", "select e.event_id, p.value as last_purchase from (select event_id, user_id, ts from events where event_type = 'click') e asof left join (select user_id, ts, max(value) as value from events where event_type = 'purchase' group by 1, 2) p on e.user_id = p.user_id and e.ts >= p.ts")
def j28_asof(spark: SparkSession, sf: str) -> DataFrame:
    """Each click with the user's last purchase before it."""
    e = table(spark, sf, "events")
    clicks = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    bought = e.where("event_type = 'purchase'").select("user_id", "ts", "value")
    return R.asof_join(clicks, bought, "user_id", "ts", "value").select("event_id", F.col("value").alias("last_purchase"))


# --- aggregates --------------------------------------------------------------------------------------------------------

@query("a1_by_status", f"select entity_type, status, count(*) as runs from {RUNS} group by entity_type, status")
def a1_by_status(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, sf, "runs", "entity_type", "status").groupBy("entity_type", "status").agg(F.count("*").alias("runs"))


@query("a2_conditional_counts", f"select run_id, count(*) as total, count(*) filter (status = 'OK') as ok, count(*) filter (status in ('ERROR', 'TIMEOUT', 'UNREACHABLE')) as errors from {SOURCES} where run_id is not null group by run_id")
def a2_conditional_counts(spark: SparkSession, sf: str) -> DataFrame:
    s = once(spark, sf, "sources", "run_id", "status").where("run_id is not null")
    return s.groupBy("run_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "OK").alias("ok"), F.count_if(F.col("status").isin("ERROR", "TIMEOUT", "UNREACHABLE")).alias("errors"))


@query("a3_cardinalities", " union all ".join(f"select '{t}' as name, count(*) as records, count(distinct id) as ids from {t}" for t in ("runs", "sources", "results", "urls", "result_images", "performers")))
def a3_cardinalities(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for t in ("runs", "sources", "results", "urls", "result_images", "performers"):
        one = table(spark, sf, t).agg(F.lit(t).alias("name"), F.count("*").alias("records"), F.count_distinct("id").alias("ids"))
        out = one if out is None else out.unionByName(one)
    return out


@query("a4_scalar_merge", f"""with c as (select r.source_id as ent, lower(trim(s.studio_name)) as key, s.studio_name as value, s.id as ord, s.host as src from {SCENES} s join {RESULTS} r on r.id = s.result_id where trim(s.studio_name) <> '')
select ent, key, arg_min(value, ord) as value, (select string_agg(src, ',' order by o) from (select src, min(ord) as o from c c2 where c2.ent = c.ent and c2.key = c.key group by src)) as sources from c group by ent, key""")
def a4_scalar_merge(spark: SparkSession, sf: str) -> DataFrame:
    """A field merged over sources: one option per comparison key, spelled as first met, with its sources in order."""
    s = once(spark, sf, "scraped_scenes", "result_id", "studio_name", "host").where("trim(studio_name) <> ''")
    r = once(spark, sf, "results", "source_id").select(F.col("id").alias("result_id"), F.col("source_id").alias("ent"))
    cells = s.join(r, "result_id").withColumn("key", F.lower(F.trim("studio_name")))
    merged = R.merge_values(cells, ["ent"], "key", ["id"], "studio_name", "host")
    return merged.select("ent", "key", F.col("studio_name").alias("value"), F.array_join("sources", ",").alias("sources"))


@query("a5_scalar_default", f"select result_id, case when count(distinct lower(trim(title))) = 1 then min(title) end as title, count(distinct lower(trim(title))) as options from {SCENES} where trim(title) <> '' group by result_id")
def a5_scalar_default(spark: SparkSession, sf: str) -> DataFrame:
    """The default of a field: its only value, else none."""
    s = once(spark, sf, "scraped_scenes", "result_id", "title").where("trim(title) <> ''")
    return s.groupBy("result_id").agg(F.when(F.count_distinct(F.lower(F.trim("title"))) == 1, F.min("title")).alias("title"), F.count_distinct(F.lower(F.trim("title"))).alias("options"))


@query("a6_url_union", f"select run_id, norm_key, arg_min(url, id) as url, count(*) as mentions from {URLS} where norm_key is not null group by run_id, norm_key")
def a6_url_union(spark: SparkSession, sf: str) -> DataFrame:
    """The pages of a run, each in its first spelling."""
    u = once(spark, sf, "urls", "run_id", "norm_key", "url").where("norm_key is not null")
    return u.groupBy("run_id", "norm_key").agg(F.min_by("url", "id").alias("url"), F.count("*").alias("mentions"))


@query("a8_image_options", f"select result_id, coalesce('b:' || nullif(lower(trim(image_sha256)), ''), 'u:' || image_url) as key, min(id) as first_id, count(*) as images from {RIMAGES} where coalesce(nullif(lower(trim(image_sha256)), ''), image_url) is not null group by 1, 2")
def a8_image_options(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate images by content where it is known, else by address."""
    i = once(spark, sf, "result_images", "result_id", "image_sha256", "image_url")
    sha = F.nullif(F.lower(F.trim("image_sha256")), F.lit(""))
    key = F.coalesce(F.concat(F.lit("b:"), sha), F.concat(F.lit("u:"), F.col("image_url")))
    return i.withColumn("key", key).where("key is not null").groupBy("result_id", "key").agg(F.min("id").alias("first_id"), F.count("*").alias("images"))


@query("a11_attribute_rollup", f"select source_id, arg_min(name, id) as name, arg_min(gender, id) filter (gender is not null) as gender, arg_min(country, id) filter (country is not null) as country, count(*) as mentions from {PERFORMERS} where source_id is not null group by source_id")
def a11_attribute_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """The first value of each attribute that is not null."""
    p = once(spark, sf, "performers", "source_id", "name", "gender", "country").where("source_id is not null")
    pick = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(c)
    return p.groupBy("source_id").agg(F.min_by("name", "id").alias("name"), pick("gender"), pick("country"), F.count("*").alias("mentions"))


@query("a12_identity_hash", f"select source_id, substr(sha1(string_agg(distinct lower(name), '|' order by lower(name))), 1, 10) as identity from {PERFORMERS} where name is not null and source_id is not null group by source_id")
def a12_identity_hash(spark: SparkSession, sf: str) -> DataFrame:
    """A short hash of a group's sorted distinct names."""
    p = once(spark, sf, "performers", "source_id", "name").where("name is not null and source_id is not null")
    return p.groupBy("source_id").agg(F.substring(F.sha1(F.array_join(F.array_sort(F.collect_set(F.lower("name"))), "|")), 1, 10).alias("identity"))


@query("a15_summary", f"select count(*) as sources, count(*) filter (error is not null) as failed, count(*) filter (status = 'UNREACHABLE') as unreachable, count(distinct host) as hosts, cast(sum(result_count) as bigint) as results from {SOURCES}")
def a15_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = once(spark, sf, "sources", "error", "status", "host", "result_count")
    return s.agg(F.count("*").alias("sources"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.count_if(F.col("status") == "UNREACHABLE").alias("unreachable"), F.count_distinct("host").alias("hosts"), F.sum("result_count").alias("results"))


@query("a17_histogram", f"select type, count(*) filter (status = 'OK') as ok, count(*) filter (status = 'EMPTY') as empty, count(*) filter (status = 'ERROR') as error, count(*) filter (status = 'TIMEOUT') as timeout from {SOURCES} group by type")
def a17_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by status, zero-filled, as columns."""
    p = once(spark, sf, "sources", "type", "status").groupBy("type").pivot("status", ["OK", "EMPTY", "ERROR", "TIMEOUT"]).agg(F.count("status"))
    return p.na.fill(0).select("type", *[F.col(x).alias(x.lower()) for x in ("OK", "EMPTY", "ERROR", "TIMEOUT")])


@query("a18_by_domain", f"select host, count(*) as changes, min(url) as sample from {URLS} where host is not null and regexp_replace(lower(url), '^https?://(www\\.)?', '') <> norm_key group by host")
def a18_by_domain(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses that are not in their normal form, by domain."""
    u = once(spark, sf, "urls", "host", "url", "norm_key").where("host is not null")
    return u.where(F.regexp_replace(F.lower("url"), r"^https?://(www\.)?", "") != F.col("norm_key")).groupBy("host").agg(F.count("*").alias("changes"), F.min("url").alias("sample"))


@query("a20_inverted_index", f"select word, count(*) as scenes, min(id) as first_id from (select distinct id, unnest(string_split(lower(title), ' ')) as word from {SCENES} where title is not null) where word <> '' group by word")
def a20_inverted_index(spark: SparkSession, sf: str) -> DataFrame:
    """Words with the records they occur in."""
    w = once(spark, sf, "scraped_scenes", "title").where("title is not null").select("id", F.explode(F.array_distinct(F.split(F.lower("title"), " "))).alias("word"))
    return w.where("word <> ''").groupBy("word").agg(F.count("*").alias("scenes"), F.min("id").alias("first_id"))


@query("a23_fingerprint", f"select result_id, sha256(string_agg(ordinal || ':' || coalesce(image_sha256, ''), chr(10) order by ordinal, id)) as fingerprint from {RIMAGES} where result_id is not null group by result_id")
def a23_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """One hash over ordered contents."""
    i = once(spark, sf, "result_images", "result_id", "ordinal", "image_sha256").where("result_id is not null")
    line = F.concat(F.col("ordinal").cast("string"), F.lit(":"), F.coalesce("image_sha256", F.lit("")))
    per = i.groupBy("result_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "id", line.alias("line")))).alias("l"))
    return per.select("result_id", F.sha2(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), 256).alias("fingerprint"))


@query("a24_run_counters", f"select run_id, count(*) as sources, max(depth) as depth, cast(sum(result_count) as bigint) as results from {SOURCES} where run_id is not null group by run_id")
def a24_run_counters(spark: SparkSession, sf: str) -> DataFrame:
    s = once(spark, sf, "sources", "run_id", "depth", "result_count").where("run_id is not null")
    return s.groupBy("run_id").agg(F.count("*").alias("sources"), F.max("depth").alias("depth"), F.sum("result_count").alias("results"))


@query("a28_rollup", "select o_orderstatus, o_orderpriority, count(*) as orders, round(sum(o_totalprice), 2) as total from orders group by rollup (o_orderstatus, o_orderpriority)")
def a28_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


# --- windows and sorts -------------------------------------------------------------------------------------------------

@query("w1_latest_run", f"select scene_id, id, status from (select scene_id, id, status, row_number() over (partition by scene_id order by started_at desc nulls last, id desc) as k from {RUNS} where scene_id is not null) where k = 1")
def w1_latest_run(spark: SparkSession, sf: str) -> DataFrame:
    r = once(spark, sf, "runs", "scene_id", "status", "started_at").where("scene_id is not null")
    return R.latest_per(r, ["scene_id"], ["started_at", "id"]).select("scene_id", "id", "status")


@query("w2_preferred_run", f"select scene_id, id, status from (select scene_id, id, status, row_number() over (partition by scene_id order by (status = 'REVIEWABLE') desc, started_at desc nulls last, id desc) as k from {RUNS} where scene_id is not null and status is not null) where k = 1")
def w2_preferred_run(spark: SparkSession, sf: str) -> DataFrame:
    """The latest run under review, else the latest of any kind."""
    r = once(spark, sf, "runs", "scene_id", "status", "started_at").where("scene_id is not null and status is not null").withColumn("open", F.col("status") == "REVIEWABLE")
    return R.latest_per(r, ["scene_id"], ["open", "started_at", "id"]).select("scene_id", "id", "status")


@query("w3_first_mention", f"select run_id, norm_key, id from (select run_id, norm_key, id, row_number() over (partition by run_id, norm_key order by id) as k from {URLS} where norm_key is not null) where k = 1")
def w3_first_mention(spark: SparkSession, sf: str) -> DataFrame:
    u = once(spark, sf, "urls", "run_id", "norm_key").where("norm_key is not null")
    return R.first_per(u, ["run_id", "norm_key"], [F.col("id")]).select("run_id", "norm_key", "id")


@query("w5_top_per_source", f"select source_id, id, k as rank from (select source_id, id, row_number() over (partition by source_id order by ordinal, id) as k from {RESULTS} where source_id is not null) where k <= 2")
def w5_top_per_source(spark: SparkSession, sf: str) -> DataFrame:
    r = once(spark, sf, "results", "source_id", "ordinal").where("source_id is not null")
    return R.top_per(r, ["source_id"], [F.col("ordinal"), F.col("id")], 2).select("source_id", "id", F.col("rank").cast("bigint").alias("rank"))


@query("w9_gaps", "select user_id, event_id, round(value - lag(value) over (partition by user_id order by ts, event_id), 2) as step, ntile(4) over (partition by user_id order by ts, event_id)::int as quarter from events")
def w9_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Analytic functions over each user's events."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("user_id", "event_id", F.round(F.col("value") - F.lag("value").over(w), 2).alias("step"), F.ntile(4).over(w).alias("quarter"))


@query("o1_page", f"select id, status from {RUNS} order by id desc limit 20 offset 20")
def o1_page(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of twenty runs."""
    return once(spark, sf, "runs", "status").orderBy(F.desc("id")).offset(20).limit(20)


@query("o2_latest_audit", f"select id, scene_id from {RUNS} where status = 'APPLIED' order by finished_at desc nulls last, id desc limit 5")
def o2_latest_audit(spark: SparkSession, sf: str) -> DataFrame:
    """The five applications made last: a top-k without a full sort."""
    return once(spark, sf, "runs", "scene_id", "status", "finished_at").where("status = 'APPLIED'").orderBy(F.desc_nulls_last("finished_at"), F.desc("id")).limit(5).select("id", "scene_id")


@query("o8_frontier_cap", f"select run_id, id from (select run_id, id, row_number() over (partition by run_id order by depth nulls last, id) as k from {URLS} where run_id is not null and state = 'PENDING') where k <= 60")
def o8_frontier_cap(spark: SparkSession, sf: str) -> DataFrame:
    """The first sixty open pages of each run."""
    u = once(spark, sf, "urls", "run_id", "depth", "state").where("run_id is not null and state = 'PENDING'")
    return R.top_per(u, ["run_id"], [F.asc_nulls_last("depth"), F.col("id")], 60).select("run_id", "id")


# --- sets and sinks ----------------------------------------------------------------------------------------------------

@query("u1_union_refs", "select lower(trim(image_sha256)) as sha256 from result_images where trim(image_sha256) <> '' union select sha256 from images where sha256 is not null")
def u1_union_refs(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "result_images").where("trim(image_sha256) <> ''").select(F.lower(F.trim("image_sha256")).alias("sha256"))
    return a.union(table(spark, sf, "images").where("sha256 is not null").select("sha256")).distinct()


@query("u3_set_difference", "select name from (select lower(name) as name from tags where name is not null except select lower(title) from scraped_scenes where title is not null)")
def u3_set_difference(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "tags").where("name is not null").select(F.lower("name").alias("name"))
    return a.subtract(table(spark, sf, "scraped_scenes").where("title is not null").select(F.lower("title")))


@query("u7_snapshot_diff", f"""with o as (select norm_key as key, max(state) as content from {URLS} where depth = 0 and norm_key is not null group by 1), n as (select norm_key as key, max(state) as content from {URLS} where depth > 0 and norm_key is not null group by 1)
select key, case when o.key is null then 'new' when n.key is null then 'removed' when o.content is not distinct from n.content then 'unchanged' else 'content' end as change from o full join n using (key)""")
def u7_snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Two keyed snapshots compared."""
    u = once(spark, sf, "urls", "norm_key", "state", "depth").where("norm_key is not null")
    side = lambda cond: u.where(cond).groupBy(F.col("norm_key").alias("key")).agg(F.max("state").alias("content"))
    return R.snapshot_diff(side("depth = 0"), side("depth > 0"), "key", "content")


@query("k1_merge_update", f"select t.id, t.name, coalesce(u.category, t.category) as category from {TAGS} t left join (select lower(name) as key, max(category) as category from tags where category is not null group by 1) u on u.key = lower(t.name)")
def k1_merge_update(spark: SparkSession, sf: str) -> DataFrame:
    """A partial update applied: what the update has replaces, what it lacks stays."""
    t = once(spark, sf, "tags", "name", "category").withColumn("key", F.lower("name"))
    u = table(spark, sf, "tags").where("category is not null").groupBy(F.lower("name").alias("key")).agg(F.max("category").alias("fresh"))
    return t.join(u, "key", "left").select("id", "name", F.coalesce("fresh", "category").alias("category"))


@query("k11_content_addressed", "select sha256, any_value(mime) as mime, any_value(bytes) as bytes, count(*) as arrivals from images where sha256 is not null group by sha256")
def k11_content_addressed(spark: SparkSession, sf: str) -> DataFrame:
    """Blobs stored once per content."""
    return table(spark, sf, "images").where("sha256 is not null").groupBy("sha256").agg(F.any_value("mime").alias("mime"), F.any_value("bytes").alias("bytes"), F.count("*").alias("arrivals"))


@query("k12_cascade_purge", f"select 'sources' as name, count(*) as left_over from {SOURCES} s where not exists (select 1 from {RUNS} r where r.purged = 1 and r.id = s.run_id) union all select 'results', count(*) from {RESULTS} s where not exists (select 1 from {RUNS} r where r.purged = 1 and r.id = s.run_id) union all select 'urls', count(*) from {URLS} s where not exists (select 1 from {RUNS} r where r.purged = 1 and r.id = s.run_id)")
def k12_cascade_purge(spark: SparkSession, sf: str) -> DataFrame:
    """What the child tables keep once purged runs are gone."""
    gone = once(spark, sf, "runs", "purged").where("purged = 1").select(F.col("id").alias("run_id"))
    out = None
    for t in ("sources", "results", "urls"):
        one = once(spark, sf, t, "run_id").join(gone, "run_id", "left_anti").agg(F.lit(t).alias("name"), F.count("*").alias("left_over"))
        out = one if out is None else out.unionByName(one)
    return out


@query("k17_data_uri", "select sha256, 'data:' || mime || ';base64,' || base64(data) as uri from (select sha256, any_value(mime) as mime, any_value(data) as data from images where sha256 is not null group by sha256)")
def k17_data_uri(spark: SparkSession, sf: str) -> DataFrame:
    """Stored blobs as data addresses."""
    i = table(spark, sf, "images").where("sha256 is not null").select("sha256", "mime", "data").dropDuplicates(["sha256"])
    return i.select("sha256", F.concat(F.lit("data:"), F.col("mime"), F.lit(";base64,"), F.base64("data")).alias("uri"))
