"""Queries of review, routing, selection and clean-up, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.functions.clean import endpoint_id, int_id, url_key, uuid_id
from weftline.operators import relational as R
from weftline.plans.store import ONE, PERFORMERS, RESULTS, RUNS, SCENES, SOURCES, TAGS, URLS, once
from weftline.session import fixed_values, table
from weftline.sources import sinks

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def put(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


@query("j8_routing", f"select u.norm_key, count(distinct s.host) as handlers, case when count(distinct s.host) = 1 then 'CERTAIN' else 'AMBIGUOUS' end as attribution from {URLS} u join {RESULTS} r on r.id = u.discovered_by_result_id join {SOURCES} s on s.id = r.source_id where u.norm_key is not null and s.host is not null group by u.norm_key")
def j8_routing(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with the number of handlers that came up with them: one is certain, more are ambiguous."""
    u = once(spark, sf, "urls", "norm_key", "discovered_by_result_id").where("norm_key is not null")
    r = once(spark, sf, "results", "source_id").withColumnRenamed("id", "discovered_by_result_id")
    s = once(spark, sf, "sources", "host").where("host is not null").withColumnRenamed("id", "source_id")
    per = u.join(r, "discovered_by_result_id").join(s, "source_id").groupBy("norm_key").agg(F.count_distinct("host").alias("handlers"))
    return per.select("norm_key", "handlers", F.when(F.col("handlers") == 1, "CERTAIN").otherwise("AMBIGUOUS").alias("attribution"))


@query("j16_choices", f"select s.id, coalesce(a.host, b.host) as host from {SOURCES} s left join sites a on a.host = lower(trim(s.scraper_id)) left join (select lower(name) as n, min(host) as host from sites group by 1) b on b.n = lower(trim(s.scraper_id)) where s.scraper_id is not null")
def j16_choices(spark: SparkSession, sf: str) -> DataFrame:
    """A setting's entries resolved by id, else by name."""
    s = once(spark, sf, "sources", "scraper_id").where("scraper_id is not null").withColumn("key", F.lower(F.trim("scraper_id")))
    sites = table(spark, sf, "sites")
    matched = R.priority_match(s, "key", [(sites.select(F.col("host").alias("key"), F.col("host").alias("id")), "id"), (sites.select(F.lower("name").alias("key"), F.col("host").alias("id")), "name")])
    return matched.select("id", F.col("match_id").alias("host"))


@query("j18_plan_decisions", f"select s.id, s.title, coalesce(d.keep, false) as keep from {SCENES} s left join (select id, true as keep from {SCENES} where code is not null) d on d.id = s.id where s.title is not null")
def j18_plan_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """A plan with the decisions that were handed in; none means no."""
    s = once(spark, sf, "scraped_scenes", "title", "code")
    d = s.where("code is not null").select("id", F.lit(True).alias("keep"))
    return s.where("title is not null").join(d, "id", "left").select("id", "title", F.coalesce("keep", F.lit(False)).alias("keep"))


@query("j26_plan_sources", f"select r.id as run_id, count(*) as planned from {RUNS} r join (select host from sites where kind = 'BOX') b on true where r.status <> 'FAILED' group by r.id")
def j26_plan_sources(spark: SparkSession, sf: str) -> DataFrame:
    """The calls a run plans: one a box, generated per run from the fixed list of boxes."""
    boxes = fixed_values(table(spark, sf, "sites").where("kind = 'BOX'"), "host")
    runs = once(spark, sf, "runs", "status").where("status <> 'FAILED'").select(F.col("id").alias("run_id"), F.explode(F.array(*[F.lit(b) for b in boxes])).alias("host"))
    return runs.groupBy("run_id").agg(F.count("*").alias("planned"))


@query("a7_foreign_ids", f"select regexp_replace(regexp_replace(lower(trim(s.endpoint)), '^https?://', ''), '/+(graphql)?/*$', '') as endpoint, count(distinct p.id) as mentions from {PERFORMERS} p join {SOURCES} s on s.id = p.source_id where s.endpoint is not null and regexp_matches(p.remote_site_id, '[0-9]{{2}}') and replace(p.remote_site_id, '0', '') not in ('', '----') group by 1")
def a7_foreign_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Remote ids are told apart by their endpoint: mentions with an id for each endpoint."""
    p = once(spark, sf, "performers", "source_id", "remote_site_id").select("id", "source_id", uuid_id(F.col("remote_site_id")).alias("remote"), "remote_site_id")
    s = once(spark, sf, "sources", "endpoint").where("endpoint is not null").select(F.col("id").alias("source_id"), endpoint_id(F.col("endpoint")).alias("endpoint"))
    return p.where(F.col("remote").isNotNull() & F.col("remote_site_id").rlike("[0-9]{2}")).join(s, "source_id").groupBy("endpoint").agg(F.count_distinct("id").alias("mentions"))


@query("a9_image_cells", "select result_id, first(image_url order by ordinal, id) as cell, count(*) as images from " + ONE.format("result_images") + " where image_url is not null and result_id is not null group by result_id")
def a9_image_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Each result's first image, and how many there are."""
    i = once(spark, sf, "result_images", "result_id", "ordinal", "image_url").where("image_url is not null and result_id is not null")
    return i.groupBy("result_id").agg(F.min_by("image_url", F.struct("ordinal", "id")).alias("cell"), F.count("*").alias("images"))


@query("a10_entity_groups", f"""with recursive k as (select distinct id, lower(trim(name)) as a, country || '|' || trim(gender) || '|' || substr(trim(birthdate), 1, 10) as b from {PERFORMERS} where source_id is not null),
e as (select x.id as p, y.id as q from k x join k y on x.a = y.a union select x.id, y.id from k x join k y on x.b = y.b and regexp_matches(x.b, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$')),
g(id, r) as (select id, id from k union select e.q, g.r from g join e on e.p = g.id) select id, min(r) as group_id from g group by id""")
def a10_entity_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions grouped by name or by country, gender and birthday, directly or through others: labels spread until they stay."""
    p = once(spark, sf, "performers", "source_id", "name", "country", "gender", "birthdate").where("source_id is not null")
    day = F.substring(F.trim("birthdate"), 1, 10)
    b = F.when(day.rlike("[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.concat("country", F.lit("|"), F.trim("gender"), F.lit("|"), day))
    keys = p.select("id", F.explode(F.array_compact(F.array(F.concat(F.lit("a"), F.lower(F.trim("name"))), F.concat(F.lit("b"), b)))).alias("key"))
    return R.spread_labels(keys, p.select("id"))


@query("a10_strong_groups")
def a10_strong_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions grouped by stored id, remote id at one endpoint or page, directly or through others; those without such a key by name and disambiguation among themselves. Without any of these a mention is its own group."""
    p = once(spark, sf, "performers", "source_id", "stored_id", "remote_site_id", "name", "disambiguation")
    s = once(spark, sf, "sources", "endpoint", "url_key").select(F.col("id").alias("source_id"), endpoint_id(F.col("endpoint")).alias("endpoint"), url_key(F.col("url_key")).alias("page"))
    strong = F.array_compact(F.array(
        F.concat(F.lit("local:"), int_id(F.col("stored_id"))),
        F.concat(F.lit("stash:"), F.col("endpoint"), F.lit("|"), uuid_id(F.col("remote_site_id"))),
        F.concat(F.lit("url:"), F.col("page")),
    ))
    weak = F.array_compact(F.array(F.concat(F.lit("weak:"), text.canon_text(F.col("name")), F.lit("|"), F.coalesce(text.canon_text(F.col("disambiguation")), F.lit("")))))
    keyed = p.join(s, "source_id", "left").withColumn("strong", strong)
    return R.spread_labels(keyed.select("id", F.explode(F.when(F.size("strong") > 0, F.col("strong")).otherwise(weak)).alias("key")), p.select("id"))


@query("a13_fold_by_name", f"select lower(name) as key, min(id) as id, array_to_string(list_sort(list(id)), ',') as merged from {TAGS} where name is not null group by 1")
def a13_fold_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """Records that resolve to one, with the ids they absorb."""
    t = once(spark, sf, "tags", "name").where("name is not null").select("id", F.lower("name").alias("key"))
    return t.groupBy("key").agg(F.min("id").alias("id"), F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",").alias("merged"))


@query("a16_parents", f"select title, string_agg(distinct host, ',' order by host) as hosts, count(*) as records from {SCENES} where title is not null group by title")
def a16_parents(spark: SparkSession, sf: str) -> DataFrame:
    s = once(spark, sf, "scraped_scenes", "title", "host").where("title is not null")
    return s.groupBy("title").agg(F.array_join(F.array_sort(F.collect_set("host")), ",").alias("hosts"), F.count("*").alias("records"))


@query("a22_batch_summary", f"select mode, count(*) filter (status <> 'FAILED') as ready, count(*) filter (status = 'FAILED') as failed, cast(sum(source_count) as bigint) as sources, cast(sum(error_count) as bigint) as errors from {RUNS} group by mode")
def a22_batch_summary(spark: SparkSession, sf: str) -> DataFrame:
    r = once(spark, sf, "runs", "mode", "status", "source_count", "error_count")
    return r.groupBy("mode").agg(F.count_if(F.col("status") != "FAILED").alias("ready"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.sum("source_count").alias("sources"), F.sum("error_count").alias("errors"))


@query("u2_alias_union", f"select id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(coalesce(aliases, ''), ',') || [coalesce(name, '')], lambda x: trim(x, ' ')), lambda x: x <> '' and lower(x) not in ('n/a', 'none', 'unknown')))), '|') as aliases from {TAGS}")
def u2_alias_union(spark: SparkSession, sf: str) -> DataFrame:
    """Two alias lists united, without what is to be ignored, sorted."""
    both = F.concat(F.split(F.coalesce("aliases", F.lit("")), ","), F.array(F.coalesce("name", F.lit(""))))
    kept = F.filter(F.transform(both, lambda x: F.trim(x)), lambda x: (x != "") & ~F.lower(x).isin("n/a", "none", "unknown"))
    return once(spark, sf, "tags", "aliases", "name").select("id", F.array_join(F.array_sort(F.array_distinct(kept)), "|").alias("aliases"))


@query("u4_set_equality", f"with a as (select run_id, list_sort(list_distinct(list(host))) as l from {SOURCES} where run_id is not null and host is not null group by 1), b as (select run_id, list_sort(list_distinct(list(host))) as l from {URLS} where run_id is not null and host is not null group by 1) select run_id, a.l = b.l as same, len(list_filter(b.l, lambda x: not list_contains(a.l, x)))::int as added from a join b using (run_id)")
def u4_set_equality(spark: SparkSession, sf: str) -> DataFrame:
    """Two sets of a run compared: equal or not, and how many are new."""
    side = lambda t, n: table(spark, sf, t).where("id is not null and run_id is not null and host is not null").groupBy("run_id").agg(F.array_sort(F.collect_set("host")).alias(n))
    both = side("sources", "a").join(side("urls", "b"), "run_id")
    return both.select("run_id", (F.col("a") == F.col("b")).alias("same"), F.size(F.array_except("b", "a")).alias("added"))


@query("u8_ids", f"select id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') as ids from (select id, list_filter(list_transform(regexp_split_to_array(coalesce(stored_id, '') || ',' || id || ';' || coalesce(stored_id, ''), '[,;]'), lambda x: try_cast(regexp_extract(trim(x), '^[0-9]+$') as bigint)), lambda x: x is not null) as l from {PERFORMERS})")
def u8_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The distinct ids of a list with mixed delimiters, in order of appearance."""
    packed = F.concat(F.coalesce("stored_id", F.lit("")), F.lit(","), F.col("id").cast("string"), F.lit(";"), F.coalesce("stored_id", F.lit("")))
    ids = F.array_distinct(F.filter(F.transform(F.split(packed, "[,;]"), lambda x: F.regexp_extract(F.trim(x), "^[0-9]+$", 0).try_cast("bigint")), lambda x: x.isNotNull()))
    return once(spark, sf, "performers", "stored_id").select("id", F.array_join(ids.cast("array<string>"), ",").alias("ids"))


@query("proj13_deny_list", f"select id, name from {SOURCES} where name is not null and replace(lower(trim(name)), ' ', '') not in ('boxone', 'numbox')")
def proj13_deny_list(spark: SparkSession, sf: str) -> DataFrame:
    s = once(spark, sf, "sources", "name").where("name is not null")
    return s.where(~F.replace(F.lower(F.trim("name")), F.lit(" "), F.lit("")).isin("boxone", "numbox"))


@query("proj14_blacklist", f"select run_id from {SOURCES} where run_id is not null group by run_id having not bool_or(coalesce(host, '') in ('numbox.example', 'tallybox.invalid'))")
def proj14_blacklist(spark: SparkSession, sf: str) -> DataFrame:
    """Runs none of whose handlers is on the list."""
    s = once(spark, sf, "sources", "run_id", "host").where("run_id is not null")
    return s.groupBy("run_id").agg(F.bool_or(F.coalesce("host", F.lit("")).isin("numbox.example", "tallybox.invalid")).alias("hit")).where("not hit").select("run_id")


@query("proj17_path_class", f"select id, case when starts_with(p, 'scene/') or starts_with(p, 'scenes/') or p = 'scene' then 'scene' when starts_with(p, 'performer') or starts_with(p, 'people') or starts_with(p, 'cast') then 'person' else 'other' end as class from (select id, substr(norm_key, strpos(norm_key, '/') + 1) as p from {URLS} where norm_key is not null)")
def proj17_path_class(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses by the start of their path."""
    u = once(spark, sf, "urls", "norm_key").where("norm_key is not null").select("id", F.expr("substr(norm_key, instr(norm_key, '/') + 1)").alias("p"))
    p = F.col("p")
    return u.select("id", F.when(p.startswith("scene/") | p.startswith("scenes/") | (p == "scene"), "scene").when(p.startswith("performer") | p.startswith("people") | p.startswith("cast"), "person").otherwise("other").alias("class"))


@query("proj21_folder_names", f"select id, coalesce(title <> '' and title not in ('.', '..') and not regexp_matches(title, '[\\\\/:*?\"<>|]'), false) as valid from {SCENES}")
def proj21_folder_names(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("title")
    return once(spark, sf, "scraped_scenes", "title").select("id", F.coalesce((t != "") & ~t.isin(".", "..") & ~t.rlike(r'[\\/:*?"<>|]'), F.lit(False)).alias("valid"))


@query("f20_clamp", f"select id, least(greatest(coalesce(source_count, 3), 1), 16) as workers from {RUNS}")
def f20_clamp(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, sf, "runs", "source_count").select("id", F.least(F.greatest(F.coalesce("source_count", F.lit(3)), F.lit(1)), F.lit(16)).alias("workers"))


@query("f26_clean_alias", f"select id, case when not contains(name, ' or ') then regexp_replace(name, '\\s*\\(.*$', '') end as alias from {PERFORMERS}")
def f26_clean_alias(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, sf, "performers", "name").select("id", F.when(~F.contains(F.col("name"), F.lit(" or ")), F.regexp_replace("name", r"\s*\(.*$", "")).alias("alias"))


@query("f28_minutes", f"select id, cast(duration // 60 as integer) as minutes, printf('%d:%02d', duration // 60, duration % 60) as clock from {SCENES} where duration is not null")
def f28_minutes(spark: SparkSession, sf: str) -> DataFrame:
    s = once(spark, sf, "scraped_scenes", "duration").where("duration is not null")
    return s.select("id", F.floor(F.col("duration") / 60).cast("int").alias("minutes"), F.format_string("%d:%02d", F.floor(F.col("duration") / 60).cast("int"), F.col("duration") % 60).alias("clock"))


@query("f41_preferred_text", f"select id, coalesce(nullif(trim(description), ''), nullif(trim(name), ''), '') as description from {TAGS}")
def f41_preferred_text(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda c: F.nullif(F.trim(c), F.lit(""))
    return once(spark, sf, "tags", "description", "name").select("id", F.coalesce(one("description"), one("name"), F.lit("")).alias("description"))


@query("f43_endpoints", f"select id, case when endpoint is not null then regexp_replace(lower(regexp_replace(trim(endpoint), '^[A-Za-z]+://', '')), '/+(graphql)?/*$', '') end as box from {SOURCES}")
def f43_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    """Endpoints in one notation."""
    return once(spark, sf, "sources", "endpoint").select("id", endpoint_id(F.col("endpoint")).alias("box"))


@query("x6_data_uris", "select sha256, sha256(data) = sha256 as intact, octet_length(data) as size from (select sha256, any_value(data) as data from images where sha256 is not null group by sha256)")
def x6_data_uris(spark: SparkSession, sf: str) -> DataFrame:
    """Blobs written as data addresses and read back: content, hash and size survive."""
    from weftline.sources.captures import decode_data_uri

    i = table(spark, sf, "images").where("sha256 is not null").select("sha256", "mime", "data").dropDuplicates(["sha256"])
    d = i.select("sha256", decode_data_uri(F.concat(F.lit("data:"), F.col("mime"), F.lit(";base64,"), F.base64("data"))).alias("d"))
    return d.select("sha256", (F.col("d.sha256") == F.col("sha256")).alias("intact"), F.octet_length("d.data").cast("bigint").alias("size"))


@query("x11_occurrences", f"select r.id, 'title' as kind, json_extract_string(raw_json, '$.title') as value from {RESULTS} r where json_extract_string(raw_json, '$.title') <> '' union all select r.id, 'code', json_extract_string(raw_json, '$.code') from {RESULTS} r where json_extract_string(raw_json, '$.code') <> ''")
def x11_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads flattened to one row per value."""
    r = once(spark, sf, "results", "raw_json").select("id", F.from_json("raw_json", "title string, code string").alias("p"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"p.{k}").alias("value")) for k in ("title", "code")])
    return r.select("id", F.explode(kinds).alias("x")).select("id", "x.kind", "x.value").where("value <> ''")


@query("x14_changes", f"select t.id, n.category as wanted from {TAGS} t join (select lower(split_part(name, ' ', 1)) as w, max(category) as category from {TAGS} where category is not null group by 1) n on n.w = lower(split_part(t.name, ' ', 1)) where t.category is distinct from n.category")
def x14_changes(spark: SparkSession, sf: str) -> DataFrame:
    """The change set of a selection: what already is as wanted is left out."""
    t = once(spark, sf, "tags", "name", "category").withColumn("w", F.lower(F.substring_index("name", " ", 1)))
    n = t.where("category is not null").groupBy("w").agg(F.max("category").alias("wanted"))
    return t.join(n, "w").where(~F.col("category").eqNullSafe(F.col("wanted"))).select("id", "wanted")


@query("k3_map_update", "select event_id, (json_extract(props, '$.k'))::int as k, 1 as seen from events")
def k3_map_update(spark: SparkSession, sf: str) -> DataFrame:
    """One key of a map column set, the others kept."""
    e = table(spark, sf, "events").select("event_id", F.from_json("props", "map<string,int>").alias("m"))
    m = sinks.set_key(F.col("m"), "seen", F.lit(1))
    return e.select("event_id", m.alias("m")).select("event_id", F.try_element_at("m", F.lit("k")).alias("k"), F.try_element_at("m", F.lit("seen")).alias("seen"))


@query("k10_changed", f"select host, id, url || ' -> ' || norm_key as line, row_number() over (partition by host order by url || ' -> ' || norm_key, id) as place, count(*) over (partition by host) as lines from {URLS} where host is not null and regexp_replace(lower(url), '^https?://(www\\.)?', '') <> norm_key")
def k10_changed(spark: SparkSession, sf: str) -> DataFrame:
    """A report of all addresses that are not in their normal form, by domain: one row a line, with its place and how many its domain has."""
    u = once(spark, sf, "urls", "host", "url", "norm_key").where("host is not null")
    changed = u.where(F.regexp_replace(F.lower("url"), r"^https?://(www\.)?", "") != F.col("norm_key"))
    return sinks.report_lines(changed.select("host", "id", F.concat(F.col("url"), F.lit(" -> "), F.col("norm_key")).alias("line")), "host", "line", "id")


@query("k15_json_rows", f"select id, '{{\"id\":' || id || ',\"status\":\"' || status || '\"}}' as output from {RUNS} where status is not null")
def k15_json_rows(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, sf, "runs", "status").where("status is not null").select("id", F.to_json(F.struct("id", "status")).alias("output"))


@query("t15_drift", f"with a as (select lower(title) as target, min(id) as owner from {SCENES} where title is not null and loaded_at < (select make_timestamp((epoch_us(min(loaded_at)) + epoch_us(max(loaded_at))) // 2) from scraped_scenes) group by 1), b as (select lower(title) as target, min(id) as owner from {SCENES} where title is not null group by 1) select target, case when a.owner = b.owner then 'SAME' else 'STATE_CHANGED' end as state from a join b using (target)")
def t15_drift(spark: SparkSession, sf: str) -> DataFrame:
    """A plan made in the middle of all arrivals, held against one made of all: claims whose owner changed."""
    s = table(spark, sf, "scraped_scenes")
    low, high = s.agg(F.min("loaded_at"), F.max("loaded_at")).first()
    half = low + (high - low) / 2 if low else None
    first = s.where("id is not null and title is not null").groupBy("id").agg(F.min("loaded_at").alias("seen"), F.min(F.lower("title")).alias("target"))
    a = first.where(F.col("seen") < F.lit(half)).groupBy("target").agg(F.min("id").alias("a"))
    b = first.groupBy("target").agg(F.min("id").alias("b"))
    return a.join(b, "target").select("target", F.when(F.col("a") == F.col("b"), "SAME").otherwise("STATE_CHANGED").alias("state"))


@query("w4_ordinals", f"select source_id, id, row_number() over (partition by source_id order by ordinal, id) - 1 as place from {RESULTS} where source_id is not null")
def w4_ordinals(spark: SparkSession, sf: str) -> DataFrame:
    r = once(spark, sf, "results", "source_id", "ordinal").where("source_id is not null")
    return r.select("source_id", "id", (F.row_number().over(Window.partitionBy("source_id").orderBy("ordinal", "id")) - 1).cast("bigint").alias("place"))


@query("f12_names_of", f"select id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') as names from (select id, list_filter(list_transform([coalesce(name, '')] || string_split(coalesce(aliases, ''), ','), lambda x: trim(x, ' ')), lambda x: x <> '') as l from {TAGS})")
def f12_names_of(spark: SparkSession, sf: str) -> DataFrame:
    """All names a record answers to, its own first."""
    both = F.concat(F.array(F.coalesce("name", F.lit(""))), F.split(F.coalesce("aliases", F.lit("")), ","))
    kept = F.array_distinct(F.filter(F.transform(both, lambda x: F.trim(x)), lambda x: x != ""))
    return once(spark, sf, "tags", "name", "aliases").select("id", F.array_join(kept, "|").alias("names"))


@query("f22_truthy", f"select id, coalesce(lower(trim(purged::varchar)) in ('true', 'yes', '1', 'on'), false) as purged from {RUNS}")
def f22_truthy(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, sf, "runs", "purged").select("id", text.truthy(F.col("purged")).alias("purged"))
