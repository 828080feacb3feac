"""The queries of the training-data problems that belong to the core: 2, 3, 4, 6 and 7."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.clean import hash_id, stripped
from weftline.operators import hierarchy, moments, multivalue, quantities, references
from weftline.session import Written, table


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    parts = [("performers.aliases", "performers"), ("tags.aliases", "tags")]
    found = [multivalue.split_packed(table(spark, sf, t), "id", "aliases").select(F.lit(field).alias("field"), "row_id", "pos", "value") for field, t in parts]
    return found[0].unionByName(found[1])


def _source_hosts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "sources").select(F.col("id").alias("source_id"), "host").where("source_id is not null").groupBy("source_id").agg(F.max("host").alias("host"))


def _zones(spark: SparkSession, sf: str) -> DataFrame:
    """Zones of the sites; a site without one gets it from its plain local times against the arrival of their records."""
    scenes = table(spark, sf, "scraped_scenes")
    local = F.regexp_extract("date", r"^\s*(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2})?)\s*$", 1).try_cast("timestamp_ntz")
    observed = scenes.select("host", local.alias("local"), F.col("loaded_at").cast("timestamp_ntz").alias("arrived"))
    return moments.zones_for(table(spark, sf, "sites"), observed)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    zones = _zones(spark, sf)
    dates = moments.normalise_moments(table(spark, sf, "scraped_scenes"), "id", "date", "host", zones)
    performers = table(spark, sf, "performers").select("id", "source_id", "birthdate").where("birthdate is not null").join(_source_hosts(spark, sf), "source_id", "left")
    births = moments.normalise_moments(performers, "id", "birthdate", "host", zones)
    return dates.select(F.lit("date").alias("field"), "row_id", "normal_form").unionByName(births.select(F.lit("birthdate").alias("field"), "row_id", "normal_form"))


BODY = ("bust", "waist", "hips", "band")
CONVERSIONS = {"height": quantities.MM, "weight": quantities.GRAMS} | {part: {u: quantities.MM[u] for u in ("mm", "cm", "in")} for part in BODY}


def _stated_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Every size once: (row_id, source, entity, part, fixed, bare)."""
    people = table(spark, sf, "scraped_performers").where("id is not null").select("id", "host", "name", "height", "weight").dropDuplicates(["id"])
    entity = F.lower(stripped(F.col("name")))
    h, w = quantities.height_mm(F.col("height")), quantities.weight_g(F.col("weight"))
    sized = F.array(*[F.struct(F.lit(p).alias("part"), fixed.alias("fixed"), bare.alias("bare")) for p, (fixed, bare) in (("height", h), ("weight", w))])
    body = people.select(F.col("id").alias("row_id"), F.col("host").alias("source"), entity.alias("entity"), F.explode(sized).alias("x")).select("row_id", "source", "entity", "x.*")
    sets = table(spark, sf, "measurements").where("id is not null and raw is not null").select("id", "scraped_performer_id", "raw", "units").dropDuplicates(["id"])
    places = sets.select("id", F.col("scraped_performer_id").alias("person"), _label(F.col("units")).alias("label"), F.explode(quantities.body_sizes(F.col("raw"))).alias("x")).select("id", "person", "label", "x.*")
    factor = lambda u: F.when(u == "mm", 1).when(u == "cm", 10).when(u == "in", 25.4).cast("decimal(18,6)")
    # a label holds where the value can have its unit
    over = F.col("number") > quantities.OVER_CM
    unit = F.coalesce(F.col("unit"), F.when((F.col("label") == "cm") & over, "cm").when((F.col("label") == "in") & ~over, "in"))
    named = people.select(F.col("id").alias("person"), F.col("host").alias("source"), entity.alias("entity"))
    stated = places.select("id", "person", "part", (F.col("number") * factor(unit)).cast("decimal(18,6)").alias("fixed"), F.when(unit.isNull(), F.col("number")).alias("bare"))
    stated = stated.join(named, "person", "left").select(F.col("id").alias("row_id"), "source", "entity", "part", "fixed", "bare")
    return body.unionByName(stated).where("fixed is not null or bare is not null")


def _label(c: Column) -> Column:
    s = F.lower(F.btrim(c))
    return F.when(s.rlike("^(metric|cms?|centimet|metrisch)"), "cm").when(s.rlike('^(imperial|in(ch|ches)?$|"|us$|uk$)'), "in")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    sizes = _stated_sizes(spark, sf)
    # the exact check: where the value decides by a stated bound, it decides
    bare, part = F.col("bare"), F.col("part")
    ruled = F.when(part.isin(*BODY), F.when(bare > quantities.OVER_CM, bare * 10).otherwise(bare * F.lit("25.4").cast("decimal(18,6)")))
    ruled = ruled.when((part == "weight") & (bare <= quantities.UP_TO_KG), bare * 1000).when((part == "weight") & (bare < 1000), bare * F.lit(quantities.GRAMS["lb"]).cast("decimal(18,8)"))
    # read once, used by every round of the estimate
    sizes = Written(sizes.withColumn("ruled", ruled)).df
    found = quantities.convert_sizes(sizes.drop("ruled"), CONVERSIONS)
    checked = sizes.where("ruled is not null").select("part", "row_id", quantities._half_up(F.col("ruled")).alias("exact"))
    return found.join(checked, ["part", "row_id"], "full_outer").select("part", "row_id", F.coalesce("exact", "amount").alias("amount"))


def p4_graph(spark: SparkSession, sf: str) -> DataFrame:
    """How often the source graph alone gives the amount that the stated bounds give, for each part with such bounds."""
    sizes = Written(_stated_sizes(spark, sf)).df
    bare, part = F.col("bare"), F.col("part")
    exact = F.when(part.isin(*BODY), F.when(bare > quantities.OVER_CM, bare * 10).otherwise(bare * F.lit("25.4").cast("decimal(18,6)"))).when((part == "weight") & (bare <= quantities.UP_TO_KG), bare * 1000)
    checked = sizes.where("bare is not null").select("part", "row_id", quantities._half_up(exact).alias("exact")).where("exact is not null")
    both = checked.join(quantities.convert_sizes(sizes, CONVERSIONS), ["part", "row_id"], "left")
    return both.groupBy("part").agg(F.count("*").alias("bare"), F.count_if(F.col("amount") == F.col("exact")).alias("agree"))


def _links(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "sources").where("id is not null").groupBy("id").agg(F.max("parent_source_id").alias("parent"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    links = _links(spark, sf)
    tree = hierarchy.resolve_tree(links).withColumn("text", F.array_join(F.col("path").cast("array<string>"), "/")).drop("path")
    children = table(spark, sf, "sources").where("id is not null and parent_source_id is not null").select("id").distinct()
    sources = children.join(tree, "id").select(F.lit("source").alias("node"), F.col("id").alias("node_id"), F.col("root").alias("root_id"), "level", F.col("text").alias("path"))
    urls = table(spark, sf, "urls").where("id is not null and discovered_by_result_id > 0").groupBy("id").agg(F.max("discovered_by_result_id").alias("result"))
    results = table(spark, sf, "results").where("id is not null").groupBy(F.col("id").alias("result")).agg(F.max("source_id").alias("source"))
    below = results.where("source is not null").join(tree.withColumnRenamed("id", "source"), "source")
    leaves = urls.join(below, "result").select(F.lit("url").alias("node"), F.col("id").alias("node_id"), F.col("root").alias("root_id"), F.when(F.col("level") < 0, -1).otherwise(F.col("level") + 1).alias("level"), F.col("text").alias("path"))
    return sources.unionByName(leaves)


def p6_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """How many descendants each source has, and how deep they reach."""
    return hierarchy.subtree_figures(hierarchy.resolve_tree(_links(spark, sf)))


def p6_below(spark: SparkSession, sf: str) -> DataFrame:
    """The descendants of each source, one row each, those in and below cycles included."""
    return hierarchy.all_descendants(_links(spark, sf))


def p6_figures(spark: SparkSession, sf: str) -> DataFrame:
    """How many descendants each source has, and how deep they reach, cycles and sources without any included."""
    return hierarchy.all_figures(_links(spark, sf))


REFERENCES = [
    ("result_images.image_sha256", "result_images", lambda: hash_id(F.col("image_sha256")), "images", lambda: hash_id(F.col("sha256")), False),
    ("urls.discovered_by_result_id", "urls", lambda: F.when(F.col("discovered_by_result_id") > 0, F.col("discovered_by_result_id")), "results", lambda: F.col("id"), True),
    ("sources.run_id", "sources", lambda: F.when(F.col("run_id") > 0, F.col("run_id")), "runs", lambda: F.col("id"), True),
]


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    purged = table(spark, sf, "purge_log")
    out = None
    for field, referring, key, target, target_key, ordered in REFERENCES:
        refs = references.first_seen(table(spark, sf, referring), "id", key())
        targets = table(spark, sf, target).select(target_key().alias("key"), F.col("loaded_at").alias("seen"))
        gone = purged.where(F.lower(F.btrim("table_name")) == target)
        gone = gone.select((F.btrim("row_key").try_cast("bigint") if ordered else hash_id(F.col("row_key"))).alias("key"))
        part = references.orphans(refs, targets, gone, ordered).select(F.lit(field).alias("ref_field"), "row_id", F.date_format("seen", "yyyy-MM").alias("period"), "kind")
        out = part if out is None else out.unionByName(part)
    return out


def p7_by_period(spark: SparkSession, sf: str) -> DataFrame:
    """Orphan references per field, month and kind."""
    return p7_found(spark, sf).groupBy("ref_field", "period", "kind").agg(F.count("*").alias("references"))


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p4_graph": p4_graph, "p6_found": p6_found, "p6_descendants": p6_descendants, "p6_below": p6_below, "p6_figures": p6_figures, "p7_found": p7_found, "p7_by_period": p7_by_period}

# The SQL of problems 6 and 7. Trees from their roots down; what is never reached is in or below a cycle, and the nodes of a
# cycle are those that come upon themselves.
_TREE = """recursive l as (select id, max(parent_source_id) as parent from sources where id is not null group by id), e as (select l.id, p.id as parent from l left join l p on p.id = l.parent),
t(id, root, level, path) as (select id, id, 0, id::varchar from e where parent is null union all select e.id, t.root, t.level + 1, t.path || '/' || e.id from e join t on e.parent = t.id),
r(id, up) as (select id, parent from e where id not in (select id from t) union select r.id, e.parent from r join e on e.id = r.up),
c as (select id, min(up) filter (up in (select id from r where id = up)) as root from r group by id), a as (select id, root, level, path from t union all select id, root, -1, '' from c)"""
# Every walk up, until it comes to a node that it holds.
_WALKS = """recursive l as (select id, max(parent_source_id) as parent from sources where id is not null group by id), e as (select l.id, p.id as parent from l join l p on p.id = l.parent),
w(id, up, steps, held) as (select id, parent, 1, [id] from e union all select w.id, e.parent, w.steps + 1, list_append(w.held, w.up) from w join e on e.id = w.up where not list_contains(w.held, w.up)),
b as (select up as id, id as descendant, steps from w where not list_contains(held, up))"""
ORACLES = {
    "p6_found": f"""with {_TREE} select 'source' as node, a.id as node_id, a.root as root_id, a.level, a.path from a where a.id in (select id from sources where parent_source_id is not null)
union all select 'url', u.id, a.root, case when a.level < 0 then -1 else a.level + 1 end, a.path from (select id, max(discovered_by_result_id) as result from urls where id is not null and discovered_by_result_id > 0 group by id) u join (select id, max(source_id) as source from results group by id) r on r.id = u.result join a on a.id = r.source""",
    "p6_descendants": f"with {_TREE}, d as (select level, string_split(path, '/') as p from t), x as (select unnest(p)::bigint as id, unnest(range(len(p))) as k, level from d) select id, count(*) - 1 as descendants, max(level - k)::int as height from x group by id having count(*) > 1",
    "p6_below": f"with {_WALKS} select id, descendant, steps from b",
    "p6_figures": f"with {_WALKS} select l.id, count(b.id) as descendants, coalesce(max(b.steps), 0)::int as height from l left join b on b.id = l.id group by l.id",
}
_DIGEST = "nullif(nullif(regexp_replace(regexp_replace(case when lower(trim({0}, ' ' || chr(9))) in ('', '-', '--', '?', '0', 'n/a', 'na', 'nil', 'nan', 'none', 'null', 'unknown', 'undefined', 'tba', 'tbd', 'n.a.', 'not listed') then '' else lower(trim({0}, ' ' || chr(9))) end, '^[a-z0-9_\\-]+[:=]', ''), '[\\s\\-:\"'']', '', 'g'), ''), 'none')"
_ORPHANS = " union all ".join(
    f"""select '{field}' as ref_field, f.id as row_id, strftime(f.seen, '%Y-%m') as period, case when t.seen is not null then 'late' when g.key is not null then 'deleted' else 'missing' end as kind
from (select id, max({key}) as key, min(loaded_at) as seen from {referring} where id is not null group by id) f left join (select {own} as key, min(loaded_at) as seen from {target} group by 1) t on t.key = f.key left join (select distinct {purged} as key from purge_log where lower(trim(table_name)) = '{target}') g on g.key = f.key
where f.key is not null and (t.seen is null or t.seen > f.seen)"""
    for field, referring, key, target, own, purged in (
        ("result_images.image_sha256", "result_images", _DIGEST.format("image_sha256"), "images", _DIGEST.format("sha256"), _DIGEST.format("row_key")),
        ("urls.discovered_by_result_id", "urls", "case when discovered_by_result_id > 0 then discovered_by_result_id end", "results", "id", "try_cast(trim(row_key) as bigint)"),
        ("sources.run_id", "sources", "case when run_id > 0 then run_id end", "runs", "id", "try_cast(trim(row_key) as bigint)"),
    )
)
ORACLES |= {"p7_found": _ORPHANS, "p7_by_period": f"select ref_field, period, kind, count(*) as \"references\" from ({_ORPHANS}) group by 1, 2, 3"}
