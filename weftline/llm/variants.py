"""Problem 5: mentions of one performer under names that are spelled differently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.clean import int_id, let, nullish, uuid_id
from weftline.llm.groups import hash_to_min, star_links
from weftline.llm.matches import with_source
from weftline.llm.names import average_linkage, fold_name, gram_weights, only_bearers, similar_pairs, with_bearers, year_bearers
from weftline.operators.moments import parse_moment, plain_date
from weftline.operators.multivalue import split_packed
from weftline.session import Written, table


def read_mark(c: Column) -> tuple[Column, Column, Column]:
    """What stands behind a name to tell its bearers apart, in one notation (ordinals in Roman numerals), and the year or country it states."""
    said = F.lower(nullish(c))
    mark = F.regexp_replace(F.regexp_replace(F.regexp_replace(said, "^1$", "i"), "^2$", "ii"), "^3$", "iii")
    year = F.when(said.rlike("^(19|20)[0-9]{2}$"), said.cast("int"))
    land = F.when(said.rlike("^[a-z]{2}$") & ~said.rlike("^[ivx]+$"), F.upper(said))
    return mark, year, land


def mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions: id, name, folded name, aliases, evidence (born, gender, country, mark, the year it states) and strong keys.

    A mention or source that arrived again has equal rows; all that follows counts ids, not rows.
    """
    sites = table(spark, sf, "sites").select("host", "date_order")
    once = table(spark, sf, "performers").where("id is not null").select("id", "source_id", "stored_id", "remote_site_id", "name", "gender", "birthdate", "country", "aliases", "disambiguation")
    known = with_source(spark, sf, once).join(sites, "host", "left")
    # the day as it is written: a birthday has no time zone
    written_day = F.regexp_extract("birthdate", r"^\s*['\"]?(\d{4}-\d{2}-\d{2})[T ]\d", 1).try_cast("date")
    # no date is without digits
    form = F.when(F.col("birthdate").rlike("[0-9]"), parse_moment(F.col("birthdate"), F.col("date_order"), F.lit("UTC")))
    born = F.coalesce(plain_date(F.col("birthdate"), F.col("date_order")), written_day, let(form, lambda x: F.when(F.length(x) >= 10, F.substring(x, 1, 10))).try_cast("date"))
    mark, year, land = read_mark(F.col("disambiguation"))
    sex = F.substring(F.upper(nullish(F.col("gender"))), 1, 1)
    # a page's last part names the performer with a number of their own, whichever site it is on; behind it a count of pages
    slug = F.regexp_extract(F.col("page"), r"/([a-z][a-z0-9\-]*?-\d+)(?:-\d+)?$", 1)
    keys = F.array_compact(F.array(
        F.concat(F.lit("stored "), int_id(F.col("stored_id"))),
        F.concat(F.lit("remote "), F.col("endpoint"), F.lit(" "), uuid_id(F.col("remote_site_id"))),
        F.concat(F.lit("page "), F.col("page")),
        F.concat(F.lit("slug "), F.when(slug != "", slug)),
    ))
    return known.select("id", "name", "aliases", fold_name(F.col("name")).alias("folded"), born.alias("born"), sex.alias("gender"), F.coalesce(F.upper(nullish(F.col("country"))), land).alias("country"), mark.alias("mark"), year.alias("year"), keys.alias("keys"))


def same_performer(spark: SparkSession, sf: str) -> DataFrame:
    """(id, name, cluster) of every mention, once: the operator behind p5."""
    held = Written(mentions(spark, sf))
    people = held.df
    sure = people.select("id", F.explode("keys").alias("key"))
    # one birthday and one full name, be it a name or an alias; initials are no full names
    full = F.col("value").rlike(r"\p{L}{3,}[^\p{L}/]+(?:.*[^\p{L}/])?\p{L}{3,}") & ~F.contains(F.col("value"), F.lit("/"))
    listed = split_packed(people.where("length(trim(aliases)) > 2"), "id", "aliases", ["born"], once=False).where(full)
    # middle names are left out: they differ from alias to alias
    ends = F.regexp_replace(fold_name(F.col("value")), r"^(\S+) .*?(\S+)$", "$1 $2")
    also = Written(listed.select(F.col("row_id").alias("id"), "born", ends.alias("folded")).distinct()).df
    dated = people.where("folded is not null").select("id", "born", "folded").unionByName(also).where("born is not null")
    dated = dated.select("id", F.concat_ws(" ", F.lit("day"), "born", "folded").alias("key"))
    # mentions that nothing else tells apart are one unit from the start, so that a frequent name is not compared with itself
    bare = people.where("born is null and size(keys) = 0 and folded is not null").select("id", F.concat_ws("|", F.lit("bare"), "folded", F.coalesce("gender", F.lit("")), F.coalesce("country", F.lit("")), F.coalesce("mark", F.lit(""))).alias("key"))
    groups = hash_to_min(star_links(sure.unionByName(dated).unionByName(bare)))
    placed = Written(people.drop("keys", "aliases").join(groups, "id", "left").withColumn("unit", F.coalesce("group_id", "id")).drop("group_id")).df
    held.drop()
    units = Written(placed.groupBy("unit").agg(F.max("born").alias("born"), F.max("gender").alias("gender"), F.max("country").alias("country"), F.max("mark").alias("mark"), F.coalesce(F.year(F.max("born")), F.max("year")).alias("year"))).df
    known_as = also.select("id", "folded").join(placed.select("id", "unit"), "id").select("unit", F.col("folded").alias("name"))
    spelled = placed.where("folded is not null").select("unit", F.col("folded").alias("name")).unionByName(known_as).distinct()
    profiles = Written(with_bearers(spelled.join(units, "unit"))).df
    idf = gram_weights(profiles.select("name").distinct())
    links = similar_pairs(profiles, idf).unionByName(only_bearers(profiles)).unionByName(year_bearers(profiles)).groupBy("a", "b").agg(F.max("score").alias("score"))
    links = Written(links).df
    clusters = average_linkage(links, units, profiles=profiles, idf=idf)
    return placed.join(clusters, "unit", "left").select("id", "name", F.coalesce("cluster", "unit").alias("cluster")).distinct()


def variant_pairs(clustered: DataFrame) -> DataFrame:
    """clustered(id, name, cluster) -> (id_a, id_b), id_a < id_b: records of one cluster whose names are different strings.

    Pairs of different names come first and are then expanded, so records of one name are never paired with each other.
    """
    named = clustered.where("name is not null")
    spelled = named.select("cluster", "name").distinct()
    x, y = spelled.select("cluster", F.col("name").alias("name_x")), spelled.select("cluster", F.col("name").alias("name_y"))
    differing = x.join(y, "cluster").where("name_x < name_y")
    left = named.select("cluster", F.col("name").alias("name_x"), F.col("id").alias("one"))
    right = named.select("cluster", F.col("name").alias("name_y"), F.col("id").alias("two"))
    both = differing.join(left, ["cluster", "name_x"]).join(right, ["cluster", "name_y"])
    return both.select(F.least("one", "two").alias("id_a"), F.greatest("one", "two").alias("id_b"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return variant_pairs(same_performer(spark, sf))


def p5_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """One row per mention: its cluster and the number of records in it under another name."""
    clustered = Written(same_performer(spark, sf)).df
    sizes = clustered.groupBy("cluster").agg(F.count("*").alias("all"))
    same = clustered.groupBy("cluster", "name").agg(F.count("*").alias("same"))
    return clustered.join(sizes, "cluster").join(same, ["cluster", "name"], "left").select("id", "cluster", (F.col("all") - F.coalesce("same", F.lit(1))).alias("links"))


QUERIES = {"p5_found": p5_found, "p5_clusters": p5_clusters}
ORACLES: dict[str, str] = {}
