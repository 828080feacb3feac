"""Problem 1: one group identifier for all mentions of performers that are connected by matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.clean import TRACKING_PARAMS, endpoint_id, int_id, url_key, uuid_id
from weftline.llm.groups import hash_to_min, star_links
from weftline.session import table


def with_source(spark: SparkSession, sf: str, mentions: DataFrame) -> DataFrame:
    """mentions(source_id, ...) with host, endpoint and page of their source, the latter two in one notation.

    A source that arrived twice gives its mentions twice, with the same content: whoever needs each once says so later.
    """
    sources = table(spark, sf, "sources").where("id is not null").select(F.col("id").alias("source_id"), "endpoint", "url_key", "host")
    known = mentions.join(sources, "source_id", "left")
    return known.withColumns({"endpoint": endpoint_id(F.col("endpoint")), "page": url_key(F.col("url_key"))}).drop("url_key")


def mention_keys(spark: SparkSession, sf: str) -> DataFrame:
    """(id, key): every key by which a mention of a performer can match another; repeated for repeated deliveries."""
    mentions = table(spark, sf, "performers").select("id", "source_id", int_id(F.col("stored_id")).alias("stored"), uuid_id(F.col("remote_site_id")).alias("remote"))
    known = with_source(spark, sf, mentions)
    # concat gives null where a part is null: a remote id without endpoint links nothing
    keys = F.array(F.concat(F.lit("stored "), F.col("stored")), F.concat(F.lit("remote "), F.col("endpoint"), F.lit(" "), F.col("remote")), F.concat(F.lit("page "), F.col("page")))
    return known.select("id", F.explode(F.array_compact(keys)).alias("key"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    groups = hash_to_min(star_links(mention_keys(spark, sf)))
    return groups.select(F.col("id").alias("performer_id"), "group_id")


def p1_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """How many groups there are of each size."""
    sizes = p1_found(spark, sf).groupBy("group_id").agg(F.count("*").alias("records"))
    return sizes.groupBy("records").agg(F.count("*").alias("groups"))


QUERIES = {"p1_found": p1_found, "p1_sizes": p1_sizes}

# The SQL: keys in one notation, then all that can be reached from each mention.
_BLANK = "' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(8203) || chr(8239) || chr(12288) || chr(65279)"
_NOTHING = "('', '-', '--', '?', '0', 'n/a', 'na', 'nil', 'nan', 'none', 'null', 'unknown', 'undefined', 'tba', 'tbd', 'n.a.', 'not listed', '00000000-0000-0000-0000-000000000000', '00000000000000000000000000000000')"


def _said(c: str) -> str:
    return f"case when lower(trim({c}, {_BLANK})) not in {_NOTHING} then trim({c}, {_BLANK}) end"


def _number(c: str) -> str:
    s = f"lower({_said(c)})"
    return f"(case when regexp_matches({s}, '^(?:[a-z]*[#:])?\\s*0*([0-9]+)(?:\\.0+)?$') then nullif(regexp_extract({s}, '^(?:[a-z]*[#:])?\\s*0*([0-9]+)(?:\\.0+)?$', 1), '0') else {s} end)"


_HEX = f"regexp_replace(lower({_said('p.remote_site_id')}), '^urn:uuid:|^uuid:|[{{}}\\-\\s]', '', 'g')"
_REMOTE = f"(case when regexp_matches({_HEX}, '^[0-9a-f]{{32}}$') then case when not regexp_matches({_HEX}, '^0+$') then {_HEX} end else {_number('p.remote_site_id')} end)"
_BOX = f"nullif(regexp_replace(regexp_replace(lower({_said('s.endpoint')}), '^[a-z]+://(?:www\\.)?|^www\\.|[?#].*$', '', 'g'), '\\.?(?::443|:80)?(?:/+(?:graphql)?/*)?$', ''), '')"
_HOSTED = "regexp_replace(regexp_replace(u, '^([a-z][a-z0-9+.\\-]*:)?//', '', 'i'), '#.*$', '')"
_PAGE = f"""(select id, case when host <> '' then host || case when path = '' then '/' else path end || case when query <> '' then '?' || query else '' end end as page from (select id,
regexp_replace(regexp_replace(lower(regexp_extract(h, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www\\.', '') as host, regexp_replace(regexp_replace(regexp_extract(h, '^[^/?]*([^?]*)', 1), '/+', '/', 'g'), '/$', '') as path,
array_to_string(list_sort(list_transform(list_filter(string_split(regexp_extract(h, '\\?(.*)$', 1), '&'), lambda x: x <> '' and lower(regexp_extract(x, '^([^=]*)', 1)) not in ({', '.join(repr(x) for x in TRACKING_PARAMS)})), lambda x: case when contains(x, '=') then x else x || '=' end)), '&') as query
from (select id, {_HOSTED} as h from (select id, {_said('url_key')} as u from sources where id is not null))))"""
_GROUPED = f"""with recursive s as (select s.id, any_value({_BOX}) as box, any_value(x.page) as page from sources s left join {_PAGE} x on x.id = s.id where s.id is not null group by s.id),
k as (select distinct p.id, unnest(['stored ' || {_number('p.stored_id')}, 'remote ' || s.box || ' ' || {_REMOTE}, 'page ' || s.page]) as key from performers p left join s on s.id = p.source_id where p.id is not null),
f as (select key, min(id) as low from k where key is not null group by key), e as (select distinct k.id as x, f.low as y from k join f using (key)), b as (select x, y from e union select y, x from e),
r(id, near) as (select x, x from b union select b.y, r.near from r join b on b.x = r.id), g as (select id as performer_id, min(near) as group_id from r group by id)"""
ORACLES = {
    "p1_found": f"{_GROUPED} select performer_id, group_id from g where group_id in (select group_id from g group by 1 having count(*) > 1)",
    "p1_sizes": f"{_GROUPED}, n as (select group_id, count(*) as records from g group by 1 having count(*) > 1) select records, count(*) as groups from n group by 1",
}
