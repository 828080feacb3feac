"""Pairwise matches consolidated into groups: hash-to-min over rows, never over gathered sets.

The cluster set C(v) of a vertex is kept as links (a, b), a < b: v with each record of its set. In each round every vertex
sends its set to the set's minimum and that minimum to all of the set, until every group is a star around its minimum; a
group that is one is set aside at once. A set that holds a third of all rows is spread over many partitions: minima are
pre-aggregated, and the join back to the rows is one row per vertex on one side, which adaptive execution splits where a
vertex is hot.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import Written


def star_links(keyed: DataFrame) -> DataFrame:
    """keyed(id bigint, key string) -> (a, b): each record linked to the smallest record of its key.

    A key of n records gives n - 1 links, not n * n. Null keys and ids link nothing; repeated rows count once.
    """
    # keys of any length as 128 bits: narrow rows are shuffled and sorted
    narrow = F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), "key").alias("k2")
    held = Written(keyed.where("id is not null and key is not null").select("id", *narrow))
    keyed = held.df
    least = keyed.groupBy("k1", "k2").agg(F.min("id").alias("b"), F.max("id").alias("last")).where("b < last")
    links = Written(keyed.join(least, ["k1", "k2"]).where("id <> b").select(F.col("id").alias("a"), "b").distinct())
    held.drop()
    return links.df


#: What a link is: one that may still move, one of a group that is settled, the one of these that also speaks for the group's least record.
OPEN, SETTLED, SPEAKS = 0, 1, 2


def _round(links: DataFrame) -> DataFrame:
    """links(a, b, leaf) -> (a, b, leaf, state), a < b, once each: every record passes its neighbours on to the least of them.

    A record that is greater than its only neighbour is a leaf. Where the least of its neighbourhood had only leaves before
    this round, the group is a star, which no later round changes.
    """
    ends = [F.struct(F.col(v).alias("v"), F.col(u).alias("u"), "leaf") for v, u in ("ab", "ba")]
    both = links.select(F.explode(F.array(*ends)).alias("x")).select("x.*")
    near = both.groupBy("v").agg(F.min("u").alias("low"), F.max("u").alias("high"), F.min("leaf").alias("leaves"))
    v, u, low = (F.col(x) for x in ("v", "u", "low"))
    # one link for each neighbour: it to the least record, or, for the least record itself, this one to it
    moved = F.when(v < low, F.struct(v.alias("a"), u.alias("b"))).when(u == low, F.struct(u.alias("a"), v.alias("b"))).otherwise(F.struct(low.alias("a"), u.alias("b")))
    state = F.when((v < low) & (F.col("leaves") == 1), F.when(u == low, SPEAKS).otherwise(SETTLED)).otherwise(OPEN)
    leaf = ((low < v) & (low == F.col("high"))).cast("int")
    sent = both.drop("leaf").join(near, "v").select(moved.alias("to"), leaf.alias("leaf"), state.alias("state"))
    return sent.groupBy(F.col("to.a").alias("a"), F.col("to.b").alias("b")).agg(F.max("leaf").alias("leaf"), F.max("state").alias("state"))


def hash_to_min(links: DataFrame) -> DataFrame:
    """links(a bigint, b bigint) -> (id, group_id): every linked record with the smallest record it is connected to.

    Records without a link to another have no row. Repeated, reversed and self links change nothing; links with a null are
    left out; no links give no rows. Groups that are settled take no part in further rounds.
    """
    left = links.where("a is not null and b is not null and a <> b").select("a", "b", F.lit(0).alias("leaf"))
    settled, held = [], None
    while True:
        # the numbers are taken as the rows are written
        step = Written(_round(left), open=F.count_if(F.col("state") == OPEN), settled=F.count_if(F.col("state") != OPEN))
        if held:
            held.drop()
        if step.seen["settled"] or not step.seen["open"]:
            settled.append(step.df.where(F.col("state") != OPEN))
        held = None if step.seen["settled"] else step
        if not step.seen["open"]:
            break
        left = step.df.where(F.col("state") == OPEN).select("a", "b", "leaf")
    stars = reduce(DataFrame.unionByName, settled)
    ends = F.when(F.col("state") == SPEAKS, F.array("b", "a")).otherwise(F.array("b"))
    return stars.select(F.explode(ends).alias("id"), F.col("a").alias("group_id"))
