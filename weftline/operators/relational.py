"""Relational operators of the run store, each a composition of built-in DataFrame operations.

Every operator names columns by argument and touches no others, so extra columns and name clashes do no harm. Nulls in
keys follow SQL: they join nothing, and form one group where stated.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group of `keys` by `order`; null keys form a group.

    By an aggregate over a struct, not a window: it combines before the shuffle, so a hot group is never gathered in
    one task. The order must be ascending comparable columns (negate or flip for descending) that tell rows apart.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min(F.struct(F.struct(*order).alias("o"), F.struct(*rest).alias("r"))).alias("m"))
    return picked.select(*keys, "m.r.*").select(*df.columns)


def latest_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each group by `order` (nulls count as earliest)."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max(F.struct(F.struct(*order).alias("o"), F.struct(*rest).alias("r"))).alias("m"))
    return picked.select(*keys, "m.r.*").select(*df.columns)


def top_per(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """At most k rows of each group, with their place `rank` from 1; Spark prunes groups before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def rank_in_slices(df: DataFrame, keys: list[str], slices: list[Column], order: list[Column], rank: str = "rank", total: Column | None = None, sum_as: str = "running") -> DataFrame:
    """df with the place `rank` of each row within its key, from 1, though no key is gathered in one task.

    `slices` are the leading parts of the order, coarse enough to be few and fine enough to be small (say, an id by the
    hundred thousand): rows of an earlier slice come before those of a later one. Rows are ranked within (key, slice), and
    the rows of earlier slices are added from one row a slice. With `total`, its running sum up to the row is `sum_as`.
    Without keys the whole table is ranked. Nulls come first; the order must tell rows apart.
    """
    names = [f"_s{i}" for i in range(len(slices))]
    cut = df.withColumns(dict(zip(names, slices, strict=True))).withColumn("_one", F.lit(1))
    value = total if total is not None else F.lit(0)
    per = cut.withColumn("_v", value).groupBy(*keys, *names).agg(F.count("*").alias("_n"), F.sum("_v").alias("_t"))
    up_to = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    before = per.select(*keys, *names, F.coalesce(F.sum("_n").over(up_to), F.lit(0)).alias("_before"), F.coalesce(F.sum("_t").over(up_to), F.lit(0)).alias("_sum"))
    within = Window.partitionBy(*keys, *names).orderBy(*order)
    own = cut.withColumn("_own", F.row_number().over(within))
    if total is not None:
        own = own.withColumn("_run", F.sum(total).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    l, r = own.alias("l"), before.alias("r")
    same = F.lit(True)
    for c in [*keys, *names]:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    out = [F.col(f"l.{c}") for c in df.columns] + [(F.col("_own") + F.col("_before")).cast("bigint").alias(rank)]
    if total is not None:
        out.append((F.col("_run") + F.col("_sum")).alias(sum_as))
    return l.join(r, same).select(*out)


def new_only(new: DataFrame, existing: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Insert-or-ignore: rows of `new` whose key is not in `existing`, the first by `order` of each key."""
    return first_per(new.join(existing.select(*keys).distinct(), keys, "left_anti"), keys, order)


def orphans(parents: DataFrame, key: str, *references: DataFrame) -> DataFrame:
    """Rows of `parents` that none of the one-column `references` mentions; nulls among references do not count."""
    refs = None
    for r in references:
        one = r.toDF(key).where(F.col(key).isNotNull())
        refs = one if refs is None else refs.unionByName(one)
    return parents.join(refs.distinct(), key, "left_anti")


def priority_match(left: DataFrame, key: str, stages: list[tuple[DataFrame, str]]) -> DataFrame:
    """left(key, ...), stages: (df(key, id), name) from strong to weak -> left with `match_id`, `stage` of the first stage that has the key.

    Within a stage the smallest id counts. Keys that no stage has get nulls.
    """
    known = None
    for i, (df, name) in enumerate(stages):
        one = df.select(F.col(key), F.struct(F.lit(i).alias("p"), F.col("id").alias("match_id"), F.lit(name).alias("stage")).alias("m"))
        known = one if known is None else known.unionByName(one)
    best = known.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("m").alias("m")).select(key, "m.match_id", "m.stage")
    return left.join(best, key, "left")


def unique_match(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left with `match_id` where exactly one id of right(key, id) answers to the key, and `matches`, how many do."""
    per = right.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct("id").alias("matches"), F.min("id").alias("one"))
    out = left.join(per, key, "left")
    return out.select(*left.columns, F.coalesce("matches", F.lit(0)).alias("matches"), F.when(F.col("matches") == 1, F.col("one")).alias("match_id"))


def merge_values(cells: DataFrame, group: list[str], key: str, order: list[str], value: str, source: str) -> DataFrame:
    """N sources' cells merged: one option per distinct key of a group, spelled as its first source spells it.

    -> (group..., key, value, sources): sources are distinct, in order of their first appearance. Cells with a null key
    are no option.
    """
    own = cells.where(F.col(key).isNotNull()).select(*group, F.col(key).alias("_k"), F.struct(*order).alias("_o"), F.col(value).alias("_v"), F.col(source).alias("_s"))
    firsts = own.groupBy(*group, "_k", "_s").agg(F.min("_o").alias("_first"), F.min(F.struct("_o", "_v")).alias("_spelled"))
    merged = firsts.groupBy(*group, "_k").agg(F.min("_spelled").alias("_spelled"), F.array_sort(F.collect_list(F.struct("_first", "_s"))).alias("_l"))
    return merged.select(*group, F.col("_k").alias(key), F.col("_spelled._v").alias(value), F.transform("_l", lambda x: x["_s"]).alias("sources"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """old/new(key, content), one row a key -> (key, change): new, removed, content or unchanged. Null content equals null."""
    a, b = old.select(key, F.col(content).alias("was"), F.lit(True).alias("in_old")), new.select(key, F.col(content).alias("now"), F.lit(True).alias("in_new"))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("in_old").isNull(), "new").when(F.col("in_new").isNull(), "removed").when(F.col("was").eqNullSafe(F.col("now")), "unchanged").otherwise("content")
    return both.select(key, change.alias("change"))


def asof_join(left: DataFrame, right: DataFrame, by: str, at: str, value: str, bucket_seconds: int = 86_400) -> DataFrame:
    """left(by, at, ...) with `value` of the last row of right(by, at, value) at or before it.

    Rows are laid into time buckets of a key; within a bucket one sorted pass finds the last value, and buckets carry over
    the last value of the buckets before, found on one row a bucket. No key is gathered whole. Ties in `right` go to the
    greatest value; nulls in by or at match nothing.
    """
    slot = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / bucket_seconds)
    r = right.where(F.col(by).isNotNull() & F.col(at).isNotNull()).groupBy(by, at).agg(F.max(value).alias("_v")).withColumn("_slot", slot(at))
    ends = r.groupBy(by, "_slot").agg(F.max(F.struct(at, "_v")).alias("_e"))
    rest = left.columns
    l = left.withColumn("_slot", slot(at))
    slots = ends.select(by, "_slot", "_e").unionByName(l.where(F.col(by).isNotNull() & F.col("_slot").isNotNull()).select(by, "_slot").distinct().withColumn("_e", F.lit(None).cast(ends.schema["_e"].dataType)))
    slots = slots.groupBy(by, "_slot").agg(F.max("_e").alias("_e"))
    carried = slots.withColumn("_c", F.last("_e", ignorenulls=True).over(Window.partitionBy(by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1))).select(by, "_slot", F.col("_c._v").alias("_c"))
    events = r.select(by, "_slot", F.col(at).alias("_t"), F.lit(0).alias("_side"), "_v", F.lit(None).cast(left.schema.simpleString()).alias("_row"))
    asks = l.select(by, "_slot", F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_v"].dataType).alias("_v"), F.struct(*rest).alias("_row"))
    order = Window.partitionBy(by, "_slot").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = events.unionByName(asks).withColumn("_last", F.last("_v", ignorenulls=True).over(order)).where("_side = 1")
    return seen.join(carried, [by, "_slot"], "left").select("_row.*", F.coalesce("_last", "_c").alias(value))


def fold_chain(links: DataFrame, seeds: DataFrame, rounds: int | None = None) -> DataFrame:
    """Breadth-first waves: links(parent, child), seeds(id) -> (id, depth) of all that can be reached, least depth.

    Ends with an empty wave; an error if more than `rounds` waves have rows.

    One anti join a wave keeps what was seen before; each wave is written to the shared folder, so lineage stays short.
    """
    from weftline.session import Written

    seen = Written(seeds.select("id").where("id is not null").distinct().withColumn("depth", F.lit(0)))
    wave = seen
    edges = Written(links.where("parent is not null and child is not null").select("parent", "child").distinct()).df
    for depth in count(1):
        step = edges.join(wave.df.select(F.col("id").alias("parent")), "parent").select(F.col("child").alias("id")).distinct()
        fresh = Written(step.join(seen.df.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)))
        if fresh.df.isEmpty():
            break
        if rounds is not None and depth > rounds:
            raise ValueError(f"more than {rounds} waves")
        seen, wave = Written(seen.df.unionByName(fresh.df)), fresh
    return seen.df


def fall_unless_vouched(nodes: DataFrame, mentioned: DataFrame) -> DataFrame:
    """nodes(id, run_id, parent, page, failed), one row an id, mentioned(run_id, page, voucher) -> (id) of all nodes that fall.

    A failed node falls. A child of a fallen one of its run falls too, unless a node that does not fall mentions its page;
    one without page falls. This is the least such set, so no order matters. Nodes that nothing vouches for fall with the
    node above them: they are one segment, found by pointer doubling, and only what is vouched for takes rounds.
    """
    from weftline.operators.hierarchy import resolve_tree
    from weftline.session import Written

    nodes = Written(nodes.where("id is not null")).df
    up = nodes.select(F.col("id").alias("parent"), "run_id")
    below = nodes.where("not failed").join(up, ["parent", "run_id"]).select("id", "run_id", "parent", "page")
    vouched = Written(below.join(mentioned, ["run_id", "page"]).select("id", "parent", "voucher").distinct()).df
    free = below.join(vouched.select("id"), "id", "left_anti").select("id", "parent")
    tree = Written(resolve_tree(nodes.select("id").join(free, "id", "left")).select("id", "root")).df
    of = lambda c: tree.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root"))
    # a voucher that is no node of these can't fall
    open_nodes = Written(vouched.join(of("parent"), "parent").join(of("voucher"), "voucher", "left").select("id", "parent_root", "voucher_root").distinct()).df
    fallen = Written(nodes.where("failed").select("id"))
    while True:
        down = fallen.df.select(F.col("id").alias("root"))
        standing = open_nodes.join(down.withColumnRenamed("root", "voucher_root"), "voucher_root", "left_anti").select("id")
        ripe = open_nodes.join(down.withColumnRenamed("root", "parent_root"), "parent_root", "left_semi").select("id").distinct()
        fresh = Written(ripe.join(standing, "id", "left_anti").join(fallen.df, "id", "left_anti"))
        if fresh.df.isEmpty():
            return tree.join(down, "root", "left_semi").select("id")
        fallen = Written(fallen.df.unionByName(fresh.df))


def spread_labels(keyed: DataFrame, ids: DataFrame) -> DataFrame:
    """keyed(id, key), ids(id) -> (id, group_id): the smallest id each record is connected to through keys.

    A key of n records enters as n - 1 links to its least record. Every round moves a link (v, u) down to the least record
    that u is linked to, then ties all that v is linked to to the least of them, until each record has one link, to the least
    of its group. Rounds grow with the logarithm of the longest chain, links never become more, and no table outlives its
    round. Records without keys are their own group; keys of records that are not in ids count for nothing.
    """
    from weftline.session import Written

    ids = ids.where("id is not null").distinct()
    # keys of any length as 128 bits: narrow rows are shuffled and sorted
    narrow = F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), "key").alias("k2")
    links = Written(keyed.where("id is not null and key is not null").join(ids, "id", "left_semi").select("id", *narrow))
    least = links.df.groupBy("k1", "k2").agg(F.min("id").alias("u"), F.max("id").alias("last")).where("u < last")
    # the number and a digest of the links are taken as they are written: equal ones mean that nothing changed
    digest = {"n": F.count(F.lit(1)), "h": F.bit_xor(F.xxhash64("v", "u"))}
    held, before = Written(links.df.join(least, ["k1", "k2"]).where("id > u").select(F.col("id").alias("v"), "u").distinct(), **digest), None
    links.drop()
    while held.seen["n"] and held.seen != before:
        before = held.seen
        below = held.df.groupBy(F.col("v").alias("u")).agg(F.min("u").alias("low"))
        down = Written(held.df.join(below, "u", "left").select("v", F.coalesce("low", "u").alias("u")))
        held.drop()
        low = down.df.groupBy("v").agg(F.min("u").alias("low"))
        tied = down.df.join(low, "v").select("low", F.explode(F.array("v", "u")).alias("v")).where("v > low")
        held = Written(tied.select("v", F.col("low").alias("u")).distinct(), **digest)
        down.drop()
    return ids.join(held.df.withColumnRenamed("v", "id"), "id", "left").select("id", F.coalesce("u", "id").alias("group_id"))
