"""Parent-child links to full hierarchies: path, level, root and descendants of every node; cycles apart.

Deterministic hash splitters cut every chain into short pieces. Each node first walks to its next splitter (or root);
the reduced graph of splitters is solved the same way; exact paths are the node's piece joined to its splitter's.
Walking is by pointer doubling. A walk that comes back to a node it holds is in or below a cycle: the cycle is the tail of
the walk from that node on, so cycles without any splitter need no bound on their length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import Written

#: One node in so many is a splitter.
SPLIT = 8


def _walk(state: DataFrame) -> DataFrame:
    """Doubles every open walk until it stops.

    state(id, ptr, seg, stop, loop): seg are the nodes from id up to but without ptr; `stop` says that the walk ends at
    ptr. -> the same, all stopped: loop is the smallest id of the cycle that the walk runs into, else null.
    """
    held = Written(state)
    while not held.df.where(~F.col("stop")).isEmpty():
        here, ahead = held.df, held.df.select(F.col("id").alias("ptr"), F.col("ptr").alias("far"), F.col("seg").alias("more"), F.col("stop").alias("halt"), F.col("loop").alias("ring"))
        seg = F.concat("seg", "more")
        moved = here.where(~F.col("stop")).join(ahead, "ptr").select("id", F.col("far").alias("ptr"), seg.alias("seg"), "halt", "ring")
        at = F.array_position("seg", F.col("ptr"))
        ring = F.when(F.col("ring").isNotNull(), F.col("ring")).when(at > 0, F.array_min(F.slice("seg", at.cast("int"), F.size("seg"))))
        moved = moved.select("id", "ptr", "seg", (F.col("halt") | (at > 0)).alias("stop"), ring.alias("loop"))
        step = Written(here.where("stop").unionByName(moved))
        held.drop()
        held = step
    return held.df


def resolve_tree(nodes: DataFrame, split: int = SPLIT) -> DataFrame:
    """nodes(id bigint, parent bigint), one row per id -> (id, root, level, path array<bigint>), path from the root.

    Nodes whose parent is null or unknown are roots (level 0). A node in or below a cycle (an own parent counts) has
    root = smallest id of the cycle, level -1 and an empty path. Null ids are left out; an empty table gives an empty one.
    """
    nodes = nodes.where("id is not null")
    known = nodes.select(F.col("id").alias("parent")).withColumn("found", F.lit(True))
    linked = nodes.join(known, "parent", "left").select("id", F.when(F.col("found"), F.col("parent")).alias("parent"))
    linked = Written(linked)
    is_root, splitter = F.col("parent").isNull(), F.pmod(F.xxhash64("id"), F.lit(split)) == 0
    marked = linked.df.select("id", "parent", is_root.alias("root"), (is_root | splitter).alias("cut"))
    # whether the parent is a cut node follows from its id, unless it is a root: join that in
    roots = linked.df.where(is_root).select(F.col("id").alias("parent"), F.lit(True).alias("top"))
    inner = marked.where(~F.col("root")).join(roots, "parent", "left").withColumn("top", F.coalesce("top", F.lit(False)))
    up_cut = F.col("top") | (F.pmod(F.xxhash64("parent"), F.lit(split)) == 0)
    near = _walk(inner.select("id", F.col("parent").alias("ptr"), F.array("id").alias("seg"), up_cut.alias("stop"), F.lit(None).cast("bigint").alias("loop")))
    tops = linked.df.where(is_root).select("id")
    # the reduced graph: splitters that are no roots, each pointing at its next splitter or root
    cuts = near.where(F.pmod(F.xxhash64("id"), F.lit(split)) == 0)
    reduced = cuts.join(tops.select(F.col("id").alias("ptr"), F.lit(True).alias("top")), "ptr", "left")
    far = _walk(reduced.select("id", "ptr", "seg", (F.coalesce("top", F.lit(False)) | F.col("loop").isNotNull()).alias("stop"), "loop"))
    solved = far.select(F.col("id").alias("ptr"), F.col("ptr").alias("end"), F.col("seg").alias("more"), F.col("loop").alias("ring"))
    whole = near.join(solved, "ptr", "left").select(
        "id", F.coalesce("end", "ptr").alias("end"), F.when(F.col("more").isNull(), F.col("seg")).otherwise(F.concat("seg", "more")).alias("seg"), F.coalesce("loop", "ring").alias("loop")
    )
    up = F.reverse(F.concat("seg", F.array("end")))
    deep = whole.select(
        "id", F.coalesce("loop", "end").alias("root"), F.when(F.col("loop").isNull(), F.size("seg")).otherwise(-1).alias("level"),
        F.when(F.col("loop").isNull(), up).otherwise(F.array().cast("array<bigint>")).alias("path"),
    )
    return deep.unionByName(tops.select("id", F.col("id").alias("root"), F.lit(0).alias("level"), F.array("id").alias("path")))


def descendants(tree: DataFrame) -> DataFrame:
    """tree of `resolve_tree` -> (id, descendant, steps): a row for each node below another; cycles have none.

    The result has as many rows as all paths have steps together; it is never gathered.
    """
    up = tree.where("level > 0").select(F.col("id").alias("descendant"), "level", F.posexplode(F.slice("path", 1, F.col("level"))).alias("at", "id"))
    return up.select("id", "descendant", (F.col("level") - F.col("at")).alias("steps"))


def subtree_figures(tree: DataFrame) -> DataFrame:
    """tree of `resolve_tree` -> (id, descendants, height) of every node that has a node below it; cycles have none.

    Counts double their reach each round: what lies less than twice as far below a node is what lies near it and what lies
    near the nodes at exactly that distance. One row a node, however deep the tree; as many rounds as its depth has bits.
    """
    path, level = F.col("path"), F.col("level")
    held = Written(tree.where("level >= 0").select("id", F.when(level > 0, F.get(path, level - 1)).alias("up"), F.lit(0).cast("bigint").alias("below"), F.lit(0).alias("height")))
    reach = 1
    while not held.df.where("up is not null").isEmpty():
        own = held.df
        added = own.where("up is not null").groupBy(F.col("up").alias("id")).agg(F.sum(F.col("below") + 1).alias("more"), F.max(F.col("height") + reach).alias("far"))
        jump = own.select(F.col("id").alias("up"), F.col("up").alias("next"))
        moved = own.join(jump, "up", "left").select("id", F.col("next").alias("up"), "below", "height")
        step = Written(moved.join(added, "id", "left").select("id", "up", (F.col("below") + F.coalesce("more", F.lit(0))).alias("below"), F.greatest("height", F.coalesce("far", F.lit(0))).cast("int").alias("height")))
        held.drop()
        held, reach = step, reach * 2
    return held.df.where("below > 0").select("id", F.col("below").alias("descendants"), "height")


def _opened(nodes: DataFrame, split: int) -> tuple[DataFrame, DataFrame]:
    """nodes -> the trees of all nodes, each cycle cut above its smallest id, which becomes the root; and what hangs on cycles.

    The second is (id, root, level, path, ring, entry): `ring` is the cycle from its smallest id down, `entry` how many nodes
    of it the path holds. They are the first of the path, so the walk up from the root goes through the others, last to first.
    """
    tree = Written(resolve_tree(nodes, split)).df
    loose = nodes.join(tree.where("level < 0").select("id", "root"), "id")
    cut = Written(resolve_tree(loose.select("id", F.when(F.col("id") != F.col("root"), F.col("parent")).alias("parent")), split)).df
    rings = cut.join(loose.where("id = root").select(F.col("parent").alias("id")), "id").select("root", F.col("path").alias("ring"))
    hung = cut.join(rings, "root").withColumn("entry", F.size(F.array_intersect("ring", "path")))
    return tree.where("level >= 0").unionByName(cut), hung


def all_descendants(nodes: DataFrame, split: int = SPLIT) -> DataFrame:
    """nodes of `resolve_tree` -> (id, descendant, steps): a row for each node whose walk up comes to another, cycles included.

    Steps are those of the first time. Nodes of a cycle are below each other, never below themselves. As many rows as all
    walks have steps together; they are never gathered.
    """
    whole, hung = _opened(nodes, split)
    size, entry = F.size("ring"), F.col("entry")
    round_ = hung.select(F.col("id").alias("descendant"), (F.col("level") + size - entry).alias("most"), F.posexplode(F.slice("ring", entry + 1, size - entry)).alias("at", "id"))
    return descendants(whole).unionByName(round_.select("id", "descendant", (F.col("most") - F.col("at")).alias("steps")))


def all_figures(nodes: DataFrame, split: int = SPLIT) -> DataFrame:
    """nodes of `resolve_tree` -> (id, descendants, height) of every node, cycles included: how many rows `all_descendants` has for it, and the most steps of one.

    Nodes with nothing below them have 0 and 0. All of a cycle and what hangs on it is below each node of the cycle; the
    furthest is the furthest before the node on the way down the cycle, or from it on.
    """
    whole, hung = _opened(nodes, split)
    # the deepest that comes upon the cycle at each of its nodes; place 1 is the smallest id
    deepest = hung.groupBy("root", "entry").agg(F.max("level").alias("far"), F.max(F.size("ring")).alias("long"), F.max(F.when(F.size("path") == F.col("entry"), F.col("id"))).alias("id"), F.count("*").alias("n"))
    down, place = Window.partitionBy("root").orderBy("entry"), F.col("entry") - 1
    before = F.max("far").over(down.rowsBetween(Window.unboundedPreceding, -1)) + F.col("long") - place
    onward = F.max("far").over(Window.partitionBy("root").orderBy(F.desc("entry")).rowsBetween(Window.unboundedPreceding, 0)) - place
    members = deepest.groupBy("root").agg(F.sum("n").alias("all"))
    circling = deepest.withColumn("reach", F.greatest(before, onward)).join(members, "root").select("id", (F.col("all") - 1).alias("others"), "reach")
    known = whole.select("id").join(subtree_figures(whole), "id", "left").join(circling, "id", "left")
    return known.select("id", F.coalesce("others", "descendants", F.lit(0)).cast("bigint").alias("descendants"), F.coalesce("reach", "height", F.lit(0)).cast("int").alias("height"))


def marked_above(nodes: DataFrame) -> DataFrame:
    """nodes(id, parent, marked boolean), one row an id -> (id) of those that are marked or have a marked node above them.

    Marks are handed down twice as far each round. A round that marks no further node is the last: on the way to a mark
    further up lies a node as far from it as that round reaches. So circles end it, too. Null marks are none; unknown
    parents are no parents.
    """
    nodes = nodes.where("id is not null").select("id", "parent", F.coalesce("marked", F.lit(False)).alias("marked"))
    known = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("found"))
    digest = {"marked": F.count_if("marked"), "open": F.count_if(F.col("up").isNotNull() & ~F.col("marked"))}
    held = Written(nodes.join(known, "parent", "left").select("id", F.when(F.col("found"), F.col("parent")).alias("up"), "marked"), **digest)
    last = None
    while held.seen["open"] and held.seen["marked"] != last:
        last = held.seen["marked"]
        ahead = held.df.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("marked").alias("over"))
        step = Written(held.df.join(ahead, "up", "left").select("id", F.col("next").alias("up"), (F.col("marked") | F.coalesce("over", F.lit(False))).alias("marked")), **digest)
        held.drop()
        held = step
    return held.df.where("marked").select("id")
