"""Sinks: content-addressed blobs, partial updates, cascades, reports. Each writes a new version and never edits in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add_blobs(existing: DataFrame, new: DataFrame, key: str = "sha256") -> DataFrame:
    """The store with blobs it did not have; a content is kept once."""
    return existing.unionByName(new.dropDuplicates([key]).join(existing.select(key), key, "left_anti"), allowMissingColumns=True)


def merge_update(current: DataFrame, updates: DataFrame, key: str, replace: list[str]) -> DataFrame:
    """current with the values of `updates` (one row a key) where it has them; absent and null values leave the old ones."""
    new = updates.select(key, *[F.col(c).alias(f"_{c}") for c in replace])
    joined = current.join(new, key, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in replace else F.col(c) for c in current.columns])


def purge(child: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """A child table without the rows of what is gone; rows with a null key stay."""
    return child.join(gone.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def set_key(m: Column, key: str, value: Column) -> Column:
    """A map column with one key set, all others as they are."""
    return F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(F.lit(key), value))


def drop_key(m: Column, key: str) -> Column:
    return F.map_filter(m, lambda k, _: k != key)


def add_foreign_id(ids: Column, endpoint: str, new_id: Column) -> Column:
    """An array of (endpoint, foreign_id) with one more, unless it is there or null."""
    there = F.exists(ids, lambda x: (x["endpoint"] == endpoint) & (x["foreign_id"] == new_id))
    one = F.struct(F.lit(endpoint).alias("endpoint"), new_id.alias("foreign_id"))
    return F.when(new_id.isNull() | F.coalesce(there, F.lit(False)), ids).otherwise(F.concat(F.coalesce(ids, F.array().cast("array<struct<endpoint:string,foreign_id:string>>")), F.array(one)))


def report_lines(changes: DataFrame, group: str, line: str, row_id: str) -> DataFrame:
    """A text report as rows: (group, row_id, line, place, lines), a group's lines in order, with their number on each.

    A group of any size is ranked in slices by the start of its lines; no group is one text or one task. Null lines are left
    out.
    """
    from weftline.operators.relational import rank_in_slices

    own = changes.where(F.col(line).isNotNull())
    ranked = rank_in_slices(own, [group], [F.substring(F.col(line), 1, 24)], [F.col(line), F.col(row_id)], "place")
    total = own.groupBy(group).agg(F.count("*").alias("lines"))
    return ranked.join(total, group).select(group, row_id, line, "place", "lines")
