"""References to records that do not exist, per field and month.

Integer parent keys are sorted and compressed into contiguous runs; each distinct referred-to key is matched as of the
run that starts before it, and is an orphan beyond the run's end. Digest keys have no order worth compressing: each is a
run of its own, for which the as-of match is equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys per bucket: runs end at bucket bounds, so that a bucket's window holds at most twice as many rows, however large the table.
BUCKET = 1 << 16


def key_runs(targets: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """targets(key bigint, seen timestamp), any number of rows a key -> runs(bucket, run_start, run_end, first, last).

    `first`/`last`: bounds of the first arrival of the run's keys. Null keys are left out.
    """
    keys = targets.where("key is not null").groupBy("key").agg(F.min("seen").alias("seen"))
    keys = keys.withColumn("bucket", F.floor(F.col("key") / bucket))
    by_bucket = Window.partitionBy("bucket").orderBy("key")
    islands = keys.withColumn("island", F.col("key") - F.row_number().over(by_bucket))
    return islands.groupBy("bucket", "island").agg(
        F.min("key").alias("run_start"), F.max("key").alias("run_end"), F.min("seen").alias("first"), F.max("seen").alias("last")
    ).drop("island")


def _asof_runs(keys: DataFrame, runs: DataFrame, bucket: int) -> DataFrame:
    """keys(key, seen): distinct; adds run_end and last of the run that starts at or before the key in its bucket."""
    probe = keys.select(F.floor(F.col("key") / bucket).alias("bucket"), F.col("key").alias("at"), F.lit(1).alias("side"), "key", "seen", F.lit(None).cast("struct<run_end:bigint,last:timestamp_ntz>").alias("run"))
    build = runs.select("bucket", F.col("run_start").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("bigint").alias("key"), F.lit(None).cast(keys.schema["seen"].dataType).alias("seen"), F.struct("run_end", F.col("last").cast("timestamp_ntz").alias("last")).alias("run"))
    order = Window.partitionBy("bucket").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    return build.unionByName(probe).withColumn("run", F.last("run", ignorenulls=True).over(order)).where("side = 1").select("key", "seen", "run")


def orphans(refs: DataFrame, targets: DataFrame, deleted: DataFrame, ordered: bool = True, bucket: int = BUCKET) -> DataFrame:
    """Report every reference whose target is missing, deleted or came later.

    refs(row_id, key, seen), one row per referring record; targets(key, seen), any number of rows a key; deleted(key).
    `seen` is the first arrival. -> (row_id, seen, kind): `late` if the target exists but arrived after the reference,
    `deleted` if it does not exist and was deleted, else `missing`. Null keys refer to nothing and are left out; so are
    references that hold. An empty targets table makes every reference an orphan. Rows are judged by distinct key, so
    a key that a third of all rows refer to is one row until the verdict is joined back.
    """
    refs = refs.where("key is not null")
    used = refs.groupBy("key").agg(F.min("seen").alias("seen"))
    if ordered:
        judged = _asof_runs(used, key_runs(targets, bucket), bucket)
        there = F.col("run").isNotNull() & (F.col("key") <= F.col("run.run_end"))
        # in a run whose keys all came before the first reference nothing can be late
        judged = judged.select("key", there.alias("there"), (there & (F.col("seen").cast("timestamp_ntz") >= F.col("run.last"))).alias("sound"))
        open_keys = judged.where(~F.coalesce("sound", F.lit(False)))
    else:
        open_keys = used.select("key", F.lit(None).cast("boolean").alias("there"))
    arrivals = targets.where("key is not null").join(open_keys.select("key"), "key", "left_semi").groupBy("key").agg(F.min("seen").alias("arrived"))
    gone = deleted.where("key is not null").select("key").distinct().withColumn("purged", F.lit(True))
    verdict = open_keys.select("key").join(arrivals, "key", "left").join(gone, "key", "left")
    kind = F.when(F.col("arrived").isNotNull(), F.when(F.col("arrived") > F.col("seen"), "late")).when(F.col("purged"), "deleted").otherwise("missing")
    return refs.join(verdict, "key").select("row_id", "seen", kind.alias("kind")).where("kind is not null")


def first_seen(df: DataFrame, row_id: str, key: Column, seen: str = "loaded_at") -> DataFrame:
    """One row per record id with its first arrival; deliveries of a record repeat its content."""
    return df.select(F.col(row_id).alias("row_id"), key.alias("key"), F.col(seen).alias("seen")).where("row_id is not null").groupBy("row_id").agg(F.max("key").alias("key"), F.min("seen").alias("seen"))
