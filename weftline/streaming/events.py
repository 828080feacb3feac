"""Structured Streaming: watermarked windows, state machines with timeouts, idempotent sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A folder of parquet files as a stream, with the schema of what is there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def hourly(events: DataFrame, late: str | None = None) -> DataFrame:
    """events(ts, event_type, value) -> (hour, event_type, events, total), batch or stream; `late` is the watermark of a stream."""
    if late:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("hour"), "event_type", "events", "total")


def deduplicated(events: DataFrame, key: str, late: str) -> DataFrame:
    """Deliveries of a record counted once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def stale_runs(beats: DataFrame, timeout_minutes: int) -> DataFrame:
    """beats(run_id, ts, status): a stream -> (run_id, status, last): runs that finish, and FAILED for those silent too long."""
    span = timeout_minutes * 60_000

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"run_id": [key[0]], "status": ["FAILED"], "last": [pd.Timestamp(last, unit="ms")]})
            return
        last, ended = (state.get[0] if state.exists else 0), None
        for part in rows:
            last = max(last, int(part.ts.max().timestamp() * 1000))
            done = part[part.status != "RUNNING"]
            if len(done):
                ended = done.sort_values("ts").status.iloc[-1]
        if ended:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"run_id": [key[0]], "status": [ended], "last": [pd.Timestamp(last, unit="ms")]})
        else:
            state.update((last,))
            state.setTimeoutTimestamp(max(last + span, state.getCurrentWatermarkMs() + 1))

    keyed = beats.withWatermark("ts", "1 minute").groupBy("run_id")
    return keyed.applyInPandasWithState(step, "run_id bigint, status string, last timestamp", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def run_once(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Everything there is, in batches, each handed to `handle` with its number; a batch that comes again has the same number."""
    return df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch into a folder of its own, so that a repeated batch replaces itself."""

    def handle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return handle
