"""Structured Streaming forms: event-time windows, sessions, idempotent sinks and leases with timers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lamella.functions.workers import workers_import

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, per_trigger: int = 8) -> DataFrame:
    """A stream of the Parquet files in a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).parquet(path)


def window_counts(events: DataFrame, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of each type and window; rows later than ``late`` are left out on a stream."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of each user, closed after a gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def rate_limited(events: DataFrame, limit: int, width: str = "60 seconds", late: str = "1 minute") -> DataFrame:
    """Users above ``limit`` events in a window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select(F.col("w.start").alias("start"), "user_id", "n")


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """The first delivery of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def leases(events: DataFrame, seconds: int, late: str = "10 minutes") -> DataFrame:
    """Per user: the last heartbeat, and expired leases by an event-time timer."""
    workers_import(events.sparkSession)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "last": [pd.Timestamp(last, unit="us")], "state": ["expired"]})
            return
        newest = max((int(b["ts"].max().value // 1000) for b in batches if len(b)), default=0)
        newest = max(newest, state.get[0] if state.exists else 0)
        state.update((newest,))
        state.setTimeoutTimestamp(max(newest // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]], "last": [pd.Timestamp(newest, unit="us")], "state": ["held"]})

    kept = events.withWatermark("ts", late).select("user_id", "ts")
    return kept.groupBy("user_id").applyInPandasWithState(run, "user_id long, last timestamp, state string", "last long", "update", GroupStateTimeout.EventTimeTimeout)


def appended_by_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink in which a repeated batch replaces itself, so each is stored once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
