"""Structured Streaming: running counts and timers, windows with late data, stateful progress, live log replay."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lakewright.operators import replay


def read_stream(spark: SparkSession, folder: str, schema, *, kind: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    """New files of a folder as a stream; durable, so nothing is dropped when a reader is slow."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(kind).load(folder)


def running_counts(events: DataFrame) -> DataFrame:
    """Counters and timers by type; use with output mode complete or update."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("peak"))


def windowed(events: DataFrame, size: str, *, slide: str | None = None, late: str = "1 hour", time: str = "ts") -> DataFrame:
    """Counts by event-time window; rows later than the watermark are let go (extension)."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    counted = events.withWatermark(time, late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n")


def sessions(events: DataFrame, gap: str, *, late: str = "1 hour", time: str = "ts") -> DataFrame:
    """Counts by user session (extension)."""
    counted = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def active_counts(events: DataFrame, start: str, *stops: str) -> DataFrame:
    """(key, active) after each batch: starts less stops, never below zero. events: key, event_type."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        active = state.get[0] if state.exists else 0
        for frame in frames:
            for kind in frame.event_type:
                active = active + 1 if kind == start else max(0, active - 1) if kind in stops else active
        state.update((active,))
        yield pd.DataFrame({"key": [key[0]], "active": [active]})

    return events.groupBy("key").applyInPandasWithState(step, "key string, active long", "active long", "update", GroupStateTimeout.NoTimeout)


def live_replay(log: DataFrame, history: Callable[[], DataFrame | None], publish: Callable[[DataFrame], None], fields: list[str], checkpoint: str) -> StreamingQuery:
    """Folds each batch's touched entities again from the whole log, so late operations count.

    history gives the operations stored so far, this batch's included; publish gets the new state of touched entities.
    """

    def fold(batch: DataFrame, _: int) -> None:
        touched = batch.select("entity", "id").distinct()
        stored = history()
        whole = batch if stored is None else stored.join(touched, ["entity", "id"], "left_semi")
        publish(replay.entity_state(whole, fields))

    return log.writeStream.option("checkpointLocation", checkpoint).foreachBatch(fold).trigger(availableNow=True).start()
