"""Counters over events in the order of their times, with timers, however their rows arrive.

`ordered_counts` keeps rows that have come until the watermark has passed their time. A timer at a row's time then takes what is due in the
order of (ts, seq), so the clamp at zero gives what it would give over sorted input; a key that has had no event for `idle` is let go by
another timer, and begins anew at zero. `active_in_order` is the same over a whole table, as window sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

#: What the stream's session needs: state with timers lives in this store.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
COUNTED = StructType([StructField("key", StringType()), StructField("ts", TimestampType()), StructField("seq", LongType()), StructField("active", LongType())])
EXPIRED = StructType([StructField("key", StringType()), StructField("ts", TimestampType())])


def active_in_order(events: DataFrame, start: str, *stops: str) -> DataFrame:
    """(key, ts, seq, active) of every event (key, event_type, ts, seq). A count that is never let below zero is the plain sum less the lowest
    point, below zero, that the sum has had."""
    order = Window.partitionBy("key").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col("event_type") == start, 1).when(F.col("event_type").isin(*stops), -1).otherwise(0)
    summed = events.select("key", "ts", "seq", F.sum(step).over(order).alias("s"))
    return summed.select("key", "ts", "seq", (F.col("s") - F.least(F.lit(0), F.min("s").over(order))).alias("active"))


class OrderedCounter(StatefulProcessor):
    def __init__(self, start: str, stops: tuple[str, ...], idle_ms: int):
        self.starts, self.stops, self.idle = start, stops, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms long, seq long, event_type string")
        self.active = handle.getValueState("active", "active long, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            ms = (frame.ts.astype("int64") // {"ns": 1_000_000, "us": 1_000, "ms": 1}[frame.ts.dt.unit]).tolist()
            new = [(m, int(s), str(e)) for m, s, e in zip(ms, frame.seq, frame.event_type, strict=True) if m > passed]
            if new:
                self.waiting.appendList(new)
                for m in {m for m, *_ in new}:
                    self.handle.registerTimer(m)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        now, later = [r for r in rows if r[0] <= due], [r for r in rows if r[0] > due]
        active, last = self.active.get() if self.active.exists() else (0, 0)
        out = []
        for ms, seq, kind in now:
            active = active + 1 if kind == self.starts else max(0, active - 1) if kind in self.stops else active
            out.append((key[0], pd.Timestamp(ms, unit="ms"), seq, active))
        if now:
            last = now[-1][0]
            self.waiting.put(later) if later else self.waiting.clear()
            self.active.update((active, last))
            self.handle.registerTimer(last + self.idle)
        elif self.active.exists() and due >= last + self.idle:
            self.active.clear()
        yield pd.DataFrame(out, columns=COUNTED.names) if out else pd.DataFrame()

    def close(self) -> None:
        pass


def ordered_counts(events: DataFrame, start: str, *stops: str, late: str = "1 hour", idle_ms: int = 30 * 86_400_000) -> DataFrame:
    """(key, ts, seq, active) of every event of a stream (key string, event_type, ts timestamp, seq long), once the watermark has passed it; times
    count in milliseconds. For output mode append, in a session with STORE."""
    seen = events.withWatermark("ts", late)
    return seen.groupBy("key").transformWithStateInPandas(OrderedCounter(start, stops, idle_ms), COUNTED, "append", "eventTime")
