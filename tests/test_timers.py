"""Ordered counters: shuffled input gives what sorted input gives."""

import random

from pyspark.sql import functions as F

from lakewright.streaming import timers

SCHEMA = "key string, event_type string, ts timestamp, seq long"


def plain(rows, idle=None):
    active, last, out = {}, {}, []
    for key, kind, ms, seq in sorted(rows, key=lambda r: (r[0], r[2], r[3])):
        if idle is not None and key in last and ms >= last[key] + idle:
            active[key] = 0
        now = active.get(key, 0)
        active[key] = now + 1 if kind == "start" else max(0, now - 1) if kind == "stop" else now
        last[key] = ms
        out.append((key, ms, seq, active[key]))
    return sorted(out)


def drawn(n=120):
    draw = random.Random(6)
    return [(draw.choice("abc"), draw.choice(["start", "stop", "stop", "look"]), 1_700_000_000_000 + 1000 * draw.randint(0, 50), k) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(k, e, m, s) for k, e, m, s in rows], "key string, event_type string, ms long, seq long").select("key", "event_type", F.timestamp_millis("ms").alias("ts"), "seq")


def got(frame):
    return sorted((r.key, r.ms, r.seq, r.active) for r in frame.select("key", F.unix_millis("ts").alias("ms"), "seq", "active").collect())


def test_whole_table(spark):
    rows = drawn()
    assert got(timers.active_in_order(frame(spark, rows), "start", "stop")) == plain(rows)


def test_stream_in_any_order(spark, tmp_path):
    for name, value in timers.STORE.items():
        spark.conf.set(name, value)
    try:
        rows = drawn()
        random.Random(2).shuffle(rows)
        folder = str(tmp_path / "in")
        end = 1_700_000_000_000 + 10_000_000
        for part in (rows[:50], rows[50:], [("z", "look", end, 999)], [("z", "look", end + 1, 1000)]):
            frame(spark, part).coalesce(1).write.mode("append").parquet(folder)
            stream = spark.readStream.schema(SCHEMA).parquet(folder)
            counted = timers.ordered_counts(stream, "start", "stop", late="60 seconds")
            query = counted.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            query.awaitTermination(120)
        assert got(spark.read.parquet(str(tmp_path / "out")).where("key <> 'z'")) == plain(rows)
    finally:
        for name in timers.STORE:
            spark.conf.unset(name)
