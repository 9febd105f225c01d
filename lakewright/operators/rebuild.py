"""Keeping the replayed state of an operation log, without replaying all of it.

Stored are the entities' state, a mark of each log file (its length and time, or whatever tells that it has changed), and which entities each file
names. When files have changed, come or gone, only the entities that they name, or named, are replayed, from the operations of the files that
name them; the others' state stays. The result is that of replaying everything.

Decisions: `skip` if no mark has changed, `conflict` if a changed file has merge markers (nothing is done), else `rebuild`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.operators import replay
from lakewright.sources.versions import Versions

#: What a conflict leaves at the beginning of a line.
MARKERS = r"^(<{7} |={7}$|>{7} )"


@dataclass(frozen=True)
class Log:
    """files: (file, mark). lines(files) and operations(files) give (file, value) and replay's operations of a frame of files."""

    files: DataFrame
    lines: Callable[[DataFrame], DataFrame]
    operations: Callable[[DataFrame], DataFrame]


def log_of_folder(spark: SparkSession, folder: str) -> Log:
    """The .jsonl files of a folder; their contents are read only when they are asked for."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").load(folder)
    files = found.select(F.col("_metadata.file_path").alias("file"), F.concat_ws(":", "length", "modificationTime").alias("mark"))

    def paths(wanted: DataFrame) -> list[str]:
        return sorted(r.file for r in wanted.select("file").collect())

    def lines(wanted: DataFrame) -> DataFrame:
        chosen = paths(wanted)
        return spark.read.text(chosen).selectExpr(replay.NAME, "value") if chosen else spark.createDataFrame([], "file string, value string")

    return Log(files, lines, lambda wanted: replay.read_files(spark, paths(wanted)))


@dataclass(frozen=True)
class Outcome:
    """What was decided, how many operations were read, how many entities were replayed, and the version of the state."""

    decision: str
    operations: int
    entities: int
    version: int


class Replayed:
    """State in a folder, kept in step with a log."""

    def __init__(self, spark: SparkSession, folder: str, fields: list[str]):
        self.spark, self.versions, self.fields = spark, Versions(spark, folder), fields

    def _stored(self, name: str, version: int | None = None) -> DataFrame | None:
        state = self.versions.read(version)[1]
        return self.spark.read.parquet(f"{state['path']}/{name}") if state else None

    def state(self, version: int | None = None) -> DataFrame | None:
        return self._stored("state", version)

    def refresh(self, log: Log) -> Outcome:
        number = self.versions.read()[0]
        marks, named, before = (self._stored(n) for n in ("marks", "named", "state"))
        path = self.versions.fresh("replayed")
        log.files.write.parquet(f"{path}/marks")
        files = self.spark.read.parquet(f"{path}/marks")
        if marks is None:
            changed, lost = files.select("file"), files.select("file").limit(0)
        else:
            both = files.join(marks.select("file", F.col("mark").alias("was")), "file", "full_outer")
            changed, lost = both.where("mark IS NOT NULL AND NOT (mark <=> was)").select("file"), both.where("mark IS NULL").select("file")
        changed.withColumn("lost", F.lit(False)).unionByName(lost.withColumn("lost", F.lit(True))).write.parquet(f"{path}/changed")
        touched = self.spark.read.parquet(f"{path}/changed")
        changed = touched.where("NOT lost").select("file")
        if marks is not None and touched.isEmpty():
            self.versions.remove(path)
            return Outcome("skip", 0, 0, number)
        if not log.lines(changed).where(F.col("value").rlike(MARKERS)).isEmpty():
            self.versions.remove(path)
            return Outcome("conflict", 0, 0, number)
        fresh = log.operations(changed).select("file", "entity", "id").distinct()
        if named is None:
            fresh.write.parquet(f"{path}/named")
            replay.entity_state(log.operations(changed), self.fields).write.parquet(f"{path}/state")
            read, entities = log.operations(changed).count(), self.spark.read.parquet(f"{path}/named").select("entity", "id").distinct().count()
        else:
            other = named.join(F.broadcast(touched.select("file")), "file", "left_anti")
            other.unionByName(fresh).write.parquet(f"{path}/named")
            index = self.spark.read.parquet(f"{path}/named")
            met = index.join(F.broadcast(changed), "file").unionByName(named.join(F.broadcast(touched.select("file")), "file")).select("entity", "id").distinct()
            met.write.parquet(f"{path}/met")
            met = self.spark.read.parquet(f"{path}/met")
            wanted = index.join(met, ["entity", "id"], "left_semi").select("file").distinct()
            operations = log.operations(wanted)
            again = replay.entity_state(operations.join(met, ["entity", "id"], "left_semi"), self.fields)
            before.join(met, ["entity", "id"], "left_anti").unionByName(again).write.parquet(f"{path}/state")
            read, entities = operations.count(), met.count()
        self.versions.commit(number + 1, {"path": path})
        return Outcome("rebuild", read, entities, number + 1)
