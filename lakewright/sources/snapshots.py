"""Versioned datasets: every commit names its files in manifests that hold what is in each file.

A manifest has a row for each Parquet file: its rows and the least and greatest value of each key. A version is a list of manifests; an append
adds one, a deletion writes only those files anew that can hold what is deleted. A reader asks the manifests first and opens only files whose
values can match; manifests are tables themselves, so asking them is a Spark job however many files there are. Commits go through
`versions.Versions`: of two writers the second one finds its number taken; an append then takes the next one, a deletion gives up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakewright.sources.versions import Conflict, Versions

#: How often an append tries to take the next number.
TRIES = 20

Ranges = dict[str, tuple[object, object]]


class Dataset:
    """`keys` are the columns whose values are known of each file, and by which appended rows are put into files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.versions = spark, Versions(spark, folder)

    @classmethod
    def create(cls, spark: SparkSession, folder: str, like: DataFrame, keys: list[str], *, exist_ok: bool = False) -> Dataset:
        """An empty dataset with the columns of `like`. One that is there already is an error, or is taken as it is if it has these columns and keys."""
        made = cls(spark, folder)
        try:
            made.versions.commit(1, {"keys": keys, "schema": like.schema.jsonValue(), "manifests": [], "made": "create"})
        except Conflict:
            first = made.versions.read(1)[1]
            if not exist_ok or first["keys"] != keys or StructType.fromJson(first["schema"]) != like.schema:
                raise
        return made

    def _at(self, version: int | None) -> tuple[int, dict]:
        n, state = self.versions.read(version)
        if state is None:
            raise ValueError(f"no dataset in {self.versions.folder}")
        return n, state

    def history(self) -> DataFrame:
        """(version, made, files, rows) of every version."""
        rows = []
        for n in self.versions.numbers():
            state = self.versions.read(n)[1]
            rows.append((n, state["made"], sum(m["files"] for m in state["manifests"]), sum(m["rows"] for m in state["manifests"])))
        return self.spark.createDataFrame(rows, "version int, made string, files long, rows long")

    def _write(self, rows: DataFrame, keys: list[str], files: int | None) -> dict | None:
        """Writes rows and their manifest; None if there are none."""
        path = self.versions.fresh("data")
        dealt = rows.repartitionByRange(*([files] if files else []), *keys) if keys else rows
        dealt.sortWithinPartitions(*keys).write.option("compression", "zstd").parquet(f"{path}/files")
        ends = [F.struct(*(f(k).alias(k) for k in keys)).alias(name) for name, f in (("low", F.min), ("high", F.max))] if keys else []
        stored = self.spark.read.schema(rows.schema).parquet(f"{path}/files").withColumn("_file_", F.input_file_name())
        stored.groupBy(F.col("_file_").alias("file")).agg(F.count("*").alias("rows"), *ends).coalesce(1).write.parquet(f"{path}/manifest")
        size = self.spark.read.parquet(f"{path}/manifest").agg(F.count("*").alias("files"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).head()
        return {"path": f"{path}/manifest", "files": size.files, "rows": size.rows} if size.rows else None

    def append(self, rows: DataFrame, *, files: int | None = None) -> int:
        """Adds rows; the version that has them."""
        n, state = self._at(None)
        wanted = StructType.fromJson(state["schema"]).names
        if sorted(rows.columns) != sorted(wanted):
            raise ValueError(f"columns {', '.join(wanted)} were wanted")
        manifest = self._write(rows.select(*wanted), state["keys"], files)
        for _ in range(TRIES):
            try:
                self.versions.commit(n + 1, {**state, "manifests": [*state["manifests"], *([manifest] if manifest else [])], "made": "append"})
                return n + 1
            except Conflict:
                n, state = self._at(None)
        raise Conflict(f"other writers took {TRIES} numbers of {self.versions.folder}")

    def manifest(self, version: int | None = None) -> DataFrame | None:
        """(file, rows, low, high) of every file of a version."""
        parts = [self.spark.read.parquet(m["path"]) for m in self._at(version)[1]["manifests"]]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def _may_hold(self, ranges: Ranges) -> Column:
        tests = [F.lit(True)]
        for key, (low, high) in ranges.items():
            tests += [F.col("high")[key] >= F.lit(low)] * (low is not None) + [F.col("low")[key] <= F.lit(high)] * (high is not None)
        return reduce(lambda a, b: a & b, tests)

    def files(self, version: int | None = None, ranges: Ranges | None = None) -> list[str]:
        """The files that can hold keys within the ranges (both ends belong to them; None is open)."""
        _, state = self._at(version)
        if unknown := set(ranges or {}) - set(state["keys"]):
            raise ValueError(f"nothing is known of {', '.join(sorted(unknown))}")
        entries = self.manifest(version)
        return [] if entries is None else sorted(r.file for r in entries.where(self._may_hold(ranges or {})).select("file").collect())

    def read(self, version: int | None = None, ranges: Ranges | None = None) -> DataFrame:
        """The rows of a version, or else of the last one, whose keys are within the ranges."""
        schema = StructType.fromJson(self._at(version)[1]["schema"])
        files = self.files(version, ranges)
        rows = self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)
        for key, (low, high) in (ranges or {}).items():
            rows = rows.where(F.lit(True) if low is None else F.col(key) >= F.lit(low)).where(F.lit(True) if high is None else F.col(key) <= F.lit(high))
        return rows

    def delete(self, ranges: Ranges, where: Column | None = None) -> int:
        """Removes the rows within the ranges (that pass a test, too); files that can't hold such rows stay as they are. The new version."""
        n, state = self._at(None)
        touched = self.files(n, ranges)
        if not touched:
            return n
        schema = StructType.fromJson(state["schema"])
        doomed = F.lit(True) if where is None else where
        for key, (low, high) in ranges.items():
            doomed = doomed & (F.lit(True) if low is None else F.col(key) >= F.lit(low)) & (F.lit(True) if high is None else F.col(key) <= F.lit(high))
        kept = self.spark.read.schema(schema).parquet(*touched).where(~F.coalesce(doomed, F.lit(False)))
        anew = self._write(kept, state["keys"], len(touched))
        gone = self.spark.createDataFrame([(f,) for f in touched], "file string")
        path = self.versions.fresh("data")
        self.manifest(n).join(F.broadcast(gone), "file", "left_anti").coalesce(1).write.parquet(f"{path}/manifest")
        size = self.spark.read.parquet(f"{path}/manifest").agg(F.count("*").alias("files"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).head()
        manifests = [{"path": f"{path}/manifest", "files": size.files, "rows": size.rows}] * bool(size.files) + [anew] * bool(anew)
        self.versions.commit(n + 1, {**state, "manifests": manifests, "made": "delete"})
        return n + 1
