"""Sinks: keyed upserts, appends, exports, manifests and a catalog of data files, all on Parquet."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.operators import relational as R


class Store:
    """A table as versions in a folder: every change writes a new version and then moves the pointer, so readers see
    the old state or the new one, and a failed write leaves the old."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _pointers(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("n long, version string").json(f"{self.folder}/pointer")
        except Exception as problem:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(problem):
                return None
            raise

    def _current(self) -> tuple[int, str] | None:
        found = self._pointers()
        row = found.orderBy(F.desc("n")).head() if found is not None else None
        return (row.n, row.version) if row else None

    def read(self) -> DataFrame | None:
        current = self._current()
        return self.spark.read.parquet(f"{self.folder}/{current[1]}") if current else None

    def replace(self, rows: DataFrame, partition_by: list[str] | None = None) -> None:
        current = self._current()
        version = f"v-{uuid.uuid4().hex}"
        writer = rows.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.folder}/{version}")
        self._claim(current[0] + 1 if current else 1, version)

    def _claim(self, n: int, version: str) -> None:
        """Makes `version` the n-th by creating its pointer, which only one writer can; the other gets an error and its
        version is removed."""
        context = self.spark.sparkContext
        paths = context._jvm.org.apache.hadoop.fs.Path
        pointer = paths(f"{self.folder}/pointer/{n:012d}.json")
        system = pointer.getFileSystem(context._jsc.hadoopConfiguration())
        try:
            out = system.create(pointer, False)
        except Exception as taken:
            system.delete(paths(f"{self.folder}/{version}"), True)
            raise RuntimeError("another writer has changed the table meanwhile") from taken
        out.write(bytearray(json.dumps({"n": n, "version": version}).encode() + b"\n"))
        out.close()

    def upsert(self, rows: DataFrame, keys: list[str]) -> None:
        stored = self.read()
        self.replace(R.upsert(rows.limit(0) if stored is None else stored, rows, keys))

    def append(self, rows: DataFrame, keys: list[str], *, strict: bool = False) -> None:
        """Adds rows of new keys; with strict, a key that is stored already is an error."""
        stored = self.read()
        if stored is None:
            return self.replace(rows)
        if strict and not rows.join(stored.select(*keys), keys, "left_semi").isEmpty():
            raise ValueError("a key is stored already")
        self.replace(stored.unionByName(R.append_new(stored, rows, keys), allowMissingColumns=True))

    def delete(self, where: Column) -> None:
        stored = self.read()
        if stored is not None:
            self.replace(stored.where(~F.coalesce(where, F.lit(False))))

    def set_flag(self, where: Column, column: str, value: object) -> None:
        stored = self.read()
        if stored is not None:
            self.replace(stored.withColumn(column, F.when(where, F.lit(value)).otherwise(F.col(column))))


def export_path(visibility: str, ecosystem: str, package: str, version: str, stamp: int) -> Column:
    """Where an exported package lies."""
    parts = [R.sanitize_segment(F.lit(x)) for x in (visibility, ecosystem, package, version)]
    return F.concat_ws("/", F.lit("lance"), *parts, F.lit("symbols"), F.lit(str(stamp)))


def export(rows: DataFrame, path: str) -> int:
    """Writes rows as ZSTD Parquet and tells how many; nothing is written for none."""
    if rows.isEmpty():
        return 0
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.parquet(path).count()


def export_delta(rows: DataFrame, path: str, created: str) -> int:
    """Appends the rows that are newer than the newest exported one."""
    spark = rows.sparkSession
    try:
        mark = spark.read.parquet(path).agg(F.max(created).alias("m")).head().m
    except Exception as problem:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        mark = None
    fresh = rows if mark is None else rows.where(F.col(created) > F.lit(mark))
    n = fresh.count()
    if n:
        fresh.write.mode("append").option("compression", "zstd").parquet(path)
    return n


def register_file(catalog: DataFrame, entry: DataFrame) -> DataFrame:
    """The catalog with an entry, unless one with the same place and scope is there."""
    keys = ["ecosystem", "package", "version", "path", "visibility"]
    return catalog.unionByName(R.append_new(catalog, entry, keys))


def visible_paths(catalog: DataFrame, package: str, owner: str | None, org: str | None) -> list[str]:
    """Paths of a package's newest registrations that a caller may see; a handful, for one scan of them all."""
    seen = catalog.where(R.visible(owner, org) & (F.col("package") == package))
    latest = R.latest_per_key(seen, ["ecosystem", "package", "version", "visibility", "org_id", "owner_sub"], [F.desc("created_at"), F.desc("id")])
    return [r.path for r in latest.select("path").orderBy("path").collect()]


def write_manifest(packages: DataFrame, path: str, exported_at: str) -> None:
    """One JSON line: version, time, the packages with their symbol counts, and totals."""
    rows = packages.groupBy("ecosystem", "package", "version").agg(F.count("*").alias("symbol_count"))
    one = rows.agg(F.sort_array(F.collect_list(F.struct("ecosystem", "package", "version", "symbol_count"))).alias("packages"), F.sum("symbol_count").alias("total_symbols"))
    one.select(F.lit(1).alias("schema_version"), F.lit(exported_at).alias("exported_at"), "packages", "total_symbols").coalesce(1).write.json(path)


def is_stale(manifest: DataFrame, now: Column, seconds: int = 3600) -> DataFrame:
    """Whether a manifest is older than `seconds`."""
    age = F.unix_timestamp(now) - F.unix_timestamp(F.to_timestamp("exported_at"))
    return manifest.select("exported_at", (age > seconds).alias("stale"))


#: Folders of a log.
LOG_FOLDERS = 64


def append_log(operations: DataFrame, folder: str) -> None:
    """Appends operations to a log. A session's operations of one call are in one file, in the order of their times; sessions are dealt over
    LOG_FOLDERS folders by their hash, so files don't grow with the number of sessions, and each line names its session."""
    placed = operations.withColumn("part", F.pmod(F.xxhash64("ses"), F.lit(LOG_FOLDERS)).cast("int"))
    placed.repartition("part").sortWithinPartitions("part", "ses", "ts").write.mode("append").partitionBy("part").json(folder)


def as_json_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
