"""The indexing job: a listing of files is compared with the one stored, and only what has changed is cut, stored and indexed.

Files are known by the SHA-256 of their content. A run makes, for the changed files, new parts of each table and a segment of the full-text index,
and a list of the paths that it sets or removes; a row counts if no later run lists its path. Then one pointer makes files, tables and index of the run
visible at once; a run that fails before leaves what was. A second run over the same files writes nothing. Paths must be unique.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.operators import search
from lakewright.sources.versions import Versions, broadcast_few


@dataclass(frozen=True)
class Run:
    """The version after a run, and how many files it found new or changed, and gone."""

    version: int
    changed: int
    gone: int


class Indexer:
    """`cutters` make, from files (path, content), the tables of an index, each with a column path; `searched` names the one whose rows (key, text)
    are indexed in full text: (table, entity, key, fields)."""

    def __init__(self, spark: SparkSession, folder: str, cutters: dict[str, Callable[[DataFrame], DataFrame]], searched: tuple[str, str, str, list[str]]):
        self.spark, self.versions, self.cutters, self.searched = spark, Versions(spark, folder), cutters, searched

    def _state(self, version: int | None = None) -> tuple[int, dict]:
        n, state = self.versions.read(version)
        return n, state or {"runs": [], "index": 0}

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """A table of a version, or `files`: (path, hash)."""
        runs = self._state(version)[1]["runs"]
        parts = []
        for k, run in enumerate(runs):
            if name not in run["parts"]:
                continue
            rows = self.spark.read.parquet(f"{run['path']}/{name}")
            if later := runs[k + 1 :]:
                listed = reduce(DataFrame.unionByName, (self.spark.read.parquet(f"{r['path']}/listed") for r in later)).select("path").distinct()
                rows = rows.join(broadcast_few(listed, sum(r["listed"] for r in later)), "path", "left_anti")
            parts.append(rows)
        return reduce(lambda a, b: a.unionByName(b), parts) if parts else None

    def index(self, version: int | None = None) -> search.StoredIndex:
        return search.StoredIndex(self.spark, f"{self.versions.folder}/fulltext", self._state(version)[1]["index"])

    def run(self, files: DataFrame) -> Run:
        """Brings everything in step with files (path, content)."""
        number, state = self._state()
        path, before = self.versions.fresh("run"), self.read("files")
        hashed = files.select("path", F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256).alias("hash"))
        known = before if before is not None else self.spark.createDataFrame([], "path string, hash string")
        both = hashed.join(known.select("path", F.col("hash").alias("was")), "path", "full_outer").where("NOT (hash <=> was)")
        both.select("path", "hash", F.col("hash").isNull().alias("gone"), F.col("was").isNotNull().alias("known")).write.parquet(f"{path}/listed")
        listed = self.spark.read.parquet(f"{path}/listed")
        n = listed.agg(F.count_if(~F.col("gone")).alias("changed"), F.count_if("gone").alias("gone")).head()
        if not n.changed and not n.gone:
            self.versions.remove(path)
            return Run(number, 0, 0)
        parts = []
        if n.changed:
            listed.where("NOT gone").select("path", "hash").write.parquet(f"{path}/files")
            wanted = files.join(broadcast_few(listed.where("NOT gone").select("path"), n.changed), "path", "left_semi")
            for name, cut in self.cutters.items():
                cut(wanted).write.parquet(f"{path}/{name}")
            parts = ["files", *self.cutters]
        name, entity, key, fields = self.searched
        home = f"{self.versions.folder}/fulltext"
        index = search.StoredIndex(self.spark, home, state["index"] or 0)
        old = self.read(name)
        gone = None
        if old is not None:
            replaced = old.join(broadcast_few(listed.where("known").select("path"), n.changed + n.gone), "path", "left_semi")
            gone = replaced.select(F.lit(entity).alias("entity"), F.col(key).cast("string").alias("id"))
        fresh = [(self.spark.read.parquet(f"{path}/{name}"), entity, key, fields)] if n.changed else []
        # a run that failed may have left an index that nothing names: its number is passed over
        index = index.change(fresh, gone, number=max([0, *Versions(self.spark, home).numbers()]) + 1)
        runs = [*state["runs"], {"path": path, "parts": parts, "listed": n.changed + n.gone}]
        self.versions.commit(number + 1, {"runs": runs, "index": index.version})
        return Run(number + 1, n.changed, n.gone)
