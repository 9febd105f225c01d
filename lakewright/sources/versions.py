"""Versions of a folder: numbered pointers, each a JSON document that one writer only can create.

What a version consists of is written first, under names that nobody else uses; then its pointer is created, exclusively. Readers take
the pointer of the highest number, or of the one they ask for, so they see a version whole or not at all; a writer that comes second
gets an error and leaves what was. Pointers and folders are reached through Hadoop's file systems, so any shared store will do.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has made the version meanwhile."""


class Versions:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        context = spark.sparkContext
        self._paths = context._jvm.org.apache.hadoop.fs.Path
        self._conf, self._text = context._jsc.hadoopConfiguration(), context._jvm.org.apache.commons.io.IOUtils

    def _system(self, path):
        return path.getFileSystem(self._conf)

    def numbers(self) -> list[int]:
        """The numbers of all versions, ascending."""
        home = self._paths(f"{self.folder}/pointer")
        system = self._system(home)
        if not system.exists(home):
            return []
        names = [f.getPath().getName() for f in system.listStatus(home)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def read(self, n: int | None = None) -> tuple[int, dict | None]:
        """The number and the document of version n or else of the last one; (0, None) of an empty folder, and of version 0."""
        known = self.numbers()
        if n == 0 or (n is None and not known):
            return 0, None
        n = known[-1] if n is None else n
        if n not in known:
            raise ValueError(f"no version {n} of {self.folder}")
        path = self._paths(self._pointer(n))
        stream = self._system(path).open(path)
        try:
            return n, json.loads(self._text.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, n: int, document: dict) -> None:
        """Makes a document version n."""
        path = self._paths(self._pointer(n))
        system = self._system(path)
        try:
            out = system.create(path, False)
        except Exception as taken:
            raise Conflict(f"version {n} of {self.folder} is another writer's") from taken
        out.write(bytearray(json.dumps(document, sort_keys=True).encode()))
        out.close()

    def _pointer(self, n: int) -> str:
        return f"{self.folder}/pointer/{n:012d}.json"

    def fresh(self, label: str) -> str:
        """A path below the folder that nobody else uses."""
        return f"{self.folder}/{label}-{uuid.uuid4().hex}"

    def remove(self, path: str) -> None:
        gone = self._paths(path)
        self._system(gone).delete(gone, True)


#: Rows up to which a side of known size is broadcast.
FEW_ROWS = 500_000


def broadcast_few(rows: DataFrame, n: int | None = None) -> DataFrame:
    """rows, marked for broadcast if they are few; n is their number, if it is known. They should be of few bytes each."""
    n = rows.limit(FEW_ROWS + 1).count() if n is None else n
    return F.broadcast(rows) if n <= FEW_ROWS else rows
