"""Shared pieces of the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.session import ensure_checkpoint_dir

def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow over single batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield function(batch)

    return df.mapInArrow(run, schema)


_SCOPES: list[list[str]] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared checkpoint folder."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    for paths in _SCOPES[-1:]:
        paths.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Removes the scratch tables made within it; what is to stay must have been written elsewhere by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        _remove(spark, _SCOPES.pop())


def _remove(spark: SparkSession, paths: list[str]) -> None:
    context = spark.sparkContext
    for name in paths:
        path = context._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the scratch tables that a materialised df reads; nothing may read it afterwards."""
    _remove(df.sparkSession, sorted({file.rpartition("/")[0] for file in df.inputFiles()}))


#: Rows, and bytes of the columns that may have any length, up to which a side of a join is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20


def broadcast_if_few(df: DataFrame, rows: int = BROADCAST_ROWS, *, size: Column | None = None) -> DataFrame:
    """df, marked for broadcast if it is found small; else as it is, to be joined by shuffle. df should be materialised;
    size gives the bytes of a row's columns of any length."""
    found = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.lit(0) if size is None else size), F.lit(0)).alias("bytes")).head()
    return F.broadcast(df) if found.n <= rows and found.bytes <= BROADCAST_BYTES else df


def give_back() -> None:
    """Returns to the system what a worker has freed; the C library else keeps what numpy's arrays took. Nothing where it can't."""
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


class Recent:
    """A bounded memory of computed values in two generations: when the younger is full it becomes the older, and
    what is asked for again moves to the younger. Keys longer than `longest` aren't kept, so its size in bytes is
    bounded as well. Values are never None."""

    def __init__(self, compute: Callable[[list[str]], list], entries: int = 100_000, longest: int = 64):
        self.compute, self.entries, self.longest = compute, entries, longest
        self.young: dict = {}
        self.old: dict = {}

    def __call__(self, keys: list[str]) -> list:
        """The values of keys; those that aren't known are computed together, each once."""
        found = list(map(self.young.get, keys))
        if None in found:
            gaps = [at for at, value in enumerate(found) if value is None]
            now = {key: self.old.get(key) for key in dict.fromkeys(keys[at] for at in gaps)}
            fresh = [key for key, value in now.items() if value is None]
            now.update(zip(fresh, self.compute(fresh), strict=True))
            for at in gaps:
                found[at] = now[keys[at]]
            self.young.update((key, value) for key, value in now.items() if len(key) <= self.longest)
            if len(self.young) > self.entries:
                self.old, self.young = self.young, {}
        return found
