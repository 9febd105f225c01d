"""Listing a folder's files by tasks, a level of folders at a time.

A level is a frame of folders with the ignore rules that hold in them; every task lists its folders, reads their ignore files, and gives the files and the
folders that aren't ignored, the latter with the rules that they hand down. So the driver never walks: it only starts as many levels as the folders
are deep. Levels are kept as tables in the shared folder. Folders are reached through pyarrow's file systems.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.operators.text import glob_regex
from lakewright.session import ensure_checkpoint_dir
from lakewright.sources.archives import file_system
from lakewright.sources.files import ignored, rules_of
from lakewright.sources.versions import Versions

#: Folders that a task lists.
FOLDERS = 200
LEVEL = "path string, folder boolean, size long, rules string"


def list_files(
    spark: SparkSession, root: str, *, mode: str = "project", ignore_files: tuple[str, ...] = (".gitignore",), pruned: tuple[str, ...] = (".git",), include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()
) -> DataFrame:
    """(path, size) of the files below root, by paths relative to it; what `files.walk` gives."""
    store = Versions(spark, ensure_checkpoint_dir(spark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = file_system(root.rstrip("/"))
        for batch in batches:
            rows = []
            for base, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                home = f"{top}/{base}" if base else top
                found = system.get_file_info(fs.FileSelector(home))
                rules = [(b, [tuple(r) for r in own]) for b, own in json.loads(text)]
                if mode == "project":
                    names = {f.base_name for f in found if f.is_file}
                    own = [r for name in ignore_files if name in names for r in rules_of(system.open_input_stream(f"{home}/{name}").readall().decode("utf-8", "replace"))]
                    rules += [(base, own)] if own else []
                handed = json.dumps(rules)
                for info in found:
                    path, folder = (f"{base}/{info.base_name}" if base else info.base_name), info.type == fs.FileType.Directory
                    if mode != "project" or not ((folder and info.base_name in pruned) or ignored(path, folder, rules)):
                        rows.append((path, folder, None if folder else info.size, handed if folder else None))
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            kinds = (pa.string(), pa.bool_(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "folder", "size", "rules"])

    level, kept = spark.createDataFrame([("", "[]")], "path string, rules string"), []
    n = 1
    while n:
        path = store.fresh("listing")
        level.repartition(max(1, -(-n // FOLDERS))).mapInArrow(run, LEVEL).write.parquet(path)
        kept.append(path)
        level = spark.read.schema(LEVEL).parquet(path).where("folder").select("path", "rules")
        n = level.count()
    rows = spark.read.schema(LEVEL).parquet(*kept).where("NOT folder").select("path", "size")
    # Python's and Java's patterns agree on what glob_regex makes
    wanted = [F.col("path").rlike(glob_regex(g)) for g in include]
    rows = rows.where(reduce(lambda a, b: a | b, wanted)) if wanted else rows
    for g in exclude:
        rows = rows.where(~F.col("path").rlike(glob_regex(g)))
    return rows
