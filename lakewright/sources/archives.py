"""Web archives (gzip members of one record each) as a Spark data source, with an offset index.

    spark.dataSource.register(WebArchive)
    spark.read.format("webarchive").load("folder")                                    # every record
    spark.read.format("webarchive").option("index", "folder/index").load("folder").where("uri = '...'")

Every record is a gzip member of its own, so any member can be read alone. Without an index a file is one partition and its members are read one
after another. `write_index` looks at every file once and stores for each record its URI, file, offset and length; with it a file is split into runs of
whole members of about SPLIT bytes, and a filter of equality (or membership) on the URI is pushed down: only the members that the index names are
read, each by its place. Files are reached through pyarrow's file systems, so a folder may be in any shared store that it knows.

A record that isn't whole is an error that names the file and the offset.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

#: Compressed bytes of a partition, and bytes that are read at once.
SPLIT, CHUNK = 64 << 20, 1 << 20
SCHEMA = "record_id string, type string, uri string, date string, content_type string, body binary"
INDEX = "uri string, file string, start long, size long"
#: The header's first line and the names of its fields.
VERSION = "WARC/1.1"
FIELDS = {"record_id": "WARC-Record-ID", "type": "WARC-Type", "uri": "WARC-Target-URI", "date": "WARC-Date", "content_type": "Content-Type"}


def record(row: dict) -> bytes:
    """A record as a gzip member."""
    body = row["body"] or b""
    lines = [VERSION, *(f"{name}: {row[column]}" for column, name in FIELDS.items() if row.get(column) is not None), f"Content-Length: {len(body)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + bytes(body) + b"\r\n\r\n") + packer.flush()


def parsed(raw: bytes, where: str) -> tuple:
    """The columns of a record."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    named = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    size = named.get("content-length", "")
    if not gap or not lines[0].startswith("WARC/") or not size.isdigit() or len(rest) < int(size):
        raise ValueError(f"no whole record at {where}")
    return (*(named.get(name.lower()) for name in FIELDS.values()), rest[: int(size)])


def members(stream: io.RawIOBase, start: int, end: int | None, where: str) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, contents) of the gzip members from one offset to another."""
    stream.seek(start)
    at, waiting, inflate, contents, begun = start, b"", zlib.decompressobj(31), [], False
    while end is None or at < end:
        if not waiting:
            waiting = stream.read(CHUNK)
            if not waiting:
                break
        begun = True
        try:
            contents.append(inflate.decompress(waiting))
        except zlib.error as problem:
            raise ValueError(f"no gzip member at {where}@{at}") from problem
        if inflate.eof:
            rest = inflate.unused_data
            size = stream.tell() - len(rest) - at
            yield at, size, b"".join(contents)
            at, waiting, inflate, contents, begun = at + size, rest, zlib.decompressobj(31), [], False
        else:
            waiting = b""
    if begun and not inflate.eof:
        raise ValueError(f"a member without an end at {where}@{at}")


def file_system(place: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in place and not place.startswith("file:"):
        return fs.FileSystem.from_uri(place)
    return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", place)


def _files(folder: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    system, path = file_system(folder)
    found = system.get_file_info(fs.FileSelector(path, recursive=True))
    return system, sorted((f for f in found if f.is_file and f.path.endswith(".warc.gz")), key=lambda f: f.path)


@dataclass
class Run(InputPartition):
    """Members of a file: all from start to end, or those of the given places."""

    file: str
    start: int = 0
    end: int | None = None
    places: tuple[tuple[int, int], ...] | None = None


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.index = options["path"], options.get("index")
        self.split = int(options.get("split", SPLIT))
        self.uris: list[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for asked in filters:
            wanted = [asked.value] if isinstance(asked, EqualTo) else list(asked.value) if isinstance(asked, In) else None
            if self.index and wanted is not None and asked.attribute == ("uri",):
                self.uris = wanted if self.uris is None else [u for u in self.uris if u in wanted]
            else:
                yield asked

    def partitions(self) -> list[Run]:
        if not self.index:
            return [Run(f.path) for f in _files(self.folder)[1]]
        system, path = file_system(self.index)
        stored = ds.dataset(path, filesystem=system, format="parquet", exclude_invalid_files=False)
        where = None if self.uris is None else ds.field("uri").isin(self.uris)
        table = stored.to_table(columns=["file", "start", "size"], filter=where).sort_by([("file", "ascending"), ("start", "ascending")])
        runs: list[Run] = []
        for file, start, size in zip(*(table.column(c).to_pylist() for c in ("file", "start", "size")), strict=True):
            last = runs[-1] if runs else None
            if self.uris is not None:
                if last and last.file == file and sum(n for _, n in last.places) < self.split:
                    runs[-1] = Run(file, places=(*last.places, (start, size)))
                else:
                    runs.append(Run(file, places=((start, size),)))
            elif last and last.file == file and last.end == start and start - last.start < self.split:
                last.end = start + size
            else:
                runs.append(Run(file, start, start + size))
        return runs

    def read(self, run: Run) -> Iterator[tuple]:
        system, _ = file_system(self.folder)
        with system.open_input_file(run.file) as stream:
            for start, end in [(run.start, run.end)] if run.places is None else [(s, s + n) for s, n in run.places]:
                for at, _, contents in members(stream, start, end, run.file):
                    yield parsed(contents, f"{run.file}@{at}")


class WebArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "webarchive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known, and lets its filters be pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WebArchive)


def write(rows: DataFrame, folder: str, *, files: int = 8) -> DataFrame:
    """Writes rows (columns of SCHEMA) as archives of one task each; (file, records) of what was written. A file has its task's attempt in
    its name and appears only when it is whole; what is returned names the files that count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, path = file_system(folder)
        system.create_dir(path, recursive=True)
        name, count = f"part-{context.partitionId():05d}-{context.taskAttemptId()}", 0
        with system.open_output_stream(f"{path}/{name}.open") as out:
            for batch in batches:
                for row in batch.to_pylist():
                    out.write(record(row))
                    count += 1
        system.move(f"{path}/{name}.open", f"{path}/{name}.warc.gz")
        yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{name}.warc.gz"]), pa.array([count], pa.int64())], ["file", "records"])

    return rows.repartition(files, "uri").mapInArrow(run, "file string, records long")


def write_index(spark: SparkSession, folder: str, path: str) -> None:
    """Stores (uri, file, start, size) of every record, sorted by URI; each file is looked at by a task of its own."""
    system, found = _files(folder)
    files = spark.createDataFrame([(f.path,) for f in found], "file string").repartition(max(1, len(found)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(folder)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                with system.open_input_file(file) as stream:
                    rows = [(parsed(contents, f"{file}@{at}")[2], file, at, size) for at, size, contents in members(stream, 0, None, file)]
                for some in (rows[k : k + 10_000] for k in range(0, len(rows), 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["uri", "file", "start", "size"])

    files.mapInArrow(run, INDEX).repartitionByRange("uri").sortWithinPartitions("uri").write.mode("overwrite").parquet(path)


def of_pages(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) as records."""
    stamp = F.lit("2024-01-01T00:00:00Z").alias("date")
    return pages.select(F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">")).alias("record_id"), F.lit("resource").alias("type"), F.col("url").alias("uri"), stamp, F.lit("text/html").alias("content_type"), F.col("html").cast("binary").alias("body"))
