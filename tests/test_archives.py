"""Web archives: round trips, splits between members, look-ups by the index."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from lakewright.sources import archives


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    archives.register(spark)
    folder = str(tmp_path_factory.mktemp("archives"))
    rows = archives.of_pages(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    odd = spark.createDataFrame([("<o1>", "metadata", None, None, None, None), ("<o2>", "response", "http://x/é?a:b", None, "a: b", bytearray(b"\r\n\r\nWARC/1.1\r\n\x00"))], archives.SCHEMA)
    rows = rows.unionByName(odd)
    files = archives.write(rows, folder, files=3).collect()
    archives.write_index(spark, folder, f"{folder}/index")
    return folder, rows, files


def found(frame):
    return sorted((r.record_id, r.type, r.uri, r.date, r.content_type, bytes(r.body or b"")) for r in frame.collect())


def test_round_trip(spark, written):
    folder, rows, files = written
    read = spark.read.format("webarchive").load(folder)
    assert found(read) == found(rows) and read.rdd.getNumPartitions() == len(files) == 3
    assert sum(f.records for f in files) == rows.count()
    for f in files:  # any reader of gzip finds the records
        assert gzip.open(f.file).read().count(b"WARC-Type:") == f.records


def test_an_index_splits_files_between_members(spark, written):
    folder, rows, _ = written
    split = spark.read.format("webarchive").option("index", f"{folder}/index").option("split", "4000").load(folder)
    assert split.rdd.getNumPartitions() > 6 and found(split) == found(rows)


def test_a_look_up_reads_its_members_only(spark, written):
    folder, rows, _ = written
    url = rows.where("content_type = 'text/html'").orderBy("uri").head().uri
    index = spark.read.parquet(f"{folder}/index").where(F.col("uri") == url).collect()
    reader = archives.ArchiveReader({"path": folder, "index": f"{folder}/index"})
    assert list(reader.pushFilters([archives.EqualTo(("uri",), url), archives.EqualTo(("type",), "x")])) == [archives.EqualTo(("type",), "x")]
    assert [r.places for r in reader.partitions()] == [((i.start, i.size),) for i in index]
    looked = spark.read.format("webarchive").option("index", f"{folder}/index").load(folder).where(F.col("uri") == url)
    assert found(looked) == found(rows.where(F.col("uri") == url)) and looked.rdd.getNumPartitions() == 1
    # all but its member may be broken
    (one,) = index
    whole = open(one.file, "rb").read()
    try:
        with open(one.file, "wb") as out:
            out.write(b"\0" * one.start + whole[one.start : one.start + one.size] + b"\0" * (len(whole) - one.start - one.size))
        assert found(looked) == found(rows.where(F.col("uri") == url))
        with pytest.raises(Exception, match="no gzip member"):
            spark.read.format("webarchive").load(folder).count()
    finally:
        with open(one.file, "wb") as out:
            out.write(whole)
    several = spark.read.format("webarchive").option("index", f"{folder}/index").load(folder).where(F.col("uri").isin(url, "http://x/é?a:b", "absent"))
    assert found(several) == found(rows.where(F.col("uri").isin(url, "http://x/é?a:b")))


def test_what_is_cut_off_is_an_error(spark, written, tmp_path):
    folder, _, files = written
    whole = open(files[0].file, "rb").read()
    for name, data, says in (("a", whole[:-9], "without an end"), ("b", gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort"), "no whole record"), ("c", gzip.compress(b"HTTP/1.1\r\n\r\n"), "no whole record")):
        os.makedirs(tmp_path / name)
        (tmp_path / name / "x.warc.gz").write_bytes(data)
        with pytest.raises(Exception, match=says):
            spark.read.format("webarchive").load(str(tmp_path / name)).count()
