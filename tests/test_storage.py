import json

import pytest
from pyspark.sql import functions as F

from lakewright.sources import files, sinks
from lakewright.streaming import events


def test_store(spark, tmp_path):
    store = sinks.Store(spark, str(tmp_path / "t"))
    assert store.read() is None
    frame = lambda *rows: spark.createDataFrame(rows, "id long, v string")
    store.append(frame((1, "a"), (2, "b")), ["id"])
    store.upsert(frame((2, "c"), (3, "d")), ["id"])
    store.append(frame((3, "x"), (4, "e")), ["id"])
    assert sorted(tuple(r) for r in store.read().collect()) == [(1, "a"), (2, "c"), (3, "d"), (4, "e")]
    with pytest.raises(ValueError):
        store.append(frame((4, "again")), ["id"], strict=True)
    store.delete(F.col("id") == 1)
    store.set_flag(F.col("id") == 4, "v", "flag")
    assert sorted(tuple(r) for r in store.read().collect()) == [(2, "c"), (3, "d"), (4, "flag")]


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "id long, created string")
    path = str(tmp_path / "delta")
    assert sinks.export_delta(rows, path, "created") == 2 and sinks.export_delta(rows, path, "created") == 0
    assert sinks.export_delta(rows.union(spark.createDataFrame([(3, "2024-01-03")], rows.schema)), path, "created") == 1
    assert sinks.export(rows.limit(0), str(tmp_path / "none")) == 0
    assert spark.range(1).select(sinks.export_path("public", "rust", "a b", "1.0", 5)).head()[0] == "lance/public/rust/a_b/1.0/symbols/5"
    packages = spark.createDataFrame([("rust", "a", "1"), ("rust", "a", "1")], "ecosystem string, package string, version string")
    sinks.write_manifest(packages, str(tmp_path / "m"), "2024-01-01 00:00:00")
    manifest = spark.read.json(str(tmp_path / "m"))
    assert manifest.head().total_symbols == 2 and sinks.is_stale(manifest, F.expr("TIMESTAMP '2024-01-01 02:00:00'")).head().stale
    assert files.read_many(spark, [path, str(tmp_path / "missing")]).count() == 3


def test_catalog(spark):
    schema = "id long, ecosystem string, package string, version string, path string, visibility string, org_id string, owner_sub string, created_at long"
    catalog = spark.createDataFrame([(1, "rust", "a", "1", "p1", "public", None, None, 1), (2, "rust", "a", "1", "p2", "public", None, None, 2), (3, "rust", "a", "1", "p3", "team", "o", None, 1), (4, "rust", "a", "1", "p4", "private", None, "me", 1)], schema)
    assert sinks.visible_paths(catalog, "a", None, None) == ["p2"] and sinks.visible_paths(catalog, "a", "me", "o") == ["p2", "p3", "p4"]
    assert sinks.register_file(catalog, catalog.limit(1)).count() == 4


def test_walk_and_manifests(spark, tmp_path):
    for name, body in {"a.py": "x = 1\n", "skip.log": "x", ".gitignore": "*.log\nbuild/\n!keep.log\n", "keep.log": "y", "build/o.py": "z", ".git/config": "c", "tests/test_a.py": "t", "bin.dat": "a\0b"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    assert files.walk(str(tmp_path)) == [".gitignore", "a.py", "bin.dat", "keep.log", "tests/test_a.py"]
    assert len(files.walk(str(tmp_path), mode="raw")) == 8 and files.walk(str(tmp_path), include=("*.py",), exclude=("tests/**",)) == ["a.py"]
    read = {r.path: r for r in files.read_files(spark, str(tmp_path), skip_tests=True).collect()}
    assert read["a.py"].language == "python" and read["a.py"].line_count == 1 and "bin.dat" not in read and "tests/test_a.py" not in read
    assert files.manifest_dependencies("x/package.json", json.dumps({"dependencies": {"a": "^1"}, "devDependencies": {"a": "2", "b": "3"}})) == [("npm", "a", "^1"), ("npm", "b", "3")]
    assert files.manifest_dependencies("Cargo.toml", '[dependencies]\nserde = { version = "1" }\n') == [("rust", "serde", "1")]
    assert files.manifest_dependencies("requirements.txt", "numpy==2.0 # c\n-r x\nflask\n") == [("pypi", "numpy", "2.0"), ("pypi", "flask", "*")]


def test_streams_equal_batches(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    folder = str(tmp_path / "in")
    source.repartition(3).write.parquet(folder)
    stream = events.read_stream(spark, folder, source.schema, files_per_trigger=1)
    query = events.running_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    query.awaitTermination()
    wanted = sorted(tuple(r) for r in source.groupBy("event_type").agg(F.count("*"), F.round(F.sum("value"), 4), F.max("value")).collect())
    assert sorted(tuple(r) for r in spark.table("counts").select("event_type", "n", F.round("total", 4), "peak").collect()) == wanted


def test_active_counts_never_go_below_zero(spark, tmp_path):
    rows = spark.createDataFrame([("k", "stop"), ("k", "start"), ("k", "start"), ("k", "stop")], "key string, event_type string").coalesce(1)
    folder = str(tmp_path / "in")
    rows.write.parquet(folder)
    query = events.active_counts(events.read_stream(spark, folder, rows.schema), "start", "stop").writeStream.outputMode("update").format("memory").queryName("active").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("active").head().active == 1


def test_two_writers_cannot_take_one_version(spark, tmp_path):
    folder = str(tmp_path / "table")
    first, second = sinks.Store(spark, folder), sinks.Store(spark, folder)
    first.replace(spark.createDataFrame([(1, "a")], "id int, v string"))
    known = second._current()
    first.upsert(spark.createDataFrame([(2, "b")], "id int, v string"), ["id"])
    second._current = lambda: known
    with pytest.raises(RuntimeError, match="another writer"):
        second.replace(spark.createDataFrame([(3, "c")], "id int, v string"))
    assert sorted(map(tuple, first.read().collect())) == [(1, "a"), (2, "b")]
