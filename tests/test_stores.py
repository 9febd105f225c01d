"""Versioned datasets, replayed state, logs of several versions, and the quantised index."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lakewright.operators import log_versions, quantised, rebuild, replay, vector
from lakewright.sources.snapshots import Dataset
from lakewright.sources.versions import Conflict, Versions


def numbers(frame):
    return sorted(r.k for r in frame.collect())


def test_datasets(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 7).cast("int").alias("x"))
    folder = str(tmp_path / "set")
    data = Dataset.create(spark, folder, rows, ["k"])
    with pytest.raises(Conflict):
        Dataset.create(spark, folder, rows, ["k"])
    with pytest.raises(Conflict):
        Dataset.create(spark, folder, rows, ["x"], exist_ok=True)
    assert Dataset.create(spark, folder, rows, ["k"], exist_ok=True).read().count() == 0
    assert data.append(rows.where("k < 60"), files=4) == 2 and data.append(rows.where("k >= 60"), files=3) == 3
    assert numbers(data.read(2)) == list(range(60)) and numbers(data.read()) == list(range(100)) and data.read(1).count() == 0
    assert numbers(data.read(3, {"k": (55, 64)})) == list(range(55, 65)) and numbers(data.read(3, {"k": (None, 3)})) == [0, 1, 2, 3]
    # a file that can't hold what is asked for isn't opened: it may even be broken
    wanted = set(data.files(3, {"k": (0, 5)}))
    assert 0 < len(wanted) < len(data.files(3)) == 7
    broken = next(f for f in data.files(3) if f not in wanted)
    path = broken.removeprefix("file://")
    whole = open(path, "rb").read()
    with open(path, "wb") as out:
        out.write(b"not a table")
    crc = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    assert numbers(data.read(3, {"k": (0, 5)})) == list(range(6))
    with open(path, "wb") as out:
        out.write(whole)
    before = data.files(3)
    assert data.delete({"k": (2, 4)}, F.col("x") == 3) == 4
    assert numbers(data.read()) == [k for k in range(100) if k != 3] and numbers(data.read(3)) == list(range(100))
    assert len(set(before) - set(data.files())) == 1  # only the file that held it is replaced
    assert data.delete({"k": (1000, None)}) == 4
    assert [(r.version, r.made, r.rows) for r in data.history().orderBy("version").collect()] == [(1, "create", 0), (2, "append", 60), (3, "append", 100), (4, "delete", 99)]
    with pytest.raises(ValueError, match="nothing is known of x"):
        data.read(ranges={"x": (1, 2)})
    with pytest.raises(ValueError, match="no version"):
        data.read(9)


def test_an_append_takes_the_next_number(spark, tmp_path):
    rows = spark.range(3).select(F.col("id").alias("k"))
    data = Dataset.create(spark, str(tmp_path / "set"), rows, ["k"])
    commit, tries = data.versions.commit, []

    def late(n, state):
        if not tries:  # another writer comes first
            tries.append(n)
            Dataset(spark, str(tmp_path / "set")).append(rows.withColumn("k", F.col("k") + 10))
        commit(n, state)

    data.versions.commit = late
    assert data.append(rows) == 3 and numbers(data.read()) == [0, 1, 2, 10, 11, 12]


def line(ts, op, key, **data):
    return json.dumps({"ts": ts, "ses": "s", "op": op, "entity": "note", "id": key, "data": data})


def test_rebuilding(spark, tmp_path):
    home, logs = str(tmp_path / "state"), tmp_path / "logs"
    logs.mkdir()

    def put(name, *lines):
        (logs / name).write_text("".join(x + "\n" for x in lines))

    kept = rebuild.Replayed(spark, home, ["title", "size"])

    def refresh():
        return kept.refresh(rebuild.log_of_folder(spark, str(logs)))

    def same():
        whole = replay.entity_state(replay.read_log(spark, str(logs)), ["title", "size"])
        return sorted(map(str, kept.state().collect())) == sorted(map(str, whole.collect()))

    put("a.jsonl", line("01", "create", "1", title="one"), line("02", "create", "2", title="two"))
    put("b.jsonl", line("03", "update", "1", size="3"), line("04", "create", "3", title="three"))
    put("c.jsonl", *(line(f"1{k}", "create", f"c{k}", title="c") for k in range(9)))
    first = refresh()
    assert (first.decision, first.operations, first.entities, first.version) == ("rebuild", 13, 12, 1) and same()
    assert refresh() == rebuild.Outcome("skip", 0, 0, 1)
    put("b.jsonl", line("03", "update", "1", size="3"), line("04", "create", "3", title="three"), line("05", "delete", "1"))
    second = refresh()
    assert (second.decision, second.operations, second.entities) == ("rebuild", 5, 2) and same()  # c.jsonl isn't read again
    put("d.jsonl", line("00", "create", "1", title="early"), line("06", "create", "1", title="again"))
    assert refresh().entities == 1 and same()
    (logs / "b.jsonl").unlink()
    third = refresh()
    assert (third.decision, third.entities) == ("rebuild", 2) and same() and {r.id for r in kept.state().collect()} >= {"1", "2"}
    put("e.jsonl", "<<<<<<< HEAD", line("07", "create", "9"))
    assert refresh().decision == "conflict" and kept.versions.read()[0] == third.version


def test_upgrades(spark):
    registry = log_versions.Registry(
        {1: ["kind"], 2: ["type"], 3: ["type", "source"]},
        {1: [log_versions.renamed("kind", "type")], 2: [log_versions.defaulted("source", "manual"), log_versions.computed("type", lambda d: F.upper(d["type"])), log_versions.dropped("old")]},
    )
    rows = [
        (None, "create", "a", '{"kind": "x", "old": "1"}'), (1, "update", "a", '{"kind": null}'), (1, "create", "b", '{"kind": "x", "type": "y"}'), (2, "create", "c", '{"type": "z", "source": "s"}'), (3, "create", "d", '{"type": "q", "source": "r", "old": "kept"}'),
        (3, "create", "e", '{"type": "q"}'), (4, "create", "f", "{}"), (0, "delete", "g", None), (2, "delete", "h", None), (2, "update", "i", "no object"),
    ]
    good, apart = log_versions.upgrade(spark.createDataFrame(rows, "v int, op string, id string, data string"), registry)
    found = {r.id + r.op[0]: r.data and json.loads(r.data) for r in good.collect()}
    assert found == {
        "ac": {"type": "X", "source": "manual"}, "au": {"type": None, "source": "manual"}, "bc": {"type": "Y", "source": "manual"}, "cc": {"type": "Z", "source": "s"},
        "dc": {"type": "q", "source": "r", "old": "kept"}, "hd": None,
    }
    assert {r.id: r.reason for r in apart.collect()} == {"e": "missing source", "f": "unknown version 4", "g": "unknown version 0", "i": "not an object"}
    assert {r.v for r in good.collect()} == {3}
    with pytest.raises(ValueError):
        log_versions.Registry({1: [], 3: []}, {1: []})


def test_quantised_recall(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quantised, "TILE", 20)
    monkeypatch.setattr(quantised, "BLOCK", 7)
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    odd = spark.createDataFrame([(9001, None), (9002, [0.0] * 64)], "vec_id long, embedding array<float>")
    rows = rows.select("vec_id", "embedding").unionByName(odd)
    path = str(tmp_path / "index")
    quantised.write_index(rows, path)
    assert spark.read.parquet(f"{path}/codes").count() == rows.count() - 2
    queries = rows.where("vec_id % 20 = 0")
    exact = {(r.query_id, r.vec_id): r.score for r in vector.batch_knn(queries, rows.where("vec_id < 9000"), k=10).collect()}
    found = {(r.query_id, r.vec_id): r.score for r in quantised.search(queries, rows, path, k=10, probes=14).collect()}
    assert len(found) == len(exact) and len(found.keys() & exact.keys()) >= 0.9 * len(exact)
    assert all(abs(found[p] - exact[p]) < 1e-5 for p in found.keys() & exact.keys())
    whole = {(r.query_id, r.vec_id) for r in quantised.search(queries, rows, path, k=10, probes=16, oversample=60).collect()}
    assert whole == exact.keys()  # all cells and all rows are looked at
    with pytest.raises(Exception, match="numbers were wanted"):
        quantised.encode(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>"), *quantised.read_fitted(spark, path)).collect()


def test_one_writer_a_version(spark, tmp_path):
    versions = Versions(spark, str(tmp_path / "v"))
    assert versions.read() == (0, None)
    versions.commit(1, {"x": "é"})
    with pytest.raises(Conflict):
        versions.commit(1, {"x": 2})
    assert versions.read() == (1, {"x": "é"}) and versions.numbers() == [1]


def test_files_of_a_log_do_not_grow_with_its_sessions(spark, tmp_path):
    import glob

    from lakewright.sources import sinks

    home = str(tmp_path / "log")
    rows = spark.range(4000).select(F.lit("create").alias("op"), (F.col("id") % 1000).cast("string").alias("ses"), F.lpad(F.col("id").cast("string"), 6, "0").alias("ts")).repartition(8)
    for _ in range(2):
        sinks.append_log(rows, home)
    assert len(glob.glob(f"{home}/**/*.json", recursive=True)) <= 2 * sinks.LOG_FOLDERS
    read = spark.read.schema("op string, ses string, ts string").json(home).select("*", F.col("_metadata.file_path").alias("file"))
    assert sorted(map(tuple, read.select(*rows.columns).collect())) == sorted(list(map(tuple, rows.collect())) * 2)
    assert read.groupBy("ses").agg(F.count_distinct("file").alias("n")).agg(F.max("n")).head()[0] == 2


def test_scores_of_many_queries_are_held_in_parts():
    """What a task holds at once doesn't grow with queries times rows of a block."""
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pandas as pd

    draw = np.random.default_rng(1)
    ids, vectors = np.arange(6000), draw.normal(size=(6000, 8)).astype(np.float32)
    rows = pd.DataFrame({"row_id": ids[:2048], "v": list(vectors[:2048])})
    run = vector._scan(SimpleNamespace(value=(ids, vectors)), 3, 1024, 6, True)
    tracemalloc.start()
    found = pd.concat(run(iter([rows])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20 and len(found) == 6000 * 3
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    for q in (0, 1023, 1024, 5999):
        scores = np.round(unit[:2048] @ unit[q], 6)
        want = [r for r in np.lexsort((ids[:2048], -scores)) if r != q][:3]
        assert found[found.query_id == q].row_id.tolist() == want


def test_precision_of_all_queries_by_whole_rankings(spark, tmp_path, monkeypatch):
    """precision_mrr counts every row as a query, and a first relevant row wherever it stands, as its SQL does."""
    import random

    import duckdb

    from lakewright.plans.catalogue import ORACLES, QUERIES

    monkeypatch.setattr(vector, "BLOCK_BYTES", 4 * 8 * 60)  # several blocks and tiles
    monkeypatch.setattr(vector, "TILE_ROWS", 16)
    monkeypatch.setattr(vector, "TILE_QUERIES", 7)
    dice = random.Random(3)
    rows = [(i, [dice.gauss(0, 1) for _ in range(8)], dice.choice([0, 0, 0, 1, i])) for i in range(1, 220) if i % 20]
    rows += [(300 + i, [1.0] + [0.0] * 7, i % 3) for i in range(40)]  # ties
    rows += [(401, [0.0] * 8, 0), (402, None, 0), (403, [1.0] * 8, None), (404, None, None), (405, None, 2), (406, [-1.0] * 8, 7000), (407, [float(j) for j in range(8)], 7000)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert list(QUERIES["precision_mrr"](spark, str(tmp_path)).collect()) == duck.execute(ORACLES["precision_mrr"]).fetchall()
    places = vector.relevant_places(spark.read.parquet(str(tmp_path / "embeddings.parquet")), k=5).collect()
    assert {r.query_id for r in places} == {r[0] for r in rows} and max(r.place for r in places if r.good) > 20
    ranked = """SELECT q.vec_id, coalesce(e.label = q.label, false) AS good, row_number() OVER (PARTITION BY q.vec_id
        ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS place FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id"""
    wanted = duck.execute(f"WITH n AS ({ranked}) SELECT vec_id, place, good FROM n QUALIFY place <= 5 OR good AND place = min(place) FILTER (good) OVER (PARTITION BY vec_id)").fetchall()
    assert sorted(map(tuple, places)) == sorted(wanted)
    assert vector.relevant_places(spark.createDataFrame(rows[:1], "vec_id long, embedding array<float>, label int"), k=5).count() == 0
    with pytest.raises(ValueError, match="one length"):
        vector.relevant_places(spark.createDataFrame([(1, [1.0], 0), (2, [1.0, 2.0], 0)], "vec_id long, embedding array<float>, label int"), k=5)


def test_precision_by_hand(spark, tmp_path):
    """Of 30 vectors in a row only the first and the last, 29th of each other's neighbours, are of one group."""
    import math

    from lakewright.plans.catalogue import QUERIES

    rows = [(i, [math.cos(i / 50), math.sin(i / 50)], 0 if i in (1, 30) else i) for i in range(1, 31)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert QUERIES["precision_mrr"](spark, str(tmp_path)).collect() == [(0.0, round(2 / 29 / 30, 6))]
