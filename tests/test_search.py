import numpy as np
import pyarrow as pa
import pytest
from lakewright.operators import records, search
from pyspark.sql import functions as F

ROWS = [
    (1, "Connecting pipes", "the pipes were connected by a quick brown fox"),
    (2, "Notes", "quick notes on foxes, brown and red"),
    (3, "Connection", "nothing else here"),
    (4, "Café", "naïve words of the fox quick and brown"),
    (5, None, None),
]


@pytest.fixture(scope="module")
def sources(spark):
    rows = spark.createDataFrame(ROWS, "id int, title string, body string")
    return [(rows, "note", "id", ["title", "body"]), (rows.where("id < 3"), "copy", "id", ["body"])]


CASES = {
    "connect": {"1", "3"}, "connections": {"1", "3"}, "fox quick": {"1", "2", "4"}, "fox NOT red": {"1", "4"}, '"quick brown"': {"1"}, "quick OR nothing": {"1", "2", "3", "4"},
    "title:connect": {"1", "3"}, "body:connect": {"1"}, "cafe": {"4"}, "naive": {"4"}, "conn*": {"1", "3"}, "NEAR(quick fox, 1)": {"1", "4"}, "NEAR(quick fox, 0)": {"4"}, "NEAR(notes red, 9)": {"2"},
    "(nothing OR red) notes": {"2"}, "pipes AND (fox OR nothing)": {"1"}, "absent": set(),
}


def found(index, query, **more):
    return {r.id for r in search.search(index, query, entities=["note"], **more).collect()}


def test_grammar(sources):
    index = search.Index.of(sources)
    for query, ids in CASES.items():
        assert found(index, query) == ids, query
    for empty in ("", "  ", '""', "NOT x", "***"):
        with pytest.raises(ValueError, match="empty"):
            search.parse(empty)


def test_a_stored_index_answers_alike(spark, sources, tmp_path):
    stored, made = search.StoredIndex(spark, str(tmp_path / "index")).change(sources), search.Index.of(sources)
    for query in ("fox NOT red", '"quick brown"', "conn*", "NEAR(quick fox, 1)"):
        assert sorted(search.search(stored, query).collect()) == sorted(search.search(made, query).collect()), query
    read = {f.split("bucket=")[1].split("/")[0] for f in stored.read(["connect"], []).inputFiles() if "bucket=" in f}
    assert read == {str(search.bucket_of("connect"))}


def test_parentheses_and_accents(spark, sources):
    for wrong in ("a ) b", "(a b", "x:(a b", ")"):
        with pytest.raises(ValueError):
            search.parse(wrong)
    index = search.Index.of(sources)
    assert found(index, "title:(connect OR notes)") == {"1", "2", "3"} and found(index, "body:(connect OR fox) NOT title:notes") == {"1", "4"}
    rows = spark.createDataFrame([(1, "un café noir"), (2, "cafe au lait"), (3, "CAFE\u0301 crème, Łódź"), (4, "őrült šaty")], "id int, body string")
    index = search.Index.of([(rows, "note", "id", ["body"])])
    for query, ids in (("café", {"1", "2", "3"}), ("cafe", {"1", "2", "3"}), ("CAFÉ creme", {"3"}), ("orult saty", {"4"}), ("őrült", {"4"}), ("cafe\u0301", {"1", "2", "3"}), ("łodz", {"3"})):
        assert found(index, query) == ids, query


def test_kinds_and_limits(sources):
    index = search.Index.of(sources)
    both = search.multi_search(index, "fox").collect()
    assert {(r.entity, r.id) for r in both} == {("note", "1"), ("note", "2"), ("note", "4"), ("copy", "1"), ("copy", "2")} and max(r.relevance for r in both) == 1.0
    assert found(index, "fox", limit=1) < {"1", "2", "4"} and search.search(index, "fox", entities=["none"]).count() == 0


def test_router():
    engines = {"fts": lambda query, limit: (query, limit)}
    assert search.route("x", "fts", engines) == ("x", 20) and search.route("x", "fts", engines, limit=3) == ("x", 3)
    for query, mode in ((" ", "fts"), ("x", "magic"), ("x", "vector")):
        with pytest.raises(ValueError):
            search.route(query, mode, engines)


def test_references_and_times(spark):
    rows = spark.createDataFrame([("cargo:a::b:1.0", "x/y.rs#L3-L9"), ("npm:left-pad", "x.rs#7"), ("alone", "x.rs")], "ref string, place string")
    got = [tuple(r) for r in rows.select(*records.package_ref(F.col("ref")), *records.location(F.col("place"))).collect()]
    assert got == [("cargo", "a::b", "1.0", "x/y.rs", 3, 9), ("npm", "left-pad", None, "x.rs", 7, 7), (None, "alone", None, "x.rs", None, None)]
    times = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("2024-01-02 03:04:05",), ("2024-01-02T04:04:05.5+01:00",), ("yesterday",), (None,)], "t string")
    assert [r[0] for r in times.select(F.date_format(records.parse_time(F.col("t")), "HH:mm:ss.S")).collect()] == ["03:04:05.0", "03:04:05.0", "03:04:05.5", None, None]


def test_merged_json_and_recovery(spark):
    rows = spark.createDataFrame([(1, 1, '{"a": 1, "b": "x"}'), (1, 2, '{"b": "y", "c": null}'), (2, 1, None)], "k int, at int, data string")
    assert sorted((r.k, r.field, r.value) for r in records.merge_maps(rows, ["k"], "data", [F.col("at")]).where("value IS NOT NULL").collect()) == [(1, "a", "1"), (1, "b", "y")]
    work = spark.createDataFrame([(1, "active"), (2, "done"), (3, "paused")], "workflow_id int, status string")
    given = spark.createDataFrame([(10, 1, "started", "x"), (11, 2, "started", "x"), (12, 3, "done", "x"), (13, 3, "started", "y"), (14, 9, "started", "z")], "id int, workflow_id int, status string, agent string")
    assert sorted((r.id, r.status, r.agent) for r in records.recover(given, work).collect()) == [(10, "pending", None), (11, "started", "x"), (12, "done", "x"), (13, "pending", None), (14, "started", "z")]


def test_an_index_is_changed_by_segments(spark, sources, tmp_path):
    import glob
    import os

    schema = "id int, title string, body string"
    fields = ["title", "body"]
    first = search.StoredIndex(spark, str(tmp_path / "index")).change(sources[:1])
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(str(tmp_path / "index/**/*.parquet"), recursive=True)}
    gone = spark.createDataFrame([("note", 3), ("note", 99), ("note", 7)], "entity string, id int")
    second = first.change([(spark.createDataFrame([(2, "Zebra", "stripes"), (7, "Late", "a fox came late")], schema), "note", "id", fields)], gone)
    third = second.change([(spark.createDataFrame([(2, "Zebra", "red stripes"), (3, "Back", "connected again")], schema), "note", "id", fields)])
    fourth = third.change([], spark.createDataFrame([("note", 1)], "entity string, id int"))
    # what is stored of each version, by loops
    states = [{r[0]: r for r in ROWS}]
    states.append({k: r for k, r in states[0].items() if k not in (2, 3)} | {2: (2, "Zebra", "stripes"), 7: (7, "Late", "a fox came late")})
    states.append(states[1] | {2: (2, "Zebra", "red stripes"), 3: (3, "Back", "connected again")})
    states.append({k: r for k, r in states[2].items() if k != 1})

    def check(index, state):
        plain = search.Index.of([(spark.createDataFrame(list(state.values()), schema), "note", "id", fields)])
        for query in ("fox OR connect OR zebra", "late* OR red"):
            assert sorted(search.search(index, query).collect()) == sorted(search.search(plain, query).collect()), query

    for index, state in zip((first, second, third, fourth), states, strict=True):
        check(index, state)
    check(search.StoredIndex(spark, str(tmp_path / "index"), 2), states[1])
    bucket = search.bucket_of("fox")
    fifth = fourth.compact([bucket])
    check(fifth, states[3])
    assert {b for b in fifth.state["buckets"] if fifth.state["buckets"][b] != fourth.state["buckets"][b]} == {str(bucket)}
    assert all(os.stat(f).st_mtime_ns == t for f, t in before.items())  # nothing that was there is written again
    sixth = fifth.compact(list(range(search.BUCKETS)))
    check(sixth, states[3])
    assert len(sixth.state["changes"]) == 1 and all(len(p) <= 1 for p in sixth.state["buckets"].values())
    check(sixth.change([(spark.createDataFrame([(1, "fox", "fox")], schema), "note", "id", fields)]), states[3] | {1: (1, "fox", "fox")})
    with pytest.raises(Exception, match="another writer"):
        first.change([], gone)


def test_cells_of_vectors(spark, tmp_path):
    from lakewright.operators import vector

    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    path = str(tmp_path / "ivf")
    vector.build_ivf(rows, path, cells=8)
    assert spark.read.parquet(f"{path}/cells").count() == rows.count()
    met = 0
    for probe in rows.where("vec_id % 50 = 0").collect():
        want = [r.vec_id for r in vector.vector_search(rows, list(probe.embedding), limit=10).collect()]
        assert [r.vec_id for r in vector.search_ivf(spark, path, list(probe.embedding), probes=8, limit=10).collect()] == want
        met += len(set(want) & {r.vec_id for r in vector.search_ivf(spark, path, list(probe.embedding), probes=6, limit=10).collect()})
    assert met >= 0.9 * 10 * rows.where("vec_id % 50 = 0").count()


def test_multiline_matches_and_targets(spark):
    from lakewright.operators import text

    files = spark.createDataFrame([("a", "one\ntwo end\nstart three\nend\nstart"), ("b", "none")], "path string, content string")
    found = text.grep_multiline(files, r"end\nstart")
    assert sorted((r.path, r.line_no, r.line_end) for r in found.collect()) == [("a", 2, 3), ("a", 4, 5)]
    assert text.grep_target(packages=["x"]) == ("packages", ["x"]) and text.grep_target(everything=True)[0] == "all"
    for more in ({}, {"paths": ["x"], "everything": True}):
        with pytest.raises(ValueError):
            text.grep_target(**more)


def test_postings_lie_in_blocks(spark, tmp_path):
    """A term that all rows have takes few stored rows, and the texts are read once; compaction keeps that."""
    rows = spark.range(3000).select("id", F.concat(F.lit("common words of every row, number n"), "id").alias("body")).repartition(2)
    index = search.StoredIndex(spark, str(tmp_path / "index")).change([(rows, "note", "id", ["body"])])
    bucket = search.bucket_of("common")
    for state in (index, index.change([], spark.createDataFrame([("note", 7)], "entity string, id int")).compact([bucket])):
        paths = [p for p, _ in state.state["buckets"][str(bucket)]]
        assert spark.read.parquet(*paths).where("term = 'common'").count() <= 16
        assert search.search(state, "common", limit=10_000).count() == (3000 if state is index else 2999)
    assert index.state["totals"]["note"][0] == 3000


def test_a_query_of_one_kind_indexes_that_kind_only(spark):
    from lakewright.plans import retrieval

    part = retrieval.stored(spark, "/root/testdata/sf0.001", "part")
    assert set(part.state["totals"]) == {"part"}
    both = search.Index.together([part, retrieval.stored(spark, "/root/testdata/sf0.001", "region")])
    assert {r.entity for r in search.search(both, "asia OR cold", limit=10_000).collect()} == {"part", "region"}


def test_packed_blocks_give_their_postings_back():
    ids, lengths = pa.array(["a#1", "é", None, "", "b"]), pa.array([5, 4, 3, 2, 9], pa.int32())
    counts, positions, starts = np.array([2, 1, 0, 3, 1]), np.array([0, 4, 2, 5, 6, 7, 8]), np.array([0, 1, 4])
    keys = [pa.array(list("xxx")), pa.array(["f", None, "f"]), pa.array(["t", "", "u"])]
    block = pa.RecordBatch.from_arrays([*keys, *search._packed(ids, lengths, counts, positions, starts)], search._NAMES)
    want = [("x", "a#1", "f", "t", [0, 4], 5), ("x", "é", None, "", [2], 4), ("x", None, None, "", [], 3), ("x", "", None, "", [5, 6, 7], 2), ("x", "b", "f", "u", [8], 9)]
    for batches in ([block], [block.slice(0, 1), block.slice(1), block.slice(0, 0)]):
        assert [tuple(r.values()) for got in search._unpacked(iter(batches)) for r in got.to_pylist()] == want


def test_texts_are_cut_once_and_blocks_hold_no_arrays(spark):
    rows = spark.createDataFrame([(1, "a b")], "id int, body string")
    plan = search._rows(search._wide([(rows, "note", "id", ["body"])]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    assert "array" not in search._BLOCK
