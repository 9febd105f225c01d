import random

import pytest
from pyspark.sql import functions as F

from lakewright.functions import stemming
from lakewright.operators import graph, recursive, relational, replay, vector
from lakewright.operators import text as T
from lakewright.parsing import chunks, symbols


def values(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def test_versions_sort(spark):
    names = ["1.2.0", "1.10.0", "1.10.0-rc.1", "v2.0.0", "nightly", "2.0.0-alpha"]
    frame = spark.createDataFrame([(n,) for n in names], "v string")
    assert [r.v for r in frame.orderBy(F.desc(relational.semver_key(F.col("v")))).collect()] == ["v2.0.0", "2.0.0-alpha", "1.10.0", "1.10.0-rc.1", "1.2.0", "nightly"]


def test_segments_and_locators(spark):
    frame = spark.createDataFrame([("a b//c",), ("__",), ("ok-1.2",), ("é",)], "s string")
    assert [r[0] for r in frame.select(relational.sanitize_segment(F.col("s"))).collect()] == ["a_b_c", "_", "ok-1.2", "_"]
    paths = spark.createDataFrame([("db#t",), ("x.lance?v=1#t",), ("plain",)], "s string")
    assert [r[0] for r in paths.select(relational.normalise_locator(F.col("s"))).collect()] == ["db/t.lance", "x.lance", "plain"]
    assert spark.range(1).select(relational.snapshot_key(F.lit("rust"), F.lit("a"))).head()[0] == "dls-72757374-61"


def test_lower_ranks_agree(spark):
    frame = spark.range(10).withColumn("g", F.lit("x"))
    assert relational.ranked_percentiles(frame, ["g"], "id", {"p": 0.95}).head().p == 8
    assert frame.agg(relational.lower_rank_percentile("id", 0.95).alias("p")).head().p == 8


def test_moves(spark):
    allowed = spark.createDataFrame([("task", "open", "done")], "machine string, before string, after string")
    moves = spark.createDataFrame([("task", "open", "done"), ("task", "done", "open")], "machine string, before string, after string")
    assert [r.permitted for r in relational.allowed_moves(moves, allowed).orderBy(F.desc("before")).collect()] == [True, False]


def test_overfetch_can_return_less(spark):
    frame = spark.range(1000)
    near = relational.filter_list(frame, F.col("id") > 990, [F.asc("id")], 5)
    capped = relational.filter_list(frame, F.col("id") > 990, [F.asc("id")], 5, overfetch=True)
    assert near.count() == 5 and capped.count() == 0


def test_grep_options(spark):
    files = spark.createDataFrame([("src/a.rs", "fn one() {}\r\nlet The = 1;\n\nfoo.bar\n"), ("b/test.md", "The end"), ("c", None), ("d", "")], "path string, content string")
    found = T.grep(files, "the", T.GrepOptions(before=1, after=1))
    assert [(r.path, r.line_no, r.before, r.after) for r in found.orderBy("path").collect()] == [("b/test.md", 1, [], []), ("src/a.rs", 2, ["fn one() {}"], [""])]
    assert T.grep(files, "The", T.GrepOptions()).count() == 2 and T.grep(files, "THE", T.GrepOptions()).count() == 0
    assert T.grep(files, "foo.bar", T.GrepOptions(fixed=True, include=("**/*.rs",))).count() == 1
    assert T.grep(files, "th", T.GrepOptions(word=True)).count() == 0 and T.grep(files, "The", T.GrepOptions(exclude=("*.md",))).count() == 1
    assert T.grep(files, "fn", T.GrepOptions(invert=True, before=0, after=0)).count() == 4


@pytest.mark.parametrize("glob,path,hit", [("*.rs", "a/b.rs", True), ("src/*.rs", "src/a/b.rs", False), ("src/**/*.rs", "src/b.rs", True), ("{a,b}/?.txt", "b/x.txt", True), ("[!a].c", "a.c", False)])
def test_globs(glob, path, hit):
    import re

    assert bool(re.match(T.glob_regex(glob), path)) is hit


def test_match_grammar(spark):
    frame = spark.createDataFrame([(1, "the quick brown fox"), (2, "Quick! the fox"), (3, "slow fox")], "id long, t string")
    ask = lambda q: [r.id for r in frame.where(T.matches(F.col("t"), T.parse_match(q))).orderBy("id").collect()]
    assert ask("quick fox") == [1, 2] and ask('"quick brown"') == [1] and ask("slow OR quick") == [1, 2, 3] and ask("fox NOT quick") == [3] and ask("qui*") == [1, 2]
    with pytest.raises(ValueError):
        T.parse_match("  ")


def test_blend(spark):
    left = spark.createDataFrame([(1, "A", 1.0, 0), (2, "b", 0.0, 1), (3, "a", 0.5, 2)], "id long, name string, score double, seq int")
    right = spark.createDataFrame([(9, "B", 1.0, 0), (8, "z", 0.5, 1)], "id long, name string, relevance double, seq int")
    assert values(T.blend(left, right, alpha=1.0), "id", "combined") == [(1, 0.75), (2, 0.5), (8, 0.0)]
    assert values(T.blend(left, right, alpha=0.0), "id", "combined") == [(1, 0.0), (2, 1.0), (8, 0.5)]
    assert [r.id for r in T.blend(left, right, alpha=0.5).collect()] == [2, 1, 8]


def test_snippet(spark):
    assert spark.range(1).select(T.snippet(F.lit("one two three four"), ["three"], width=8)).head()[0].endswith("[three] four")


def test_stemmer():
    known = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat", "electrical": "electr", "adoption": "adopt", "rate": "rate", "controll": "control", "running": "run"}
    assert {w: stemming.stem(w) for w in known} == known


def test_graph(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "y"), ("b", "c")], "src string, dst string")
    assert values(graph.weak_components(links), "node", "component") == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("x", "x"), ("y", "x")]
    assert graph.shortest_path(links, "a", "d") == ["a", "c", "d"] and graph.shortest_path(links, "d", "a") is None
    assert values(graph.topological_levels(links), "node", "level") == [("a", 0), ("b", 1), ("c", 2), ("d", 3), ("x", 0), ("y", 1)]
    assert not graph.has_cycle(links) and graph.has_cycle(links.union(spark.createDataFrame([("d", "a")], "src string, dst string")))
    assert [(r.node, r.score) for r in graph.betweenness(links).collect()] == [("c", 2.0), ("a", 0.0), ("b", 0.0), ("d", 0.0), ("x", 0.0), ("y", 0.0)]


def log_of(spark, rows):
    return spark.createDataFrame([(ts, "f", i, op, "task", key, data, "s") for i, (ts, op, key, data) in enumerate(rows)], "ts string, file string, line long, op string, entity string, id string, data string, ses string")


def test_replay(spark):
    rows = [
        ("1", "create", "a", '{"title": "one", "status": "open"}'), ("2", "create", "a", '{"title": "late"}'), ("3", "update", "a", '{"title": null}'), ("4", "transition", "a", '{"status": "done"}'),
        ("1", "create", "b", '{"title": "gone"}'), ("2", "delete", "b", None), ("3", "create", "b", '{"title": "back"}'), ("1", "update", "c", '{"title": "never made"}'), ("5", "tag", "a", '{"tag": "x"}'), ("6", "tag", "a", '{"tag": "y"}'), ("7", "untag", "a", '{"tag": "x"}'),
    ]
    wanted = [("a", None, "done", "1", "4"), ("b", "back", "open", "3", None)]
    for order in (rows, random.Random(1).sample(rows, len(rows))):
        state = replay.entity_state(log_of(spark, order), ["title", "status"])
        got = sorted((r.id, r.title, r.status, r.created_at, None if r.id == "b" else "4") for r in state.collect())
        assert got == wanted
    assert values(replay.tags(log_of(spark, rows)), "id", "tag") == [("a", "y")]
    bad = spark.createDataFrame([("f", 1, "<<<<<<< HEAD"), ("f", 2, "{"), ("f", 3, '{"op": "create"}'), ("f", 4, "")], "file string, line int, value string")
    assert values(replay.invalid_lines(bad), "line", "problem") == [(1, "conflict marker"), (2, "not JSON"), (3, "missing field")]


def plain_recursion(rows, budget):
    """The fold itself, over rows in order."""
    hits, used, ended = [], 0, None
    for path, _, name, signature, doc, line in sorted(rows, key=lambda r: (r[0], r[5], r[2])):
        if len(hits) >= budget.max_chunks or used >= budget.max_total_bytes:
            break
        cost = min(len((doc if doc is not None else signature).encode()), budget.max_bytes_per_chunk)
        if path == ended:
            continue
        if used + cost > budget.max_total_bytes:
            ended = path
            continue
        hits.append((path, name, line))
        used += cost
    return hits, used


def test_recursive_budget(spark):
    rows = [("a/x.rs", "function", f"f{i}", "fn spawn()", "spawn " * n if n else None, i) for i, n in enumerate([0, 0, 1500, 0])] + [("a/y.rs", "function", "g", "fn spawn()", None, 1), ("b/z.rs", "struct", "S", "spawn", None, 1)]
    schema = "path string, kind string, name string, signature string, doc_comment string, line_start int"
    frame = spark.createDataFrame(rows, schema)
    found = recursive.recursive_query(frame, ["function"], ["SPAWN"])
    assert [h["name"] for h in found.hits] == ["f0", "f1", "f2", "f3", "g"] and found.bytes_used == 6040
    assert found.hits[0]["ref_id"] == "a/x.rs::function::f0::0" and found.files == 2
    assert [(e["source"] == e["target"], e["category"]) for e in found.edges] == [(True, "same_module")] + [(False, "same_module")] * 3 + [(False, "same_crate")]
    assert len(recursive.recursive_query(frame, [], [], recursive.Budget(max_chunks=2)).hits) == 2
    with pytest.raises(ValueError, match="max_chunks"):
        recursive.recursive_query(frame, [], [], recursive.Budget(max_chunks=0))


def test_recursive_budgets_against_the_fold(spark):
    dice = random.Random(4)
    rows = [(f"f{i:02d}", "function", f"n{j}", "s" * dice.choice([1, 5, 40, 90]), None, j) for i in range(25) for j in range(dice.randint(1, 5))]
    frame = spark.createDataFrame(rows, "path string, kind string, name string, signature string, doc_comment string, line_start int")
    for budget in (recursive.Budget(2, 3, 50, 120), recursive.Budget(2, 7, 60, 130), recursive.Budget(2, 4, 90, 90), recursive.Budget(2, 200, 30, 400)):
        found = recursive.recursive_query(frame, [], [], budget)
        assert ([(h["path"], h["name"], h["line_start"]) for h in found.hits], found.bytes_used) == plain_recursion(rows, budget)


def test_upsert_knows_the_last_row(spark):
    stored = spark.createDataFrame([(1, "old", 0), (9, "kept", 0)], "id int, v string, at int")
    for rows in ([(1, "a", 1), (1, "b", 2)], [(1, "b", 2), (1, "a", 1)]):
        incoming = spark.createDataFrame(rows, "id int, v string, at int")
        assert values(relational.upsert(stored, incoming, ["id"], [F.col("at")]), "id", "v") == [(1, "b"), (9, "kept")]
        assert values(relational.upsert(stored, incoming, ["id"]), "id", "v") == [(1, "b"), (9, "kept")]


def test_ranks_of_skewed_groups_against_sorting(spark):
    dice = random.Random(8)
    rows = [("hot", float(dice.choice([1, 1, 2, 1e6, dice.random()]))) for _ in range(3000)] + [("one", 5.0), ("same", 2.0), ("same", 2.0), ("none", None), (None, 4.0), (None, 8.0)]
    frame = spark.createDataFrame(rows, "k string, v double")
    for bins in (3, 1024):
        found = {r.k: (r.p50, r.p95, r.p99) for r in relational.ranked_percentiles(frame, ["k"], "v", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, bins=bins).collect()}
        for k in {k for k, v in rows if v is not None}:
            own = sorted(v for n, v in rows if n == k and v is not None)
            assert found.pop(k) == tuple(own[int((len(own) - 1) * p)] for p in (0.5, 0.95, 0.99))
        assert not found
    whole = relational.ranked_percentiles(frame, [], "v", {"p95": 0.95}).head().p95
    own = sorted(v for _, v in rows if v is not None)
    assert whole == own[int((len(own) - 1) * 0.95)]


def test_nearest_rows_of_another_table(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [2.0, 0.1])], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<float>")
    near = vector.batch_knn(queries, rows, k=2, exclude_self=False, block=1)
    assert values(near, "query_id", "vec_id", "place") == [(1, 1, 1), (1, 5, 2)]
    assert values(vector.batch_knn(queries, rows, k=2), "query_id", "vec_id", "place") == [(1, 2, 2), (1, 5, 1)]
    with pytest.raises(Exception, match="3 numbers"):
        vector.vector_search(rows, [1.0, 2.0, 3.0]).collect()


def test_test_files(spark):
    paths = ["src/conftest.py", "test_notes.md", "test_a.py", "a/tests/x.rs", "a/Tests/x.rs", "b_test.go", "App.Spec.TSX", "main.rs", "tests", "benches/b.rs", "contest.py"]
    found = spark.createDataFrame([(p,) for p in paths], "p string").select("p", symbols.is_test(F.col("p")).alias("t")).collect()
    assert [r.p for r in found if r.t] == ["src/conftest.py", "test_a.py", "a/tests/x.rs", "b_test.go", "App.Spec.TSX", "benches/b.rs"]


def test_chunks_keep_their_bounds():
    text = "intro\n\n# A\n" + "word " * 2000 + "\n## B\n" + "x" * 5000 + "\n```\n# not a heading\n```\nSetext\n===\nend\n"
    found = chunks.chunk_document(text, "a.md")
    assert all(len(c["content"]) <= chunks.MOST_CHARS for c in found) and [c["chunk_index"] for c in found] == list(range(len(found)))
    assert all(text.encode()[c["byte_offset"] :].decode(errors="ignore").startswith(c["content"]) for c in found)
    assert {c["title"] for c in found} == {None, "A", "B", "Setext"} and chunks.chunk_document(" \n", "a.txt") == []
    assert [c["title"] for c in chunks.chunk_document("Top\n===\na\n\nSub\n---\nb\n", "a.rst")] == ["Top", "Sub"]


def test_symbols(spark):
    python = symbols.extract_api("A = 1\nclass K:\n    async def go(self):\n        pass\n", "a.py")
    assert [(s["kind"], s["name"], s["line_end"]) for s in python] == [("const", "A", 1), ("class", "K", 4), ("method", "go", 4)] and python[2]["is_async"]
    rust = symbols.extract_api("/// Doc.\npub fn a() {\n}\nenum E { X }\n", "a.rs")
    assert [(s["kind"], s["name"], s["doc_comment"]) for s in rust] == [("function", "a", "Doc."), ("enum", "E", None)]
    assert symbols.extract_api("def broken(", "a.py") == [] and symbols.extract_api("x", "noending") == []
    files = spark.createDataFrame([("a.go", "func Go() {\n}\n"), ("b.json", '{"k": 1}'), ("c.xyz", "?")], "path string, content string")
    assert values(symbols.extract_symbols(files), "path", "kind", "name") == [("a.go", "function", "Go"), ("b.json", "property", "k")]
    assert [r[0] for r in files.select(symbols.language_column(F.col("path"))).collect()] == ["go", "json", None]


def test_chunks_of_a_long_text_take_no_square_of_its_time():
    import re
    import time

    from lakewright.parsing import chunks

    text = "é" * 3_000_000
    start = time.perf_counter()
    found = chunks.chunk_document(text, "a.txt")
    assert time.perf_counter() - start < 5
    assert [c["byte_offset"] for c in found] == [2 * i * (chunks.MOST_CHARS - chunks.OVERLAP) for i in range(len(found))]
    for odd in ("\n\n\n\nab\n \n\t\nc", "a\n\n\n", "\n\n\n", "", "a\n\nb"):
        plain = [(m.start(), m[0]) for m in re.finditer(r"(?:(?!\n[ \t]*\n[ \t]*\n).)+", odd, re.DOTALL) if m[0].strip()]
        assert [(at, body) for _, _, at, body in chunks.sections(odd, "text")] == plain


def test_chunks_leave_a_worker_in_parts(spark, monkeypatch):
    from lakewright.parsing import chunks

    monkeypatch.setattr(chunks, "PART_CHARS", 5000)
    rows = spark.createDataFrame([(i, "word " * 4000) for i in range(3)], "id int, text string")
    whole = [(str(i), c["char_len"]) for i in range(3) for c in chunks.chunk_document("word " * 4000, "x")]
    assert sorted(map(tuple, chunks.chunk_documents(rows, path="id", content="text", columns=["path", "char_len"]).collect())) == sorted(whole)
