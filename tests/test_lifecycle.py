"""Life cycles against a plain fold, and records' updates."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lakewright.operators import lifecycle, records

SCHEMA = "ts string, file string, line int, op string, entity string, id string, data string"


def plain(log):
    allowed = {(k, "transition", b, a) for k, b, afters in records.TRANSITIONS for a in afters}
    allowed |= {(k, "reopen", b, after) for k, (befores, after) in lifecycle.REOPENED.items() for b in befores}
    rows, refused = {}, []
    for ts, file, line, op, entity, key, data in sorted(log, key=lambda r: r[:3]):
        data = json.loads(data) if data else {}
        if entity not in lifecycle.INITIAL:
            continue
        if op == "delete":
            rows.pop((entity, key), None)
            refused = [r for r in refused if r[:2] != (entity, key)]
        elif op == "create":
            rows.setdefault((entity, key), {"status": lifecycle.INITIAL[entity], "started": ts, "ended": None, "summary": None, "reason": None, "updated": None, "yes": 0, "no": 0})
        elif op in ("transition", "reopen") and (entity, key) in rows:
            row = rows[entity, key]
            to = lifecycle.REOPENED.get(entity, (0, ""))[1] if op == "reopen" else data.get("to") or ""
            if (entity, op, row["status"], to) not in allowed:
                row["no"] += 1
                refused.append((entity, key, ts, row["status"], to))
                continue
            row["status"], row["yes"] = to, row["yes"] + 1
            if entity == "session":
                row["summary"], row["ended"] = data.get("summary"), (data.get("ended_at") or ts) if op == "transition" else None
            else:
                row["updated"] = ts
                row["reason"] = data.get("reason") if entity == "hypothesis" else None
    return sorted((k, i, *r.values()) for (k, i), r in rows.items()), sorted(refused)


@pytest.mark.parametrize("block", [lifecycle.BLOCK, 3])
def test_against_a_plain_fold(spark, monkeypatch, block):
    monkeypatch.setattr(lifecycle, "BLOCK", block)
    draw = random.Random(5)
    known = {k: sorted({s for m, b, afters in records.TRANSITIONS if m == k for s in (b, *afters)}) for k in lifecycle.INITIAL}
    log = []
    for n in range(700):
        entity = draw.choice([*lifecycle.INITIAL, "finding"])
        op = draw.choice(["transition"] * 8 + ["reopen"] * 2 + ["create", "update"] + ["delete"] * (n % 5 == 0))
        data = {"to": draw.choice([*known.get(entity, ["x"]), None])} if op == "transition" else {}
        data |= draw.choice([{}, {"summary": "s%d" % n}, {"reason": "r%d" % n, "ended_at": "e"}, {"summary": None}])
        log.append((f"{draw.randint(0, 90):03d}", draw.choice("ab"), n, op, entity, draw.choice("123"), draw.choice([json.dumps(data)] * 9 + [None])))
    frame = spark.createDataFrame(log, SCHEMA).repartition(3)
    want, refused = plain(log)
    names = ("entity", "id", "status", "started_at", "ended_at", "summary", "reason", "updated_at", "accepted", "refused")
    got = sorted((tuple(r[n] for n in names) for r in lifecycle.life_cycles(frame).collect()), key=lambda r: r[:2])
    assert got == want and len(want) > 9
    assert sorted((r.entity, r.id, r.ts, r.before, r.to) for r in lifecycle.refused(frame).collect()) == refused and len(refused) > 40
    assert lifecycle.life_cycles(frame.limit(0)).count() == 0


def test_several_changes_of_a_key(spark):
    stored = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, name string, n int")
    changes = spark.createDataFrame([(1, 2, '{"name": "late"}'), (1, 1, '{"name": "early", "n": 7}'), (1, 3, '{"n": null}'), (3, 1, '{"n": 1}')], "k int, at int, data string")
    assert sorted(map(tuple, records.update(stored, changes, "k", fields=["name", "n"], order=[F.col("at")]).collect())) == [(1, "late", None), (2, "b", 6)]
    hits = spark.createDataFrame([(1, "z"), (1, "a"), (2, "q")], "k int, v string")
    for n in (1, 3):
        assert sorted(map(tuple, records.store_refs(hits.limit(0), hits.repartition(n), ["k"]).collect())) == [(1, "a"), (2, "q")]


def test_types_of_fields(spark):
    rows = [('{"i": 1, "n": 1.5, "b": true, "s": "x", "o": {}, "a": []}', ""), ('{"i": 1.5, "n": "1", "b": "true", "s": {"x": 1}, "o": [], "a": {}}', "ibsnoa"), ('{"i": null, "n": 2, "b": 0, "s": null, "o": null, "a": null}', "ibsoa"), ("[1]", "inbsoa"), ("no", "inbsoa"), (None, "inbsoa")]
    kinds = {"i": "integer", "n": "number", "b": "boolean", "s": "string", "o": "object", "a": "array"}
    frame = spark.createDataFrame(rows, "j string, want string").select("j", "want", records.schema_problems(F.col("j"), kinds).alias("found"))
    for r in frame.collect():
        assert {x[0] for x in r.found} == set(r.want), r.j


def test_a_tasks_share_of_hits_is_bounded(spark, monkeypatch):
    """Hits beyond TASK_ROWS for each of the four shuffle partitions are dealt over more, with the same rows; a null key is nobody's."""
    monkeypatch.setattr(records, "TASK_ROWS", 20, raising=False)
    hits = spark.createDataFrame([(k % 200, f"v{k}") for k in range(400)] + [(None, "n")], "k int, v string")
    once = records.store_refs(hits.limit(0), hits, ["k"])
    assert once.select(F.spark_partition_id()).distinct().count() > 4
    least = [(k, min(f"v{k}", f"v{k + 200}")) for k in range(200)]
    assert sorted(tuple(r) for r in once.collect() if r.k is not None) == least and once.count() == 201
    again = records.store_refs(once, hits, ["k"])
    assert sorted(tuple(r) for r in again.collect() if r.k is not None) == least and again.count() == 202
    edges = hits.select("k")
    assert records.store_refs(records.store_refs(edges.limit(0), edges, ["k"]), edges.dropna(), ["k"]).count() == 201
