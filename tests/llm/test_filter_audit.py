"""The filter audit against plain counts in every order."""

import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest

from lakewright.llm import filter_audit, queries

DOCS, LABELS = "doc_id long, text string, source string", "doc_id long, quality int, toxic int"
NAMES = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    capitals = len(re.findall("[A-Z]", text))
    tests = (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * capitals > 5 * len(text), bool(re.search(r"[#$%&*|]", text)))
    return {f for f, x in zip("ABCD", tests, strict=True) if x}


def plain(docs, labels):
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = ({i for i, *r in labels if i is not None and r[k] == 1} for k in (0, 1))
    rows = []
    for i, t, s in docs:
        failed = fails(t or "") | ({"E"} if i is not None and i > least[t or ""] else set())
        rows.append((s or "", failed, i in good, i in toxic))
    out, shapley = [], Counter()
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                removed = [r for r in left if f in r[1]]
                redundant = sum(f in r[1] for r in gone)
                left, gone = [r for r in left if f not in r[1]], gone + removed
                shapley[part, f] += len(removed)
                alone = sum(r[0] == part and r[1] == {f} for r in rows)
                out.append([part, "".join(order), step, len(left), len(removed), redundant, alone, sum(r[2] for r in removed), sum(r[3] for r in removed)])
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def found(frame):
    return sorted(tuple(r[n] for n in NAMES) for r in frame.collect())


def drawn(seed, n=60):
    draw = random.Random(seed)
    docs = []
    for i in range(n):
        words = draw.choices(["the", "The", "a", "é", "ÀB", "x|y", "#", "word", "ONE", *(f"w{k}" for k in range(90))], k=draw.choice([0, 1, 20, 49, 50, 51, 90, 120]))
        text = draw.choice([" ", "\n", "\x0b\t", "  ", "\x1f"]).join(words)
        docs.append((draw.choice([None, i, i, i, i // 2]), draw.choice([None, "", " " + text, text, text, text]), draw.choice([None, "", "s1", "s2"])))
    docs += draw.choices(docs, k=15)
    labels = [(draw.choice([None, *range(n)]), draw.choice([0, 1, None]), draw.choice([0, 1, None])) for _ in range(50)]
    return docs, labels


@pytest.mark.parametrize("seed", range(4))
def test_against_plain_counts(spark, seed):
    docs, labels = drawn(seed)
    frame = spark.createDataFrame([(*d, 1, "y") for d in docs], DOCS + ", mask int, first string").repartition(4)
    assert found(filter_audit.audit(frame, spark.createDataFrame(labels, LABELS))) == plain(docs, labels)


def test_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(spark.createDataFrame([], DOCS), none).collect() == []
    docs = [(1, "A" * 200_000, "s"), (2, None, None)]
    assert found(filter_audit.audit(spark.createDataFrame(docs, DOCS), none)) == plain(docs, [])


def masks(texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    return filter_audit.scan(data, np.cumsum([0, *(len(t.encode()) for t in texts)]))


def expected(texts):
    return [sum(1 << "ABCD".index(f) for f in fails(t)) for t in texts]


def test_words_that_hash_alike_are_told_apart(monkeypatch):
    draw = random.Random(9)
    texts = [" ".join(draw.choices([f"{a}{b}" for a in "abcdefgh" for b in "xyz"] + ["aab", "baa"], k=60)) for _ in range(40)]
    assert masks(texts).tolist() == expected(texts)
    monkeypatch.setattr(filter_audit, "_BYTE", np.ones(256, np.uint64))  # every two words of a length hash alike
    assert masks(texts).tolist() == expected(texts)
    monkeypatch.setattr(filter_audit, "_BYTE", np.zeros(256, np.uint64))
    assert masks(texts).tolist() == expected(texts)


def test_long_texts_and_neighbouring_bounds(monkeypatch):
    texts = ["", "", "ab", "cd", "", "é" * 60, " ", "x y" * 80, "A", "", " B " * 90, ""]
    assert masks(texts).tolist() == expected(texts)
    monkeypatch.setattr(filter_audit, "LONG_BYTES", 10)
    assert masks(texts).tolist() == expected(texts)
    assert masks([""]).tolist() == expected([""])


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    connection = duckdb.connect()
    for name in ("documents", "labels"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    theirs = connection.execute(f"SELECT {', '.join(NAMES)} FROM ({queries.ORACLES['op13_filter_audit']})").fetchall()
    assert found(queries.QUERIES["op13_filter_audit"](spark, folder)) == sorted(theirs)
