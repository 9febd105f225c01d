import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lakewright.llm import simhash


def plain(text, width=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r " else c for c in lowered).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(values):
    """Smallest index reachable over links of at most four bits, by brute force."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(values):
        for j in range(i):
            if (x ^ values[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_fingerprints_against_a_plain_version():
    texts = ["", "\x0b \t", "One", "one two THREE", "a b c d", "a b c d e f g a b c d É é", "x " * 50_000]
    assert [simhash.fingerprint(t) for t in texts] == [plain(t) for t in texts]


@pytest.mark.parametrize("more", [[], [1], [1, 1]])
def test_groups_of_hard_fingerprints(spark, monkeypatch, more):
    """Chains, dense clouds around centres, and strangers, by keys of three, four and five blocks."""
    monkeypatch.setattr(simhash, "MORE_BLOCKS", more)
    dice = random.Random(7)
    values = [dice.getrandbits(64) for _ in range(40)] + [0, 1]
    for _ in range(3):
        centre = dice.getrandbits(64)
        for _ in range(60):
            x = centre
            for bit in dice.sample(range(64), dice.randint(0, 6)):
                x ^= 1 << bit
            values.append(x)
    x = dice.getrandbits(64)
    for _ in range(30):
        for bit in dice.sample(range(64), 4):
            x ^= 1 << bit
        values.append(x)
    values = list(dict.fromkeys(values))
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    classes = spark.createDataFrame([(v, dice.randint(1, 3)) for v in signed], "fp long, n long")
    found = {r.node: r.root for r in simhash.fingerprint_groups(classes).collect()}
    expected = grouped(values)
    mine = [found.get(v, v) for v in signed]
    pairs = set(zip(mine, expected, strict=True))
    assert len(pairs) == len(set(mine)) == len(set(expected))


def test_pivot_tables_never_part_linked_pairs(spark):
    dice = random.Random(3)
    rows = []
    for _ in range(300):
        a = dice.getrandbits(64)
        b = a
        for bit in dice.sample(range(64), dice.randint(0, 9)):
            b ^= 1 << bit
        rows.append(tuple(np.array([a, b], np.uint64).view(np.int64).tolist()))
    pairs = spark.createDataFrame(rows, "a long, b long")
    tables = [F.struct(F.col(c).alias("fp"), *(t.alias(f"t{k}") for k, t in enumerate(simhash.pivot_table(F.col(c))))).alias(n) for c, n in (("a", "x"), ("b", "y"))]
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 4
    assert pairs.select(close.alias("close"), *tables).where(F.col("close") != simhash.linked("x", "y")).count() == 0


def test_documents(spark):
    rows = [(9, "same words here again and more"), (4, "Same Words here again and more"), (4, "Same Words here again and more"), (7, None), (8, " \n"), (2, "else entirely other text in here"), (None, "nothing like that at all")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")
    found = sorted(((r.doc_id, r.component_id, r.fingerprint) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert {(a, b) for a, b, _ in found} == {(9, 4), (4, 4), (7, 7), (8, 7), (2, 2), (None, None)} and len(found) == 7
    assert all(f == "0" * 16 for a, _, f in found if a in (7, 8))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_keys_are_never_sent_through_the_driver(spark, monkeypatch):
    """Few bytes of fingerprints have very many keys; Spark's own estimate would have them broadcast."""
    plans, write = {}, simhash.materialise

    def seen(df, label, *more):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, label, *more)

    monkeypatch.setattr(simhash, "materialise", seen)
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.md5(F.col("id").cast("string")), F.sha1(F.col("id").cast("string"))).alias("text"))
    assert simhash.near_duplicates(docs).select("component_id").distinct().count() == 2000
    for label in ("simhash-keys", "simhash-rooted", "simhash-named"):
        assert "SortMergeJoin" in plans[label], label
    assert "BroadcastHashJoin" not in plans["simhash-keys"]
