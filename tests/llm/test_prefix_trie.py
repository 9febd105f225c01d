"""The trie of conversation prefixes against a plain one."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from lakewright.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            by_conv[conv].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [(role, text) for *_, role, text in sorted(t)] for c, t in by_conv.items()}
    members = defaultdict(list)
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, convs in members.items():
        tokens = (len(convs) - 1) * len(node[-1][1]) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += tokens
    ends = {n: ",".join(str(c) for c in sorted(m) if whole[c] == n) for n, m in members.items()}
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), children[n], leaves[n], saved[n], hashlib.sha256(ends[n].encode()).hexdigest()) for n, m in members.items()
    )


def found(frame):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(tuple(-1 if r[n] is None else r[n] for n in names) for r in frame.collect())


def drawn(seed, convs, longest, kinds):
    draw = random.Random(seed)
    rows = []
    for _ in range(convs):
        c = draw.randint(0, 3) * 100 + draw.choice([0, *range(12)])
        for turn in range(draw.randint(0, longest)):
            rows.append((c, draw.choice([turn, turn, None]), draw.choice(["user", "bot", None]), draw.choice(["", None, "yé😀", *"abcdefgh"[:kinds]])))
    return rows


@pytest.mark.parametrize(("seed", "convs", "longest", "kinds"), [(1, 30, 4, 1), (2, 40, 9, 2), (3, 8, 40, 0), (4, 60, 3, 5)])
def test_against_a_plain_trie(spark, seed, convs, longest, kinds):
    rows = drawn(seed, convs, longest, kinds)
    frame = spark.createDataFrame([(*r, "p", 1) for r in rows], SCHEMA + ", path string, depth int").repartition(5)
    assert found(prefix_trie.trie(frame)) == plain(rows)


def test_copies_of_one_long_conversation(spark):
    """Conversations that share all or nearly all of their turns: paths leave each other everywhere."""
    base = [(k, "user", f"t{k}") for k in range(60)]
    rows = [(c, k, r, t) for c in range(7, 40) for k, r, t in base[: c + 15]]
    rows += [(500 + c, k, r, t if k < c else f"{t} {c}") for c in range(0, 40, 3) for k, r, t in base]
    assert found(prefix_trie.trie(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_nulls_short_conversations_and_no_rows(spark):
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).collect() == []
    rows = [(None, 0, "user", "x"), (103, None, None, None), (103, None, None, None), (250, 1, "", "é" * 100_000), (251, 2, None, ""), (107, 5, "user", "a"), (107, 5, "user", "b")]
    turnless = next(c for c in range(301, 400) if zlib.crc32(str(c).encode()) % 6)
    rows.append((turnless, 1, "user", "all lent away, and nobody lends"))
    assert found(prefix_trie.trie(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    names = "conv_id, depth, coalesce(parent_conv_id, -1), n_convs, n_children, n_leaves, saved_tokens, ends_sha256"
    theirs = connection.execute(f"SELECT {names} FROM ({queries.ORACLES['op12_prefix_trie']})").fetchall()
    got = found(queries.QUERIES["op12_prefix_trie"](spark, folder))
    assert got == sorted(theirs)
    assert got == plain([tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])
