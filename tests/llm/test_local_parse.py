"""Locally consistent parsing against a plain version, symbol by symbol."""

import hashlib
import random

import numpy as np
import pytest

from lakewright.llm import local_parse, queries

MASK = (1 << 64) - 1


def mixed(x):
    x = ((x ^ (x >> 31)) * local_parse._FIRST) & MASK
    x = ((x ^ (x >> 29)) * local_parse._SECOND) & MASK
    return x ^ (x >> 32)


def plain_phrases(symbols, bits):
    """The names of one level's phrases, by loops over its symbols."""
    runs = []
    for s in symbols:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    x = [s if n == 1 else mixed((s + n * local_parse._RUN) & MASK) >> (64 - bits) for s, n in runs]
    labels = x
    for _ in range(local_parse.ROUNDS):
        tossed = []
        for i, a in enumerate(labels):
            left = labels[i - 1] if i else 0
            low = (a ^ left) & -(a ^ left)
            tossed.append(2 * (low.bit_length() - 1) + bool(a & low))
        labels = tossed
    begins = [0] + [i for i in range(1, len(x) - 1) if labels[i] > labels[i - 1] and labels[i] > labels[i + 1]]
    names = []
    for start, end in zip(begins, [*begins[1:], len(x)], strict=True):
        total = sum(s * int(local_parse._PLACES[k & 63]) for k, s in enumerate(x[start:end]))
        names.append(mixed((total + end - start) & MASK))
    return names


def plain_fingerprint(text):
    if not text:
        return "-" * (local_parse.LEVELS - 1)
    levels, symbols, bits = [], [ord(c) + 1 for c in text], 32
    for _ in range(local_parse.LEVELS):
        symbols, bits = plain_phrases(symbols, bits), 64
        levels.append("".join(f"{n:08x}" for n in sorted({s >> 32 for s in symbols})[: local_parse.KEPT]))
    return "-".join(levels)


def plain_likeness(a, b):
    total = 0
    for level, (x, y) in enumerate(zip(a.split("-"), b.split("-"), strict=True)):
        x, y = ({s[i : i + 8] for i in range(0, len(s), 8)} for s in (x, y))
        least = sorted(x | y)[: local_parse.KEPT]
        total += (sum(n in x and n in y for n in least) / len(least) if least else 1) * 2**level
    return total / (2**local_parse.LEVELS - 1)


def words(n, seed):
    draw = random.Random(seed)
    return " ".join("".join(draw.choices("abcdeéßж😀 ", k=draw.randint(1, 9))) for _ in range(n))


TEXTS = ["", "a", "aa", "ab", "aaaa" * 50, "abab" * 40, "\x00\x00\x01", words(3, 1), words(80, 2), words(700, 3), "x" * 3000 + words(40, 4), words(80, 2)]


def test_sketches_equal_a_plain_version():
    assert [local_parse.shown(s) for s in local_parse.sketches(TEXTS)] == list(map(plain_fingerprint, TEXTS))
    assert [local_parse.shown(local_parse.sketches([t])[0]) for t in TEXTS] == list(map(plain_fingerprint, TEXTS))
    for text in TEXTS:
        sketch = local_parse.sketches([text])[0]
        assert all((a == b).all() for a, b in zip(sketch, local_parse.read(local_parse.shown(sketch)), strict=True))


def test_neighbours_never_share_a_label_and_phrases_stay_short():
    for text in TEXTS[1:]:
        x, first = local_parse._without_runs(np.frombuffer(text.encode("utf-32-le"), np.uint32) + np.uint32(1), np.arange(len(text)) == 0)
        labels = x
        for _ in range(local_parse.ROUNDS):
            labels = local_parse._tossed(labels, first)
            assert (labels[1:] != labels[:-1]).all()
        assert labels.max() < 8
        begins = [0, *(np.flatnonzero((labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:])) + 1).tolist(), len(x)]
        assert max(np.diff(begins)) <= 16


def test_equal_passages_share_their_inner_phrases_at_any_offset():
    passage = words(120, 5)
    texts = [words(k, 50 + k) + passage + words(9, k) for k in (0, 1, 2, 7, 31)]
    alone = local_parse.phrases(np.frombuffer(passage.encode("utf-32-le"), np.uint32) + np.uint32(1), np.arange(len(passage)) == 0)[0]
    for text in texts:
        names = local_parse.phrases(np.frombuffer(text.encode("utf-32-le"), np.uint32) + np.uint32(1), np.arange(len(text)) == 0)[0]
        inner = alone[6:-3].tolist()
        assert any(names[k : k + len(inner)].tolist() == inner for k in range(len(names)))


def plain(rows):
    """(doc_id, text) rows to results, in descending order; equal doc_ids are left to the caller."""
    texts = [t or "" for _, t in rows]
    out = []
    for k, (i, _) in enumerate(rows):
        text, after = texts[k], texts[(k + 1) % len(rows)]
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        mine, new, theirs = map(plain_fingerprint, (text, changed, after))
        out.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), mine, new, round(plain_likeness(mine, new), 12), round(plain_likeness(mine, theirs), 12)))
    return out


def found(frame):
    return sorted((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 12), round(r.near_next, 12)) for r in frame.collect())


@pytest.mark.parametrize("block", [local_parse.BLOCK_BYTES, 900])
def test_every_row_against_a_plain_version(spark, monkeypatch, block):
    monkeypatch.setattr(local_parse, "BLOCK_BYTES", block)
    monkeypatch.setattr(local_parse, "PARSED", min(local_parse.PARSED, block))
    rows = [(3 * k - 7, None if k == 4 else TEXTS[k % len(TEXTS)]) for k in range(40)]
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, block string, last string").repartition(5)
    assert found(local_parse.fingerprints(frame)) == sorted(plain(sorted(rows, reverse=True)))


def test_ties_nulls_and_few_rows(spark):
    schema = "doc_id long, text string"
    assert local_parse.fingerprints(spark.createDataFrame([], schema)).collect() == []
    assert found(local_parse.fingerprints(spark.createDataFrame([(5, TEXTS[8])], schema))) == plain([(5, TEXTS[8])])
    rows = [(7, TEXTS[7]), (None, TEXTS[8]), (7, TEXTS[9]), (7, TEXTS[7]), (None, None), (9, TEXTS[8])]
    frame = local_parse.fingerprints(spark.createDataFrame(rows, schema))
    got = frame.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars) for r in got) == sorted((i is None, i or 0, len(t or "")) for i, t in rows)
    after_nine = {hashlib.sha256(local_parse.edited(TEXTS[8], t).encode()).hexdigest() for t in (TEXTS[7], TEXTS[9])}
    assert {r.edited_sha256 for r in got if r.doc_id == 9} < after_nine
    assert [r.near_next for r in got if r.doc_id == 7].count(1.0) == 1  # the repeated row comes right after its like


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()), reverse=True)
    got = found(queries.QUERIES["op11_document_fingerprints"](spark, folder))
    assert got == sorted(plain(rows))
    assert sum(r[5] > r[6] for r in got) > 0.95 * len(got)
