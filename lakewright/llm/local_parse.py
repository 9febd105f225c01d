"""Document fingerprints by locally consistent parsing.

A text is parsed level by level. Its code points are the lowest level's symbols; on each level

* equal neighbours become one symbol, named after the symbol and the length of the run;
* deterministic coin tossing labels every symbol: twice the lowest bit in which it differs from its left neighbour, plus that bit; ROUNDS
  rounds leave eight labels, and neighbours always differ;
* a symbol whose label is greater than both its neighbours' begins a phrase, so phrases have at most about fifteen symbols;
* phrases are named by a hash of their symbols and are the symbols of the next level.

Where a phrase begins depends on a few neighbours only, so equal passages have equal phrases inside, wherever they stand. A fingerprint
has for each of LEVELS levels the KEPT smallest names of the distinct phrases, as hexadecimal digits; likeness is the mean of
the levels' estimated Jaccard similarities, each weighted twice as much as the level below, since longer phrases say more.

Each document is compared with its edited text and with the document that comes next in descending doc_id. Documents are dealt to
blocks of neighbouring ids, split by a sample of ids and texts' hashes, and each block also gets the first document of the next
one; so texts are shuffled once, and a block is read as a stream of neighbours.

Defined results: a null text is empty, and empty texts have fingerprints without names that are wholly alike; a null doc_id comes
last; rows of one doc_id stand in descending order of their text's hash, rows that are equal in any order; a single document is
its own next one; texts of any length are parsed whole, in memory that grows with the longest; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from lakewright.llm.common import materialise

LEVELS, KEPT, ROUNDS = 3, 32, 3
#: Bytes of text that a block is meant to have, the number of blocks beyond which they grow instead, sampled rows for each block, and
#: code points that are parsed at once.
BLOCK_BYTES, MOST_BLOCKS, SAMPLED, PARSED = 4 << 20, 50_000, 20, 1 << 18

_draw = np.random.default_rng(11)
_PLACES = _draw.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_RUN, _FIRST, _SECOND = (int(x) * 2 + 1 for x in _draw.integers(0, 1 << 63, 3, np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(_FIRST)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_SECOND)
    return x ^ (x >> np.uint64(32))


def _without_runs(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each run as one symbol; first marks the symbols that begin a text."""
    equal = np.flatnonzero(x[1:] == x[:-1]) + 1
    begins = np.ones(len(x), bool)
    begins[equal[~first[equal]]] = False
    if begins.all():
        return x, first
    at = np.flatnonzero(begins)
    lengths = np.diff(at, append=len(x))
    kept, many = x[at], np.flatnonzero(lengths > 1)
    names = _mixed(kept[many].astype(np.uint64) + lengths[many].astype(np.uint64) * np.uint64(_RUN))
    kept[many] = names >> np.uint64(64 - 8 * x.itemsize)
    return kept, first[at]


def _tossed(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round: a text's first symbol has no left neighbour and is taken against zero."""
    left = np.empty_like(x)
    left[1:] = x[:-1]
    left[first] = 0
    differ = x ^ left
    low = differ & (~differ + x.dtype.type(1))
    return (np.bitwise_count(low - x.dtype.type(1)) << 1) | ((x & low) != 0)


def phrases(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names of the phrases of all texts, and which of them begin a text. x has code points (32 bits) or names (64 bits), first
    marks the texts' beginnings."""
    x, first = _without_runs(x, first)
    labels = x
    for _ in range(ROUNDS):
        labels = _tossed(labels, first)
    begins = first.copy()
    begins[1:-1] |= (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:]) & ~first[2:]
    at = np.flatnonzero(begins)
    lengths = np.diff(at, append=len(x))
    places = (np.arange(len(x), dtype=np.int32) - np.repeat(at.astype(np.int32), lengths)) & 63
    names = _mixed(np.add.reduceat(x * _PLACES[places], at) + lengths.astype(np.uint64))
    return names, first[at]


def _least(names: np.ndarray) -> np.ndarray:
    """The KEPT smallest of the distinct names."""
    names = np.sort(names)
    return names[np.concatenate((np.ones(1, bool), names[1:] != names[:-1]))][:KEPT]


def sketches(texts: list[str]) -> list[list[np.ndarray]]:
    """For each text its levels' smallest names, ascending."""
    lengths = np.array(list(map(len, texts)), np.int64)
    found: list[list[np.ndarray]] = [[np.empty(0, np.uint32)] * LEVELS if not n else [] for n in lengths.tolist()]
    full = np.flatnonzero(lengths)
    if not len(full):
        return found
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.zeros(len(points), bool)
    first[np.cumsum(lengths[full]) - lengths[full]] = True
    x = points + np.uint32(1)
    for _ in range(LEVELS):
        x, first = phrases(x, first)
        high = (x >> np.uint64(32)).astype(np.uint32)
        edges = [*np.flatnonzero(first).tolist(), len(x)]
        for text, start, end in zip(full.tolist(), edges[:-1], edges[1:], strict=True):
            found[text].append(_least(high[start:end]))
    return found


def shown(sketch: list[np.ndarray]) -> str:
    return "-".join(level.astype(">u4").tobytes().hex() for level in sketch)


def read(fingerprint: str) -> list[np.ndarray]:
    return [np.frombuffer(bytes.fromhex(level), ">u4").astype(np.uint32) for level in fingerprint.split("-")]


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> float:
    """Of two fingerprints, 0 to 1. Of a level's KEPT smallest names of both texts, the share that both have."""
    total = 0.0
    for level, (mine, theirs) in enumerate(zip(a, b, strict=True)):
        mine, theirs = set(mine.tolist()), set(theirs.tolist())
        least = sorted(mine | theirs)[:KEPT]
        share = len((mine & theirs).intersection(least)) / len(least) if least else 1.0
        total += share * (1 << level)
    return total / ((1 << LEVELS) - 1)


def edited(text: str, after: str) -> str:
    """text, with its last half in exchange for as much of the beginning of what comes after."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _order(row: Row) -> tuple:
    """Ascending in the order in which documents come."""
    return (row.id is None, 0 if row.id is None else -row.id, -row.h)


def _placed(docs: DataFrame, *, key: str, text: str) -> DataFrame:
    """(block, last, id, h, text): last marks the copy of what comes next that ends a block."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keys = materialise(rows.select("id", "h", F.octet_length("text").alias("bytes")), "parse-keys")
    size = keys.agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes")).head()
    if not size.rows:
        return rows.select(F.lit(0).alias("block"), F.lit(False).alias("last"), "id", "h", "text")
    blocks = min(int(size.bytes // BLOCK_BYTES) + 1, MOST_BLOCKS)
    step = max(1, size.rows // (blocks * SAMPLED))
    sample = sorted(keys.where(F.pmod(F.xxhash64("id", "h"), F.lit(step)) == 0).select("id", "h").distinct().collect(), key=_order)
    splits = [_order(sample[len(sample) * k // blocks]) for k in range(1, blocks)] if sample else []
    known = spark.sparkContext.broadcast(splits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            found = [bisect_right(known.value, _order(Row(id=i, h=h))) for i, h in pairs]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), *batch.columns], ["block", "id", "h", *batch.schema.names[2:]])

    kind = docs.schema[key].dataType.simpleString()
    firsts = keys.select("id", "h").mapInArrow(run, f"block int, id {kind}, h long").groupBy("block")
    firsts = sorted(firsts.agg(F.max(F.struct("id", "h")).alias("f")).collect())
    following = {(after.f.id, after.f.h): before.block for before, after in zip(firsts, [*firsts[1:], firsts[0]], strict=True)}
    copies = spark.createDataFrame([(i, h, block) for (i, h), block in following.items()], f"first_id {kind}, first_h long, before int")
    dealt = rows.mapInArrow(run, f"block int, id {kind}, h long, text string")
    wanted = dealt.join(F.broadcast(copies), dealt.id.eqNullSafe(copies.first_id) & (dealt.h == copies.first_h)).dropDuplicates(["before"])
    return dealt.select("block", F.lit(False).alias("last"), "id", "h", "text").unionByName(wanted.select(F.col("before").alias("block"), F.lit(True).alias("last"), "id", "h", "text"))


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    kind = docs.schema[key].dataType.simpleString()

    def table(rows: list[tuple], after: tuple) -> tuple[pa.RecordBatch, list]:
        """The results of rows (id, text), whose neighbour is after, and after's sketch."""
        texts = [t for _, t in rows]
        others = [*texts[1:], after[1]]
        changed = [edited(a, b) for a, b in zip(texts, others, strict=True)]
        found = sketches([*texts, after[1], *changed])
        own, new = found[: len(rows) + 1], found[len(rows) + 1 :]
        columns = [
            pa.array([i for i, _ in rows], id_type), pa.array(list(map(len, texts)), pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed]), pa.array(list(map(shown, own[:-1]))), pa.array(list(map(shown, new))),
            pa.array([likeness(a, b) for a, b in zip(own, new, strict=False)], pa.float64()), pa.array([likeness(a, b) for a, b in zip(own[:-1], own[1:], strict=True)], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    id_type = pa.int32() if kind == "int" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size, current = [], 0, None
        for batch in batches:
            columns = batch.columns
            for at in range(batch.num_rows):
                block, last, i, t = (c[at].as_py() for c in columns)
                assert not waiting or block == current, "a block must end with a copy of what comes next"
                current = block
                if waiting and (last or size >= PARSED):
                    yield table(waiting, (i, t))
                    waiting, size = [], 0
                if not last:
                    waiting.append((i, t))
                    size += len(t)
        assert not waiting, "a block must end with a copy of what comes next"

    placed = _placed(docs, key=key, text=text).repartition("block")
    ordered = placed.sortWithinPartitions("block", "last", F.desc_nulls_last("id"), F.desc("h")).select("block", "last", "id", "text")
    columns = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(run, f"id {kind}, {columns}").withColumnRenamed("id", key)
