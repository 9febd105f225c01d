"""How text filters interact: what each removes alone, after others, and in every order.

* Texts are scanned as Arrow buffers: NumPy looks every byte's class up in a table and prefix sums of the classes give each
  document's words, capitals, symbols and code points at its offsets.
* Distinct words: the words' hashes, differences of one prefix sum of weighted bytes, are sorted within each document; words of
  equal hashes that meet are compared byte by byte, and a document in which two of them differ is counted by its words.
* A document is one mask, a bit for each filter that it fails. Copies are found by SHA-256: the least doc_id of each digest is
  aggregated before the shuffle, and only digests of several rows are joined back.
* Masks reduce to at most 32 x 4 counts a part, from which all orders are worked out; no text and no id is gathered.

Filters: A too few words, B too few distinct words, C too many capitals, D a symbol, E a text that a smaller doc_id has too.

Defined results: a null text is empty (it fails A; 0 of 0 words and capitals fail neither B nor C); a null source is the part ''; a
row without doc_id has no smaller doc_id and is nobody's, and no label; rows that repeat a doc_id count each, and with equal
texts are no copies of one another; of a doc_id's labels any that is 1 counts; texts are scanned whole, of whatever length; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.llm.common import broadcast_if_few, materialise

FILTERS = "ABCDE"
#: The limits of A, B (in hundredths of the words) and C (in hundredths of the code points), and D's symbols.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SYMBOLS = 50, 65, 5, "#$%&*|"

#: Bytes that are scanned at once, and bytes of a text from which its distinct words are counted one by one.
SCAN_BYTES, LONG_BYTES = 2 << 20, 16 << 20
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_CAPITAL = np.zeros(256, np.int32)
_CAPITAL[ord("A") : ord("Z") + 1] = 1
_SYMBOL = np.zeros(256, np.int32)
_SYMBOL[list(SYMBOLS.encode())] = 1
_POINT = (np.arange(256) & 0xC0 != 0x80).astype(np.int32)  # all but continuation bytes

_draw = np.random.default_rng(13)
_BYTE = _draw.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_draw.integers(0, 1 << 61)) * 8 + 5
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _weights(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse modulo 2^64."""
    if len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def _per_text(classes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of classes between the bounds, through a prefix sum."""
    running = np.concatenate(([0], np.cumsum(classes, dtype=np.int64)))
    return np.diff(running[bounds])


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; none reaches over a bound."""
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = bounds[(bounds > 0) & (bounds < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _distinct(data: np.ndarray, bounds: np.ndarray, starts: np.ndarray, ends: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """Distinct words of each text."""
    up, down = _weights(len(data))
    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up, dtype=np.uint64)))
    hashes = (running[ends] - running[starts]) * down[starts]
    order = np.lexsort((hashes, owners))
    starts, sizes, hashes, sorted_owners = starts[order], (ends - starts)[order], hashes[order], owners[order]
    same = np.zeros(len(order), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (sorted_owners[1:] == sorted_owners[:-1])
    found = np.bincount(sorted_owners[~same], minlength=len(bounds) - 1)
    at = np.flatnonzero(same)
    differ = sizes[at] != sizes[at - 1]
    at_equal = at[~differ]
    lengths = sizes[at_equal]
    offsets = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    unlike = data[np.repeat(starts[at_equal], lengths) + offsets] != data[np.repeat(starts[at_equal - 1], lengths) + offsets]
    for owner in {*sorted_owners[at[differ]].tolist(), *np.repeat(sorted_owners[at_equal], lengths)[unlike].tolist()}:
        found[owner] = len(set(_WORD.findall(data[bounds[owner] : bounds[owner + 1]].tobytes())))
    return found


def scan(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The masks of filters A to D for the texts whose bytes lie between the bounds, which begin with 0."""
    starts, ends = _words(data, bounds)
    owners = np.searchsorted(bounds, starts, "right") - 1
    words = np.bincount(owners, minlength=len(bounds) - 1)
    if len(data) > LONG_BYTES:
        texts = [data[s:e].tobytes() for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
        distinct = np.array([len({m.group() for m in _WORD.finditer(x)}) for x in texts])
    else:
        distinct = _distinct(data, bounds, starts, ends, owners)
    capitals, symbols, points = (_per_text(table[data], bounds) for table in (_CAPITAL, _SYMBOL, _POINT))
    fails = [words < MIN_WORDS, 100 * distinct < MIN_DISTINCT * words, 100 * capitals > MAX_CAPITALS * points, symbols > 0]
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def masks(docs: DataFrame, *, key: str, text: str, part: str) -> DataFrame:
    """(id, part, mask, digest) of every document, with the bits of A to D."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2).cast(pa.large_string())
            _, offsets, values = column.buffers()
            bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(values, np.uint8) if values else np.empty(0, np.uint8)
            at = 0
            while at < len(column):
                end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SCAN_BYTES, "right")) - 1)
                own = bounds[at : end + 1]
                found = scan(data[own[0] : own[-1]], own - own[0])
                digests = [hashlib.sha256(data[s:e]).digest() for s, e in zip(own[:-1], own[1:], strict=True)]
                arrays = [*(batch.column(k).slice(at, end - at) for k in (0, 1)), pa.array(found, pa.int32()), pa.array(digests, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "part", "mask", "digest"])
                at = end

    whole = docs.select(F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return whole.mapInArrow(run, f"id {docs.schema[key].dataType.simpleString()}, part string, mask int, digest binary")


def mask_counts(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part that fail just the filters of a mask, and how many of them are good and
    how many toxic by labels (key, quality, toxic)."""
    found = materialise(masks(docs, key=key, text=text, part=part), "audit-masks")
    copied = found.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    copied = materialise(copied, "audit-copied")
    rated = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id"))
    rated = materialise(rated.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad")), "audit-labels")
    joined = found.join(broadcast_if_few(copied, rows=200_000), "digest", "left").join(broadcast_if_few(rated), "id", "left")
    copy = F.when(F.col("id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0)
    counts = joined.groupBy("part", F.col("mask").bitwiseOR(copy).alias("mask"))
    return counts.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in (("good", "good"), ("bad", "toxic"))))


def _total(values: str, test) -> Column:
    """The sum of an array, indexed by masks, over the masks that pass the test."""
    every = F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))
    return F.aggregate(every, F.lit(0).cast("long"), lambda total, m: total + F.when(test(m), F.get(F.col(values), m)).otherwise(0))


def audit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley, the
    filter's removals summed over all orders."""
    counts = mask_counts(docs, labels, key=key, text=text, part=part)
    size = 1 << len(FILTERS)
    by_mask = [F.array(*(F.coalesce(F.sum(F.when(F.col("mask") == k, F.col(c))), F.lit(0)) for k in range(size))).alias(c) for c in ("n", "good", "toxic")]
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    steps = F.sequence(F.lit(1), F.lit(len(FILTERS)))
    rows = counts.groupBy("part").agg(*by_mask).select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(steps).alias("step"))

    def bits(letters: Column) -> Column:
        return sum((F.when(F.contains(letters, F.lit(f)), 1 << k).otherwise(0) for k, f in enumerate(FILTERS)), F.lit(0))

    rows = rows.select("*", bits(F.expr("substring(filter_order, step, 1)")).alias("own"), bits(F.expr("substring(filter_order, 1, step - 1)")).alias("before"))
    own, before = F.col("own"), F.col("before")

    def removed(m: Column) -> Column:
        return (m.bitwiseAND(own) > 0) & (m.bitwiseAND(before) == 0)

    # over all orders, a document that fails k filters is removed by each of them equally often
    every = F.sequence(F.lit(0), F.lit(size - 1))
    shares = [F.lit(120 // max(1, m.bit_count())).cast("long") for m in range(size)]
    shared = F.aggregate(every, F.lit(0).cast("long"), lambda total, m: total + F.when(m.bitwiseAND(own) > 0, F.get(F.col("n"), m) * F.get(F.array(*shares), m)).otherwise(0))
    return rows.select(
        "part", "filter_order", "step",
        _total("n", lambda m: m.bitwiseAND(own.bitwiseOR(before)) == 0).alias("kept"),
        _total("n", removed).alias("removed"),
        _total("n", lambda m: (m.bitwiseAND(own) > 0) & (m.bitwiseAND(before) > 0)).alias("redundant"),
        F.get(F.col("n"), own).alias("unique_fails"),
        _total("good", removed).alias("good_lost"),
        _total("toxic", removed).alias("toxic_lost"),
        shared.alias("shapley"),
    )
