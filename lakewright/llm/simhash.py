"""Near-duplicate detection by SimHash fingerprints and pivot distance tables.

Fingerprints that differ in at most DISTANCE bits are linked, and documents are grouped by what they can reach.

* Equal fingerprints are one class; all else works on distinct fingerprints.
* Every fingerprint carries its pivot table: its Hamming distances to PIVOTS fixed reference fingerprints, seven to
  a long. By the triangle inequality two fingerprints whose tables differ by more than DISTANCE in any coordinate
  can't be linked; only survivors of that test are compared bit by bit.
* Which pairs are tested: 64 bits are cut into BLOCKS blocks, or more if there are very many fingerprints; fingerprints at most DISTANCE bits apart agree on
  all but DISTANCE whole blocks, so they share one of the keys made of that many blocks. (Distances to random
  references alone don't cut a set of fingerprints up: they concentrate around 32, and cells of them would hold
  nearly everything.)
* A key's fingerprints aren't compared pair by pair. All are tested against the key's heaviest fingerprint (the one of
  most documents), which links near copies in stars. Then only fingerprints that aren't yet in that one's group
  are tested against the rest of their key, so no link between different groups is lost, however large a key is.

Defined results: a null text counts as empty; texts without words have fingerprint zero and are linked like any
other; rows that repeat a doc_id each get their row; a null doc_id never names a group unless nothing else is in it;
an empty table gives an empty result; further input columns are ignored. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.llm.common import map_batches, materialise
from lakewright.llm.components import components

DISTANCE, BLOCKS, PIVOTS, SEED = 4, 7, 21, 42
#: Distinct fingerprints from which on a key takes one more block, so that strangers seldom share one by chance.
MORE_BLOCKS = [1 << 26, 1 << 31]
#: Words of a shingle.
WIDTH = 4

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)
_OFFSETS = np.arange(8) * 256


def fingerprint(text: str, width: int = WIDTH) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes."""
    words = text.encode("utf-8").lower().split()  # both know ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1 :], strict=False)] or [digest(joined, SEED)]
    if len(hashes) == 1:
        return hashes[0]
    columns = np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8) + _OFFSETS
    counts = np.bincount(columns.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(counts.ravel() * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, key: str, text: str, width: int = WIDTH) -> DataFrame:
    """(key, fp): fp as a signed long."""
    key_type = docs.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(x or "", width) for x in batch.column(1).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["key", "fp"])

    return map_batches(docs.select(F.col(key), F.col(text)), run, f"key {key_type}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivot_table(fp: Column) -> list[Column]:
    """Distances to the reference fingerprints, seven to a long, a byte each."""
    pivots = np.random.default_rng(SEED).integers(0, 1 << 64, PIVOTS, np.uint64).tolist()
    longs = []
    for at in range(0, PIVOTS, 7):
        packed = F.lit(0).cast("long")
        for place, pivot in enumerate(pivots[at : at + 7]):
            packed = packed.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(_signed(pivot)))).cast("long"), 8 * place))
        longs.append(packed)
    return longs


_HIGH, _REACH = int("80" * 7, 16), int(f"{DISTANCE:02x}" * 7, 16)


def tables_agree(a: Column, b: Column) -> Column:
    """Whether no coordinate of two packed tables differs by more than DISTANCE. Each byte of (a | 0x80) - b + DISTANCE
    keeps its high bit exactly if a - b >= -DISTANCE, and bytes of up to 64 never borrow from each other."""
    high, reach = F.lit(_HIGH), F.lit(_REACH)
    above = a.bitwiseOR(high) - b + reach
    below = b.bitwiseOR(high) - a + reach
    return above.bitwiseAND(below).bitwiseAND(high) == high


def linked(a: str, b: str) -> Column:
    """Pivot tables first, then the bits."""
    test = F.lit(True)
    for k in range(PIVOTS // 7):
        test = test & tables_agree(F.col(f"{a}.t{k}"), F.col(f"{b}.t{k}"))
    return test & (F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= DISTANCE)


def blocks_for(fingerprints: int) -> int:
    """More blocks make longer keys and more of them. Whatever the number, no link is lost; 7, 8 and 9 blocks give keys of
    27, 32 and 35 bits."""
    return BLOCKS + sum(fingerprints >= n for n in MORE_BLOCKS)


def block_keys(fp: Column, blocks: int = BLOCKS) -> Column:
    """Array of hashes of the fingerprint's bits in every choice of blocks - DISTANCE blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    keys = []
    for number, chosen in enumerate(combinations(masks, blocks - DISTANCE)):
        keys.append(F.xxhash64(F.lit(number), fp.bitwiseAND(F.lit(_signed(sum(chosen))))))
    return F.array(*keys)


def fingerprint_groups(classes: DataFrame) -> DataFrame:
    """(node, root) over distinct fingerprints; classes has fp and n (its documents). Roots themselves are left out."""
    tables = [f"t{k}" for k in range(PIVOTS // 7)]
    spread = classes.select(F.explode(block_keys(F.col("fp"), blocks_for(classes.count()))).alias("key"), "fp", "n")
    heaviest = spread.groupBy("key").agg(F.max(F.struct("n", "fp")).alias("c"), F.count("*").alias("members")).where("members > 1")

    def tabled(fp: str) -> Column:
        return F.struct(F.col(fp).alias("fp"), *(t.alias(name) for t, name in zip(pivot_table(F.col(fp)), tables, strict=True)))

    # tables follow from fingerprints, so they are made only where keys are shared, not moved with all keys
    # sizes are estimated from the few bytes of a fingerprint, not from its many keys, so that Spark would broadcast all keys from the driver
    members = materialise(
        spread.drop("n").join(heaviest.select("key", "c.fp").withColumnRenamed("fp", "heaviest").hint("merge"), "key").where("fp <> heaviest").select("key", tabled("fp").alias("x"), tabled("heaviest").alias("c")),
        "simhash-keys",
    )
    stars = components(members.where(linked("x", "c")).select(F.col("c.fp").alias("u"), F.col("x.fp").alias("v")), "simhash-stars")
    rooted = members.join(stars.select(F.col("node").alias("xn"), F.col("root").alias("xr")).hint("merge"), F.col("x.fp") == F.col("xn"), "left")
    rooted = rooted.join(stars.select(F.col("node").alias("cn"), F.col("root").alias("cr")).hint("merge"), F.col("c.fp") == F.col("cn"), "left")
    rooted = materialise(
        rooted.select("key", "x", F.coalesce("xr", "x.fp").alias("root"), F.coalesce("cr", "c.fp").alias("centre")), "simhash-rooted"
    )
    apart = rooted.where("root <> centre").select("key", F.col("x").alias("y"), F.col("root").alias("other"))
    bridges = apart.hint("merge").join(rooted.select("key", "x", "root"), "key").where((F.col("other") != F.col("root")) & linked("y", "x"))
    found = bridges.select(F.least("other", "root").alias("u"), F.greatest("other", "root").alias("v")).distinct()
    return components(stars.select(F.col("root").alias("u"), F.col("node").alias("v")).unionByName(found), "simhash-groups")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Per row: key, fingerprint (16 hex digits), component_id (the smallest key that it reaches)."""
    marked = materialise(fingerprints(docs, key=key, text=text, width=width), "simhash-fingerprints")
    classes = materialise(marked.groupBy("fp").agg(F.min("key").alias("least"), F.count("*").alias("n")), "simhash-classes")
    groups = fingerprint_groups(classes)
    rooted = classes.join(groups, classes.fp == groups.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    by_class = materialise(rooted.join(named.hint("merge"), "root").select(F.col("fp").alias("class"), "component"), "simhash-named")
    return marked.join(by_class.hint("merge"), F.col("fp") == F.col("class")).select(
        F.col("key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id")
    )
