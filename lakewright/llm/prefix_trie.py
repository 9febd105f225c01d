"""The trie of conversation prefixes: who shares which beginning, and what sharing it would save.

* Every conversation's turns are chained: the digest of its first d turns is SHA-256 of the digest of its first d - 1 and of turn d,
  so equal digests are equal prefixes. Every prefix is a row, and the rows of a (depth, digest) are a node.
* Subtree sums: exploding every node to all its ancestors would take the square of a conversation's length. Instead each node goes
  with the longest conversation through it, which cuts the trie into vertical paths. Each path is exploded to all the paths above it,
  at the node where it leaves them; that is at most one row for each turn of the path's conversation. A running sum
  up each path then gives every node the whole of its subtree.
* Nodes of very many conversations are aggregated before they are shuffled. A conversation's turns, and the conversations that end
  at one node, are walked as a sorted stream, so neither is held whole however long it is.

Rebuilt conversations: the first h turns of conversation c - c % 100, then c's own turns after its first h, h = crc32(c) % 6.

Defined results: a null role or text is empty; a null turn comes first; turns of the same number, repeated rows too, stand in the
order of their digests; rows without a conv_id belong to no conversation and are left out; texts count whole; an empty table
gives an empty result, without a root; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewright.llm.common import broadcast_if_few, materialise

#: Conversations that lend each other their first turns, and the bound of how many.
LENT_WITHIN, LENT_TURNS = 100, 6
#: The digest of no turns.
ROOT = hashlib.sha256(b"").digest()


def turns(conversations: DataFrame) -> DataFrame:
    """(conv, at, turn_digest, chars): turns numbered from 1; texts go no further than here."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").alias("conv"), "turn", digest.alias("turn_digest"), F.length(text).cast("long").alias("chars"))
    at = F.row_number().over(Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "turn_digest"))
    return rows.select("conv", at.alias("at"), "turn_digest", "chars")


def lent(conv: Column) -> Column:
    """How many turns a conversation begins with that are another's."""
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(LENT_TURNS))


def rebuilt(own: DataFrame) -> DataFrame:
    """(conv, part, at, turn_digest, chars): part -1 is every conversation's empty beginning, 0 its lent and 1 its own turns."""
    convs = own.where("at = 1").select("conv", lent(F.col("conv")).alias("h"), (F.col("conv") - F.col("conv") % LENT_WITHIN).alias("base"))
    lenders = own.where((F.col("conv") % LENT_WITHIN == 0) & (F.col("at") < LENT_TURNS)).withColumnRenamed("conv", "base")
    borrowed = convs.join(broadcast_if_few(lenders, rows=200_000), "base").where("at <= h")
    rest = own.where(F.col("at") > lent(F.col("conv")))
    empty = convs.select("conv", F.lit(-1).alias("part"), F.lit(0).alias("at"), F.lit(None).cast("binary").alias("turn_digest"), F.lit(0).cast("long").alias("chars"))
    columns = ("at", "turn_digest", "chars")
    return empty.unionByName(borrowed.select("conv", F.lit(0).alias("part"), *columns)).unionByName(rest.select("conv", F.lit(1).alias("part"), *columns))


def prefixes(sequence: DataFrame) -> DataFrame:
    """(conv, depth, length, digest, parent, chars): each prefix of each conversation, the empty one too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest = None, ROOT
        for batch in batches:
            digests, parents = [], []
            for conv, depth, turn in zip(*(batch.column(k).to_pylist() for k in (0, 1, 4)), strict=True):
                if depth == 0:
                    current, before, digest = conv, None, ROOT
                else:
                    assert conv == current, "a conversation's turns must come one after another"
                    before, digest = digest, hashlib.sha256(digest + turn).digest()
                digests.append(digest)
                parents.append(before)
            arrays = [batch.column(0), batch.column(1), batch.column(2), pa.array(digests, pa.binary()), pa.array(parents, pa.binary()), batch.column(3)]
            yield pa.RecordBatch.from_arrays(arrays, ["conv", "depth", "length", "digest", "parent", "chars"])

    one = Window.partitionBy("conv")
    depth = (F.row_number().over(one.orderBy("part", "at")) - 1).cast("long")
    length = F.count("*").over(one) - 1
    ordered = sequence.select("conv", depth.alias("depth"), length.alias("length"), "chars", "turn_digest").sortWithinPartitions("conv", "depth")
    return ordered.mapInArrow(run, f"conv {sequence.schema['conv'].dataType.simpleString()}, depth long, length long, digest binary, parent binary, chars long")


def ends(found: DataFrame) -> DataFrame:
    """(depth, digest, ends_sha256): of the conversations that end at each node, in ascending order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, hasher, done = None, None, []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [[], [], []]
            kinds = (pa.int64(), pa.binary(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["depth", "digest", "ends_sha256"])

        for batch in batches:
            for depth, digest, conv in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if (depth, digest) == current:
                    hasher.update(b",%d" % conv)
                else:
                    if current:
                        done.append((*current, hasher.hexdigest()))
                    current, hasher = (depth, digest), hashlib.sha256(b"%d" % conv)
            yield flush()
            done = []
        if current:
            done = [(*current, hasher.hexdigest())]
            yield flush()

    last = found.where("depth = length").select("depth", "digest", "conv").repartition("depth", "digest").sortWithinPartitions("depth", "digest", "conv")
    return last.mapInArrow(run, "depth long, digest binary, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 and digest."""
    own = materialise(turns(conversations), "trie-turns")
    found = materialise(prefixes(rebuilt(own)), "trie-prefixes")
    longest = F.max(F.struct("length", (-F.col("conv")).alias("least")))
    grouped = found.groupBy("depth", "digest").agg(
        F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.first("parent").alias("parent"), F.first("chars").alias("chars"), longest.alias("longest")
    )
    plain = materialise(grouped.select("depth", "digest", "conv_id", "n_convs", "parent", "chars", (-F.col("longest.least")).alias("path")), "trie-nodes")
    above = plain.select((F.col("depth") + 1).alias("depth"), F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    below = plain.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    nodes = plain.join(below, ["depth", "digest"], "left").join(ends(found), ["depth", "digest"], "left").join(above, ["depth", "parent"], "left")
    saved = (F.col("n_convs") - 1) * F.col("chars")
    nodes = nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "path",
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaf"), saved.alias("saved"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "digest",
    )
    nodes = materialise(nodes, "trie-linked")
    whole = nodes.groupBy("path").agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saves"))
    walked = found.join(broadcast_if_few(materialise(whole, "trie-paths")), F.col("conv") == F.col("path")).select("conv", "depth", "digest", "leaves", "saves")
    met = walked.join(nodes.select("depth", "digest", "path"), ["depth", "digest"]).where("conv <> path")
    leaving = met.groupBy("conv", "path").agg(F.max("depth").alias("depth"), F.first("leaves").alias("leaves"), F.first("saves").alias("saves"))
    joined = leaving.groupBy("path", "depth").agg(F.sum("leaves").alias("more_leaves"), F.sum("saves").alias("more_saves"))
    up = Window.partitionBy("path").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = nodes.join(joined, ["path", "depth"], "left")
    zero = F.lit(0).cast("long")
    return summed.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        F.sum(F.col("leaf") + F.coalesce("more_leaves", zero)).over(up).alias("n_leaves"),
        F.sum(F.col("saved") + F.coalesce("more_saves", zero)).over(up).alias("saved_tokens"),
        "ends_sha256", F.lower(F.hex("digest")).alias("prefix_digest"),
    )
