"""Token-id output: one zstandard frame a document under a shared dictionary, with an offset index.

The store is a folder of two Parquet tables, both written by Spark:

* `dictionary`: one row, the dictionary trained on serialized id arrays, its sha256, the id width in
  bytes and the end id.
* `blocks`: rows (shard, block, dictionary_sha256, before, n_tokens, data, index). `data` is the documents' frames one
  after another, `index` an array of (doc_id, offset, length, n_tokens) in ascending doc_id order, `before` the
  ids of the shard's earlier blocks. Shards cut the doc_id order into ranges and blocks cut a shard, so (shard,
  block, position in index) is the global order; a reader seeks to one document by its offset and decompresses
  only its frame.

Defined results: a null text counts as empty and stores the end id alone; an empty table gives an empty
store; rows that repeat a doc_id are stored one after another, in the order of their frames' hashes, so that
`start` is reproducible; rows of a null doc_id come first; further input columns are ignored. A text of any length is
one frame.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import ceil
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakewright.llm.common import broadcast_if_few, discard, materialise, scratch_path
from lakewright.llm.pretokens import KNOWN_PATTERN, TextEncoder

#: Documents, in the order of a hash of their id, on whose ids the dictionary is trained.
DICTIONARY_DOCS, DICTIONARY_TEXT = 400, 1 << 20
DICTIONARY_BYTES = 112_640
LEVEL = 3
#: A block is closed at so many bytes of frames or documents.
BLOCK_BYTES, BLOCK_DOCS = 1 << 20, 1024
#: Frames' bytes that a shard aims at, and shards whose totals are summed together.
SHARD_BYTES, GROUP = 32 << 20, 1024

#: Bytes of pre-tokens that a worker remembers.
MEMORY_BYTES = 72 << 20

INDEX = "array<struct<doc_id:long,offset:long,length:int,n_tokens:long>>"


class LibraryEncoder:
    """Ids of the tokenizers library, little-endian.

    A byte-level library of the known splitting pattern encodes each match of it separately, so a text's ids are its
    pre-tokens' ids in a row, and the library's own merges give each of those. All else goes to the library as a
    whole: texts with added tokens, with characters that Unicode versions class differently, and other kinds of library.
    """

    def __init__(self, definition: str, width: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; a thread pool only takes memory
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        self.merges = self.library.model.tokenize
        self.added = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.kind = {2: "H", 4: "I"}[width]
        self.apart = not _byte_level(definition)
        self.encoder = TextEncoder(KNOWN_PATTERN, self._encode_new, width, self._whole, MEMORY_BYTES)

    def _packed(self, ids: list[int]) -> bytes:
        return pack(f"<{len(ids)}{self.kind}", *ids)

    def _encode_new(self, pretokens: list[bytes]) -> list[bytes]:
        return [self._packed([x.id for x in self.merges(p.decode("latin-1").translate(_SIGNS))]) for p in pretokens]

    def _whole(self, text: str) -> bytes | None:
        if self.apart or any(token in text for token in self.added) or not all(map(_settled, set(text))):
            return self._packed(self.library.encode(text, add_special_tokens=False).ids)
        return None

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        marked = pa.array([self.apart] * len(texts), pa.bool_())
        for token in self.added:
            marked = pc.or_(marked, pc.match_substring(texts.fill_null(""), token))
        return self.encoder.encode(texts, marked)


def _signs() -> dict[int, int]:
    """The character that stands for each byte in a byte-level vocabulary: visible Latin-1 for itself, the rest from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in visible)}


_SIGNS = _signs()


def _byte_level(definition: str) -> bool:
    """Whether the library splits by the known pattern into bytes, merges them, and does nothing else to a text."""
    found = json.loads(definition)
    splitter, model = found.get("pre_tokenizer") or {}, found["model"]
    plain = not any(found.get(x) for x in ("normalizer", "truncation", "padding")) and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
    return plain and model.get("type") == "BPE" and splitter.get("type") == "ByteLevel" and not splitter.get("add_prefix_space") and splitter.get("use_regex", True)


@lru_cache(4096)
def _settled(char: str) -> bool:
    """Whether a character was already what it is (letter, number, other or white space) in an old Unicode version."""
    if char in " \t\n\r":
        return True
    old, new = unicodedata.ucd_3_2_0.category(char), unicodedata.category(char)
    return old[0] == new[0] and old[0] != "C" and (old[0] == "Z") == char.isspace()


def train_dictionary(docs: DataFrame, definition: str, width: int, *, key: str, text: str) -> bytes:
    """Trained on the ids of DICTIONARY_DOCS documents of up to DICTIONARY_TEXT bytes, those of the lowest hash; b'' if they
    are too few or short."""
    named = docs.select(F.xxhash64(F.col(key).cast("string")).alias("h"), F.col(key).alias("k"), F.col(text).alias("t")).where(F.octet_length("t").between(1, DICTIONARY_TEXT))
    picked = named.where("k IS NOT NULL").select("h", "k").distinct().orderBy("h", "k").limit(DICTIONARY_DOCS)
    keys = [row.k for row in picked.collect()]
    texts = [row.t for row in named.where(F.col("k").isin(keys)).orderBy("h", F.xxhash64("t")).limit(DICTIONARY_DOCS).collect()] if keys else []
    arrays = list(LibraryEncoder(definition, width).encode(pa.array(texts, pa.string())))
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, arrays).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_store(docs: DataFrame, path: str, definition: str, *, end_id: int, id_width: int, key: str = "doc_id", text: str = "text") -> None:
    """Encodes every document, appends end_id, and writes the store to `path` in ascending key order.

    Documents are encoded and compressed where they are read. Their frames are written once, and shuffled once into
    ranges of (key, hash, place), so that a key or text that fills the table is dealt over many shards.
    """
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, definition, id_width, key=key, text=text)
    digest = hashlib.sha256(dictionary).hexdigest()
    head = [(bytearray(dictionary), digest, id_width, end_id)]
    spark.createDataFrame(head, "dictionary binary, sha256 string, id_width int, end_id long").coalesce(1).write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast((definition, dictionary))
    end = end_id.to_bytes(id_width, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = LibraryEncoder(shared.value[0], id_width), _packer(shared.value[1])
        place = 0
        for batch in (whole.slice(at, 2000) for whole in batches for at in range(0, whole.num_rows, 2000)):
            counts, frames = [], []
            for ids in encoder.encode(batch.column(1)):
                counts.append(len(ids) // id_width + 1)
                frames.append(packer.compress(ids + end))
            marks = [xxhash.xxh3_64_intdigest(x) >> 1 for x in frames]
            places = range(place, place := place + len(frames))
            arrays = [batch.column(0), pa.array(marks, pa.int64()), pa.array(places, pa.int64()), pa.array(counts, pa.int64()), pa.array(frames, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "mark", "place", "n_tokens", "frame"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        block, size, count, before, frames, index = 0, 0, 0, 0, [], []

        def close() -> pa.RecordBatch:
            row = {"shard": shard, "block": block, "dictionary_sha256": digest, "before": before, "n_tokens": count, "data": b"".join(frames), "index": index}
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK)

        for batch in (whole.slice(at, BLOCK_DOCS) for whole in batches for at in range(0, whole.num_rows, BLOCK_DOCS)):
            for k, n, frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if index and (size >= BLOCK_BYTES or len(index) >= BLOCK_DOCS):
                    yield close()
                    block, size, count, before, frames, index = block + 1, 0, 0, before + count, [], []
                index.append({"doc_id": k, "offset": size, "length": len(frame), "n_tokens": n})
                frames.append(frame)
                size += len(frame)
                count += n
        if index:
            yield close()

    frames = docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(encode, "doc_id long, mark long, place long, n_tokens long, frame binary")
    encoded = materialise(frames, "token-frames", compression="uncompressed")
    size = encoded.agg(F.coalesce(F.sum(F.octet_length("frame")), F.lit(0)).alias("n")).head().n
    shards = max(1, ceil(size / SHARD_BYTES), spark.sparkContext.defaultParallelism)
    order = [F.asc_nulls_first("doc_id"), F.asc("mark"), F.asc("place")]
    ordered = encoded.repartitionByRange(shards, *order).sortWithinPartitions("doc_id", "mark", "place").select("doc_id", "n_tokens", "frame")
    columns = f"shard int, block int, dictionary_sha256 string, before long, n_tokens long, data binary, index {INDEX}"
    ordered.mapInArrow(gather, columns).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    discard(encoded)


_BLOCK = pa.schema(
    [
        ("shard", pa.int32()),
        ("block", pa.int32()),
        ("dictionary_sha256", pa.string()),
        ("before", pa.int64()),
        ("n_tokens", pa.int64()),
        ("data", pa.binary()),
        ("index", pa.list_(pa.struct([("doc_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int32()), ("n_tokens", pa.int64())]))),
    ]
)


def shard_starts(blocks: DataFrame) -> DataFrame:
    """(of, start): the ids before each shard, summed within GROUP shards and then over the groups."""
    sums = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("group", F.expr(f"shard div {GROUP}"))
    within = F.sum("n").over(Window.partitionBy("group").orderBy("shard")) - F.col("n")
    groups = sums.groupBy("group").agg(F.sum("n").alias("m"))
    before = groups.select(F.col("group").alias("_group_"), (F.sum("m").over(Window.orderBy("group")) - F.col("m")).alias("low"))
    return sums.withColumn("within", within).join(F.broadcast(before), F.col("group") == F.col("_group_")).select(F.col("shard").alias("of"), (F.col("low") + F.col("within")).alias("start"))


def read_store(spark: SparkSession, path: str, *, ids: bool = True) -> DataFrame:
    """One row a document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked,
    ids (binary, 32-bit). Blocks are unpacked one at a time."""
    head = spark.read.parquet(f"{path}/dictionary").head()
    dictionary, digest, width = bytes(head.dictionary), head.sha256, head.id_width
    shared = spark.sparkContext.broadcast(dictionary)
    blocks = spark.read.parquet(f"{path}/blocks")
    starts = materialise(shard_starts(blocks), "shard-starts")
    placed = blocks.join(broadcast_if_few(starts), F.col("shard") == F.col("of"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = _unpacker(shared.value)
        for batch in batches:
            for at in range(batch.num_rows):
                yield from unpack_block(*(c[at] for c in batch.columns), unpacker)

    def unpack_block(named: pa.Scalar, start: pa.Scalar, data: pa.Scalar, index: pa.Scalar, unpacker) -> Iterator[pa.RecordBatch]:
        if named.as_py() != digest:
            raise ValueError("a block names another dictionary")
        start, data, entries = start.as_py(), memoryview(data.as_buffer()), index.values
        for at in range(0, len(entries), 128):
            out = []
            for key, offset, length, n in zip(*(c.to_pylist() for c in entries.slice(at, 128).flatten()), strict=True):
                stored = unpacker.decompress(data[offset : offset + length])
                wide = stored if width == 4 else np.frombuffer(stored, "<u2").astype("<u4").tobytes()
                out.append((key, start, len(wide) // 4, zlib.crc32(wide), wide if ids else None))
                start += n
            arrays = [pa.array(c, pa.binary() if i == 4 else pa.int64()) for i, c in enumerate(zip(*out, strict=True)) if ids or i < 4]
            yield pa.RecordBatch.from_arrays(arrays, names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + ids]
    picked = placed.select("dictionary_sha256", (F.col("start") + F.col("before")).alias("start"), "data", "index")
    return picked.mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[int] | None:
    """The ids of one document: its index entry is found by scan statistics-free filter, its frame alone is decompressed."""
    head = spark.read.parquet(f"{path}/dictionary").head()
    entry = spark.read.parquet(f"{path}/blocks").select("data", F.explode("index").alias("x")).where(F.col("x.doc_id") == doc_id)
    found = entry.select(F.substring("data", F.col("x.offset").cast("int") + 1, F.col("x.length")).alias("frame")).head()
    if found is None:
        return None
    ids = _unpacker(bytes(head.dictionary)).decompress(bytes(found.frame))
    return np.frombuffer(ids, "<u2" if head.id_width == 2 else "<u4").tolist()


def store_and_read(docs: DataFrame, definition_path: str, *, end_id: int, id_width: int, path: str | None = None, ids: bool = True) -> DataFrame:
    """Writes the store, under the shared folder unless told where, and reads it back."""
    with open(definition_path, encoding="utf-8") as file:
        definition = file.read()
    path = path or scratch_path(docs.sparkSession, "token-store")
    write_store(docs, path, definition, end_id=end_id, id_width=id_width)
    return read_store(docs.sparkSession, path, ids=ids)


def _packer(dictionary: bytes) -> zstandard.ZstdCompressor:
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if shared:
        shared.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)


def _unpacker(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
