"""Byte-level BPE encoding and decoding by two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves whole pre-tokens that are vocabulary
entries. Tier two: other pre-tokens are merged with a heap of ranked neighbours over linked bytes,
in O(n log n) even for a pre-token of a whole document.

Defined results: a null text counts as empty, an empty text has no ids and decodes to no bytes, an
empty table gives an empty result, repeated rows give repeated rows, further input columns are
ignored whatever their names. Texts are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.llm.common import give_back
from lakewright.llm.pretokens import TextEncoder

#: Bytes of a worker's memory of pre-tokens, and documents that it takes at a time.
MEMORY_BYTES, PART_DOCS = 32 << 20, 500


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PerfectHash:
    """Minimal perfect hash by hash and displace: n keys take n slots, one displacement a bucket.

    Buckets of several keys get, largest first, the first seed that sends their keys to free slots;
    buckets of one key name their slot directly, as a negative number. A lookup hashes twice and
    compares one stored key, so strangers are told apart.
    """

    def __init__(self, values: dict[bytes, int]):
        n = self.size = len(values)
        self.buckets = max(1, n // 2)
        self.displacements = np.zeros(self.buckets, np.int64)
        self.keys: list[bytes | None] = [None] * n
        self.values: list[int] = [0] * n
        groups: dict[int, list[bytes]] = {}
        for key in values:
            groups.setdefault(xxhash.xxh3_64_intdigest(key) % self.buckets, []).append(key)
        free = np.ones(n, bool)
        order = sorted(groups.items(), key=lambda group: (-len(group[1]), group[0]))
        singles = [group for group in order if len(group[1]) == 1]
        for bucket, keys in order[: len(order) - len(singles)]:
            seed = 1
            while True:
                slots = [self._slot(key, seed) for key in keys]
                if len(set(slots)) == len(slots) and free[slots].all():
                    break
                seed += 1
            self.displacements[bucket] = seed
            self._place(keys, slots, values, free)
        for (bucket, keys), slot in zip(singles, np.flatnonzero(free).tolist(), strict=True):
            self.displacements[bucket] = -1 - slot
            self._place(keys, [slot], values, free)
        self.displacements = self.displacements.tolist()

    def _slot(self, key: bytes, seed: int) -> int:
        return xxhash.xxh3_64_intdigest(key, seed) % self.size

    def _place(self, keys, slots, values, free) -> None:
        for key, slot in zip(keys, slots, strict=True):
            self.keys[slot], self.values[slot], free[slot] = key, values[key], False

    def get(self, key: bytes) -> int | None:
        """The key's value, or None for a stranger."""
        if not self.size:
            return None
        seed = self.displacements[xxhash.xxh3_64_intdigest(key) % self.buckets]
        slot = -1 - seed if seed < 0 else self._slot(key, seed)
        return self.values[slot] if self.keys[slot] == key else None


def merge_bytes(piece: bytes, rank) -> list[int]:
    """Ids of one pre-token: always the lowest-ranked neighbouring pair first, leftmost among equals.

    Parts are linked by where they end and by the part before them; a heap holds pairs as one number of (rank, start,
    end), and an entry is stale if no pair of living parts spans it any more.
    """
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    bits = n.bit_length()
    double, mask = 2 * bits, (1 << bits) - 1
    heap = [(r << double) | (i << bits) | (i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        pair = heappop(heap)
        left, stop = pair >> bits & mask, pair & mask
        middle = end[left]  # 0 if the part at left was merged away
        if not middle or middle >= n or end[middle] != stop:
            continue
        end[left], end[middle] = stop, 0
        if stop < n:
            before[stop] = left
            if (r := rank(piece[left : end[stop]])) is not None:
                heappush(heap, (r << double) | (left << bits) | end[stop])
        if (lower := before[left]) >= 0 and (r := rank(piece[lower:stop])) is not None:
            heappush(heap, (r << double) | (lower << bits) | stop)
    ids, at = [], 0
    while at < n:
        ids.append(rank(piece[at : end[at]]))
        at = end[at]
    return ids


class Codec:
    """Encodes texts to little-endian unsigned 32-bit ids and back."""

    def __init__(self, hashed: PerfectHash, pattern: str, memory: int = MEMORY_BYTES):
        self.table = hashed
        self.token = dict(zip(hashed.values, hashed.keys, strict=True))
        self.rank = dict(zip(hashed.keys, hashed.values, strict=True)).get
        self.encoder = TextEncoder(pattern, self._encode_new, 4, memory=memory)

    def pretoken(self, piece: bytes) -> list[int]:
        """Tier one, or else tier two."""
        whole = self.table.get(piece)
        return [whole] if whole is not None else merge_bytes(piece, self.rank)

    def _encode_new(self, pretokens: list[bytes]) -> list[bytes]:
        return [pack(f"<{len(ids)}I", *ids) for ids in map(self.pretoken, pretokens)]

    def encode(self, texts: list[str | None] | pa.Array) -> Iterator[bytes]:
        return self.encoder.encode(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, *, key: str = "doc_id", text: str = "text", ids: bool = True, decoded: bool = False
) -> DataFrame:
    """Per row: the key, ids (binary, little-endian unsigned 32-bit; if asked), n_tokens, ids_sha256, and of
    what these ids decode to: decoded (text, if asked) and decoded_sha256.

    The vocabulary file is read and hashed on the driver, and the hash with its tokens is broadcast: its size is
    that of the vocabulary, whatever the input. Rows are handled where they are; nothing is shuffled.
    """
    key_type = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((PerfectHash(read_ranks(ranks_path)), pattern))
    columns = f"`{key}` {key_type}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    columns += ", ids binary" * ids + ", decoded string" * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*shared.value)
        for batch in (whole.slice(at, PART_DOCS) for whole in batches for at in range(0, whole.num_rows, PART_DOCS)):
            rows = []
            for x in codec.encode(batch.column(1)):
                back = codec.decode(x)
                rows.append((len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(back).hexdigest(), x if ids else None, back.decode() if decoded else None))
            out = [batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True))]
            yield pa.RecordBatch.from_arrays(out, [key, *_NAMES]).select([key, *names])
            give_back()

    names = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids, *["decoded"] * decoded]
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, columns)


_KINDS = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]
_NAMES = ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
