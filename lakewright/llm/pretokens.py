"""Byte-level BPE over Arrow strings: texts are cut into pre-tokens in numpy, and each distinct pre-token of a part is
looked up once in a memory of bounded bytes.

The cut is that of KNOWN_PATTERN. Texts of characters on whose classes all Unicode versions and libraries surely agree
(ASCII without controls, the letters of Latin-1, dashes and quotation marks) are cut by their bytes' classes, all others
by the pattern itself. What the memory holds is what a fresh computation would give, so results don't depend on
what was seen before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: The pattern that the byte classes below stand for.
KNOWN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
UNUSUAL = "[^\\t\\n\\r -~À-ÖØ-öø-ÿ–—‘-‟…]"
#: Bytes of texts that are cut together, bytes of a worker's memory of pre-tokens, and the longest that it keeps.
PART_BYTES, MEMORY_BYTES, LONGEST = 1 << 20, 144 << 20, 64
#: What an entry takes beside its key and value: two objects' heads and its share of the table.
ENTRY_BYTES = 160

_SPACE, _LETTER, _DIGIT, _OTHER = range(4)


def _classes() -> np.ndarray:
    table = np.full(256, _OTHER, np.uint8)
    table[[9, 10, 13, 32]] = _SPACE
    table[[c for c in range(128) if chr(c).isalpha()]] = _LETTER
    table[0xC3] = _LETTER  # leads the letters of Latin-1; 0xE2 leads the dashes and quotation marks
    table[48:58] = _DIGIT
    return table


_CLASS = _classes()


def token_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in the bytes of usual texts that lie one after another; offsets has a text's start and, last, the end."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    kind = _CLASS[data]
    following = np.flatnonzero(data & 0xC0 == 0x80)
    following = following[data[following - 1] == 0xC3]  # other following bytes are of signs, and a sign's class is theirs
    kind[following] = _LETTER
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    space = kind == _SPACE
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    # the last space before something is a match of its own or goes with what follows
    start[:-1] |= space[:-1] & ~space[1:] & ~first[1:-1]
    blank = data == 32
    start[1:] &= ~(blank[:-1] & ~space[1:])
    start |= first[:-1]
    for at in np.flatnonzero((data == 39) & start).tolist():
        if length := _contraction(data[at + 1 : at + 3].tobytes()):
            stop = at + 1 + length
            if not first[at + 1 : stop].any():
                start[at + 1 : stop] = False
                if stop < n:
                    start[stop] = True
    return np.flatnonzero(start)


def _contraction(two: bytes) -> int:
    """How many letters of 's 't 'm 'd 'll 've 're follow the apostrophe."""
    return 1 if two[:1] in (b"s", b"t", b"m", b"d") else 2 if two in (b"ll", b"ve", b"re") else 0


class BoundedMemory:
    """Computed values in two generations, bounded by bytes: when the younger is full it becomes the older, and what is
    asked for again moves to the younger."""

    def __init__(self, compute: Callable[[list[bytes]], list[bytes]], most: int = MEMORY_BYTES):
        self.compute, self.most, self.size = compute, most // 2, 0
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def __call__(self, keys: list[bytes]) -> list[bytes]:
        """The values of distinct keys."""
        found = list(map(self.young.get, keys))
        gaps = [at for at, value in enumerate(found) if value is None]
        if gaps:
            older = self.old
            fresh = [at for at in gaps if keys[at] not in older]
            for at in gaps:
                found[at] = older.get(keys[at])
            for at, value in zip(fresh, self.compute([keys[at] for at in fresh]), strict=True):
                found[at] = value
            for at in gaps:
                key = keys[at]
                if len(key) <= LONGEST:
                    self.young[key] = value = found[at]
                    self.size += len(key) + len(value) + ENTRY_BYTES
                    if self.size > self.most:
                        self.old, self.young, self.size = self.young, {}, 0
        return found


class TextEncoder:
    """Ids of whole texts. `encode_new(pre-tokens)` gives each one's ids as little-endian bytes of `width` each;
    `whole(text)`, where it isn't None for a text, gives the ids of a text that isn't to be cut."""

    def __init__(self, pattern: str, encode_new: Callable[[list[bytes]], list[bytes]], width: int, whole: Callable[[str], bytes | None] | None = None, memory: int = MEMORY_BYTES):
        self.cut = regex.compile(pattern).findall
        self.known = pattern == KNOWN_PATTERN
        self.look = BoundedMemory(encode_new, memory)
        self.whole, self.kind, self.width = whole, {2: "<u2", 4: "<u4"}[width], width

    def encode(self, texts: pa.Array, apart: pa.Array | None = None) -> Iterator[bytes]:
        """Each text's ids; null counts as empty. `apart` marks texts that mustn't be cut by byte classes."""
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, UNUSUAL) if self.known else pa.array([True] * len(texts), pa.bool_())
        if apart is not None:
            odd = pc.or_(odd, apart)
        odd = odd.to_numpy(zero_copy_only=False)
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        at = 0
        while at < len(texts):
            if odd[at]:
                yield self._one(texts[at].as_py())
                at += 1
                continue
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PART_BYTES, "right")) - 1)
            strange = np.flatnonzero(odd[at:stop])
            if len(strange):
                stop = at + int(strange[0])
            yield from self._usual(texts.buffers()[2], offsets[at : stop + 1])
            at = stop

    def _one(self, text: str) -> bytes:
        if self.whole is not None and (ids := self.whole(text)) is not None:
            return ids
        tokens = [x.encode() for x in self.cut(text)]
        distinct = list(dict.fromkeys(tokens))
        return b"".join(map(dict(zip(distinct, self.look(distinct), strict=True)).__getitem__, tokens))

    def _usual(self, data: pa.Buffer | None, offsets: np.ndarray) -> Iterator[bytes]:
        low, high = int(offsets[0]), int(offsets[-1])
        if low == high:
            yield from [b""] * (len(offsets) - 1)
            return
        part = np.frombuffer(data, np.uint8)[low:high]
        offsets = offsets.astype(np.int64) - low
        starts = token_starts(part, offsets)
        edges = np.append(starts, high - low).astype(np.int32)
        tokens = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(part)])
        coded = tokens.dictionary_encode()
        values = self.look(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        codes = coded.indices.to_numpy()
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // self.width
        pool = np.frombuffer(b"".join(values), self.kind)
        begins = np.cumsum(sizes) - sizes
        each = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(each)])
        ids = pool[np.repeat(begins[codes] - ends[:-1], each) + np.arange(ends[-1])]
        bounds = ends[np.searchsorted(starts, offsets)].tolist()
        for a, b in zip(bounds, bounds[1:]):
            yield ids[a:b].tobytes()
