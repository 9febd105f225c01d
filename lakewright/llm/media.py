"""Media columns by signature sniffing.

One Aho-Corasick automaton finds every known signature in a byte string in a single pass. At each find the
format's validator reads the structure (chunk lengths, marker chains, checksums) and either gives the length
of the medium that starts there or rejects the find. The first medium at offset 0 corrects the declared type,
and valid media further in are carved, also those written in base 64 (data URIs).

`media_of_texts` keeps a text's bytes as 8-bit samples, mono PCM in a WAV file, whatever their length. What is stored is sniffed and read
back by its own structure; the payload is declared plain text, and is corrected if it begins with a valid medium. Features are taken
from the samples that are read back.

Defined results: null bytes count as empty; an empty string, or one without a valid signature at 0, keeps its
declared type (unknown if that is null); equal bytes give equal results, so ties and repeated rows do; overlapping finds of
the same kind that lie inside an accepted medium of that kind are not reported again, but for those in the samples of
a RIFF file; byte strings of any length are read whole; an empty table gives an empty result; further input columns are
ignored whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache, cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "application/octet-stream"
#: Signature bytes and the media type that they announce; (bytes, type, offset of the signature in the medium).
SIGNATURES = [
    (b"\x89PNG\r\n\x1a\n", "image/png", 0),
    (b"\xff\xd8\xff", "image/jpeg", 0),
    (b"GIF87a", "image/gif", 0),
    (b"GIF89a", "image/gif", 0),
    (b"BM", "image/bmp", 0),
    (b"RIFF", "riff", 0),
    (b"fLaC", "audio/flac", 0),
    (b"OggS", "audio/ogg", 0),
    (b"ID3", "audio/mpeg", 0),
    (b"ftyp", "video/mp4", 4),
    (b"%PDF-", "application/pdf", 0),
    (b"PK\x03\x04", "application/zip", 0),
    (b"\x1f\x8b\x08", "application/gzip", 0),
    (b"P5", "image/x-portable-graymap", 0),
    (b";base64,", "base64", 0),
]


class Bytes:
    """A byte string, with the places of marks that validators look for, each found once."""

    def __init__(self, data: bytes):
        self.data = data

    def _places(self, pattern: bytes) -> list[int]:
        return [m.start() for m in re.finditer(pattern, self.data, re.DOTALL)]

    @cached_property
    def jpeg_ends(self) -> list[int]:
        return self._places(b"\xff\xd9")

    @cached_property
    def zeros(self) -> list[int]:
        return self._places(b"\0")

    @cached_property
    def pdf_heads(self) -> list[int]:
        return self._places(rb"%PDF-[0-9]\.")

    @cached_property
    def pdf_ends(self) -> list[int]:
        return self._places(b"%%EOF")

    @cached_property
    def pdf_tables(self) -> list[int]:
        return self._places(b"startxref")

    @cached_property
    def zip_ends(self) -> dict[int, int]:
        """Where an archive starts by its end record, and where it stops."""
        found: dict[int, int] = {}
        for stop in self._places(b"PK\x05\x06"):
            if stop + 22 <= len(self.data):
                size, offset, note = struct.unpack_from("<IIH", self.data, stop + 12)
                start = stop - size - offset
                if start >= 0 and self.data[start + offset : start + offset + 4] == b"PK\x01\x02" and stop + 22 + note <= len(self.data):
                    found.setdefault(start, stop + 22 + note)
        return found


def automaton() -> ahocorasick.Automaton:
    """Over Latin-1 characters, one for each byte."""
    machine = ahocorasick.Automaton()
    for signature, kind, offset in SIGNATURES:
        machine.add_word(signature.decode("latin-1"), (len(signature), kind, offset))
    machine.make_automaton()
    return machine


def _png(data: bytes, at: int, _: Bytes) -> int | None:
    """Chunks with right checksums from IHDR to IEND."""
    position, first = at + 8, True
    while position + 12 <= len(data):
        (length,), name = struct.unpack_from(">I", data, position), data[position + 4 : position + 8]
        stop = position + 12 + length
        if stop > len(data) or first != (name == b"IHDR") or (first and length != 13):
            return None
        if zlib.crc32(data[position + 4 : stop - 4]) != struct.unpack_from(">I", data, stop - 4)[0]:
            return None
        if name == b"IEND":
            return stop - at
        position, first = stop, False
    return None


def _jpeg(data: bytes, at: int, known: Bytes) -> int | None:
    """Marker segments up to the scan, then up to the end marker."""
    position, scan = at + 2, False
    while position + 4 <= len(data) and data[position] == 0xFF:
        marker = data[position + 1]
        if marker == 0xFF:
            position += 1
            continue
        if marker < 0xC0 or 0xD0 <= marker <= 0xD9:
            return None
        (length,) = struct.unpack_from(">H", data, position + 2)
        if length < 2:
            return None
        position += 2 + length
        if marker == 0xDA:
            scan = True
            break
    if not scan:
        return None
    end = bisect_left(known.jpeg_ends, position)
    return known.jpeg_ends[end] + 2 - at if end < len(known.jpeg_ends) else None


def _gif(data: bytes, at: int, _: Bytes) -> int | None:
    """Screen descriptor, then blocks up to the trailer."""
    if at + 13 > len(data):
        return None
    flags = data[at + 10]
    position = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    while position < len(data):
        kind = data[position]
        if kind == 0x3B:
            return position + 1 - at
        if kind == 0x21:
            position += 2
        elif kind == 0x2C and position + 10 <= len(data):
            local = data[position + 9]
            position += 10 + (3 << ((local & 7) + 1) if local & 0x80 else 0) + 1
        else:
            return None
        while position < len(data) and data[position]:
            position += data[position] + 1
        position += 1
    return None


def _bmp(data: bytes, at: int, _: Bytes) -> int | None:
    """Size fields that agree with each other and with what is there."""
    if at + 30 > len(data):
        return None
    size, reserved, start, header = struct.unpack_from("<IIII", data, at + 2)
    planes, depth = struct.unpack_from("<HH", data, at + 26)
    fits = header in (40, 52, 56, 108, 124) and 14 + header <= start <= size <= len(data) - at
    return size if fits and reserved == 0 and planes == 1 and depth in (1, 4, 8, 16, 24, 32) else None


def _riff(data: bytes, at: int, _: Bytes) -> tuple[int, str] | None:
    """A RIFF form whose chunks fill its length; WAVE needs fmt and data, WEBP an image chunk."""
    if at + 12 > len(data):
        return None
    (length,), form = struct.unpack_from("<I", data, at + 4), data[at + 8 : at + 12]
    stop, position, names = at + 8 + length, at + 12, []
    if stop > len(data):
        return None
    while position + 8 <= stop:
        (size,) = struct.unpack_from("<I", data, position + 4)
        names.append(data[position : position + 4])
        position += 8 + size + (size & 1)
    if position != stop and position != stop + 1:
        return None
    if form == b"WAVE" and names[:1] == [b"fmt "] and b"data" in names:
        return stop - at, "audio/wav"
    if form == b"WEBP" and names[:1] and names[0] in (b"VP8 ", b"VP8L", b"VP8X"):
        return stop - at, "image/webp"
    return None


def _flac(data: bytes, at: int, _: Bytes) -> int | None:
    """Metadata blocks from STREAMINFO on; frames run to the end of the data."""
    position, first = at + 4, True
    while position + 4 <= len(data):
        kind, length = data[position] & 0x7F, int.from_bytes(data[position + 1 : position + 4], "big")
        if first and (kind, length) != (0, 34) or kind > 6:
            return None
        last, first = data[position] & 0x80, False
        position += 4 + length
        if last:
            return len(data) - at if position <= len(data) else None
    return None


def _ogg(data: bytes, at: int, _: Bytes) -> int | None:
    """Pages one after another."""
    position = at
    while position + 27 <= len(data) and data[position : position + 5] == b"OggS\x00":
        segments = data[position + 26]
        table = data[position + 27 : position + 27 + segments]
        if len(table) < segments or position + 27 + segments + sum(table) > len(data):
            break
        position += 27 + segments + sum(table)
    return position - at or None


def _mp3(data: bytes, at: int, _: Bytes) -> int | None:
    """A tag with a syncsafe size, then a frame header."""
    if at + 10 > len(data) or data[at + 3] not in (2, 3, 4) or max(data[at + 6 : at + 10]) > 127:
        return None
    a, b, c, d = data[at + 6 : at + 10]
    frame = at + 10 + (a << 21 | b << 14 | c << 7 | d)
    return len(data) - at if frame + 2 <= len(data) and data[frame] == 0xFF and data[frame + 1] & 0xE0 == 0xE0 else None


def _mp4(data: bytes, at: int, _: Bytes) -> int | None:
    """Boxes one after another, from ftyp to at least one more; a box may have a long size, or none and run to the end."""
    position, boxes = at, 0
    while position + 8 <= len(data):
        (size,), name = struct.unpack_from(">I", data, position), data[position + 4 : position + 8]
        if size == 1 and position + 16 <= len(data):
            (size,) = struct.unpack_from(">Q", data, position + 8)
            size = size if size >= 16 else 0
        elif size == 0 and boxes:
            size = len(data) - position
        if size < 8 or position + size > len(data) or not name.isalnum():
            break
        position, boxes = position + size, boxes + 1
    return position - at if boxes >= 2 else None


def _pdf(data: bytes, at: int, known: Bytes) -> int | None:
    """A version, a cross-reference and an end mark: the last before another document begins, as updates append more."""
    if not data[at + 5 : at + 6].isdigit() or data[at + 6 : at + 7] != b".":
        return None
    first = bisect_left(known.pdf_ends, at)
    if first == len(known.pdf_ends):
        return None
    head = bisect_right(known.pdf_heads, known.pdf_ends[first])
    limit = known.pdf_heads[head] if head < len(known.pdf_heads) else len(data)
    stop = known.pdf_ends[bisect_left(known.pdf_ends, limit) - 1]
    table = bisect_left(known.pdf_tables, at)
    return stop + 5 - at if table < len(known.pdf_tables) and known.pdf_tables[table] < stop else None


def _zip(_: bytes, at: int, known: Bytes) -> int | None:
    """An end record whose central directory lies where it says."""
    return known.zip_ends[at] - at if at in known.zip_ends else None


def _gzip(data: bytes, at: int, known: Bytes) -> int | None:
    """A member whose header is whole and that inflates with the right checksum."""
    if at + 18 > len(data) or data[at + 3] & 0xE0:
        return None
    flags, position = data[at + 3], at + 10
    if flags & 4:
        position += 2 + int.from_bytes(data[position : position + 2], "little")
    for name in (8, 16):
        if flags & name:
            end = bisect_left(known.zeros, position)
            if end == len(known.zeros):
                return None
            position = known.zeros[end] + 1
    position += flags & 2
    if position >= len(data) or data[position] & 6 == 6:  # no such kind of block
        return None
    inflate = zlib.decompressobj(31)
    try:
        for start in range(at, len(data), 1 << 16):
            waiting = data[start : start + (1 << 16)]
            while waiting and not inflate.eof:
                inflate.decompress(waiting, 1 << 20)
                waiting = inflate.unconsumed_tail
            if inflate.eof:
                return min(start + (1 << 16), len(data)) - len(inflate.unused_data) - at
    except zlib.error:
        return None
    return None


def _pgm(data: bytes, at: int, _: Bytes) -> int | None:
    """Width, height, depth and as many samples."""
    head = _GRAYMAP.match(data, at)
    if head is None:
        return None
    width, height, most = (int(x) for x in head.groups())
    stop = head.end() + width * height * (2 if most > 255 else 1)
    return stop - at if 0 < most < 65536 and width and height and stop <= len(data) else None


#: Up to the one white-space byte after the depth; samples may begin with white space too.
_GRAYMAP = re.compile(rb"P5\s+(\d{1,9})\s+(\d{1,9})\s+(\d{1,5})\s")
_CODED = re.compile(rb"[A-Za-z0-9+/]+={0,2}")


def _base64(data: bytes, at: int, _: Bytes) -> tuple[int, str] | None:
    """A data URI whose decoded bytes start with a valid medium."""
    run = _CODED.match(data, at + 8)
    if run is None:
        return None
    coded = run[0][: len(run[0]) // 4 * 4]
    inner = sniff(base64.b64decode(coded), _machine())
    return (8 + len(coded), f"{inner[0][0]};base64") if inner and inner[0][1] == 0 else None


VALIDATORS = {
    "image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "riff": _riff, "audio/flac": _flac, "audio/ogg": _ogg, "audio/mpeg": _mp3, "base64": _base64,
    "video/mp4": _mp4, "application/pdf": _pdf, "application/zip": _zip, "application/gzip": _gzip, "image/x-portable-graymap": _pgm,
}


@cache
def _machine() -> ahocorasick.Automaton:
    return automaton()


def sniff(data: bytes, machine: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(type, offset, length) of the valid media in data, by offset."""
    found: list[tuple[str, int, int]] = []
    past: dict[str, int] = {}
    known = Bytes(data)
    for end, (size, kind, inset) in machine.iter(data.decode("latin-1")):
        at = end - size + 1 - inset
        if at < 0 or at < past.get(kind, 0):
            continue
        valid = VALIDATORS[kind](data, at, known)
        if valid is not None:
            length, name = valid if isinstance(valid, tuple) else (valid, kind)
            past[kind] = at + (12 if kind == "riff" else length)
            found.append((name, at, length))
    return sorted(found, key=lambda x: (x[1], -x[2], x[0]))


def store_payload(payload: bytes, rate: int = 8000) -> bytes:
    """The payload as 8-bit mono samples of a WAV file."""
    header = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return header + payload


def samples(medium: bytes, kind: str) -> bytes:
    """The samples of a medium that sniff has found to be of that kind."""
    if kind == "image/x-portable-graymap":
        return medium[_GRAYMAP.match(medium).end() :]
    position = 12
    while kind == "audio/wav" and position + 8 <= len(medium):
        name, size = struct.unpack_from("<4sI", medium, position)
        if name == b"data":
            return medium[position + 8 : position + 8 + size]
        position += 8 + size + (size & 1)
    raise ValueError(f"no samples in {kind}")


def described(kind: str, declared: str, back: bytes) -> str:
    """What the samples are like: their number, sum, spread, largest, different values, and how often neighbours cross the mean."""
    values = np.frombuffer(back, np.uint8)
    total, squares = int(values.sum(dtype=np.int64)), int((values.astype(np.int64) ** 2).sum())
    spread = (squares / len(values) - (total / len(values)) ** 2) ** 0.5
    above = values.astype(np.int64) * len(values) > total
    crossings = int((above[1:] != above[:-1]).sum())
    return f"{kind};declared={declared};corrected={int(kind != declared)};samples={len(values)};sum={total};sd={spread:.4f};peak={int(values.max())};values={len(np.unique(values))};crossings={crossings}"


def sniff_column(rows: DataFrame, key: str, data: str, declared: str | None = None) -> DataFrame:
    """Per row: key, media_type (corrected), corrected (declared differs), carved (array of type, offset, length)."""
    key_type = rows.schema[key].dataType.simpleString()
    picked = rows.select(F.col(key), F.col(data).cast("binary"), (F.col(declared) if declared else F.lit(None)).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in batches:
            kinds, carved = [], []
            said = batch.column(2).to_pylist()
            for value, claim in zip(batch.column(1), said, strict=True):
                media = sniff(value.as_py() or b"", machine)
                kinds.append(media[0][0] if media and media[0][1] == 0 else claim or UNKNOWN)
                carved.append([{"type": t, "offset": o, "length": n} for t, o, n in media])
            spans = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
            wrong = [k != c for k, c in zip(kinds, said, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.string()), pa.array(wrong, pa.bool_()), pa.array(carved, spans)], [key, "media_type", "corrected", "carved"])

    return picked.mapInArrow(run, f"`{key}` {key_type}, media_type string, corrected boolean, carved array<struct<type:string,offset:long,length:long>>")


def media_of_texts(docs: DataFrame, *, key: str = "doc_id", text: str = "text", unit: int = 64, stored: bool = False) -> DataFrame:
    """Stores each text's bytes, padded with zeros to a positive multiple of `unit`, sniffs what was stored, and
    describes what is read back. `stored` adds the stored form as column media."""
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = [_described(x or "", machine, unit) for x in part.column(1).to_pylist()]
                arrays = [part.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(_KINDS[: len(names) - 1]))]
                yield pa.RecordBatch.from_arrays(arrays, names)

    names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *["media"] * stored]
    columns = f"`{key}` {key_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, columns + ", media binary" * stored)


_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]


#: What a text's payload is declared to be, and the form that it is stored in.
DECLARED, STORED = "text/plain", "audio/wav"


def _described(text: str, machine: ahocorasick.Automaton, unit: int) -> tuple:
    raw = text.encode("utf-8")
    medium = store_payload(raw + b"\0" * (unit if not raw else -len(raw) % unit))
    back = samples(medium, STORED)
    first = len(medium) - len(back)
    found = sniff(medium, machine)
    held = [(t, o - first, n) for t, o, n in found if o >= first]
    kind = next((t for t, o, _ in held if o == 0), DECLARED)
    stored = next((t for t, o, _ in found if o == 0), UNKNOWN)
    inside = ",".join(f"{t}@{o}+{n}" for t, o, n in held)
    feature = f"{stored};{described(kind, DECLARED, back)};carved={inside}"
    tail = zlib.crc32(back[-64:])
    return (len(raw), len(back), hashlib.sha256(back).hexdigest(), tail, len(medium), hashlib.sha256(medium).hexdigest(), feature, medium)
