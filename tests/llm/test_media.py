import base64
import gzip
import hashlib
import io
import struct
import time
import zipfile
import zlib

from lakewright.llm import media


def png():
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def archive():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


WAV = media.store_payload(b"abcd" * 16)
GIF = b"GIF89a\x01\x00\x01\x00\x80\x00\x00" + b"\0" * 6 + b"\x2c" + b"\0\0\0\0\x01\0\x01\0\0" + b"\x02\x02D\x01\0" + b";"
PGM = b"P5 2 2 255\n" + b"\1\2\3\4"


def test_formats_are_found_with_their_lengths():
    machine = media.automaton()
    for data, kind in ((png(), "image/png"), (WAV, "audio/wav"), (GIF, "image/gif"), (PGM, "image/x-portable-graymap"), (archive(), "application/zip"), (gzip.compress(b"x" * 99), "application/gzip")):
        assert media.sniff(data, machine)[0] == (kind, 0, len(data))
        assert media.sniff(b"...." + data + b"\0\0", machine)[0] == (kind, 4, len(data))


def test_wrong_structure_is_rejected():
    machine = media.automaton()
    broken = bytearray(png())
    broken[20] ^= 1
    for data in (bytes(broken), WAV[:-1], b"BM and RIFF and GIF89a and ID3 in a text, P5 too, %PDF-, ftyp", b"", b"\xff\xd8\xff"):
        assert media.sniff(data, machine) == []


def test_columns(spark):
    rows = [(1, bytearray(png()), "image/jpeg"), (2, bytearray(b"junk" + GIF), "audio/ogg"), (3, None, None), (4, bytearray(WAV), "audio/wav")]
    found = {r.k: r for r in media.sniff_column(spark.createDataFrame(rows, "k long, data binary, said string"), "k", "data", "said").collect()}
    assert (found[1].media_type, found[1].corrected) == ("image/png", True)
    assert found[2].media_type == "audio/ogg" and [(c.type, c.offset, c.length) for c in found[2].carved] == [("image/gif", 4, len(GIF))]
    assert found[3].media_type == media.UNKNOWN and found[4].corrected is False


def test_texts(spark):
    rows = [(1, "a" * 64, "x"), (2, "é" * 33, "x"), (3, None, None), (4, "", None), (2, "é" * 33, "x"), (5, "word " * 100_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string")
    seen = set()
    for r in media.media_of_texts(docs, stored=True).collect():
        raw = {1: "a" * 64, 2: "é" * 33, 3: "", 4: "", 5: "word " * 100_000}[r.doc_id].encode()
        padded = raw + b"\0" * (64 if not raw else -len(raw) % 64)
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(padded), zlib.crc32(padded[-64:]))
        kind, head = "audio/wav", media.store_payload(padded)[:44]
        assert bytes(r.media) == head + padded and media.samples(bytes(r.media), kind) == padded and len(r.media) == r.media_bytes
        assert (r.payload_sha256, r.media_sha256) == (hashlib.sha256(padded).hexdigest(), hashlib.sha256(head + padded).hexdigest())
        mean = sum(padded) / len(padded)
        sd = (sum((x - mean) ** 2 for x in padded) / len(padded)) ** 0.5
        crossings = sum((x > mean) != (y > mean) for x, y in zip(padded, padded[1:]))
        want = f"{kind};text/plain;declared=text/plain;corrected=0;samples={len(padded)};sum={sum(padded)};sd={sd:.4f};peak={max(padded)};values={len(set(padded))};crossings={crossings};carved="
        assert r.feature == want
        seen.add((raw, r.feature))
    assert len(seen) == len({f for _, f in seen}) == 4
    assert media.media_of_texts(docs.limit(0)).count() == 0


def test_white_space_first_at_every_length():
    """Texts that begin with white space or with a picture's head, around the length from which pictures were once made."""
    machine = media.automaton()
    for size in [*range(0, 70), *range(4040, 4170), 5000]:
        for lead in ("", " ", "\n" * 40, "\t\r\x0b\x0c ", "P5\n", "P5 2 2 255\n"):
            text = (lead + " " * size)[:size]
            raw = text.encode()
            padded = raw + b"\0" * (64 if not raw else -len(raw) % 64)
            got = media._described(text, machine, 64)
            assert got[:6] == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), 44 + len(padded), hashlib.sha256(got[7]).hexdigest())
            assert got[7][44:] == padded and (";corrected=1;" in got[6]) == (text.startswith("P5 2 2 255\n") and len(padded) >= 15)


def test_graymaps_whose_samples_begin_with_white_space():
    for lead in (b" ", b"\n\n ", b"12 ", b"\x0b"):
        data = b"P5\n3 2\n255\n" + (lead + b"......")[:6]
        assert media.sniff(data, media.automaton()) == [("image/x-portable-graymap", 0, len(data))]
        assert media.samples(data, "image/x-portable-graymap") == data[-6:]


def test_media_in_texts_are_carved(spark):
    coded = base64.b64encode(png()).decode()
    text = f"see <img src='data:image/jpeg;base64,{coded}'> and data:image/png;base64,AAAA%%%"
    (row,) = media.media_of_texts(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row.feature.endswith(f";carved=image/png;base64@{text.index(';base64')}+{8 + len(coded)}")


def test_structures_within_structures():
    machine = media.automaton()
    inner = media.store_payload(b"\1\2" * 8)
    outer = media.store_payload(b"...." + inner + b"....")
    assert media.sniff(outer, machine) == [("audio/wav", 0, len(outer)), ("audio/wav", 48, len(inner))]
    pdf = b"%PDF-1.4 a startxref 1 %%EOF more startxref 2 %%EOF"
    assert media.sniff(pdf + b" " + pdf, machine) == [("application/pdf", 0, len(pdf)), ("application/pdf", len(pdf) + 1, len(pdf))]
    box = lambda name, body: struct.pack(">I", 8 + len(body)) + name + body
    long = struct.pack(">I4sQ", 1, b"mdat", 16 + 5) + b"12345"
    open_ended = struct.pack(">I4s", 0, b"mdat") + b"678"
    for tail in (long, open_ended):
        assert media.sniff(box(b"ftyp", b"isom") + tail, machine) == [("video/mp4", 0, 12 + len(tail))]


def test_hostile_bytes_take_linear_time():
    machine, began = media.automaton(), time.process_time()
    for unit in (b"%PDF-1.", b"PK\x03\x04", b"PK\x05\x06", b"\xff\xd8\xff\xe0\0\2\xff\xda\0\2", b"P5 9 9 255\n", b"OggS\0", b"ID3", b"BM", b";base64,", b"RIFF", b"\x1f\x8b\x08"):
        media.sniff(unit * (500_000 // len(unit)), machine)
    assert time.process_time() - began < 60
