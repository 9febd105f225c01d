import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lakewright.llm import token_store

DEFINITION = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(DEFINITION)


def library():
    return LIBRARY


def test_round_trip_against_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {r.doc_id: r for r in token_store.store_and_read(docs, DEFINITION, end_id=2, id_width=2).collect()}
    start = 0
    for row in sorted(docs.select("doc_id", "text").collect()):
        ids = np.array([*library().encode(row.text, add_special_tokens=False).ids, 2], "<u4").tobytes()
        got = found[row.doc_id]
        assert (bytes(got.ids), got.start, got.n_tokens, got.ids_crc32) == (ids, start, len(ids) // 4, zlib.crc32(ids))
        start += got.n_tokens


def test_edges_and_single_documents(spark, tmp_path):
    rows = [(5, "b " * 60_000, "x"), (3, None, "x"), (4, "", None), (3, "again", None), (None, "nameless", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    path = str(tmp_path / "store")
    definition = open(DEFINITION).read()
    token_store.write_store(docs, path, definition, end_id=2, id_width=4)
    found = sorted(token_store.read_store(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None, 3, 3, 4, 5]
    assert [r.start for r in found] == [0, *np.cumsum([r.n_tokens for r in found])[:-1]]
    assert token_store.read_document(spark, path, 4) == [2] and token_store.read_document(spark, path, 9) is None
    assert token_store.read_document(spark, path, 5)[:-1] == library().encode("b " * 60_000, add_special_tokens=False).ids


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_store.store_and_read(docs, DEFINITION, end_id=2, id_width=2, path=str(tmp_path / "none")).count() == 0


def test_added_tokens_as_the_library_takes_them(spark, tmp_path):
    """Against a tokenizer on which nothing is set."""
    plain = Tokenizer.from_file(DEFINITION)
    added = [x.content for x in plain.get_added_tokens_decoder().values()]
    texts = [t for a in added for t in (f"end {a} next", a, f"{a}{a} é", f"x{a}y 12", a[:-1])] + ["no such token"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = token_store.store_and_read(docs, DEFINITION, end_id=2, id_width=2, path=str(tmp_path / "added")).collect()
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist()[:-1] for r in found}
    assert added and got == {i: plain.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert [r.start for r in sorted(found)] == [0, *np.cumsum([r.n_tokens for r in sorted(found)])[:-1]]


def test_unusual_characters_and_repeated_rows(spark, tmp_path):
    signs = random.Random(3)
    alphabet = " \n\t\r\x0b\x1c\x85\xa0\u3000\u180e\u200b'sdtrellvm aB1\u00b2\u00bd\u0663\u00e9\u00df\u2014_.,!\u5b57\U0001f600\u0301\u1c89\ua7cb"
    texts = ["".join(signs.choice(alphabet) for _ in range(signs.randint(0, 30))) for _ in range(1500)]
    docs = spark.createDataFrame([(i // 3, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    found = token_store.store_and_read(docs, DEFINITION, end_id=2, id_width=2, path=str(tmp_path / "odd")).collect()
    want = sorted((i // 3, tuple(library().encode(t, add_special_tokens=False).ids)) for i, t in enumerate(texts))
    assert sorted((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()[:-1])) for r in found) == want
    assert [r.start for r in sorted(found, key=lambda r: r.start)] == [0, *np.cumsum([r.n_tokens for r in sorted(found, key=lambda r: r.start)])[:-1]]
    assert [r.doc_id for r in sorted(found, key=lambda r: r.start)] == sorted(r.doc_id for r in found)
