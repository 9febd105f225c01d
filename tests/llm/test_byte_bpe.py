import hashlib
import random
import tracemalloc

import public_tokenizers
import tiktoken

from lakewright.llm import byte_bpe

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def test_perfect_hash_is_minimal_and_perfect():
    ranks = byte_bpe.read_ranks(RANKS)
    table = byte_bpe.PerfectHash(ranks)
    assert sorted(table.keys) == sorted(ranks) and all(table.get(k) == v for k, v in ranks.items())
    assert table.get(b"no such entry in it") is None and byte_bpe.PerfectHash({}).get(b"x") is None


def test_random_texts_against_the_library():
    signs = random.Random(5)
    alphabet = " \n\t\r\x0b\x0c\x1c\x1f\x85\xa0　'sdtrellvm aB1²½٣éß—_.,!#字😀́​"
    texts = ["".join(signs.choice(alphabet) for _ in range(signs.randint(0, 40))) for _ in range(5000)]
    texts += ["", " ", "a" * 20_000, " " * 5000, "\n " * 3000, "<|endoftext|>"]
    codec, library = byte_bpe.Codec(byte_bpe.PerfectHash(byte_bpe.read_ranks(RANKS)), PATTERN), reference()
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_forgetting_changes_nothing():
    codec, library = byte_bpe.Codec(byte_bpe.PerfectHash(byte_bpe.read_ranks(RANKS)), PATTERN, memory=4000), reference()
    texts = [f"word{i} other{i % 7} third" for i in range(600)]
    for text in texts:
        (ids,) = codec.encode([text])
        assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == library.encode_ordinary(text)
    assert len(codec.encoder.look.young) + len(codec.encoder.look.old) < 40


def test_table(spark):
    rows = [(1, "The cat sat", "x"), (1, "The cat sat", "x"), (2, None, None), (3, "", None), (None, "naïve 字", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string")
    found = byte_bpe.encode_documents(docs, RANKS, PATTERN, decoded=True).collect()
    assert len(found) == 5
    for row in found:
        text = {1: "The cat sat", 2: "", 3: "", None: "naïve 字"}[row.doc_id]
        assert row.decoded == text and row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert row.n_tokens == len(reference().encode_ordinary(text)) and row.ids_sha256 == hashlib.sha256(row.ids).hexdigest()
    assert byte_bpe.encode_documents(docs.limit(0), RANKS, PATTERN).count() == 0


def test_many_short_texts_take_little_at_a_time():
    r = random.Random(5)
    words = ["".join(r.choices("abcdefgh", k=r.randint(1, 4))) for _ in range(2000)]
    texts = [" ".join(r.choices(words, k=700)) for _ in range(2500)]
    codec = byte_bpe.Codec(byte_bpe.PerfectHash(byte_bpe.read_ranks(RANKS)), PATTERN)
    tracemalloc.start()
    n = sum(map(len, codec.encode(texts)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n and most < 64 << 20
