import random
from itertools import combinations

import corpus_pipeline
from lakewright.llm import shingles


def plain(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def grouped(texts):
    """Smallest key reachable over links of Jaccard similarity 0.8, by brute force."""
    places, sets, root = {}, {}, {k: k for k in texts}
    for k, t in texts.items():
        sets[k] = sum(1 << p for p in {places.setdefault(x, len(places)) for x in plain(t)})

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(sets, 2):
        if sets[a] == sets[b] or 5 * (sets[a] & sets[b]).bit_count() >= 4 * (sets[a] | sets[b]).bit_count():
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k: find(k) for k in texts}


def edited():
    """Families of copies with zero to four changed words, a large family, strangers that share a passage, short texts."""
    dice = random.Random(5)
    draw = lambda n: [f"w{dice.randrange(5000)}" for _ in range(n)]
    texts, passage = ["", None, " \n", "one", "One", "one two", "a b c d e", "a b c d e f"], draw(40)
    for family in range(9):
        first = draw(dice.randint(60, 300))
        for _ in range(90 if family == 0 else 6):
            copy = list(first)
            for _ in range(dice.randint(0, 4)):
                copy[dice.randrange(len(copy))] = draw(1)[0]
            texts.append(" ".join(copy))
    texts += [" ".join(draw(60) + passage + draw(10)) for _ in range(30)]
    return dict(enumerate(texts))


def test_groups_against_brute_force(spark, monkeypatch):
    texts, expected = edited(), grouped(edited())
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    for common in (shingles.COMMON, 5):
        monkeypatch.setattr(shingles, "COMMON", common)
        found = {r.doc_id: r.component_id for r in shingles.near_copies(docs, width=5).collect()}
        assert found == expected and len(texts) - 60 > len(set(found.values())) > 30


def test_stage_drops_edited_copies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    expected = set(grouped({r.doc_id: r.text for r in docs.collect()}).values())
    assert {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()} == expected


def test_empty_table_and_missing_ids(spark):
    docs = spark.createDataFrame([(None, "some words here"), (3, "some words here"), (None, "others"), (3, None)], "doc_id long, text string")
    found = sorted(((r.doc_id, r.component_id) for r in shingles.near_copies(docs, width=5).collect()), key=str)
    assert found == [(3, 3), (3, 3), (None, 3), (None, None)]
    assert shingles.near_copies(docs.limit(0), width=5).count() == 0


def test_bitmaps_never_differ_in_more_bits_than_sets_in_shingles():
    dice = random.Random(3)
    texts = [" ".join(dice.choices("abcdefghij", k=dice.choice([0, 3, 50, 900, 4000]))) for _ in range(30)]
    sets = [shingles.shingles(t, 5) for t in texts]
    bits = [sum(int(b) % 2**64 << 64 * k for k, b in enumerate(shingles._bitmap(s))) for s in sets]
    for a, b in combinations(range(len(sets)), 2):
        assert (bits[a] ^ bits[b]).bit_count() <= len(set(sets[a].tolist()) ^ set(sets[b].tolist()))


def test_large_group_of_falling_similarity(spark, monkeypatch):
    """2,000 copies of one text with 0 to 19 changed words: the more are changed, the fewer copies are similar enough."""
    monkeypatch.setattr(shingles, "SPLIT", 300)
    dice = random.Random(8)
    first, texts = [f"w{k}" for k in range(140)], []
    for k in range(2000):
        copy = list(first)
        for at in dice.sample(range(len(copy)), k // 100):
            copy[at] = f"x{dice.randrange(400)}"
        texts.append(" ".join(copy))
    texts = dict(enumerate(texts))
    expected = grouped(texts)
    found = shingles.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4), width=5).collect()
    assert {r.doc_id: r.component_id for r in found} == expected
    assert 100 < len(set(expected.values())) < 1900


def test_sketches_spare_whole_sets(spark, monkeypatch):
    """Long texts of which a half or more is common are told apart by sketches; whole sets are made only of the two that are nearly similar enough and of near copies."""
    dice = random.Random(4)
    passage = [f"p{k}" for k in range(2400)]
    own = lambda n: [f"w{dice.randrange(10**6)}" for _ in range(n)]
    texts = [" ".join(passage + own(1600)) for _ in range(10)]
    first = own(5000)
    texts += [" ".join(first[: 5000 - n] + own(n)) for n in (0, 100, 500, 560, 3000)]
    texts += [" ".join(texts[0].split()[:3900] + own(200))]  # sketches of different sizes, links by whole sets
    texts, made, write = dict(enumerate(texts)), [], shingles.materialise

    def written(df, label, *more):
        done = write(df, label, *more)
        if label == "shingle-sets":
            made.append(done.count())
        return done

    monkeypatch.setattr(shingles, "materialise", written)
    monkeypatch.setattr(shingles, "COMMON", 0)  # else the passage comes last and brings no pairs together
    found = shingles.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2), width=5).collect()
    expected = grouped(texts)
    assert {r.doc_id: r.component_id for r in found} == expected and expected[15] == 0 and len(set(expected.values())) == 13
    assert made and sum(made) <= 8


def test_sketches_never_differ_in_more_bits_than_sets_in_shingles(spark):
    dice = random.Random(6)
    words = [f"w{k}" for k in range(1300)]
    sets = []
    for _ in range(16):
        kept = words[: dice.choice([1000, 1020, 1100, 1200])]
        for at in dice.sample(range(len(kept)), dice.choice([0, 20, 60, 200])):
            kept[at] = f"x{dice.randrange(10**6)}"
        sets.append(shingles.shingles(" ".join(kept), 5))
    pairs = [(a, b) for a, b in combinations(sets, 2) if min(len(a), len(b)) * 5 >= max(len(a), len(b)) * 4]
    assert {len(shingles.sketch(s)) for s in sets} == {16, 32}
    rows = [(len(a), len(b), shingles.sketch(a).tolist(), shingles.sketch(b).tolist(), 9 * len(set(a.tolist()) & set(b.tolist())) >= 4 * (len(a) + len(b))) for a, b in pairs]
    told = spark.createDataFrame(rows, "un int, vn int, us array<long>, vs array<long>, similar boolean").withColumn("near", shingles._sketches_near()).collect()
    assert all(r.near for r in told if r.similar) and any(r.similar and len(r.us) != len(r.vs) for r in told) and any(not r.near for r in told)
