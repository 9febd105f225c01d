import hashlib
import random
import re
import string

import pytest

from lakewright.llm import decontaminate

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall((text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))


def plain(text, items):
    own, hit, names = words(text), set(), set()
    for name, body in items:
        theirs = words(body)
        size = min(10, len(theirs))
        for s in range(len(theirs) - size + 1 if size else 0):
            for at in range(len(own) - size + 1):
                if own[at : at + size] == theirs[s : s + size]:
                    hit.update(range(at, at + size))
                    names.add(str(name))
    return len(own), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def case():
    dice = random.Random(11)
    vocabulary = ["the", "of", "Ä", "É9", "x1", "rare", "zeta", "qi", "mu", "Nu"]
    say = lambda n: " ".join(dice.choice(vocabulary) for _ in range(n))
    items = [(i, say(dice.choice([3, 10, 12, 25]))) for i in range(12)] + [(50, None), (51, " .;"), (52, "one"), (10, "the the the the the the the the the the the")]
    items.append((53, items[0][1]))
    texts = [None, "", "  ", "the " * 40, "ONE!", say(400)]
    for _, body in items[:9]:
        texts += [say(15) + " " + body.upper().replace("É", "É") + " " + say(9), body, (body + ", ") * 3, body[: len(body) // 2]]
    docs = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (7, texts[8]), (None, texts[9]), (99, say(5000) + " one")]
    return docs, items


@pytest.mark.parametrize("broadcast", [True, False])
def test_against_a_plain_version(spark, broadcast):
    docs, items = case()
    left = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, words string").repartition(3)
    right = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, word string")
    found = decontaminate.contamination(left, right, broadcast=broadcast).collect()
    got = sorted(str((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)) for r in found)
    assert got == sorted(str((i, *plain(t, items))) for i, t in docs)


def test_empty_tables(spark):
    docs, items = case()
    left = spark.createDataFrame(docs, "doc_id long, text string")
    right = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.contamination(left.limit(0), right).count() == 0
    rows = decontaminate.contamination(left, right.limit(0)).collect()
    assert len(rows) == len(docs) and not any(r.contaminated or r.n_items for r in rows)
