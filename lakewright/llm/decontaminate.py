"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

An item's windows are its runs of WINDOW consecutive words (an item of fewer words is one window). A window occurs
in a document if its words stand there in a row. Containment must be whole, so a prefix of one shingle suffices:
its rarest word. Words are ordered by how often all documents use them; windows of an item that share their rarest
word at one place form an entry, which is joined with the documents' words on that word. The place in the
window bounds where the window would begin and end in the document; what fits is compared word by word.

The entries are broadcast if they are small (BROADCAST_BYTES, measured); documents are then read once for the counts
and once for the join, and only hits are shuffled. Larger entries are joined by shuffling (document, position,
word) and each candidate is then brought to its document's words.

Defined results: words are runs of digits, letters a to z after lower-casing A to Z, and non-ASCII characters; a
null or empty text has none; items without words never occur; repeated item ids count as one item; rows that
repeat a doc_id and text are each reported; empty tables give no rows or no hits; further columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewright.llm.common import materialise

WINDOW = 10
#: Words of a document that are handled as one row.
SEGMENT = 64
#: Bytes of entries, and of the benchmark's vocabulary, up to which they are broadcast.
BROADCAST_BYTES = 48 << 20
#: What separates words, after lower-casing.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Stands with a document's first words, so that each document leaves one row in the join. No word can equal it.
MARK = "\x00"


def words(text: str) -> Column:
    """The words of a text column, as an array that is never null."""
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, SEPARATORS, -1), "")


def item_words(items: DataFrame, key: str, text: str) -> DataFrame:
    """(items: ids with the same words, item_words) of items that have words."""
    return items.select(F.col(key).cast("string").alias("item"), words(text).alias("item_words")).where(F.size("item_words") > 0).groupBy("item_words").agg(F.collect_set("item").alias("items"))


def _small(df: DataFrame, columns: list[str]) -> bool:
    size = sum((F.octet_length(F.to_json(F.struct(c))) for c in columns), F.lit(32))
    return (df.agg(F.sum(size).alias("n")).head().n or 0) <= BROADCAST_BYTES


def word_counts(docs: DataFrame, text: str, vocabulary: DataFrame) -> DataFrame:
    """(word, n): how often all documents use each word of the vocabulary; words that none uses are left out."""
    spread = docs.select(words(text).alias("w")).select(F.explode_outer("w").alias("word"))
    known = F.broadcast(vocabulary) if _small(vocabulary, ["word"]) else vocabulary
    return spread.join(known, "word").groupBy("word").agg(F.count("*").alias("n"))


def entries(items: DataFrame, counts: DataFrame) -> DataFrame:
    """(word, at, span, starts, size, items): `span` are the item words of the windows whose rarest word is `word`,
    which stands at span[at]; the windows begin at `starts` in span and have `size` words."""
    placed = items.select("items", F.size("item_words").alias("length"), "item_words", F.xxhash64("item_words").alias("id"), F.posexplode("item_words").alias("place", "word"))
    rare = placed.join(counts, "word", "left").withColumn("rank", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "place"))
    size = F.least(F.lit(WINDOW), F.col("length"))
    forward = Window.partitionBy("id", "item_words").orderBy("place").rowsBetween(0, WINDOW - 1)
    windows = rare.withColumn("rarest", F.min("rank").over(forward)).where((F.col("place") + size <= F.col("length")) & (F.col("rarest.n") > 0))
    grouped = windows.groupBy("id", "item_words", F.col("rarest.word").alias("word"), F.col("rarest.place").alias("key_place"), size.alias("size")).agg(
        F.first("items").alias("items"), F.sort_array(F.collect_list("place")).alias("places")
    )
    first = F.element_at("places", 1)
    shaped = grouped.select(
        "word",
        (F.col("key_place") - first).alias("at"),
        F.slice("item_words", first + 1, F.element_at("places", -1) + F.col("size") - first).alias("span"),
        F.transform("places", lambda p: p - first).alias("starts"),
        "size",
        "items",
    )
    merged = shaped.groupBy("word", "at", "span", "starts", "size").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return merged


def segments(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, h, n_words, number, start, near, own): documents cut into SEGMENT words each, own, with the words around
    them that a window may reach into, near, which begin at document position `start`. A row stays small however long
    its document is; a document without words has one segment."""
    source = docs.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), words(text).alias("w"))
    numbers = F.sequence(F.lit(0), F.greatest(F.ceil(F.size("w") / SEGMENT) - 1, F.lit(0)).cast("int"))

    def cut(number: Column) -> Column:
        start = F.greatest(number * SEGMENT - (WINDOW - 1), F.lit(0))
        near = F.slice("w", start + 1, F.lit(SEGMENT + 2 * (WINDOW - 1)))
        return F.struct(number.alias("number"), start.alias("start"), near.alias("near"), F.slice("w", number * SEGMENT + 1, F.lit(SEGMENT)).alias("own"))

    return source.select("key", "h", F.size("w").alias("n_words"), F.explode_outer(F.transform(numbers, cut)).alias("s")).select("key", "h", "n_words", "s.*")


def _verified(candidates: DataFrame) -> DataFrame:
    """Candidates whose entry occurs, with `begins`: where its windows begin in the document. Needs base (document
    position of span[0]), `around` (the document's words there) and the entry's columns. What has no entry stays.

    The test runs in an outer explode, which the optimizer doesn't move into the join: the join stays in generated
    code, and only candidates, not all words, are ever copied with the words around them.
    """
    skipped = F.greatest(-F.col("base"), F.lit(0))
    fits = F.filter(
        "starts",
        lambda s: (s >= skipped) & (F.slice("around", s - skipped + 1, F.col("size")) == F.slice("span", s + 1, F.col("size"))),
    )
    hit = F.filter(F.array(F.transform(fits, lambda s: s + F.col("base"))), lambda b: F.size(b) > 0)
    kept = ["key", "h", "n_words", "size", "items"]
    return candidates.select(*kept, F.explode_outer(hit).alias("begins")).where("size IS NULL OR begins IS NOT NULL").select("key", "h", "n_words", "begins", "size", "items")


def _around() -> Column:
    begin = F.greatest(F.col("base"), F.lit(0))
    return F.slice("near", begin - F.col("start") + 1, F.size("span") - (begin - F.col("base")))


def find_hits(docs: DataFrame, found: DataFrame, key: str, text: str, *, broadcast: bool) -> DataFrame:
    """One row for each document (size null) and one for each place where an entry occurs: key, h, n_words, begins, size, items."""
    cut = segments(docs, key, text)
    if broadcast:
        mark = F.when(F.col("number") == 0, F.array(F.lit(MARK))).otherwise(F.array().cast("array<string>"))
        spread = cut.select("key", "h", "n_words", "number", "start", "near", F.posexplode_outer(F.concat("own", mark)).alias("p", "word"))
        table = found.unionByName(found.sparkSession.range(1).select(F.lit(MARK).alias("word")), allowMissingColumns=True)
        joined = spread.join(F.broadcast(table), "word").withColumn("base", F.col("number") * SEGMENT + F.col("p") - F.col("at"))
        return _verified(joined.select("key", "h", "n_words", "base", _around().alias("around"), "span", "starts", "size", "items"))
    numbered = found.withColumn("entry", F.xxhash64("word", "at", "span", "starts"))
    spread = cut.select("key", "h", "number", F.posexplode("own").alias("p", "word"))
    pairs = spread.join(numbered.select("word", "at", "entry"), "word").select(
        F.col("key").alias("k"), F.col("h").alias("hash"), F.col("number").alias("at_number"), (F.col("number") * SEGMENT + F.col("p") - F.col("at")).alias("base"), "entry"
    )
    same = cut.key.eqNullSafe(F.col("k")) & (cut.h == F.col("hash")) & (cut.number == F.col("at_number"))
    near = cut.join(pairs.distinct(), same).join(numbered, "entry").select("key", "h", "n_words", "base", _around().alias("around"), "span", "starts", "size", "items")
    none = [F.lit(None).cast(t).alias(n) for n, t in (("begins", "array<int>"), ("size", "int"), ("items", "array<string>"))]
    return cut.where("number = 0").select("key", "h", "n_words", *none).unionByName(_verified(near))


def contamination(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", broadcast: bool | None = None) -> DataFrame:
    """Per document: key, h (hash of its text), n_words, n_hit, n_items, items_sha256, contaminated, hit_items, spans
    (array of begin and end of the hit runs, in words).

    `broadcast` forces how entries are joined; by default their measured size decides.
    """
    benchmark = item_words(items, item_key, item_text)
    vocabulary = benchmark.select(F.explode("item_words").alias("word")).distinct()
    counts = materialise(word_counts(docs, text, vocabulary), "word-counts")
    found = materialise(entries(benchmark, counts), "benchmark-entries")
    small = _small(found, ["word", "span", "starts", "items"]) if broadcast is None else broadcast
    hits = find_hits(docs, found, key, text, broadcast=small)
    runs = F.transform("begins", lambda b: F.struct(b.alias("begin"), (b + F.col("size")).alias("end")))
    gathered = hits.groupBy("key", "h", "n_words").agg(
        F.count_if(F.col("size").isNull()).alias("copies"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set(runs)))).alias("runs"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("hit_items"),
    )
    empty = F.expr("named_struct('done', array_remove(array(named_struct('begin', 0, 'end', 0)), named_struct('begin', 0, 'end', 0)), 'begin', -1, 'end', -1)")
    folded = F.aggregate(
        "runs",
        empty,
        lambda a, r: F.when(a["end"] < 0, F.struct(a["done"].alias("done"), r["begin"].alias("begin"), r["end"].alias("end")))
        .when(r["begin"] <= a["end"], F.struct(a["done"].alias("done"), a["begin"].alias("begin"), F.greatest(a["end"], r["end"]).alias("end")))
        .otherwise(F.struct(F.concat(a["done"], F.array(F.struct(a["begin"].alias("begin"), a["end"].alias("end")))).alias("done"), r["begin"].alias("begin"), r["end"].alias("end"))),
        lambda a: F.when(a["end"] < 0, a["done"]).otherwise(F.concat(a["done"], F.array(F.struct(a["begin"].alias("begin"), a["end"].alias("end"))))),
    )
    merged = gathered.withColumn("spans", folded)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["begin"]))
    return merged.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(
        F.col("key").alias(key),
        "h",
        F.col("n_words").cast("long"),
        n_hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "hit_items",
        "spans",
    )
