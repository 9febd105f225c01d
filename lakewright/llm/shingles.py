"""Near copies by exact Jaccard similarity of word shingles, through prefixes of the sets in one fixed order.

Texts whose shingle sets have a similarity of LEAST / OF or more are linked, and documents are grouped by what they
can reach. A shingle is known by its 64-bit hash.

* Equal sets are one class; all else works on distinct sets.
* Sets that are similar enough share a shingle among the first n - ceil(n * LEAST / OF) + 1 of each, in whichever order
  all sets are put. Shingles that a sample of documents finds common come last, by their counts; the rest by their
  hashes. The sample only decides how many pairs are tested, never which are found.
* Every set carries a bitmap of BITS bits, each the parity of how many of its shingles hash there. Two bitmaps never differ in more
  bits than the sets differ in shingles, so pairs whose bitmaps differ too much aren't made at all.
* A pair is tested if it shares enough such keys, at places that leave room for the overlap that it needs. A set of more than BITS
  shingles has a sketch as well, a bitmap that grows with it, since BITS parities tell little of large sets; it discards pairs before whole
  sets are moved. What is left is linked if the whole sets, made again from the texts, are similar enough.
* A key of more than FEW sets is first tested against some centres of its own, for rounds that go on while they link anything and for
  ROUNDS at most; then all its sets that are still in another group than its centre are tested against the rest, so no link between
  different groups is lost. A key of more than SPLIT sets is split: a part of SPLIT of them meets all that are apart.

Defined results: those of lakewright.llm.simhash; texts without words are one class.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewright.llm.common import broadcast_if_few, discard, map_batches, materialise
from lakewright.llm.components import components

#: The least similarity, LEAST / OF.
LEAST, OF = 4, 5
SEED = 42
#: Sampled documents, in how many of them a shingle is common, and how many common ones are put last.
SAMPLE_DOCS, COMMON_DOCS, COMMON = 10_000, 3, 100_000
#: Keys of more sets than FEW are tested against centres first, CENTRES for equal keys in each of ROUNDS; SPLIT sets of a key are one part.
FEW, CENTRES, ROUNDS, SPLIT = 16, 8, 4, 1000
#: Bits of a set's bitmap, 64 to a long.
BITS = 512
_BITMAP = [f"b{k}" for k in range(BITS // 64)]


def shingles(text: str, width: int) -> np.ndarray:
    """Ascending hashes of the distinct shingles; a text of fewer words is one shingle."""
    words = text.encode("utf-8").lower().split()  # both know ASCII only
    if not words:
        return np.empty(0, np.int64)
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1 :], strict=False)] or [digest(joined, SEED)]
    return np.unique(np.array(hashes, np.uint64).view(np.int64))


def shingle_sets(docs: DataFrame, *, text: str, width: int) -> DataFrame:
    """(class, shingles): class is the set's hash."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(x or "", width) for x in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(list(map(_class, found)), pa.int64()), _lists(found)], ["class", "shingles"])

    return map_batches(docs.select(text), run, "class long, shingles array<long>")


def _class(found: np.ndarray) -> int:
    x = xxhash.xxh64_intdigest(found.tobytes(), SEED)
    return x - (1 << 64) if x >> 63 else x


def _bitmap(found: np.ndarray, bits: int = BITS) -> np.ndarray:
    return np.packbits((np.bincount(found & (bits - 1), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def sketch(found: np.ndarray) -> np.ndarray:
    """A bitmap of a bit a shingle or more, a power of two; none for a set of up to BITS shingles."""
    return _bitmap(found, 1 << (len(found) - 1).bit_length()) if len(found) > BITS else np.empty(0, np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(np.concatenate(arrays)))


def common_shingles(docs: DataFrame, *, text: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending hashes of shingles that are common in a sample of texts, and their counts there."""
    some = docs.where(F.pmod(F.xxhash64(text), F.lit(max(1, docs.count() // SAMPLE_DOCS))) == 0)
    counted = shingle_sets(some, text=text, width=width).select(F.explode("shingles").alias("s")).groupBy("s").count().where(F.col("count") >= COMMON_DOCS)
    found = sorted((r.s, r["count"]) for r in counted.orderBy(F.desc("count"), "s").limit(COMMON).collect())
    return np.array([s for s, _ in found], np.int64), np.array([n for _, n in found], np.int64)


def prefix(found: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set, in the order of all sets; found is ascending."""
    n = len(found)
    length = n + (-n * LEAST) // OF + 1 if n else 0
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        weights = np.where(common[at] == found, counts[at], 0)
        found = found[np.argsort(weights, kind="stable")]
    return found[:length]


def prefixes(docs: DataFrame, *, key: str, text: str, width: int) -> DataFrame:
    """(key, row, h, class, n, prefix, bits, sketch): row tells rows apart, h is the text's hash, n the size of its set."""
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, text=text, width=width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            classes, sizes, firsts, bitmaps, sketches = [], [], [], [], []
            for x in batch.column(3).to_pylist():
                found = shingles(x or "", width)
                classes.append(_class(found))
                sizes.append(len(found))
                firsts.append(prefix(found, *shared.value))
                bitmaps.append(_bitmap(found))
                sketches.append(sketch(found))
            arrays = [*batch.columns[:3], pa.array(classes, pa.int64()), pa.array(sizes, pa.int32()), *map(_lists, (firsts, bitmaps, sketches))]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "row", "h", "class", "n", "prefix", "bits", "sketch"])

    source = docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), F.xxhash64(text).alias("h"), text)
    return source.mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, row long, h long, class long, n int, prefix array<long>, bits array<long>, sketch array<long>")


def _first(n: Column) -> Column:
    """ceil(n * LEAST / OF)."""
    return F.ceil(n * LEAST / OF)


def _overlap(x: str = "x.n", y: str = "y.n") -> Column:
    return F.ceil((F.col(x) + F.col(y)) * LEAST / (LEAST + OF))


def _near() -> Column:
    """Whether the sizes and the bitmaps of x and y leave it open that they are similar enough."""
    differ = sum((F.bit_count(F.col(f"x.{b}").bitwiseXOR(F.col(f"y.{b}"))) for b in _BITMAP), F.lit(0))
    sized = F.least("x.n", "y.n") * OF >= F.greatest("x.n", "y.n") * LEAST
    return sized & (differ <= F.col("x.n") + F.col("y.n") - 2 * _overlap())


def _sketches_near() -> Column:
    """Whether the sketches us and vs of sets of un and vn shingles leave it open that they are similar enough. The halves of a sketch fold into
    the sketch of half its bits, and sizes are within LEAST / OF, so one fold makes two sketches equally long."""

    def folded(a: str, b: str) -> Column:
        n = F.size(b)
        return F.when(F.size(a) > n, F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, n + 1, n), lambda p, q: p.bitwiseXOR(q))).otherwise(F.col(a))

    differ = F.aggregate(F.zip_with(folded("us", "vs"), folded("vs", "us"), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, x: n + x)
    return differ <= F.col("un") + F.col("vn") - 2 * _overlap("un", "vn")


def candidates(pairs: DataFrame, *, whole: bool) -> DataFrame:
    """(u, v): the distinct pairs of sets that can be similar enough; pairs has key, x and y.

    Their sizes and places must leave room for the overlap o = ceil((nx + ny) * LEAST / (LEAST + OF)). Of the prefix
    that ends first, at most nx - o shingles are missing in the other set and the rest are in its prefix; so if pairs has
    the whole of the keys that two sets share, each once, they must be at least o - ceil(n * LEAST / OF) + 1."""
    overlap = _overlap()
    left = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    least = overlap - _first(F.greatest("x.n", "y.n")) + 1
    named = pairs.where(_near()).select(F.least("x.class", "y.class").alias("u"), F.greatest("x.class", "y.class").alias("v"), least.alias("least"), (left >= overlap).alias("room"))
    if not whole:
        return named.where("room").select("u", "v").distinct()
    return named.groupBy("u", "v").agg(F.count("*").alias("keys"), F.max("least").alias("least"), F.max("room").alias("room")).where("room AND keys >= least").select("u", "v")


def set_groups(once: DataFrame, docs: DataFrame, *, text: str, width: int) -> DataFrame:
    """(node, root) over distinct sets, which once has with their prefixes; roots themselves are left out."""
    # most shingles are one set's only, so bitmaps join the others when those are gone
    keyed = once.select(F.posexplode("prefix").alias("at", "key"), "class").withColumn("members", F.count("*").over(Window.partitionBy("key")))
    shared = keyed.where("members > 1").join(once.select("class", "n", *(F.get("bits", F.lit(k)).alias(b) for k, b in enumerate(_BITMAP))), "class")
    members = materialise(shared.select("key", "members", F.struct("class", "n", "at", *_BITMAP).alias("x")), "shingle-keys")
    groups = members.select(F.col("x.class").alias("node"), F.col("x.class").alias("root")).limit(0)

    def rooted() -> DataFrame:
        joined = members.join(broadcast_if_few(groups), F.col("x.class") == F.col("node"), "left")
        return joined.select("key", "members", "x", F.coalesce("root", "x.class").alias("root"))

    def centred(current: DataFrame, turn: int) -> DataFrame:
        drawn = F.xxhash64(F.lit(turn), F.pmod("key", F.lit(CENTRES)), F.col("x.class"))
        found = current.groupBy("key").agg(F.max(F.struct(drawn.alias("drawn"), "x", "root")).alias("c"), F.min("root").alias("low"), F.max("root").alias("high"))
        return found.where("low <> high").select("key", F.col("c.x").alias("y"), F.col("c.root").alias("centre"))

    def similar(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (u, v) whose whole sets, made again from the texts, are similar enough. Sketches are compared first."""

        def ends() -> DataFrame:
            return broadcast_if_few(materialise(pairs.select(F.explode(F.array("u", "v")).alias("class")).distinct(), "shingle-several"))

        sketched = materialise(once.where(F.size("sketch") > 0).join(ends(), "class").select("class", "n", "sketch"), "shingle-sketches")
        left, right = (sketched.select(F.col("class").alias(c), F.col("n").alias(f"{c}n"), F.col("sketch").alias(f"{c}s")) for c in "uv")
        small = F.col("us").isNull() | F.col("vs").isNull()
        pairs = materialise(pairs.join(left, "u", "left").join(right, "v", "left").where(small | _sketches_near()).select("u", "v"), "shingle-near")
        hashes = materialise(once.join(ends(), "class").select(F.col("h").alias("_h_")), "shingle-texts")
        texts = docs.join(broadcast_if_few(hashes), F.xxhash64(text) == F.col("_h_"), "left_semi")
        known = materialise(shingle_sets(texts, text=text, width=width).dropDuplicates(["class"]), "shingle-sets")
        left, right = (known.select(F.col("class").alias(c), F.col("shingles").alias(f"{c}s")) for c in "uv")
        both = F.size(F.array_intersect("us", "vs"))
        linked = pairs.join(left, "u").join(right, "v").where(both * (LEAST + OF) >= (F.size("us") + F.size("vs")) * LEAST).select("u", "v")
        linked = materialise(linked, "shingle-links")
        discard(known)
        return linked

    def joined_by(pairs: DataFrame, *, whole: bool) -> DataFrame | None:
        """The groups, joined by the similar ones of the pairs; None if there are none."""
        found = similar(materialise(candidates(pairs, whole=whole), "shingle-pairs"))
        if found.isEmpty():
            return None
        return components(groups.select(F.col("root").alias("u"), F.col("node").alias("v")).unionByName(found), "shingle-groups")

    for turn in range(ROUNDS):
        large = rooted().where(F.col("members") > FEW)
        centres = materialise(centred(large, turn), "shingle-centres")
        after = None if centres.isEmpty() else joined_by(large.join(centres, "key").where("root <> centre"), whole=False)
        if after is None:
            break
        groups = after

    def mixed_keys(which: str) -> DataFrame:
        current = rooted().where(which)
        root = F.struct(F.xxhash64(F.lit(ROUNDS), "x.class").alias("drawn"), "root")
        several = current.groupBy("key").agg(F.max(root)["root"].alias("centre"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
        return current.join(several.select("key", "centre").hint("merge"), "key")

    # sets of a key are moved once, to where they meet; only those of a key that is split are moved again
    met = mixed_keys(f"members <= {SPLIT}").select("key", "x", "root", "centre")
    here = met.where("root <> centre").select("key", F.col("x").alias("y"), F.col("root").alias("other")).hint("merge").join(met, "key")
    mixed = materialise(mixed_keys(f"members > {SPLIT}"), "shingle-mixed")
    parts = F.ceil(F.col("members") / SPLIT)
    apart = mixed.where("root <> centre").select("key", F.col("x").alias("y"), F.col("root").alias("other"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    parted = mixed.select("key", "x", "root", "centre", F.pmod(F.col("x.class"), parts).alias("part"))
    # of two that are both apart, each is met by the other, so one of the two ways is taken
    pairs = apart.join(parted, ["key", "part"]).select(*here.columns).unionByName(here).where("root = centre OR other < root")
    after = joined_by(pairs, whole=True)
    return groups if after is None else after


def near_copies(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int) -> DataFrame:
    """Per row: key, h (hash of its text), component_id (the smallest key that it reaches) and kept_h (the smallest hash among
    its group's texts of that key). A key that is null comes after all others."""
    docs = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text))
    marked = materialise(prefixes(docs, key=key, text=text, width=width), "shingle-prefixes")
    first = F.struct(F.col("key").isNull().alias("nameless"), "key", "h")
    classes = materialise(marked.groupBy("class").agg(F.min(first).alias("least"), F.min("row").alias("first"), F.count("*").alias("rows")), "shingle-classes")
    repeated = marked.select("row", "class").join(classes.where("rows > 1").select("class", "first"), "class").where("row <> first").select("row")
    once = marked.join(broadcast_if_few(materialise(repeated, "shingle-repeated")), "row", "left_anti").drop("key", "row")
    groups = set_groups(once, docs, text=text, width=width)
    rooted = classes.join(groups, F.col("class") == F.col("node"), "left").select("class", "least", F.coalesce("root", "class").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    by_class = materialise(rooted.join(named, "root").select(F.col("class").alias("named"), "component"), "shingle-named")
    joined = marked.select("key", "h", "class").join(by_class, F.col("class") == F.col("named"))
    return joined.select(F.col("key").alias(key), "h", F.col("component.key").alias("component_id"), F.col("component.h").alias("kept_h"))
