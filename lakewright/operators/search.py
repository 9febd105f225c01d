"""Full-text search over stemmed postings, a stored index of segments, and a router over the kinds of search.

Texts are folded (case, diacritics), cut into runs of letters and digits and stemmed (Porter). A row's key must be its own. The index
has a row for each (entity, id, field, term) with the term's positions. BM25 is that of the common embedded full-text engines: an inverse
document frequency of ln((N - n + 0.5) / (n + 0.5)), at least 1e-6, summed over phrases.

Query grammar: terms are joined by AND; AND, OR, NOT, parentheses, "phrases", prefix*, field:term, field:(...) and NEAR(a b, n).

A stored index (`StoredIndex`) never rewrites what it has: a change adds a segment with the postings of the changed rows and a list of the rows
that it replaces or removes, and a posting counts if no later segment lists its row. Postings lie in blocks, what many rows have of one term, so a term is
written once for many rows and few rows are shuffled and sorted. Blocks lie in buckets by a hash of their term, so a
query reads the folders of its own terms; `compact` writes single buckets anew and leaves the others' files where they are.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakewright.functions.stemming import stem, stem_terms
from lakewright.operators import text as T
from lakewright.operators.relational import limit_or_default
from lakewright.sources.versions import Versions, broadcast_few

BUCKETS = 64
#: How many tokens may lie between the terms of NEAR without a number.
NEAR = 10


@lru_cache(300_000)
def _stem(word: str) -> str:
    return stem(word)


#: (rows, entity, key, fields) of one kind of row.
Source = tuple[DataFrame, str, str | Column, list[str]]


def _wide(sources: list[Source]) -> DataFrame:
    """(entity, id, length, fields) of every row: the tokens of all fields together, and (field, tokens) of each; ids as strings."""
    parts = []
    for rows, entity, key, fields in sources:
        cut = F.array(*(F.struct(F.lit(f).alias("field"), T.tokens(T.folded(F.col(f).cast("string"))).alias("tokens")) for f in fields))
        key = F.col(key) if isinstance(key, str) else key
        parts.append(rows.select(F.lit(entity).alias("entity"), key.cast("string").alias("id"), cut.alias("fields")))
    every = reduce(DataFrame.unionByName, parts)
    return every.select("entity", "id", F.aggregate("fields", F.lit(0), lambda n, f: n + F.size(f["tokens"])).alias("length"), "fields")


def _rows(wide: DataFrame) -> DataFrame:
    """(entity, id, length, field, tokens, at) of every field, the first of a row at 0. Of an inner posexplode Spark infers a filter on the
    array's size, for which it would cut every text once more; each row has fields."""
    return wide.select("entity", "id", "length", F.posexplode_outer("fields").alias("at", "x")).select("entity", "id", "length", "x.field", "x.tokens", "at")


#: Tokens and rows whose postings are put into blocks together.
BLOCK_TOKENS, BLOCK_ROWS = 1 << 20, 10_000
#: ids has a block's ids one after another; numbers has, as little-endian signed 32-bit integers, how many these are, the bytes of each (-1: null),
#: the length of each row, how often each has the term, and at which places. Arrays of arrays take Spark several times as long.
_BLOCK = "entity string, field string, term string, ids string, numbers binary"
_POSTING = "entity string, id string, field string, term string, positions array<int>, length int"


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins; keys aren't empty."""
    return np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each of some runs."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _packed(ids: pa.Array, lengths: pa.Array, counts: np.ndarray, positions: np.ndarray, starts: np.ndarray) -> list[pa.Array]:
    """Columns ids and numbers of the blocks that start at some postings; ids isn't a slice."""
    n = np.diff(np.append(starts, len(ids)))
    placed = np.diff(np.concatenate([[0], np.cumsum(counts)])[np.append(starts, len(ids))])
    edges = np.concatenate([[0], np.cumsum(1 + 3 * n + placed)])
    numbers = np.empty(edges[-1], "<i4")
    numbers[edges[:-1]] = n
    at, each = _places(edges[:-1] + 1, n), np.repeat(n, n)
    for k, values in enumerate((pc.binary_length(ids).fill_null(-1).to_numpy(), lengths.to_numpy(), counts)):
        numbers[at + k * each] = values
    numbers[_places(edges[:-1] + 1 + 3 * n, placed)] = positions
    offsets = np.frombuffer(ids.buffers()[1], np.int32)[np.append(starts, len(ids))]
    joined = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), ids.buffers()[2] or pa.py_buffer(b""))
    return [joined, pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((4 * edges).astype(np.int32)), pa.py_buffer(numbers)])]


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings (entity, id, field, term, positions, length) of blocks (entity, field, term, ids, numbers)."""
    for batch in batches:
        entity, field, term, ids, packed = (x.take(pa.array(np.arange(batch.num_rows), pa.int32())) for x in batch.columns)
        if not batch.num_rows:
            continue
        numbers = np.frombuffer(packed.buffers()[2], "<i4")
        edges = np.frombuffer(packed.buffers()[1], np.int32)[: batch.num_rows + 1].astype(np.int64) // 4
        begins = np.frombuffer(ids.buffers()[1], np.int32)[: batch.num_rows + 1]
        every, low = numbers[edges[:-1]].astype(np.int64), 0
        sums = np.cumsum(every)
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(sums, (sums[low - 1] if low else 0) + BLOCK_TOKENS, "right")))
            n, first = every[low:high], edges[low:high]
            at, each = _places(first + 1, n), np.repeat(n, n)
            sizes, lengths, counts = (numbers[at + k * each] for k in range(3))
            placed = edges[low + 1 : high + 1] - first - 1 - 3 * n
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(numbers[_places(first + 1 + 3 * n, placed)]))
            null, ends = sizes < 0, begins[low] + np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))])
            valid = pa.array(~null).buffers()[1] if null.any() else None
            id_ = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends.astype(np.int32)), ids.buffers()[2] or pa.py_buffer(b""), valid)
            of = pa.array(np.repeat(np.arange(low, high), n), pa.int32())
            yield pa.RecordBatch.from_arrays([entity.take(of), id_, field.take(of), term.take(of), lists, pa.array(lengths)], _POSTED)
            low = high


def _blocks_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    entity, id_, length, field, tokens, at = batch.columns
    first = np.flatnonzero(at.to_numpy(zero_copy_only=False) == 0)
    names = entity.dictionary_encode()
    for number in range(len(names.dictionary)):
        own = pa.array(first[names.indices.to_numpy(zero_copy_only=False)[first] == number], pa.int32())
        if n := len(own):
            none = np.zeros(n, np.int64)
            yield pa.RecordBatch.from_arrays([names.dictionary.slice(number, 1), pa.array([None], pa.string()), pa.array([""]), *_packed(id_.take(own), length.take(own), none, none[:0], np.array([0]))], _NAMES)
    sizes = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = tokens.flatten().dictionary_encode()
    if not len(coded):
        return
    terms: dict[str, int] = {}
    term_of = np.array([terms.setdefault(_stem(word), len(terms)) for word in coded.dictionary.to_pylist()], np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    kinds = names.indices.to_numpy(zero_copy_only=False).astype(np.int64) * (len(field) + 1) + field.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    key = kinds[row] * len(terms) + term_of[coded.indices.to_numpy(zero_copy_only=False)]
    order = np.argsort(key, kind="stable")  # so rows and places stay ascending
    key, row, place = key[order], row[order], place[order]
    begins = _starts(key, row)
    counts = np.diff(np.append(begins, len(row)))
    of, key = row[begins], key[begins]
    blocks = _starts(key)
    heads, taken = pa.array(of[blocks], pa.int32()), pa.array(of, pa.int32())
    lists = _packed(id_.take(taken), length.take(taken), counts, place, blocks)
    found = pa.array(list(terms), pa.string()).take(pa.array(key[blocks] % len(terms)))
    yield pa.RecordBatch.from_arrays([entity.take(heads), field.take(heads), found, *lists], _NAMES)


_NAMES = ["entity", "field", "term", "ids", "numbers"]
_POSTED = ["entity", "id", "field", "term", "positions", "length"]


def _postings(rows: DataFrame) -> DataFrame:
    """Postings in blocks, made where the rows are: a block has what some rows of one kind and field have of one term. Each row is also in one block
    without a field, of the term "", which has the rows' lengths. A worker remembers stems."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.list_value_length(batch.column(4)).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                before = sizes[at - 1] if at else 0
                stop = min(at + BLOCK_ROWS, max(at + 1, int(np.searchsorted(sizes, before + BLOCK_TOKENS, "right"))))
                yield from _blocks_of(batch.slice(at, stop - at))
                at = stop

    return rows.mapInArrow(run, _BLOCK)


def _blocked(postings: DataFrame) -> DataFrame:
    """Postings put into blocks again, those of one term that follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, BLOCK_ROWS) for whole in batches for at in range(0, whole.num_rows, BLOCK_ROWS)):
            entity, id_, field, term, positions, length = batch.columns
            blocks = _starts(*(c.dictionary_encode().indices.to_numpy(zero_copy_only=False) for c in (entity, field, term)))
            heads = pa.array(blocks, pa.int32())
            # a slice begins elsewhere than at 0, which take mends
            every = pa.array(np.arange(batch.num_rows), pa.int32())
            lists = _packed(id_.take(every), length, pc.list_value_length(positions).to_numpy(), positions.flatten().to_numpy(), blocks)
            yield pa.RecordBatch.from_arrays([entity.take(heads), field.take(heads), term.take(heads), *lists], _NAMES)

    return postings.select("entity", "id", "field", "term", "positions", "length").mapInArrow(run, _BLOCK)


def totals(sizes: DataFrame) -> DataFrame:
    """(entity, docs, mean)."""
    return sizes.groupBy("entity").agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))


def bucket_of(term: str) -> int:
    """That of Spark's xxhash64, without asking Spark."""
    x = xxhash.xxh64_intdigest(term.encode(), 42)
    return (x - (1 << 64) if x >> 63 else x) % BUCKETS


class Index:
    """Postings (entity, id, field, term, positions, length) by wanted terms, and totals."""

    def __init__(self, read: Callable[[list[str], list[str]], DataFrame], stats: DataFrame):
        self.read, self.stats = read, stats

    @classmethod
    def of(cls, sources: list[Source]) -> Index:
        """Without storing anything, for a query or two over little: the tokens whose stems are asked for are picked out first."""
        wide = _wide(sources)
        rows = _rows(wide)

        def read(exact: list[str], begin: list[str]) -> DataFrame:
            spread = rows.select("entity", "id", "length", "field", F.posexplode("tokens").alias("at", "token"))
            known = stem_terms(rows.select(F.explode("tokens").alias("term")).distinct()).where(_wanted(F.col("stem"), exact, begin))
            met = spread.join(known.select(F.col("term").alias("token"), F.col("stem").alias("term")), "token")
            return met.groupBy("entity", "id", "length", "field", "term").agg(F.sort_array(F.collect_list("at")).alias("positions"))

        return cls(read, totals(wide))

    @classmethod
    def together(cls, indexes: list[Index]) -> Index:
        """Indexes of different kinds of rows as one."""
        return cls(lambda exact, begin: reduce(DataFrame.unionByName, (x.read(exact, begin) for x in indexes)), reduce(DataFrame.unionByName, (x.stats for x in indexes)))


def _wanted(term: Column, exact: list[str], begin: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [term.isin(*exact)] * bool(exact) + [term.startswith(b) for b in begin])


class StoredIndex(Index):
    """An index in a folder. Its versions list, for each bucket, the folders of postings and up to which version each is clean of dead ones, and
    for each change the rows that it set or removed."""

    def __init__(self, spark: SparkSession, folder: str, version: int | None = None):
        self.spark, self.versions = spark, Versions(spark, folder)
        self.version, self.state = self.versions.read(version)

    def read(self, exact: list[str], begin: list[str]) -> DataFrame:
        chosen = range(BUCKETS) if begin else sorted({bucket_of(t) for t in exact})
        return self._live(chosen, _wanted(F.col("term"), exact, begin))

    @property
    def stats(self) -> DataFrame:
        rows = [(entity, docs, tokens / docs) for entity, (docs, tokens) in (self.state or {"totals": {}})["totals"].items() if docs]
        return self.spark.createDataFrame(rows, "entity string, docs long, mean double")

    def _live(self, buckets, wanted: Column | None = None) -> DataFrame:
        """The (wanted) postings of some buckets whose row no later change has set or removed."""
        parts: dict[int, list[str]] = {}
        for bucket in buckets:
            for path, clean in (self.state or {"buckets": {}})["buckets"].get(str(bucket), []):
                parts.setdefault(clean, []).append(path)
        found = self.spark.createDataFrame([], _POSTING)
        for clean, paths in sorted(parts.items()):
            blocks = self.spark.read.schema(_BLOCK).parquet(*paths)
            blocks = blocks if wanted is None else blocks.where(wanted)
            stored = blocks.select(*_NAMES).mapInArrow(_unpacked, _POSTING)
            later = [c for c in self.state["changes"] if c["version"] > clean]
            if later:
                dead = self.spark.read.parquet(*(c["path"] for c in later)).select("entity", "id").distinct()
                stored = stored.join(broadcast_few(dead, sum(c["rows"] for c in later)), ["entity", "id"], "left_anti").select(*found.columns)
            found = found.unionByName(stored)
        return found

    def change(self, changed: list[Source], gone: DataFrame | None = None, *, number: int | None = None) -> StoredIndex:
        """The index after some rows have been set, in place of what it had of them, and those of gone (entity, id) removed. What hasn't
        changed is neither read nor written. The new version has the next number, or a given later one."""
        path = self.versions.fresh("segment")
        there = []
        if changed:
            bucket = F.when(F.col("field").isNull(), -1).otherwise(F.pmod(F.xxhash64("term"), F.lit(BUCKETS))).cast("int")
            self._write(_postings(_rows(_wide(changed))).withColumn("bucket", bucket), path)
            there = self._buckets(f"{path}/postings")
            sizes = self._sizes(f"{path}/postings/bucket=-1") if -1 in there else self.spark.createDataFrame([], "entity string, id string, length int")
            # a row that is both set and gone is set
            listed = sizes if gone is None else sizes.unionByName(_removed(gone).join(sizes, ["entity", "id"], "left_anti"))
        else:
            listed = _removed(gone) if gone is not None else self.spark.createDataFrame([], "entity string, id string, length int")
        if self.state and self.state["changes"]:
            listed = listed.join(self._lengths_of(listed.select("entity", "id")), ["entity", "id"], "left")
        else:
            listed = listed.withColumn("before", F.lit(None).cast("int"))
        listed.write.parquet(f"{path}/rows")
        written = self.spark.read.schema("entity string, id string, length int, before int").parquet(f"{path}/rows")
        sums = written.groupBy("entity").agg(*(F.count(c).alias(f"n_{c}") for c in ("length", "before")), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("length", "before")), F.count("*").alias("rows"))
        state = self.state or {"buckets": {}, "changes": [], "totals": {}}
        totals, count, number = dict(state["totals"]), 0, number or self.version + 1
        for r in sums.collect():
            docs, tokens = totals.get(r.entity, (0, 0))
            totals[r.entity] = (docs + r.n_length - r.n_before, tokens + r.length - r.before)
            count += r.rows
        buckets = {b: list(parts) for b, parts in state["buckets"].items()}
        for b in (b for b in there if b >= 0):
            buckets.setdefault(str(b), []).append([f"{path}/postings/bucket={b}", number])
        self.versions.commit(number, {"buckets": buckets, "changes": [*state["changes"], {"path": f"{path}/rows", "version": number, "rows": count}], "totals": totals})
        return StoredIndex(self.spark, self.versions.folder, number)

    def _write(self, blocks: DataFrame, path: str) -> None:
        """Blocks by bucket; those of one term are dealt over eight tasks."""
        dealt = blocks.repartition("bucket", F.pmod(F.xxhash64("ids"), F.lit(8)))
        dealt.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings")

    def _sizes(self, path: str) -> DataFrame:
        return self.spark.read.schema(_BLOCK).parquet(path).select(*_NAMES).mapInArrow(_unpacked, _POSTING).select("entity", "id", "length")

    def _lengths_of(self, wanted: DataFrame) -> DataFrame:
        """(entity, id, before): what the index has of the wanted rows; a row's last change counts."""
        changes = self.state["changes"]
        parts = [self.spark.read.parquet(c["path"]).select("entity", "id", "length", F.lit(c["version"]).alias("v")) for c in changes]
        met = reduce(DataFrame.unionByName, parts).join(wanted, ["entity", "id"], "left_semi")
        return met.groupBy("entity", "id").agg(F.max_by("length", "v").alias("before"))

    def _buckets(self, path: str) -> list[int]:
        home = self.versions._paths(path)
        names = [f.getPath().getName() for f in self.versions._system(home).listStatus(home)]
        return sorted(int(n.partition("=")[2]) for n in names if n.startswith("bucket="))

    def clone(self, folder: str) -> StoredIndex:
        """A new index with the same contents, which shares the files that are there; changes of either leave the other as it is."""
        Versions(self.spark, folder).commit(1, self._as_of_one())
        return StoredIndex(self.spark, folder, 1)

    def _as_of_one(self) -> dict:
        if len(self.state["changes"]) > 1:
            raise ValueError("only an index of one change can be cloned; compact it first")
        change = self.state["changes"][0]
        return {"buckets": {b: [[p, 1] for p, _ in parts] for b, parts in self.state["buckets"].items()}, "changes": [{**change, "version": 1}], "totals": self.state["totals"]}

    def compact(self, buckets: list[int] | None = None, parts: int = 4) -> StoredIndex:
        """The index with some buckets written anew without dead postings, or else those of more than `parts` parts; the files of the
        others stay. Changes that every bucket is clean of are forgotten, but for the lengths of their rows, which become one list."""
        state, number = self.state, self.version + 1
        chosen = [b for b, p in state["buckets"].items() if (int(b) in buckets if buckets is not None else len(p) > parts)]
        path = self.versions.fresh("segment")
        after = {b: list(p) for b, p in state["buckets"].items()}
        if chosen:
            live = self._live(map(int, chosen)).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
            dealt = live.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "term", "entity", "field").drop("bucket")
            self._write(_blocked(dealt).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")), path)
            there = set(self._buckets(f"{path}/postings"))
            after |= {b: [[f"{path}/postings/bucket={b}", self.version]] if int(b) in there else [] for b in chosen}
        changes, oldest = state["changes"], min((p[1] for parts_ in after.values() for p in parts_), default=self.version)
        old = [c for c in changes if c["version"] <= oldest]
        if len(old) > 1:
            parts_ = [self.spark.read.parquet(c["path"]).select("entity", "id", "length", F.lit(c["version"]).alias("v")) for c in old]
            last = reduce(DataFrame.unionByName, parts_).groupBy("entity", "id").agg(F.max_by("length", "v").alias("length"))
            last.where("length IS NOT NULL").write.parquet(f"{path}/rows")
            rows = self.spark.read.parquet(f"{path}/rows").count()
            changes = [{"path": f"{path}/rows", "version": old[-1]["version"], "rows": rows}, *changes[len(old) :]]
        self.versions.commit(number, {"buckets": after, "changes": changes, "totals": state["totals"]})
        return StoredIndex(self.spark, self.versions.folder, number)


def _removed(gone: DataFrame) -> DataFrame:
    return gone.select("entity", F.col("id").cast("string").alias("id")).distinct().withColumn("length", F.lit(None).cast("int"))


@dataclass(frozen=True)
class Phrase:
    """Terms in a row, the last one maybe a prefix, in a field or in any; or near each other."""

    terms: tuple[str, ...]
    prefix: bool = False
    field: str | None = None
    near: int | None = None


_PART = re.compile(r'NEAR\s*\([^()]*\)|\w+\s*:\s*\(|(?:\w+\s*:\s*)?"[^"]*"\*?|[()]|[^\s()]+')


def parse(query: str):
    """A tree of ("and" | "or" | "not", left, right) and phrases. An empty query is an error, and so is a parenthesis without its other."""
    parts = _PART.findall(query)
    at = 0

    def words(text: str) -> tuple[str, ...]:
        return tuple(re.findall(r"[^\W_]+", T.fold(text)))

    def leaf(part: str, field: str | None) -> Phrase | None:
        if part.startswith("NEAR") and part.endswith(")"):
            inner, _, number = part[part.index("(") + 1 : -1].partition(",")
            return Phrase(tuple(map(_stem, words(inner))), field=field, near=int(number) if number.strip() else NEAR)
        named = re.match(r"(\w+)\s*:\s*(.+)$", part, re.DOTALL)
        field, body = (named[1], named[2]) if named else (field, part)
        prefix = body.endswith("*")
        found = words(body)
        cut = tuple(w if prefix and i == len(found) - 1 else _stem(w) for i, w in enumerate(found))
        return Phrase(cut, prefix, field) if cut else None

    def either(field: str | None, depth: int):
        nonlocal at
        left = every(field, depth)
        while at < len(parts) and parts[at] == "OR":
            at += 1
            right = every(field, depth)
            left = ("or", left, right) if left and right else left or right
        return left

    def group(field: str | None, depth: int):
        nonlocal at
        inner = either(field, depth + 1)
        if at >= len(parts):
            raise ValueError("a parenthesis isn't closed")
        at += 1
        return inner

    def every(field: str | None, depth: int):
        nonlocal at
        left = None
        while at < len(parts) and parts[at] not in ("OR", ")"):
            word = parts[at]
            at += 1
            if word == "AND":
                continue
            negated = word == "NOT"
            if negated:
                if at >= len(parts) or parts[at] == ")":
                    break
                word = parts[at]
                at += 1
            if word == "(":
                right = group(field, depth)
            elif word.endswith("(") and ":" in word:
                right = group(word[:-1].partition(":")[0].strip(), depth)
            else:
                right = leaf(word, field)
            if right is not None:
                left = ("not", left, right) if negated else ("and", left, right) if left else right
        if at < len(parts) and parts[at] == ")" and not depth:
            raise ValueError("a parenthesis isn't opened")
        return left

    tree = either(None, 0)
    if tree is None or _negative(tree):
        raise ValueError("an empty full-text query")
    return tree


def _negative(tree) -> bool:
    return isinstance(tree, tuple) and tree[0] == "not" and tree[1] is None


def phrases(tree) -> Iterator[Phrase]:
    if isinstance(tree, Phrase):
        yield tree
    elif tree is not None:
        yield from phrases(tree[1])
        if tree[0] != "not":
            yield from phrases(tree[2])


def _all_phrases(tree) -> Iterator[Phrase]:
    if isinstance(tree, Phrase):
        yield tree
    elif tree is not None:
        yield from _all_phrases(tree[1])
        yield from _all_phrases(tree[2])


def _count(phrase: Phrase) -> Column:
    """How often a phrase occurs in a row's hits, an array of (field, term, positions)."""
    own = F.filter("hits", lambda h: h["field"] == phrase.field) if phrase.field else F.col("hits")

    def places(term: str, prefix: bool, field: Column) -> Column:
        same = F.filter(own, lambda h: (h["field"] == field) & (h["term"].startswith(term) if prefix else h["term"] == term))
        return F.flatten(F.transform(same, lambda h: h["positions"]))

    def moved(at: Column, back: int) -> Column:
        return F.transform(at, lambda p: p - back) if back else at

    def within(field: Column) -> Column:
        last = len(phrase.terms) - 1
        lists = [places(t, phrase.prefix and i == last, field) for i, t in enumerate(phrase.terms)]
        if phrase.near is not None:
            # the places from which a term is within reach, of every term; sets of them meet in one pass over each
            from_where = [F.array_distinct(F.flatten(F.transform(x, lambda p: F.sequence(p - (phrase.near + 1), p)))) for x in lists]
            starts = F.array_distinct(F.flatten(F.array(*lists)))
            return F.size(reduce(F.array_intersect, from_where, starts))
        return F.size(reduce(F.array_intersect, [moved(x, i) for i, x in enumerate(lists)]) if last else lists[0])

    fields = F.array_distinct(F.transform(own, lambda h: h["field"]))
    return F.aggregate(F.transform(fields, within), F.lit(0), lambda a, n: a + n)


def _holds(tree, names: dict[Phrase, str]) -> Column:
    if isinstance(tree, Phrase):
        return F.col(names[tree]) > 0
    left, right = _holds(tree[1], names) if tree[1] else F.lit(True), _holds(tree[2], names)
    return left & right if tree[0] == "and" else left | right if tree[0] == "or" else left & ~right


def search(index: Index, query: str, *, entities: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """(entity, id, score): the best `limit` rows of each entity kind, ties by id as a string. Kinds that the index doesn't
    know are dropped."""
    tree = parse(query)
    wanted = list(dict.fromkeys(_all_phrases(tree)))
    exact = sorted({t for p in wanted for i, t in enumerate(p.terms) if not (p.prefix and i == len(p.terms) - 1)})
    begin = sorted({p.terms[-1] for p in wanted if p.prefix})
    found = index.read(exact, begin)
    if entities is not None:
        found = found.where(F.col("entity").isin(*entities)) if entities else found.limit(0)
    rows = found.groupBy("entity", "id", "length").agg(F.collect_list(F.struct("field", "term", "positions")).alias("hits"))
    names = {p: f"p{i}" for i, p in enumerate(wanted)}
    counted = rows.select("entity", "id", "length", *(_count(p).alias(n) for p, n in names.items()))
    hit = counted.groupBy("entity").agg(*(F.count_if(F.col(n) > 0).alias(f"d{n}") for n in names.values()))
    known = counted.where(_holds(tree, names)).join(F.broadcast(hit), "entity").join(F.broadcast(index.stats), "entity")
    score = F.lit(0.0)
    for phrase in dict.fromkeys(phrases(tree)):
        n = names[phrase]
        idf = F.greatest(F.ln((F.col("docs") - F.col(f"d{n}") + 0.5) / (F.col(f"d{n}") + 0.5)), F.lit(1e-6))
        score = score + idf * F.col(n) * (T.K1 + 1) / (F.col(n) + T.K1 * (1 - T.B + T.B * F.col("length") / F.col("mean")))
    ranked = known.select("entity", "id", F.round(score, 6).alias("score"))
    place = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("score"), "id"))
    return ranked.withColumn("place", place).where(F.col("place") <= limit_or_default(limit)).drop("place")


def multi_search(index: Index, query: str, *, entities: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """(entity, id, relevance): each kind's best rows by place, (n - i) / n, whatever the kinds' raw scores."""
    found = search(index, query, entities=entities, limit=limit)
    return T.positional_relevance(found, ["entity"], [F.desc("score"), F.asc("id")]).select("entity", "id", F.round("relevance", 6).alias("relevance"))


MODES = ("vector", "fts", "hybrid", "recursive", "graph")


def route(query: str, mode: str, engines: dict[str, Callable[[str, int], DataFrame]], *, limit: int | None = None) -> DataFrame:
    """A query by its mode. `engines` has a function of (query, limit) for each mode that is set up; an empty query, an
    unknown mode and a mode without an engine are errors."""
    if not query.strip() and mode != "graph":
        raise ValueError("an empty query")
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    if mode not in engines:
        raise ValueError(f"no {mode} search is set up")
    return engines[mode](query, limit_or_default(limit))
