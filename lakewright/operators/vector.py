"""Vector scoring and exact top-k over array columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine in [-1, 1]; null when either vector is null or has no length."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length)


def l2_distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))


def vector_search(
    rows: DataFrame,
    query: list[float],
    *,
    vector: str = "embedding",
    key: str = "vec_id",
    where: Column | None = None,
    limit: int = 20,
    min_score: float | None = None,
    metric: str = "cosine",
) -> DataFrame:
    """Exact top-k of one query vector, ties by key.

    The query vector is a literal, so the scan, the filter and the score stay in one stage and
    `orderBy().limit()` plans as TakeOrderedAndProject: k rows leave each task. Rows whose vector is
    null are skipped; one of another length is an error. A min_score filter commutes with the limit, since both
    follow the score, and so runs first.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    wrong = F.raise_error(F.concat(F.lit(f"a vector of {len(query)} numbers was wanted, not of "), F.size(vector).cast("string")))
    usable = rows.where(F.col(vector).isNotNull())
    if where is not None:
        usable = usable.where(where)
    fits = F.when(F.size(vector) == len(query), F.col(vector)).otherwise(wrong.cast(rows.schema[vector].dataType))
    score = cosine_similarity(fits, q) if metric == "cosine" else -l2_distance(fits, q)
    scored = usable.withColumn("score", score)
    if min_score is not None:
        scored = scored.where(F.col("score") >= min_score)
    return scored.orderBy(F.desc_nulls_last("score"), F.asc(key)).limit(limit)


#: Bytes of queries up to which they are broadcast, and how many of them a task scores at a time.
QUERY_BYTES, QUERY_PART = 64 << 20, 1024


def batch_knn(
    queries: DataFrame, rows: DataFrame, *, k: int, vector: str = "embedding", key: str = "vec_id", block: int = 1024, digits: int = 6, exclude_self: bool = True
) -> DataFrame:
    """Exact nearest rows of every query by cosine: (query_id, key, score, place), ties by key.

    Queries are handled in blocks of as many vectors as QUERY_BYTES hold. A block is broadcast, rows are streamed past it
    where they are, in matrix products of `block` rows, and each task passes on k rows a query only, which a window
    then ranks; rows aren't shuffled. `exclude_self` leaves out the row of the query's own key, for queries out of the same
    table. A vector without length has no neighbours and is none; a null vector is skipped; another length is an error.
    """
    q = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("query_id"), F.col(vector).cast("array<float>").alias("q"))
    size = q.agg(F.count("*").alias("n"), F.coalesce(F.sum(4 * F.size("q") + 16), F.lit(0)).alias("bytes")).head()
    blocks = max(1, -(-size.bytes // QUERY_BYTES))
    parts = rows.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("row_id"), F.col(vector).cast("array<float>").alias("v"))
    near = None
    for number in range(blocks):
        members = q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number).orderBy("query_id").toPandas()
        shared = rows.sparkSession.sparkContext.broadcast((members.query_id.to_numpy(), np.array(members.q.tolist(), np.float32)))
        found = parts.mapInPandas(_scan(shared, k, block, digits, exclude_self), "query_id long, row_id long, score double")
        near = found if near is None else near.unionByName(found)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id")
    ranked = near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    return ranked.select("query_id", F.col("row_id").alias(key), "score", "place")


def _scan(shared, k: int, block: int, digits: int, exclude_self: bool):
    def run(frames):
        ids, vectors = shared.value
        if not len(ids):
            return
        parts = [slice(at, at + QUERY_PART) for at in range(0, len(ids), QUERY_PART)]
        scores, rows = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
        for frame in frames:
            for at in range(0, len(frame), block):
                part = frame.iloc[at : at + block]
                b = np.array([np.asarray(x, float) for x in part.v])
                if b.shape[1:] != vectors.shape[1:]:
                    raise ValueError(f"vectors of {vectors.shape[1]} numbers were wanted")
                length = np.linalg.norm(b, axis=1)
                b = (b / np.maximum(length, 1e-300)[:, None]).T
                names = part.row_id.to_numpy()
                # what is held at once is a part of the queries by a block of rows, however many there are of either
                for own in parts:
                    a = vectors[own].astype(float)
                    a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
                    found = np.round(a @ b, digits)
                    found[:, length == 0] = -np.inf
                    found[np.abs(a).sum(1) == 0] = -np.inf
                    if exclude_self:
                        found[ids[own][:, None] == names[None, :]] = -np.inf
                    both = np.concatenate([scores[own], found], axis=1)
                    named = np.concatenate([rows[own], np.broadcast_to(names, found.shape)], axis=1)
                    order = np.lexsort((named, -both), axis=1)[:, :k]
                    scores[own], rows[own] = np.take_along_axis(both, order, 1), np.take_along_axis(named, order, 1)
        for own in parts:
            out = pd.DataFrame({"query_id": np.repeat(ids[own], k), "row_id": rows[own].ravel(), "score": scores[own].ravel()})
            yield out[np.isfinite(out.score)]

    return run


# --- places of relevant rows ---------------------------------------------------------------------------------------------

#: Bytes of vectors a block, and queries and rows that are scored at a time.
BLOCK_BYTES, TILE_QUERIES, TILE_ROWS = 32 << 20, 256, 1024
#: In millionths, above and below every cosine: what DuckDB has as NaN (a vector without length), and null (no vector).
UNDEFINED, MISSING = 2e6, -2e6


def relevant_places(rows: DataFrame, *, k: int, vector: str = "embedding", key: str = "vec_id", group: str = "label") -> DataFrame:
    """Every row as a query against all others, by cosine rounded to six digits, ties by key: (query_id, place, good) of its k
    nearest, good if they are of its own group, and of its nearest row of that group, wherever that stands.

    Order is SQL's: cosines with a vector without length come first (NaN), those with a null vector last; vectors of several
    lengths are an error. Keys are unique, those that are null take no part; groups are whole numbers. All pairs are scored: the
    time is quadratic by nature. Rows are dealt into blocks by hash and each pair of blocks is a task, so a task holds two blocks of
    BLOCK_BYTES at most and nothing goes through the driver. The first step finds each query's nearest row of its group, the
    second its k nearest and how many rows are ahead of that one.
    """
    plain = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"), F.col(group).cast("long").alias("g"))
    size = plain.agg(F.count("*").alias("n"), F.coalesce(F.sum(4 * F.array_size("v")), F.lit(0)).alias("bytes"), F.min(F.array_size("v")).alias("least"), F.max(F.array_size("v")).alias("most")).head()
    if size.least != size.most:
        raise ValueError(f"vectors of one length were wanted, not of {size.least} to {size.most} numbers")
    # as many blocks as their bytes need, or as give each core a few pairs
    wide = int(np.ceil(np.sqrt(4 * rows.sparkSession.sparkContext.defaultParallelism)))
    blocks = max(1, -(-size.bytes // BLOCK_BYTES), min(wide, -(-size.n // TILE_ROWS)))
    found = _pairs(plain.where(F.col("g").isNotNull()), blocks).mapInArrow(_nearest_of_group(size.most or 0), "id long, far long, first long")
    first = found.groupBy("id").agg(F.min(F.struct("far", "first")).alias("f")).select("id", "f.far", "f.first")
    seen = _pairs(plain.join(first, "id", "left"), blocks).mapInArrow(_nearest_and_ahead(size.most or 0, k), "id long, ahead long, top array<struct<far: long, id: long, good: boolean>>")
    each = seen.groupBy("id").agg(F.sum("ahead").alias("ahead"), F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
    near = F.transform("top", lambda x, at: F.struct((at + 1).cast("long").alias("place"), x["good"].alias("good")))
    beyond = F.when(F.col("ahead") >= k, F.array(F.struct((F.col("ahead") + 1).alias("place"), F.lit(True).alias("good")))).otherwise(F.array().cast("array<struct<place: long, good: boolean>>"))
    return each.select(F.col("id").alias("query_id"), F.inline(F.concat(near, beyond)))


def _pairs(rows: DataFrame, blocks: int) -> DataFrame:
    """Each row as a query (own) beside every block of rows, and as a row beside every block of queries; a partition a pair of blocks."""
    part, own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), F.col("at") < blocks
    dealt = rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(2 * blocks - 1))))
    pair = F.when(own, part * blocks + F.col("at")).otherwise((F.col("at") - blocks) * blocks + part)
    return dealt.select(pair.alias("pair"), own.alias("own"), *rows.columns).repartitionById(blocks * blocks, F.col("pair"))


class _Side:
    """Queries or rows of a pair of blocks, in the order of their keys."""

    def __init__(self, table: pa.Table, dim: int):
        table = table.combine_chunks().sort_by("id")
        column = lambda name, kind: table[name].fill_null(0).to_numpy().astype(kind)
        self.id, self.g, self.grouped = table["id"].to_numpy(), column("g", np.int64), table["g"].is_valid().to_numpy()
        self.missing, self.v = table["v"].is_null().to_numpy(), np.zeros((len(table), dim), np.float32)
        self.v[~self.missing] = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) if dim else 0
        length = np.sqrt(np.einsum("ij,ij->i", self.v, self.v, dtype=float))
        self.undefined = ~self.missing & ~((length > 0) & (length < np.inf))
        self.length = np.where(self.missing | self.undefined, 1, length)
        if "first" in table.column_names:
            known = table["first"].is_valid().to_numpy()
            self.score, self.first = np.where(known, -column("far", float), np.inf), np.where(known, column("first", np.int64), -1)

    def unit(self, at) -> np.ndarray:
        return np.where((self.missing | self.undefined)[at, None], 0, self.v[at]).astype(float) / self.length[at, None]


def _sides(batches, dim: int) -> tuple[_Side, _Side] | None:
    found = list(batches)
    if not found:
        return None
    table = pa.Table.from_batches(found)
    return _Side(table.filter(table["own"]), dim), _Side(table.filter(pc.invert(table["own"])), dim)


def _millionths(q: _Side, r: _Side, at, to) -> np.ndarray:
    """Cosines times a million, not yet rounded; -inf where a query meets itself."""
    found = (q.unit(at) * 1e6) @ r.unit(to).T
    found[q.undefined[at]] = UNDEFINED
    found[:, r.undefined[to]] = UNDEFINED
    found[q.missing[at]] = MISSING
    found[:, r.missing[to]] = MISSING
    ids, names = q.id[at], r.id[to]
    place = np.searchsorted(names, ids)
    same = np.flatnonzero(names[np.minimum(place, len(names) - 1)] == ids)
    found[same, place[same]] = -np.inf
    return found


def _rounded(x: np.ndarray) -> np.ndarray:
    """Halves go away from zero, as in SQL."""
    return np.trunc(x + np.copysign(0.5, x))


def _where(found: np.ndarray):
    """np.nonzero, several times as fast where little is found."""
    return np.divmod(np.flatnonzero(found), found.shape[1])


def _tiles(n: int, size: int):
    return (slice(at, min(n, at + size)) for at in range(0, n, size))


def _nearest_of_group(dim: int):
    def run(batches):
        if (sides := _sides(batches, dim)) is None:
            return
        q, r = sides
        score, first = np.full(len(q.id), -np.inf), np.zeros(len(q.id), np.int64)
        by_group = np.argsort(q.g, kind="stable"), np.argsort(r.g, kind="stable")  # within a group by key
        both = np.intersect1d(q.g, r.g)
        bounds = (np.searchsorted(x.g[order], both, side) for x, order in zip((q, r), by_group) for side in ("left", "right"))
        for a, b, c, d in zip(*bounds):
            for rows in _tiles(d - c, TILE_ROWS):
                to = by_group[1][c:d][rows]
                for queries in _tiles(b - a, TILE_QUERIES):
                    at = by_group[0][a:b][queries]
                    found = _rounded(_millionths(q, r, at, to))
                    best = found.argmax(1)  # the first of equal ones has the least key
                    most = found[np.arange(len(at)), best]
                    new = most > score[at]
                    score[at[new]], first[at[new]] = most[new], r.id[to[best[new]]]
        known = np.isfinite(score)
        yield pa.RecordBatch.from_pydict({"id": q.id[known], "far": (-score[known]).astype(np.int64), "first": first[known]})

    return run


def _nearest_and_ahead(dim: int, k: int):
    def run(batches):
        if (sides := _sides(batches, dim)) is None:
            return
        q, r = sides
        for queries in _tiles(len(q.id), TILE_QUERIES):
            n = queries.stop - queries.start
            ahead, wanted, named = np.zeros(n, np.int64), q.score[queries], q.first[queries]
            score, place = np.full((n, k), -np.inf), np.zeros((n, k), np.int64)  # places in r, which are in the order of keys
            for rows in _tiles(len(r.id), TILE_ROWS):
                found = _millionths(q, r, queries, rows)
                # a later row has a larger key, so only a greater score takes a place; 0.6 is more than rounding moves
                least = score[:, -1]
                if rows.start == 0 and found.shape[1] > k:
                    least = np.partition(found, -k, axis=1)[:, -k] - 1.2
                own, row = _where(found > (least + (-0.6 if rows.start == 0 else 0.4))[:, None])
                if len(own):
                    own, row, new = np.r_[np.repeat(np.arange(n), k), own], np.r_[place.ravel(), row + rows.start], np.r_[score.ravel(), _rounded(found[own, row])]
                    order = np.lexsort((row, -new, own))
                    order = order[np.arange(len(order)) - np.searchsorted(own[order], own[order]) < k].reshape(n, k)
                    score, place = new[order], row[order]
                over = found > (wanted + 0.6)[:, None]
                ahead += np.count_nonzero(over, axis=1)
                own, row = _where((found >= (wanted - 0.6)[:, None]) ^ over)
                close, names = _rounded(found[own, row]), r.id[rows][row]
                before = (names != named[own]) & ((close > wanted[own]) | ((close == wanted[own]) & (names < named[own])))
                ahead += np.bincount(own[before], minlength=n)
            held = np.isfinite(score)
            good = (q.g[queries, None] == r.g[place]) & q.grouped[queries, None] & r.grouped[place] if len(r.id) else held
            top = pa.StructArray.from_arrays([(-score[held]).astype(np.int64), r.id[place[held]], good[held]], names=["far", "id", "good"])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(held.sum(1))].astype(np.int32)), top)
            yield pa.RecordBatch.from_arrays([pa.array(q.id[queries]), pa.array(ahead), lists], names=["id", "ahead", "top"])

    return run


# --- inverted-file index -----------------------------------------------------------------------------------------------

#: Vectors that centres are fitted on, those of the lowest hash of their key, and the steps of the fit.
SAMPLE, STEPS = 10_000, 8


def fit_centres(rows: DataFrame, *, cells: int, vector: str = "embedding", key: str = "vec_id") -> list[list[float]]:
    """Unit centres by k-means over a bounded sample."""
    some = rows.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(F.col(key).cast("string"))).limit(SAMPLE).select(vector).collect()
    x = np.array([r[0] for r in some], float)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    centres = x[:: max(1, len(x) // cells)][:cells].copy()
    for _ in range(STEPS):
        own = (x @ centres.T).argmax(1)
        for c in range(len(centres)):
            if (own == c).any():
                centres[c] = x[own == c].mean(0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
    return centres.tolist()


def build_ivf(rows: DataFrame, path: str, *, cells: int = 16, vector: str = "embedding", key: str = "vec_id") -> None:
    """Writes every row to the folder of its nearest centre, and the centres beside them."""
    centres = fit_centres(rows, cells=cells, vector=vector, key=key)
    shared = rows.sparkSession.sparkContext.broadcast(np.array(centres))

    @F.pandas_udf("int")
    def nearest(found: pd.Series) -> pd.Series:
        return pd.Series([int((shared.value @ np.asarray(x, float)).argmax()) for x in found])

    placed = rows.where(F.col(vector).isNotNull()).withColumn("cell", nearest(vector))
    placed.write.partitionBy("cell").mode("overwrite").parquet(f"{path}/cells")
    rows.sparkSession.createDataFrame([(i, c) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")


def search_ivf(spark, path: str, query: list[float], *, probes: int = 12, vector: str = "embedding", key: str = "vec_id", limit: int = 20) -> DataFrame:
    """Top-k of the cells nearest to the query; with as many probes as cells it is exact. Only those folders are read."""
    q = F.array(*(F.lit(float(x)) for x in query))
    near = spark.read.parquet(f"{path}/centres").orderBy(F.desc(dot(F.col("centre"), q)), "cell").limit(probes)
    cells = [r.cell for r in near.select("cell").collect()]
    return vector_search(spark.read.parquet(f"{path}/cells").where(F.col("cell").isin(*cells)), query, vector=vector, key=key, limit=limit).drop("cell")
