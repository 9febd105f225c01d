"""Nearest neighbours through cells and product-quantised codes.

Every row lies in the cell of its nearest centre. Its unit vector is cut into parts, and each part is replaced by the number of the nearest of
up to 256 codes of its part, so a vector of 64 numbers becomes a few bytes. Centres and codebooks are fitted by k-means on a bounded sample
(SAMPLE vectors, those of the lowest hash of their key); every row is encoded and stored, in tiles of about TILE rows of one cell.

A query goes to its nearest cells, as many as `probes`; with all cells none is left out. Blocks of a cell's queries are joined with the cell's
tiles. There the inner products of a query with all codes of each part are one table of numbers, and the sum of what a row's codes look up
in it estimates their cosine. The best k x oversample rows of a query by that estimate are ranked again by their exact cosine.
`vector.batch_knn` and `vector.vector_search` stay the exact way.

Rows without a vector or of no length are in no index and no result; vectors of another length than the first are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakewright.operators.vector import cosine_similarity, fit_centres
from lakewright.sources.versions import broadcast_few

#: Vectors that codebooks are fitted on, and the steps of the fit.
SAMPLE, STEPS = 20_000, 12
#: Rows of a tile, and queries of a block.
TILE, BLOCK = 20_000, 256


def _units(column: pa.Array, width: int | None = None) -> np.ndarray:
    x = np.array([v for v in column.to_pylist()], float) if len(column) else np.empty((0, width or 0))
    if x.ndim != 2 or (width is not None and x.shape[1] != width):
        raise ValueError(f"vectors of {width} numbers were wanted")
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def fit_codebooks(rows: DataFrame, *, parts: int = 16, codes: int = 256, vector: str = "embedding", key: str = "vec_id") -> np.ndarray:
    """parts x codes x numbers of a part. A part's first centres are evenly spaced members of the sample, so the
    fit is the same each time."""
    some = rows.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(F.col(key).cast("string")), key).limit(SAMPLE).select(vector).toArrow()
    x = _units(some.column(0).combine_chunks())
    if not len(x) or x.shape[1] % parts:
        raise ValueError(f"vectors must be there and have a multiple of {parts} numbers")
    books = []
    for piece in np.split(x, parts, axis=1):
        centres = piece[:: max(1, len(piece) // codes)][:codes].copy()
        for _ in range(STEPS):
            own = ((centres**2).sum(1) - 2 * piece @ centres.T).argmin(1)
            sums = np.zeros_like(centres)
            np.add.at(sums, own, piece)
            n = np.bincount(own, minlength=len(centres))[:, None]
            centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
        books.append(centres)
    return np.stack(books)


def encode(rows: DataFrame, centres: np.ndarray, books: np.ndarray, *, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(row_id, cell, codes): a byte for each part."""
    shared = rows.sparkSession.sparkContext.broadcast((centres, books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, books = shared.value
        width = books.shape[2]
        for batch in batches:
            if batch.num_rows:
                x = _units(batch.column(1), books.shape[0] * width)
                found = np.stack([((b**2).sum(1) - 2 * x[:, p * width : (p + 1) * width] @ b.T).argmin(1) for p, b in enumerate(books)], axis=1).astype(np.uint8)
                cells = (x @ centres.T).argmax(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells), pa.array([row.tobytes() for row in found], pa.binary())], ["row_id", "cell", "codes"])

    alive = rows.where(F.col(vector).isNotNull() & F.exists(vector, lambda v: v != 0))
    return alive.select(F.col(key).cast("long").alias("row_id"), vector).mapInArrow(run, "row_id long, cell int, codes binary")


def write_index(rows: DataFrame, path: str, *, cells: int = 16, parts: int = 16, codes: int = 256, vector: str = "embedding", key: str = "vec_id") -> None:
    """Centres, codebooks and every row's codes in tiles, each in a folder of its own."""
    spark = rows.sparkSession
    centres = np.array(fit_centres(rows, cells=cells, vector=vector, key=key))
    books = fit_codebooks(rows, parts=parts, codes=codes, vector=vector, key=key)
    encode(rows, centres, books, vector=vector, key=key).write.mode("overwrite").parquet(f"{path}/codes")
    found = spark.read.parquet(f"{path}/codes")
    tiles = found.groupBy("cell").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    dealt = found.join(F.broadcast(tiles), "cell").withColumn("tile", F.pmod(F.xxhash64("row_id"), F.col("tiles")))
    held = dealt.groupBy("cell", "tile").agg(F.sort_array(F.collect_list(F.struct("row_id", "codes"))).alias("held"))
    held.select("cell", "tile", F.col("held.row_id").alias("ids"), F.col("held.codes").alias("codes")).write.mode("overwrite").parquet(f"{path}/tiles")
    flat = [("centre", 0, c, row.tolist()) for c, row in enumerate(centres)] + [("book", p, c, row.tolist()) for p, book in enumerate(books) for c, row in enumerate(book)]
    spark.createDataFrame(flat, "kind string, part int, code int, numbers array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/fitted")


def read_fitted(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The centres and the codebooks; their size doesn't grow with the rows."""
    found = spark.read.parquet(f"{path}/fitted").orderBy("kind", "part", "code").collect()
    books = [r for r in found if r.kind == "book"]
    return np.array([r.numbers for r in found if r.kind == "centre"]), np.array([r.numbers for r in books]).reshape(1 + books[-1].part, -1, len(books[0].numbers))


def _asked(queries: DataFrame, shared, probes: int) -> DataFrame:
    """(cell, query_id, q): a query, as a unit vector, for each of its nearest cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, books = shared.value
        for batch in batches:
            if batch.num_rows:
                x = _units(batch.column(1), books.shape[0] * books.shape[2])
                near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :probes]
                at = np.repeat(np.arange(len(x)), near.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), batch.column(0).take(pa.array(at)), pa.array(list(x[at]), pa.list_(pa.float64()))], ["cell", "query_id", "q"])

    return queries.mapInArrow(run, "cell int, query_id long, q array<double>")


def _estimates(shared, keep: int, exclude_self: bool):
    """The best `keep` rows of a tile for each query of a block, by their codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, books = shared.value
        parts, _, width = books.shape
        for batch in batches:
            for asked, vectors, ids, codes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                names, rows, q = np.array(asked), np.array(ids), np.array(vectors)
                packed = np.frombuffer(b"".join(codes), np.uint8).reshape(len(rows), parts)
                tables = np.einsum("npw,pcw->pnc", q.reshape(len(q), parts, width), books)
                total = sum(table[:, packed[:, p]] for p, table in enumerate(tables))
                if exclude_self:
                    total[names[:, None] == rows[None, :]] = -np.inf
                best = np.argsort(-total, axis=1, kind="stable")[:, :keep]
                chosen = np.take_along_axis(total, best, 1).ravel()
                out = [pa.array(np.repeat(names, best.shape[1])), pa.array(rows[best].ravel()), pa.array(chosen)]
                yield pa.RecordBatch.from_arrays(out, ["query_id", "row_id", "estimate"]).filter(pa.array(np.isfinite(chosen)))

    return run


def search(
    queries: DataFrame, rows: DataFrame, path: str, *, k: int = 10, oversample: int = 8, probes: int = 12, vector: str = "embedding", key: str = "vec_id", exclude_self: bool = True, digits: int = 6
) -> DataFrame:
    """(query_id, key, score, place): of the k x oversample rows of largest estimate the k of largest cosine, ties by key."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(read_fitted(spark, path))
    keep = k * oversample
    asked = queries.where(F.col(vector).isNotNull() & F.exists(vector, lambda v: v != 0)).select(F.col(key).cast("long").alias("query_id"), F.col(vector).alias("v"))
    n = asked.count()
    blocks = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n // BLOCK))))
    packed = _asked(asked, shared, probes).groupBy("cell", blocks.alias("block")).agg(F.collect_list("query_id").alias("asked"), F.collect_list("q").alias("vectors"))
    pairs = packed.join(spark.read.parquet(f"{path}/tiles"), "cell").select("asked", "vectors", "ids", "codes")
    found = pairs.mapInArrow(_estimates(shared, keep, exclude_self), "query_id long, row_id long, estimate double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("estimate"), "row_id"))
    likely = found.withColumn("nth", place).where(F.col("nth") <= keep).select("query_id", "row_id")
    exact = likely.join(rows.select(F.col(key).cast("long").alias("row_id"), F.col(vector).alias("w")), "row_id").join(broadcast_few(asked, n), "query_id")
    scored = exact.select("query_id", "row_id", F.round(cosine_similarity(F.col("v"), F.col("w")), digits).alias("score"))
    ranked = scored.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id"))).where(F.col("place") <= k)
    return ranked.select("query_id", F.col("row_id").alias(key), "score", "place")
