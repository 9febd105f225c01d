"""Vector queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.operators import vector
from lakewright.plans.registry import register
from lakewright.sources.tables import table

COSINE = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
FROM = "FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"


def probe(spark: SparkSession, folder: str, vec_id: int = 0) -> list[float]:
    """One stored vector, as a query vector."""
    found = table(spark, folder, "embeddings", "vec_id", "embedding").where(F.col("vec_id") == vec_id).head()
    return list(found.embedding)


@register(f"SELECT e.vec_id, e.label, round({COSINE}, 6) AS score {FROM} ORDER BY {COSINE} DESC, e.vec_id LIMIT 10")
def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    found = vector.vector_search(table(spark, folder, "embeddings"), probe(spark, folder), limit=10)
    return found.select("vec_id", "label", F.round("score", 6).alias("score"))


@register(f"SELECT e.vec_id, e.label, round({COSINE}, 6) AS score {FROM} WHERE e.label = 3 ORDER BY {COSINE} DESC, e.vec_id LIMIT 10")
def vector_filtered(spark: SparkSession, folder: str) -> DataFrame:
    found = vector.vector_search(table(spark, folder, "embeddings"), probe(spark, folder), where=F.col("label") == 3, limit=10)
    return found.select("vec_id", "label", F.round("score", 6).alias("score"))


@register(f"SELECT * FROM (SELECT e.vec_id, round({COSINE}, 6) AS score {FROM} ORDER BY {COSINE} DESC, e.vec_id LIMIT 50) WHERE score >= 0.2")
def vector_min_score(spark: SparkSession, folder: str) -> DataFrame:
    found = vector.vector_search(table(spark, folder, "embeddings"), probe(spark, folder), limit=50, min_score=0.2)
    return found.select("vec_id", F.round("score", 6).alias("score"))


@register(
    f"SELECT e.vec_id, round(list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS distance {FROM}"
    " ORDER BY list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), e.vec_id LIMIT 10"
)
def vector_l2(spark: SparkSession, folder: str) -> DataFrame:
    found = vector.vector_search(table(spark, folder, "embeddings"), probe(spark, folder), metric="l2", limit=10)
    return found.select("vec_id", F.round(-F.col("score"), 6).alias("distance"))


@register(
    """
    SELECT query_id, vec_id, score, place FROM (
      SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score,
             row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS place
      FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id) WHERE place <= 5
    """
)
def vector_batch_knn(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings", "vec_id", "embedding")
    return vector.batch_knn(rows.where("vec_id % 20 = 0"), rows, k=5).select("query_id", "vec_id", "score", F.col("place").cast("long"))
