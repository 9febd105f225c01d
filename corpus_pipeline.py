"""The corpus pipeline: quality, near copies, benchmark leaks, personal data, token ids.

Every stage takes (spark, docs, sf_dir), with docs as the stage before left them, and returns a DataFrame; all but
the last return the columns of documents. Stages know no document beyond their docs. Rows travel as one struct, so
further columns pass through whatever their names.

Defined results: a null text counts as empty; texts of any length are read and redacted whole; of rows that share a doc_id each
is judged by its own text; of repeated rows (same doc_id and text) the near-duplicate stage keeps one, the others stay or
go together; of equally good documents of a group the one with the smallest doc_id stays, then the one of the smallest
text hash; a document without a doc_id stays only if nothing in its group has one; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.llm import byte_bpe, decontaminate, pii, quality, shingles, simhash
from lakewright.llm.common import broadcast_if_few, materialise, scratch_path, scratch_scope
from lakewright.llm.components import components
from lakewright.sources.tables import table

#: Words of a shingle in the near-duplicate stage.
SHINGLE_WORDS = 5


def _rows(docs: DataFrame) -> Column:
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")


def _hashed(docs: DataFrame) -> DataFrame:
    """(row, id, h): each document as one struct, its doc_id and the hash of its text."""
    return docs.select(_rows(docs), F.col("doc_id").alias("id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("h"))


def _same(docs: DataFrame, found: DataFrame) -> Column:
    return docs.id.eqNullSafe(found.id_of) & (docs.h == found.h_of)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that are good rather than poor by the fitted grades."""
    ratings = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    return quality.score_documents(docs, ratings, keep=[_rows(docs)]).where("keep").select("row.*")


def _kept_apart(spark: SparkSession, label: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What `make` gives, in a table of its own; the scratch tables that it took are removed at once."""
    path = scratch_path(spark, label)
    with scratch_scope(spark):
        make().write.parquet(path)
    return spark.read.parquet(path)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group the document with the smallest doc_id, and of its texts that of the smallest hash. Documents are linked by their SimHash
    fingerprints, through the pivot tables of op5, and by the exact similarity of their shingle sets, which fingerprints of near copies often miss;
    a group is what can be reached by both kinds of links."""
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("h")).alias("place")

    def by_fingerprints() -> DataFrame:
        return simhash.near_duplicates(docs.select(place, "text"), key="place").where("place <> component_id").select(F.col("component_id").alias("u"), F.col("place").alias("v"))

    def by_shingles() -> DataFrame:
        found = shingles.near_copies(docs.select("doc_id", "text"), width=SHINGLE_WORDS)
        least, own = (F.struct(F.col(k).isNull().alias("nameless"), F.col(k).alias("doc_id"), F.col(h).alias("h")) for k, h in (("component_id", "kept_h"), ("doc_id", "h")))
        return found.select(least.alias("u"), own.alias("v")).where("u <> v")

    def repeated() -> DataFrame:
        return docs.select(place).groupBy("place").agg(F.count("*").alias("rows")).where("rows > 1")

    links = _kept_apart(spark, "simhash-linked", by_fingerprints).unionByName(_kept_apart(spark, "shingle-linked", by_shingles))
    gone = components(links, "near-copies").select(F.col("node").alias("place"), F.lit(False).alias("stays"))
    more = _kept_apart(spark, "near-repeated", repeated).join(gone, "place", "left_anti").select("place", F.lit(True).alias("stays"))
    odd = materialise(gone.unionByName(more).select(F.col("place.doc_id").alias("id_of"), F.col("place.h").alias("h_of"), "stays"), "near-odd")
    hashed, goes, twice = _hashed(docs), odd.where("NOT stays"), odd.where("stays")
    kept = hashed.join(broadcast_if_few(goes), _same(hashed, goes), "left_anti")
    if twice.isEmpty():
        return kept.select("row.*")
    again = broadcast_if_few(twice)
    once = kept.join(again, _same(kept, twice), "left_semi").groupBy("id", "h").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return kept.join(again, _same(kept, twice), "left_anti").select("row").unionByName(once.select("row")).select("row.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which a benchmark window occurs."""
    found = decontaminate.contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    leaks = materialise(found.where("contaminated").select(F.col("doc_id").alias("id_of"), F.col("h").alias("h_of")).distinct(), "leaks")
    hashed = _hashed(docs)
    return hashed.join(broadcast_if_few(leaks), _same(hashed, leaks), "left_anti").select("row.*")


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts [KIND] in the place of personal data and secrets; n_chars, where there is one, follows the new text."""
    found = pii.find_spans(docs.select("doc_id", "text"))
    spans = materialise(found.select(F.col("key").alias("id_of"), F.col("h").alias("h_of"), F.sort_array(F.concat("spans", "secrets")).alias("spans")), "pii-spans")
    hashed = _hashed(docs)
    joined = hashed.join(broadcast_if_few(spans, size=48 * F.size("spans")), _same(hashed, spans), "left").select("row", "spans", pii.redacted(F.col("row.text"), F.col("spans")).alias("new"))
    new = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        length = F.length("new").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(length)
    return joined.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document."""
    return byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("token_ids", token_stage),
]

#: The fitted and fingerprinting stages aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again. What a stage writes on the way
    is removed after it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        with scratch_scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
