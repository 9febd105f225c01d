"""Budgeted recursive queries over files and symbols.

The budget is a sequential fold over symbols in the order of their files. A symbol costs the bytes of its doc comment (or
else signature), cut to the chunk size. Spent chunk and byte budgets end the query; a symbol that doesn't fit into
what is left ends only its file. Candidates are ranked in Spark once and kept as a table, sorted by their
place, and rows are brought over in blocks of at most the chunk budget's rows: symbols are scanned and ranked once however many blocks it takes. A block
holds only files whose first candidate still fits, so every block adds a hit and none is lost.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakewright.session import ensure_checkpoint_dir
from lakewright.sources.versions import Versions


@dataclass(frozen=True)
class Budget:
    max_depth: int = 2
    max_chunks: int = 200
    max_bytes_per_chunk: int = 6000
    max_total_bytes: int = 750_000


@dataclass
class Result:
    hits: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)
    bytes_used: int = 0
    files: int = 0

    @property
    def category_counts(self) -> dict[str, int]:
        counts: dict[str, int] = {}
        for edge in self.edges:
            counts[edge["category"]] = counts.get(edge["category"], 0) + 1
        return counts

    @property
    def depth_reached(self) -> int:
        return int(bool(self.hits))

    def summary(self) -> str:
        return json.dumps({"hits": len(self.hits), "edges": len(self.edges), "categories": self.category_counts, "first_hits": self.hits[:5], "first_edges": self.edges[:5]}, sort_keys=True)

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        return (
            spark.createDataFrame(self.hits, "ref_id string, path string, name string, kind string, line_start int, signature string, doc string, bytes long"),
            spark.createDataFrame(self.edges, "source string, target string, category string, evidence string"),
        )


def category(before: dict, after: dict, external: bool = False) -> str:
    """How two neighbouring hits relate: by module, marked external, by the first path segment."""
    if before["path"] == after["path"]:
        return "same_module"
    if external:
        return "external"
    return "same_crate" if before["path"].split("/")[0] == after["path"].split("/")[0] else "other_crate"


def matching(symbols: DataFrame, kinds: list[str], keywords: list[str]) -> DataFrame:
    """Symbols of the kinds whose signature or doc holds a keyword; no kinds or keywords mean all."""
    text = F.lower(F.concat_ws("\n", "signature", "doc_comment"))
    wanted = F.lit(True)
    if kinds:
        wanted = wanted & F.col("kind").isin(*kinds)
    if keywords:
        wanted = wanted & F.exists(F.array(*(F.lit(k.lower()) for k in keywords)), lambda k: F.contains(text, k))
    return symbols.where(wanted)


def recursive_query(symbols: DataFrame, kinds: list[str], keywords: list[str], budget: Budget = Budget(), *, external: bool = False) -> Result:
    """Hits in (path, line) order under the budget; each hit has an edge from the hit before it, the first from itself.

    symbols: path, kind, name, signature, doc_comment, line_start. A chunk budget of zero is an error.
    """
    if budget.max_chunks <= 0:
        raise ValueError("max_chunks must be greater than zero")
    order = Window.partitionBy("path").orderBy("line_start", "name")
    cost = F.least(F.octet_length(F.coalesce("doc_comment", "signature", F.lit(""))), F.lit(budget.max_bytes_per_chunk)).cast("long")
    ranked = matching(symbols, kinds, keywords).withColumn("cost", cost).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= budget.max_chunks)
    ranked = ranked.withColumn("first_cost", F.first("cost").over(order))
    spark = symbols.sparkSession
    store = Versions(spark, ensure_checkpoint_dir(spark))
    path = store.fresh("candidates")
    ranked.repartitionByRange("path").sortWithinPartitions("path", "nth").write.parquet(path)
    try:
        return _fold(spark.read.schema(ranked.schema).parquet(path), budget, external)
    finally:
        store.remove(path)


def _fold(ranked: DataFrame, budget: Budget, external: bool) -> Result:
    result, seen, after = Result(), set(), F.lit(True)
    while len(result.hits) < budget.max_chunks and result.bytes_used < budget.max_total_bytes:
        left = budget.max_total_bytes - result.bytes_used
        block = ranked.where(after & (F.col("first_cost") <= left)).orderBy("path", "nth").limit(budget.max_chunks).collect()
        ended = None
        for row in block:
            if len(result.hits) >= budget.max_chunks or result.bytes_used >= budget.max_total_bytes:
                break
            if row.path == ended:
                continue
            if result.bytes_used + row.cost > budget.max_total_bytes:
                ended = row.path
                continue
            _add(result, row, external)
            seen.add(row.path)
        if len(block) < budget.max_chunks:
            break
        last = block[-1]
        after = F.col("path") > last.path
        if ended != last.path:
            after = after | ((F.col("path") == last.path) & (F.col("nth") > last.nth))
    result.files = len(seen)
    return result


def _add(result: Result, row, external: bool) -> None:
    hit = {
        "ref_id": f"{row.path}::{row.kind}::{row.name}::{row.line_start}", "path": row.path, "name": row.name, "kind": row.kind, "line_start": row.line_start,
        "signature": row.signature, "doc": row.doc_comment or "", "bytes": row.cost,
    }
    result.hits.append(hit)
    before = result.hits[max(len(result.hits) - 2, 0)]
    result.edges.append({"source": before["ref_id"], "target": hit["ref_id"], "category": category(before, hit, external), "evidence": "adjacent_hit"})
    result.bytes_used += row.cost


def plan_totals(files: DataFrame, symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: files, bytes, symbols, doc_spans that a query would read."""
    read = files.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes"))
    return read.crossJoin(symbols.agg(F.count("*").alias("symbols"))).crossJoin(chunks.agg(F.count("*").alias("doc_spans")))


def precedents(shared: DataFrame, ranked: DataFrame, decisions: DataFrame, now, limit: int = 10) -> DataFrame:
    """(id, score) of earlier decisions: 10 for each shared piece of evidence, 2 for each grade of confidence, less 0.2 a
    day of age, less a text rank that is better the smaller it is (50 if there is none). shared: id, shared; ranked: id,
    rank; decisions: id, confidence, created_at."""
    grade = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).otherwise(1)
    age = (F.unix_timestamp(now) - F.unix_timestamp(F.col("created_at").cast("timestamp"))) / 86400.0
    joined = decisions.join(shared, "id", "left").join(ranked, "id", "left").where("shared IS NOT NULL OR rank IS NOT NULL")
    score = 10 * F.coalesce("shared", F.lit(0)) + 2 * grade - 0.2 * age - F.coalesce("rank", F.lit(50.0))
    return joined.select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)
