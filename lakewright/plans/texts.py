"""Text queries: grep and its reports, range joins, full-text and hybrid search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.operators import text as T
from lakewright.operators import vector
from lakewright.plans.registry import register
from lakewright.plans.vectors import probe
from lakewright.sources.tables import table

LINES = """
l AS (SELECT doc_id AS path, unnest(generate_series(1, len(s))) AS line_no, unnest(s) AS line FROM (
  SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS s FROM documents WHERE length(text) > 0))
"""
WORD = "moron"
PLAIN = T.GrepOptions(before=0, after=0)


def files(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", "doc_id", "text").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))


@register(f"WITH {LINES} SELECT path, line_no::INT AS line_no, line FROM l WHERE regexp_matches(line, '{WORD}', 'i')")
def grep_lines(spark: SparkSession, folder: str) -> DataFrame:
    return T.grep(files(spark, folder), WORD, PLAIN).select("path", "line_no", "line")


@register(
    f"""
    WITH {LINES}, w AS (SELECT *, lag(line) OVER o AS b1, lag(line, 2) OVER o AS b2, lead(line) OVER o AS a1, lead(line, 2) OVER o AS a2 FROM l WINDOW o AS (PARTITION BY path ORDER BY line_no))
    SELECT path, line_no::INT AS line_no, concat_ws('|', b2, b1) AS before, concat_ws('|', a1, a2) AS after FROM w WHERE regexp_matches(line, '{WORD}', 'i')
    """
)
def grep_context(spark: SparkSession, folder: str) -> DataFrame:
    found = T.grep(files(spark, folder), WORD)
    return found.select("path", "line_no", F.array_join("before", "|").alias("before"), F.array_join("after", "|").alias("after"))


@register(f"WITH {LINES} SELECT path, count(*) AS n FROM l WHERE regexp_matches(line, '{WORD}', 'i') GROUP BY ALL")
def grep_count(spark: SparkSession, folder: str) -> DataFrame:
    return T.grep_counts(T.grep(files(spark, folder), WORD, PLAIN))


@register(f"WITH {LINES} SELECT DISTINCT path FROM l WHERE regexp_matches(line, '{WORD}', 'i')")
def grep_files(spark: SparkSession, folder: str) -> DataFrame:
    return T.grep(files(spark, folder), WORD, PLAIN).select("path").distinct()


@register(f"WITH {LINES} SELECT path, count(*) AS n FROM l WHERE regexp_matches(line, '(^|[^\\p{{L}}\\p{{N}}_])the([^\\p{{L}}\\p{{N}}_]|$)', 'i') GROUP BY ALL")
def grep_word(spark: SparkSession, folder: str) -> DataFrame:
    return T.grep_counts(T.grep(files(spark, folder), "the", T.GrepOptions(before=0, after=0, word=True)))


@register(f"WITH {LINES} SELECT path, count(*) AS n FROM l WHERE regexp_matches(line, 'The') GROUP BY ALL")
def grep_smartcase(spark: SparkSession, folder: str) -> DataFrame:
    return T.grep_counts(T.grep(files(spark, folder), "The", PLAIN))


@register(f"WITH {LINES} SELECT path, line_no::INT AS line_no FROM (SELECT path, line_no, row_number() OVER (PARTITION BY path ORDER BY line_no) AS rn FROM l WHERE contains(lower(line), 'the')) WHERE rn <= 2")
def grep_max_count(spark: SparkSession, folder: str) -> DataFrame:
    return T.grep(files(spark, folder), "the", T.GrepOptions(before=0, after=0, max_count=2, fixed=True)).select("path", "line_no")


@register(
    f"""
    WITH {LINES} SELECT (SELECT count(*) FROM documents) AS files_searched, count(DISTINCT path) AS files_matched, count(*) AS matches FROM l WHERE regexp_matches(line, '{WORD}', 'i')
    """
)
def grep_summary(spark: SparkSession, folder: str) -> DataFrame:
    searched = files(spark, folder)
    return T.grep_stats(T.grep(searched, WORD, PLAIN), searched)


@register(
    f"""
    WITH {LINES}, m AS (SELECT path, line_no::INT AS line_no FROM l WHERE contains(lower(line), 'the')),
    s AS (SELECT doc_id AS path, i::INT AS symbol_id, (i * 3 + 1)::INT AS line_start, (i * 3 + 1 + i % 7)::INT AS line_end FROM documents, generate_series(0, 5) g(i))
    SELECT path, line_no, symbol_id FROM (SELECT m.path, m.line_no, coalesce(s.symbol_id, -1)::INT AS symbol_id, row_number() OVER (PARTITION BY m.path, m.line_no ORDER BY s.line_start NULLS LAST, s.symbol_id) AS rn
      FROM m LEFT JOIN s ON s.path = m.path AND m.line_no BETWEEN s.line_start AND s.line_end) WHERE rn = 1
    """
)
def symbol_range_join(spark: SparkSession, folder: str) -> DataFrame:
    found = T.grep(files(spark, folder), "the", T.GrepOptions(before=0, after=0, fixed=True)).select("path", "line_no")
    spans = files(spark, folder).select("path", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("symbol_id"))
    symbols = spans.select("path", "symbol_id", (F.col("symbol_id") * 3 + 1).alias("line_start"), (F.col("symbol_id") * 3 + 1 + F.col("symbol_id") % 7).alias("line_end"))
    return T.enclosing_symbol(found, symbols, ["path"]).select("path", "line_no", F.coalesce("symbol_id", F.lit(-1)).alias("symbol_id"))


TOKENS = "t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents)"
BM25 = """
f AS (SELECT doc_id, len(w) AS length, len(list_filter(w, lambda x: x = 'thble')) AS t0, len(list_filter(w, lambda x: x = 'with')) AS t1 FROM t),
g AS (SELECT count(*) AS n, avg(length) AS mean, count(*) FILTER (t0 > 0) AS d0, count(*) FILTER (t1 > 0) AS d1 FROM f),
s AS (SELECT doc_id, t0, t1, round(ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * length / mean))
  + ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * length / mean)), 6) AS score FROM f, g)
"""


@register(f"WITH {TOKENS}, {BM25} SELECT doc_id, score FROM s WHERE t0 > 0 AND t1 > 0 ORDER BY score DESC, doc_id LIMIT 20")
def fts_bm25_and(spark: SparkSession, folder: str) -> DataFrame:
    return T.bm25(table(spark, folder, "documents", "doc_id", "text"), ["thble", "with"], key="doc_id", text="text")


@register(f"WITH {TOKENS}, {BM25} SELECT doc_id, score FROM s WHERE t0 > 0 OR t1 > 0 ORDER BY score DESC, doc_id LIMIT 20")
def fts_bm25_or(spark: SparkSession, folder: str) -> DataFrame:
    return T.bm25(table(spark, folder, "documents", "doc_id", "text"), ["thble", "with"], key="doc_id", text="text", require_all=False)


@register(
    f"WITH {TOKENS}, j AS (SELECT doc_id, ' ' || array_to_string(w, ' ') || ' ' AS s FROM t)"
    " SELECT doc_id FROM j WHERE contains(s, ' of the ') AND (contains(s, ' thble ') OR contains(s, ' ering')) AND NOT contains(s, ' moron ')"
)
def fts_match_grammar(spark: SparkSession, folder: str) -> DataFrame:
    query = T.parse_match('"of the" thble OR ering* NOT moron')
    return table(spark, folder, "documents", "doc_id", "text").where(T.matches(F.col("text"), query)).select("doc_id")


@register(
    f"""
    WITH {TOKENS}, {BM25}, v AS (SELECT e.vec_id AS id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
      ORDER BY score DESC, id LIMIT 40), x AS (SELECT doc_id AS id, score FROM s WHERE t0 > 0 AND t1 > 0 ORDER BY score DESC, doc_id LIMIT 40),
    y AS (SELECT id, (count(*) OVER () - row_number() OVER (ORDER BY score DESC, id) + 1) / count(*) OVER () AS relevance FROM x)
    SELECT coalesce(v.id, y.id) AS id, round(0.5 * coalesce((v.score + 1) / 2, 0) + 0.5 * coalesce(y.relevance, 0), 6) AS combined FROM v FULL JOIN y ON v.id = y.id ORDER BY combined DESC, id LIMIT 20
    """
)
def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    near = vector.vector_search(table(spark, folder, "embeddings", "vec_id", "embedding"), probe(spark, folder), limit=40)
    seq = F.struct((-F.col("score")).alias("s"), F.col("id"))
    hits = near.select(F.col("vec_id").alias("id"), F.lit(None).cast("string").alias("name"), "score").withColumn("seq", seq)
    ranked = T.bm25(table(spark, folder, "documents", "doc_id", "text"), ["thble", "with"], key="doc_id", text="text", limit=40).select(F.lit(0).alias("g"), F.col("doc_id").alias("id"), "score")
    text_hits = T.positional_relevance(ranked, ["g"], [F.desc("score"), F.asc("id")]).select("id", F.lit(None).cast("string").alias("name"), "relevance", (-F.col("relevance")).alias("seq"))
    return T.blend(hits, text_hits, alpha=0.5, limit=20).select("id", "combined")


@register(
    """
    WITH n AS (SELECT q.vec_id AS qid, e.label = q.label AS good,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS place
      FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id),
    k AS (SELECT qid, count(*) FILTER (place <= 5 AND good) / 5 AS p, coalesce(1.0 / min(CASE WHEN good THEN place END), 0) AS r FROM n GROUP BY qid)
    SELECT round(avg(p), 6) AS precision_at_k, round(avg(r), 6) AS mrr FROM k
    """
)
def precision_mrr(spark: SparkSession, folder: str) -> DataFrame:
    places = vector.relevant_places(table(spark, folder, "embeddings", "vec_id", "embedding", "label"), k=5)
    return T.retrieval_metrics(places, query="query_id", place="place", relevant="good", k=5)


@register("SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages")
def url_parts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages", "page_id", "url").select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), F.parse_url("url", F.lit("PATH")).alias("path"))
