"""Relational queries: scopes, deduplication, upserts, snapshots, joins, aggregates, windows, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakewright.operators import relational as R
from lakewright.plans.registry import register
from lakewright.sources.tables import table

#: The visibility that the fixtures' labels stand for.
VISIBILITY = "CASE WHEN quality = 1 AND toxic = 0 THEN 'public' WHEN quality = 1 THEN 'team' ELSE 'private' END"


def scoped(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").select("doc_id", F.expr(VISIBILITY).alias("visibility"))
    return table(spark, folder, "documents", "doc_id", "source", "lang").join(labels, "doc_id")


@register(
    f"""
    SELECT d.doc_id, d.source, v.visibility FROM documents d
    JOIN (SELECT doc_id, {VISIBILITY} AS visibility FROM labels) v ON v.doc_id = d.doc_id
    WHERE v.visibility = 'public' OR (v.visibility = 'team' AND d.lang = 'en') OR (v.visibility = 'private' AND d.source = 'src1')
    """
)
def catalog_visible(spark: SparkSession, folder: str) -> DataFrame:
    scope = R.visible("src1", "en", org_column="lang", owner_column="source")
    return scoped(spark, folder).where(scope).select("doc_id", "source", "visibility")


@register("SELECT doc_id, org FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN NULL ELSE lang END AS org FROM documents) WHERE org IS NULL OR org = 'fr'")
def org_scope(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "lang").select("doc_id", F.when(F.col("lang") != "en", F.col("lang")).alias("org"))
    return docs.where(R.org_scope("fr", "org"))


@register(
    """
    SELECT event_id, user_id, event_type, ts FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1
    """
)
def catalog_dedup_latest(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events", "event_id", "user_id", "event_type", "ts")
    return R.latest_per_key(rows, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])


@register("SELECT doc_id, key FROM (SELECT doc_id, md5(lower(text)) AS key, row_number() OVER (PARTITION BY md5(lower(text)) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def keyed_dedup_first(spark: SparkSession, folder: str) -> DataFrame:
    keyed = table(spark, folder, "documents", "doc_id", "text").select("doc_id", F.md5(F.lower("text").cast("binary")).alias("key"))
    return keyed.groupBy("key").agg(F.min("doc_id").alias("doc_id"))


@register(
    """
    WITH base AS (SELECT o_orderkey, o_orderstatus, o_totalprice, 0 AS turn FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'),
         delta AS (SELECT o_orderkey, 'U' AS o_orderstatus, o_totalprice * 2 AS o_totalprice, 1 AS turn FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-01')
    SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM (
      SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY turn DESC) AS rn FROM (SELECT * FROM base UNION ALL SELECT * FROM delta)) WHERE rn = 1
    """
)
def upsert_merge(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    base = orders.where("o_orderdate < TIMESTAMP_NTZ '1999-01-01'").drop("o_orderdate")
    delta = orders.where("o_orderdate >= TIMESTAMP_NTZ '1998-06-01'").select("o_orderkey", F.lit("U").alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice"))
    return R.upsert(base, delta, ["o_orderkey"]).withColumn("o_totalprice", F.round("o_totalprice", 2))


@register("SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01')")
def delta_export(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    mark = orders.where("o_orderdate < TIMESTAMP_NTZ '2001-01-01'").agg(F.max("o_orderdate").alias("mark"))
    return orders.join(F.broadcast(mark), F.col("o_orderdate") > F.col("mark")).drop("mark")


@register("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL")
def multi_file_union(spark: SparkSession, folder: str) -> DataFrame:
    """Base and delta are one read of two paths' worth of rows."""
    orders = table(spark, folder, "orders", "o_orderstatus", "o_totalprice", "o_orderdate")
    both = orders.where("o_orderdate < TIMESTAMP_NTZ '1998-01-01'").unionByName(orders.where("NOT o_orderdate < TIMESTAMP_NTZ '1998-01-01'"))
    return both.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@register(
    """
    SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS open_orders, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS pending_orders,
           (SELECT count(*) FROM events WHERE event_type = 'error') AS errors, (SELECT count(*) FROM events WHERE event_type = 'signup') AS signups,
           (SELECT count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 24 HOUR) AS recent_events
    """
)
def session_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders", "o_orderstatus").agg(F.count_if(F.col("o_orderstatus") == "O").alias("open_orders"), F.count_if(F.col("o_orderstatus") == "P").alias("pending_orders"))
    recent = F.col("ts") >= F.expr("TIMESTAMP_NTZ '2024-01-30' - INTERVAL 24 HOURS")
    events = table(spark, folder, "events", "event_type", "ts").agg(
        F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "signup").alias("signups"), F.count_if(recent).alias("recent_events")
    )
    return orders.crossJoin(F.broadcast(events))


@register(
    """
    SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'P') AS in_progress,
           count(*) FILTER (o_orderstatus = 'O') AS open, 0::BIGINT AS blocked FROM orders GROUP BY ALL
    """
)
def task_progress(spark: SparkSession, folder: str) -> DataFrame:
    return R.progress(table(spark, folder, "orders", "o_custkey", "o_orderstatus"), ["o_custkey"], "o_orderstatus", "F", "P", "O")


@register(
    """
    SELECT c.c_custkey, count(o.o_orderkey) AS total, count(*) FILTER (o.o_orderstatus = 'F') AS done,
           round(CASE WHEN count(o.o_orderkey) > 0 THEN 100.0 * count(*) FILTER (o.o_orderstatus = 'F') / count(o.o_orderkey) ELSE 0 END, 4) AS percent
    FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY ALL
    """
)
def prd_list_progress(spark: SparkSession, folder: str) -> DataFrame:
    """Orders are counted before the join, so each customer is joined with one row."""
    counts = R.progress(table(spark, folder, "orders", "o_custkey", "o_orderstatus"), ["o_custkey"], "o_orderstatus", "F", "P", "O")
    joined = table(spark, folder, "customer", "c_custkey").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left")
    total, done = F.coalesce("total", F.lit(0)), F.coalesce("done", F.lit(0))
    return joined.select("c_custkey", total.alias("total"), done.alias("done"), F.round(R.success_rate(done, total), 4).alias("percent"))


@register(
    """
    SELECT o_orderstatus, sum(CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END)::BIGINT AS large, sum(CASE WHEN o_totalprice <= 200000 THEN 1 ELSE 0 END)::BIGINT AS small FROM orders GROUP BY ALL
    """
)
def study_progress(spark: SparkSession, folder: str) -> DataFrame:
    big = F.col("o_totalprice") > 200000
    return table(spark, folder, "orders", "o_orderstatus", "o_totalprice").groupBy("o_orderstatus").agg(F.sum(F.when(big, 1).otherwise(0)).alias("large"), F.sum(F.when(~big, 1).otherwise(0)).alias("small"))


@register("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY ALL")
def status_pivot(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "orders", "o_orderpriority", "o_orderstatus").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return found.na.fill(0)


@register(
    """
    WITH items AS (SELECT l_orderkey, count(*) AS lines, sum(l_quantity) AS quantity FROM lineitem GROUP BY ALL)
    SELECT c.c_custkey, count(o.o_orderkey) AS orders, coalesce(sum(i.lines), 0)::BIGINT AS lines, round(coalesce(sum(i.quantity), 0), 2) AS quantity
    FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey LEFT JOIN items i ON i.l_orderkey = o.o_orderkey GROUP BY ALL
    """
)
def full_state_json(spark: SparkSession, folder: str) -> DataFrame:
    """Nested state by aggregates that are made before each join; the counts stand for the nested lists."""
    items = table(spark, folder, "lineitem", "l_orderkey", "l_quantity").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"))
    orders = table(spark, folder, "orders", "o_orderkey", "o_custkey").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    state = orders.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum("lines").alias("lines"), F.sum("quantity").alias("quantity"))
    joined = table(spark, folder, "customer", "c_custkey").join(state, F.col("c_custkey") == F.col("o_custkey"), "left")
    zero = F.lit(0)
    return joined.select("c_custkey", F.coalesce("orders", zero).alias("orders"), F.coalesce("lines", zero).alias("lines"), F.round(F.coalesce("quantity", F.lit(0.0)), 2).alias("quantity"))


@register("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def link_semi(spark: SparkSession, folder: str) -> DataFrame:
    pending = table(spark, folder, "orders", "o_custkey", "o_orderstatus").where("o_orderstatus = 'P'")
    return table(spark, folder, "customer", "c_custkey", "c_mktsegment").join(pending, F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@register("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2000-01-01')")
def not_superseded(spark: SparkSession, folder: str) -> DataFrame:
    later = table(spark, folder, "orders", "o_custkey", "o_orderdate").where("o_orderdate >= TIMESTAMP_NTZ '2000-01-01'")
    return table(spark, folder, "customer", "c_custkey").join(later, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


LOAD = "SELECT s_suppkey AS agent, s_nationkey AS kind, (s_acctbal + 1000) / 11000 AS load FROM supplier"


def agents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier", "s_suppkey", "s_nationkey", "s_acctbal").select(F.col("s_suppkey").alias("agent"), F.col("s_nationkey").alias("kind"), ((F.col("s_acctbal") + 1000) / 11000).alias("load"))


@register(
    f"""
    WITH a AS ({LOAD}) SELECT hot AS agent, cool AS target, kind FROM (
      SELECT h.agent AS hot, c.agent AS cool, h.kind, row_number() OVER (PARTITION BY h.agent ORDER BY c.load DESC, c.agent) AS rn
      FROM a h JOIN a c ON h.kind = c.kind WHERE h.load >= 0.8 AND c.load < 0.5) WHERE rn = 1
    """
)
def self_join_rebalance(spark: SparkSession, folder: str) -> DataFrame:
    """The fullest agent below one half is the same for all overloaded agents of a kind, so it is picked once a kind."""
    rows = agents(spark, folder)
    target = R.latest_per_key(rows.where("load < 0.5"), ["kind"], [F.desc("load"), F.asc("agent")]).select("kind", F.col("agent").alias("target"))
    return rows.where("load >= 0.8").join(target, "kind").select("agent", "target", "kind")


@register(
    f"""
    WITH a AS ({LOAD}), s AS (SELECT l_suppkey AS agent, avg(CASE WHEN l_returnflag <> 'R' THEN 1.0 ELSE 0.0 END) AS success, avg(l_quantity) * 12 AS seconds FROM lineitem GROUP BY ALL)
    SELECT agent, round(0.40 * greatest(0, 1 - load) + 0.35 * success + 0.25 * greatest(0, 1 - seconds / 600), 6) AS score FROM a JOIN s USING (agent)
    """
)
def agent_score(spark: SparkSession, folder: str) -> DataFrame:
    history = table(spark, folder, "lineitem", "l_suppkey", "l_returnflag", "l_quantity").groupBy(F.col("l_suppkey").alias("agent")).agg(
        F.avg(F.when(F.col("l_returnflag") != "R", 1.0).otherwise(0.0)).alias("success"), (F.avg("l_quantity") * 12).alias("seconds")
    )
    zero = F.lit(0.0)
    score = 0.40 * F.greatest(zero, 1 - F.col("load")) + 0.35 * F.col("success") + 0.25 * F.greatest(zero, 1 - F.col("seconds") / 600)
    return agents(spark, folder).join(history, "agent").select("agent", F.round(score, 6).alias("score"))


@register(
    """
    SELECT o.o_orderkey, count(l.l_orderkey) AS open_lines, coalesce(max(x.lines), 0)::BIGINT AS all_lines, round(max(x.mean), 4) AS mean_price
    FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_linestatus = 'O'
    LEFT JOIN (SELECT l_orderkey, count(*) AS lines, avg(l_extendedprice) AS mean FROM lineitem GROUP BY ALL) x ON x.l_orderkey = o.o_orderkey
    WHERE o.o_orderstatus <> 'P' GROUP BY o.o_orderkey
    """
)
def overview_view(spark: SparkSession, folder: str) -> DataFrame:
    """One aggregate of the lines serves the left join with its condition and the scalar subqueries."""
    lines = table(spark, folder, "lineitem", "l_orderkey", "l_linestatus", "l_extendedprice").groupBy("l_orderkey").agg(
        F.count_if(F.col("l_linestatus") == "O").alias("open_lines"), F.count("*").alias("all_lines"), F.round(F.avg("l_extendedprice"), 4).alias("mean_price")
    )
    orders = table(spark, folder, "orders", "o_orderkey", "o_orderstatus").where("o_orderstatus <> 'P'")
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", F.coalesce("open_lines", F.lit(0)).alias("open_lines"), F.coalesce("all_lines", F.lit(0)).alias("all_lines"), "mean_price")


@register(
    """
    SELECT c.c_custkey, round(c.c_acctbal / 10000, 6) AS ratio, coalesce(n, 0)::BIGINT AS active FROM customer c
    LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY ALL) ON o_custkey = c_custkey
    """
)
def workload_view(spark: SparkSession, folder: str) -> DataFrame:
    active = table(spark, folder, "orders", "o_custkey", "o_orderstatus").where(F.col("o_orderstatus").isin("O", "P")).groupBy("o_custkey").agg(F.count("*").alias("n"))
    joined = table(spark, folder, "customer", "c_custkey", "c_acctbal").join(active, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.round(F.col("c_acctbal") / 10000, 6).alias("ratio"), F.coalesce("n", F.lit(0)).alias("active"))


@register("SELECT l_partkey, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_suppkey) >= 2")
def having_evidence(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem", "l_partkey", "l_suppkey").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("suppliers")).where("suppliers >= 2")


@register("SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def distinct_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem", "l_suppkey", "l_returnflag").distinct()


@register(
    """
    SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events
    WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY GROUP BY ALL
    """
)
def period_metrics(spark: SparkSession, folder: str) -> DataFrame:
    start = R.period_start(F.expr("TIMESTAMP_NTZ '2024-01-30'"), "7d")
    return table(spark, folder, "events", "event_type", "value", "ts").where(F.col("ts") >= start).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@register("SELECT user_id, count(*) AS total, round(100.0 * count(*) FILTER (event_type <> 'error') / count(*), 6) AS rate FROM events GROUP BY ALL")
def success_rate(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "events", "user_id", "event_type").groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("event_type") != "error").alias("good"))
    return found.select("user_id", "total", F.round(R.success_rate(F.col("good"), F.col("total")), 6).alias("rate"))


@register(
    """
    SELECT event_type, s[(floor((len(s) - 1) * 0.95) + 1)::INT] AS p95, s[(floor((len(s) - 1) * 0.99) + 1)::INT] AS p99
    FROM (SELECT event_type, list_sort(list(value)) AS s FROM events WHERE value IS NOT NULL GROUP BY ALL)
    """
)
def p95_lower_rank(spark: SparkSession, folder: str) -> DataFrame:
    return R.ranked_percentiles(table(spark, folder, "events", "event_type", "value"), ["event_type"], "value", {"p95": 0.95, "p99": 0.99})


@register("SELECT ts::DATE::VARCHAR AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def daily_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events", "ts", "event_type", "value").groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@register(
    """
    SELECT ts::DATE::VARCHAR AS day, event_type, count(*) AS n, round(avg(value), 6) AS mean, count(*) FILTER (value > 50) AS above FROM events
    WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY GROUP BY ALL
    """
)
def perf_trend_30d(spark: SparkSession, folder: str) -> DataFrame:
    start = R.period_start(F.expr("TIMESTAMP_NTZ '2024-01-31'"), "30d")
    rows = table(spark, folder, "events", "ts", "event_type", "value").where(F.col("ts") >= start)
    return rows.groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.count_if(F.col("value") > 50).alias("above"))


@register(
    """
    SELECT round(avg(value), 6) AS mean, max(value) AS peak, count(*) AS n, round(100.0 * count(*) FILTER (event_type = 'error') / count(*), 6) AS error_rate,
           round(count(*) / (epoch(max(ts) - min(ts)) / 3600.0), 6) AS per_hour FROM events
    """
)
def rest_analytics(spark: SparkSession, folder: str) -> DataFrame:
    exact = F.expr("CAST(unix_micros(CAST(max(ts) AS TIMESTAMP)) - unix_micros(CAST(min(ts) AS TIMESTAMP)) AS DOUBLE) / 3600000000.0")
    return table(spark, folder, "events", "ts", "event_type", "value").agg(
        F.round(F.avg("value"), 6).alias("mean"),
        F.max("value").alias("peak"),
        F.count("*").alias("n"),
        F.round(R.success_rate(F.count_if(F.col("event_type") == "error"), F.count("*")), 6).alias("error_rate"),
        F.round(F.count("*") / exact, 6).alias("per_hour"),
    )


@register("SELECT (props->>'$.k')::BIGINT AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def json_extract_agg(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events", "props", "value").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@register("SELECT event_id, user_id FROM events WHERE props->>'$.k' = '7'")
def json_field_filter(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events", "event_id", "user_id", "props").where(F.get_json_object("props", "$.k") == "7").drop("props")


@register(
    """
    SELECT * FROM (SELECT 'event' AS source, ts AS created_at, event_id AS ref, event_type AS action FROM events
    UNION ALL SELECT 'order', o_orderdate, o_orderkey, o_orderstatus FROM orders)
    """
)
def timeline_merge(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select(F.col("ts").alias("created_at"), F.col("event_id").alias("ref"), F.col("event_type").alias("action"))
    orders = table(spark, folder, "orders").select(F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("ref"), F.col("o_orderstatus").alias("action"))
    return R.timeline(("event", events), ("order", orders))


@register("SELECT substr(md5(concat_ws(':', doc_id::VARCHAR, lang, source, n_chars::VARCHAR)), 1, 16) AS id, doc_id FROM documents")
def stable_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", "doc_id", "lang", "source", "n_chars").select(R.stable_id("doc_id", "lang", "source", "n_chars").alias("id"), "doc_id")


@register("SELECT avg(CASE WHEN quality = 1 AND toxic = 0 THEN 1.0 WHEN quality = 1 THEN 0.5 ELSE 0 END) AS overall, avg(quality) AS passed, CASE WHEN avg(quality) = 1 THEN 'passed' WHEN avg(quality) >= 0.8 THEN 'partial' ELSE 'failed' END AS status FROM labels")
def quality_report(spark: SparkSession, folder: str) -> DataFrame:
    worth = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1.0).when(F.col("quality") == 1, 0.5).otherwise(0.0)
    found = table(spark, folder, "labels").agg(F.avg(worth).alias("overall"), F.avg("quality").alias("passed"))
    return found.withColumn("status", F.when(F.col("passed") == 1, "passed").when(F.col("passed") >= 0.8, "partial").otherwise("failed"))


@register("SELECT conv_id, turn, role, lag(role, 1, role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations")
def conversation_prev_turn(spark: SparkSession, folder: str) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, folder, "conversations", "conv_id", "turn", "role").withColumn("before", F.coalesce(F.lag("role").over(order), "role"))


@register("SELECT count(*) AS files, coalesce(sum(octet_length(encode(text))), 0)::BIGINT AS bytes, count(DISTINCT (lang, source)) AS packages FROM documents")
def cache_stats(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", "text", "lang", "source").agg(
        F.count("*").alias("files"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count_distinct(F.struct("lang", "source")).alias("packages")
    )


@register("SELECT lang, source, count(*) AS files, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents GROUP BY ALL")
def package_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", "text", "lang", "source").groupBy("lang", "source").agg(F.count("*").alias("files"), F.sum(F.octet_length("text")).alias("bytes"))


@register(
    """
    SELECT a.l_suppkey AS agent, count(*) AS results, round(avg(a.l_extendedprice), 4) AS mean FROM lineitem a JOIN orders o ON o.o_orderkey = a.l_orderkey
    WHERE o.o_orderstatus = 'F' GROUP BY ALL
    """
)
def results_by_assignment(spark: SparkSession, folder: str) -> DataFrame:
    finished = table(spark, folder, "orders", "o_orderkey", "o_orderstatus").where("o_orderstatus = 'F'")
    lines = table(spark, folder, "lineitem", "l_orderkey", "l_suppkey", "l_extendedprice").join(finished, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.groupBy(F.col("l_suppkey").alias("agent")).agg(F.count("*").alias("results"), F.round(F.avg("l_extendedprice"), 4).alias("mean"))


@register(
    """
    SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderdate DESC, o_orderkey LIMIT 20
    """
)
def whats_next_tasks(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders", "o_orderkey", "o_orderpriority", "o_orderdate", "o_orderstatus")
    return R.filter_list(rows, F.col("o_orderstatus") == "O", [F.asc("o_orderpriority"), F.desc("o_orderdate"), F.asc("o_orderkey")]).drop("o_orderstatus")


@register("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def audit_recent(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events", "event_id", "ts", "event_type").orderBy(F.desc("ts"), F.desc("event_id")).limit(100)


@register("SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, count(*) AS n FROM lineitem GROUP BY ALL")
def compat_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem", "l_partkey", "l_suppkey").groupBy(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b")).agg(F.count("*").alias("n"))


@register(
    """
    SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS place, n FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL)
    QUALIFY place <= 3
    """
)
def top_users(spark: SparkSession, folder: str) -> DataFrame:
    counts = table(spark, folder, "events", "event_type", "user_id").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("n"), "user_id"))
    return counts.withColumn("place", place.cast("long")).where("place <= 3")


@register("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def paged_orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders", "o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20)
