"""Queries over records, references, JSON, metrics and sets, each beside its DuckDB equivalent."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakewright.operators import records as K
from lakewright.operators import relational as R
from lakewright.operators import text as T
from lakewright.parsing import chunks, symbols
from lakewright.plans.registry import register
from lakewright.sources.tables import memory_lake, table

# --- predicates --------------------------------------------------------------------------------------------------------


@register("SELECT page_id FROM pages WHERE url LIKE 'http://th%'")
def prefix_like(spark: SparkSession, folder: str) -> DataFrame:
    """A prefix as a parameter; it reaches the scan."""
    return table(spark, folder, "pages", "page_id", "url").where(F.col("url").startswith("http://th")).select("page_id")


@register("SELECT doc_id FROM documents WHERE (text LIKE '%thble%' OR text LIKE '%moron%') AND text NOT LIKE '%@%'")
def like_or_not(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    return table(spark, folder, "documents", "doc_id", "text").where((text.contains("thble") | text.contains("moron")) & ~text.contains("@")).select("doc_id")


@register("SELECT page_id FROM pages WHERE instr(url, '.example') > 0 AND instr(url, '?') = 0")
def canonical_locator(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages", "page_id", "url").where((F.instr("url", ".example") > 0) & (F.instr("url", "?") == 0)).select("page_id")


@register("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_partkey = 3 AND l_suppkey = 5) OR (l_partkey = 5 AND l_suppkey = 3)")
def symmetric_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").where(R.symmetric_pair("l_partkey", "l_suppkey", 3, 5)).select("l_orderkey", "l_linenumber")


@register("SELECT p_partkey FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') AND p_type IN ('ECONOMY', 'STANDARD')")
def public_api(spark: SparkSession, folder: str) -> DataFrame:
    """Visibility (a brand) and kind (a type), both out of lists."""
    public = F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13") & F.col("p_type").isin("ECONOMY", "STANDARD")
    return table(spark, folder, "part", "p_partkey", "p_brand", "p_type").where(public).select("p_partkey")


@register("SELECT event_id FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 500) WHERE contains(props, '\"k\": 8') ORDER BY ts DESC, event_id DESC LIMIT 100")
def filter_after_limit(spark: SparkSession, folder: str) -> DataFrame:
    """A substring of serialised JSON, tested after the newest min(5 n, 500) rows were taken."""
    events = table(spark, folder, "events", "event_id", "ts", "props")
    return R.filter_list(events, F.col("props").contains('"k": 8'), [F.desc("ts"), F.desc("event_id")], 100, overfetch=True).select("event_id")


STATES = "CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'in_progress' ELSE 'blocked' END"
MOVES = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'in_progress' WHEN '2' THEN 'done' WHEN '3' THEN 'blocked' ELSE 'open' END"


@register(
    f"""
    WITH m AS (SELECT o_orderkey, {STATES} AS before, {MOVES} AS after FROM orders)
    SELECT o_orderkey, (before, after) IN (('open', 'in_progress'), ('in_progress', 'done'), ('in_progress', 'blocked'), ('blocked', 'in_progress')) AS permitted FROM m
    """
)
def transition_guard(spark: SparkSession, folder: str) -> DataFrame:
    moves = table(spark, folder, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority").select("o_orderkey", F.lit("task").alias("machine"), F.expr(STATES).alias("before"), F.expr(MOVES).alias("after"))
    return R.allowed_moves(moves, K.transitions(spark)).select("o_orderkey", "permitted")


@register(
    "SELECT url, regexp_matches(lower(split_part(url, '/', -1)), '^(test_.*\\.py|conftest\\.py)$') OR regexp_matches(url, '/(tests|examples|fixtures)/') AS test FROM (SELECT DISTINCT regexp_replace(url, '/([0-9]+)', '/examples/\\1', 'g') AS url FROM pages)"
)
def test_paths(spark: SparkSession, folder: str) -> DataFrame:
    urls = table(spark, folder, "pages", "url").select(F.regexp_replace("url", "/([0-9]+)", "/examples/$1").alias("url")).distinct()
    return urls.select("url", symbols.is_test(F.col("url")).alias("test"))


# --- joins -----------------------------------------------------------------------------------------------------------


@register(
    """
    SELECT c_custkey, count(o_orderkey) AS linked, coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 0)::BIGINT AS confirmed,
      coalesce(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END), 0)::BIGINT AS open FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL
    """
)
def linked_progress(spark: SparkSession, folder: str) -> DataFrame:
    """Links and what they point to, counted by state; customers without any stay."""
    orders = table(spark, folder, "orders", "o_custkey", "o_orderstatus").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") == "O").alias("o"))
    joined = table(spark, folder, "customer", "c_custkey").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", *(F.coalesce(c, F.lit(0)).alias(name) for c, name in (("n", "linked"), ("f", "confirmed"), ("o", "open"))))


@register(
    """
    SELECT n_name, s_suppkey, c.n AS customers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000
      LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY ALL) c ON c.c_nationkey = s_nationkey
    """
)
def three_way_on(spark: SparkSession, folder: str) -> DataFrame:
    """A condition of the outer join that belongs to ON, not to WHERE."""
    rich = table(spark, folder, "supplier", "s_suppkey", "s_nationkey", "s_acctbal").where("s_acctbal > 5000")
    customers = table(spark, folder, "customer", "c_nationkey").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    nation = table(spark, folder, "nation", "n_nationkey", "n_name")
    return nation.join(rich, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(customers, F.col("c_nationkey") == F.col("s_nationkey"), "left").select("n_name", "s_suppkey", "customers")


@register(
    """
    WITH w AS (SELECT unnest(['thble', 'moron', 'ering']) AS theme), a AS (SELECT item_id AS left_id, theme FROM benchmark, w WHERE contains(lower(text), theme)),
    b AS (SELECT conv_id AS right_id, theme FROM conversations, w WHERE turn = 0 AND contains(lower(text), theme))
    SELECT left_id, right_id, string_agg(DISTINCT theme, ',' ORDER BY theme) AS themes FROM a JOIN b USING (theme) GROUP BY ALL
    """
)
def theme_pairs(spark: SparkSession, folder: str) -> DataFrame:
    first = table(spark, folder, "conversations", "conv_id", "turn", "text").where("turn = 0")
    return K.shared_themes(table(spark, folder, "benchmark", "item_id", "text").withColumnRenamed("item_id", "id"), first.withColumnRenamed("conv_id", "id"), ["thble", "moron", "ering"])


@register("SELECT p_partkey, p_name, coalesce(n, 0) AS uses FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY ALL) ON l_partkey = p_partkey ORDER BY uses DESC, p_partkey LIMIT 20")
def symbols_by_downloads(spark: SparkSession, folder: str) -> DataFrame:
    uses = table(spark, folder, "lineitem", "l_partkey").groupBy("l_partkey").agg(F.count("*").alias("n"))
    joined = table(spark, folder, "part", "p_partkey", "p_name").join(uses, F.col("p_partkey") == F.col("l_partkey"), "left")
    return joined.select("p_partkey", "p_name", F.coalesce("n", F.lit(0)).alias("uses")).orderBy(F.desc("uses"), "p_partkey").limit(20)


@register("SELECT p_partkey FROM part WHERE p_type = 'ECONOMY' AND p_size >= 10 AND p_brand IN (SELECT p_brand FROM part WHERE p_size = 7)")
def discovery(spark: SparkSession, folder: str) -> DataFrame:
    """Visible parts of a type whose brand is among the user's."""
    parts = table(spark, folder, "part", "p_partkey", "p_brand", "p_type", "p_size")
    packages = parts.select("p_partkey", F.col("p_brand").alias("package"), F.col("p_type").alias("ecosystem"), "p_size")
    mine = parts.where("p_size = 7").select(F.col("p_brand").alias("package"))
    return K.discover(packages, mine, F.col("p_size") >= 10, "ECONOMY").select("p_partkey")


# --- aggregation and JSON ------------------------------------------------------------------------------------------------


@register("SELECT o_custkey, to_json(list({'o_orderkey': o_orderkey, 'o_orderstatus': o_orderstatus} ORDER BY o_orderkey))::VARCHAR AS items FROM orders GROUP BY ALL")
def json_group_array(spark: SparkSession, folder: str) -> DataFrame:
    return K.json_group(table(spark, folder, "orders", "o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderkey", "o_orderstatus"], ["o_orderkey"])


@register(
    """
    SELECT r_regionkey, r_name, (SELECT to_json(list({'n_nationkey': n_nationkey, 'n_name': n_name} ORDER BY n_nationkey))::VARCHAR FROM nation WHERE n_regionkey = r_regionkey) AS nations,
      (SELECT count(*) FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = r_regionkey) AS suppliers FROM region
    """
)
def nested_state(spark: SparkSession, folder: str) -> DataFrame:
    """A parent with its children as JSON, and a count of theirs."""
    nation = table(spark, folder, "nation")
    children = K.json_group(nation, ["n_regionkey"], ["n_nationkey", "n_name"], ["n_nationkey"], "nations").withColumnRenamed("n_regionkey", "region_of")
    suppliers = table(spark, folder, "supplier", "s_nationkey").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("region_for")).agg(F.count("*").alias("n"))
    joined = table(spark, folder, "region").join(children, F.col("region_of") == F.col("r_regionkey"), "left").join(suppliers, F.col("region_for") == F.col("r_regionkey"), "left")
    return joined.select("r_regionkey", "r_name", "nations", F.coalesce("n", F.lit(0)).alias("suppliers"))


@register(
    """
    WITH f AS (SELECT user_id, ts, event_id, 'k' AS field, props->>'k' AS value FROM events UNION ALL SELECT user_id, ts, event_id, event_type, event_id::VARCHAR FROM events
      UNION ALL SELECT user_id, ts, event_id, 'late', CASE WHEN event_id % 2 = 0 THEN event_type END FROM events WHERE event_id % 3 = 0)
    SELECT user_id, field, arg_max_null(value, (ts, event_id)) AS value FROM f GROUP BY ALL HAVING arg_max_null(value, (ts, event_id)) IS NOT NULL
    """
)
def merged_steps(spark: SparkSession, folder: str) -> DataFrame:
    """JSON objects of several fields, one of them named by the event's kind and one sometimes there and sometimes null, merged by user: later steps
    win field by field."""
    events = table(spark, folder, "events", "user_id", "ts", "event_id", "event_type", "props")
    late = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(', "late": '), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('"'), "event_type", F.lit('"'))).otherwise("null"))).otherwise("")
    told = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "'), "event_type", F.lit('": '), F.col("event_id").cast("string"), late, F.lit("}"))
    return K.merge_maps(events.withColumn("props", told), ["user_id"], "props", [F.col("ts"), F.col("event_id")]).where("value IS NOT NULL")


@register("SELECT event_id, json_array_length('[' || props || ',' || event_id || ']')::INT AS n, (props->>'k')::INT AS k FROM events")
def json_fields(spark: SparkSession, folder: str) -> DataFrame:
    props = table(spark, folder, "events", "event_id", "props")
    listed = F.concat(F.lit("["), "props", F.lit(","), F.col("event_id").cast("string"), F.lit("]"))
    return props.select("event_id", F.json_array_length(listed).alias("n"), F.get_json_object("props", "$.k").cast("int").alias("k"))


@register("SELECT p_brand, p_type, count(*) AS n, count(DISTINCT p_name) AS names FROM part GROUP BY ALL")
def api_comparison(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part", "p_brand", "p_type", "p_name").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.count_distinct("p_name").alias("names"))


OUTCOME = "CASE event_type WHEN 'signup' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'started' END"


@register(
    f"""
    WITH e AS (SELECT 'type' || user_id % 5 AS kind, {OUTCOME} AS outcome, floor(value * 10)::BIGINT AS ms FROM events),
    s AS (SELECT kind, count(*) FILTER (outcome = 'started') AS started, count(*) FILTER (outcome = 'completed') AS completed, count(*) FILTER (outcome = 'failed') AS failed,
      coalesce(sum(ms) FILTER (outcome = 'completed'), 0)::BIGINT AS total FROM e WHERE kind IN ('type0', 'type1', 'type2', 'type9') GROUP BY ALL)
    SELECT kind, started, completed, failed, CASE WHEN completed + failed > 0 THEN round(completed * 100.0 / (completed + failed), 6)::DOUBLE ELSE 0 END AS success_rate,
      (CASE WHEN completed > 0 THEN total // completed ELSE 0 END)::BIGINT AS mean_ms FROM s WHERE started > 0
    """
)
def metric_table(spark: SparkSession, folder: str) -> DataFrame:
    """Four fixed types; one of them never starts and is left out."""
    events = table(spark, folder, "events", "user_id", "event_type", "value")
    named = events.select(F.concat(F.lit("type"), F.col("user_id") % 5).alias("kind"), F.expr(OUTCOME).alias("outcome"), F.floor(F.col("value") * 10).alias("ms"))
    return K.type_metrics(named, ["type0", "type1", "type2", "type9"])


@register("SELECT p_type, round(avg(p_retailprice / p_size) * 100, 4) AS percent FROM part WHERE p_size > 0 GROUP BY ALL")
def mean_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """The mean ratio by type, in hundredths."""
    return table(spark, folder, "part", "p_type", "p_retailprice", "p_size").where("p_size > 0").groupBy("p_type").agg(F.round(F.avg(F.col("p_retailprice") / F.col("p_size")) * 100, 4).alias("percent"))


# --- order, sets and windows ---------------------------------------------------------------------------------------------


NEAR = "list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@register(
    f"""
    WITH d AS (SELECT e.vec_id, e.label, round({NEAR}, 6) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
    k AS (SELECT *, row_number() OVER (PARTITION BY label % 3 ORDER BY distance, vec_id) AS i FROM d) SELECT vec_id, distance FROM k WHERE i <= 10 ORDER BY distance, vec_id LIMIT 10
    """
)
def merged_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Three datasets' nearest rows merged to one list."""
    from lakewright.operators import vector
    from lakewright.plans.vectors import probe

    rows, query = table(spark, folder, "embeddings"), F.array(*map(F.lit, probe(spark, folder)))
    near = rows.select("vec_id", "label", F.round(vector.l2_distance(F.col("embedding"), query), 6).alias("distance"))
    return K.merged_top([near.where(F.col("label") % 3 == i) for i in range(3)], distance="distance", key="vec_id", k=10).select("vec_id", "distance")


@register(
    """
    SELECT 'symbol' AS kind, p_partkey::BIGINT AS id, p_name AS title FROM part WHERE contains(p_name, 'cold')
    UNION ALL SELECT 'chunk', item_id::BIGINT, left(text, 20) FROM benchmark WHERE contains(lower(text), 'thble')
    """
)
def bag_union(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols and chunks as one kind of result."""
    parts = table(spark, folder, "part", "p_partkey", "p_name").where(F.col("p_name").contains("cold")).select(F.lit("symbol").alias("kind"), F.col("p_partkey").cast("long").alias("id"), F.col("p_name").alias("title"))
    items = table(spark, folder, "benchmark", "item_id", "text").where(F.lower("text").contains("thble")).select(F.lit("chunk").alias("kind"), F.col("item_id").cast("long").alias("id"), F.substring("text", 1, 20).alias("title"))
    return parts.unionByName(items)


@register("(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def set_operations(spark: SparkSession, folder: str) -> DataFrame:
    """Extension: intersection and difference of sets."""
    customers, suppliers = table(spark, folder, "customer", F.col("c_nationkey").alias("k")), table(spark, folder, "supplier", F.col("s_nationkey").alias("k"))
    return customers.intersect(suppliers).subtract(table(spark, folder, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("k")))


@register(
    """
    SELECT o_orderkey, rank() OVER w AS place, dense_rank() OVER w AS dense, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS quarter, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next,
      first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS first FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderstatus)
    """
)
def window_functions(spark: SparkSession, folder: str) -> DataFrame:
    """Extension: ranks, tiles and neighbours within a customer."""
    status, key = Window.partitionBy("o_custkey").orderBy("o_orderstatus"), Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderstatus").select(
        "o_orderkey", F.rank().over(status).cast("long").alias("place"), F.dense_rank().over(status).cast("long").alias("dense"), F.ntile(4).over(key).cast("long").alias("quarter"),
        F.lead("o_orderkey").over(key).alias("next"), F.first("o_orderkey").over(key).alias("first"),
    )


# --- ids, references and times -------------------------------------------------------------------------------------------


@register("SELECT url, CASE WHEN s = '' THEN '_' ELSE s END AS segment FROM (SELECT DISTINCT url, left(trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '_'), 128) AS s FROM pages)")
def segments(spark: SparkSession, folder: str) -> DataFrame:
    urls = table(spark, folder, "pages", "url").distinct()
    return urls.select("url", R.sanitize_segment(F.col("url")).alias("segment"))


@register("SELECT p_partkey, 'dls-' || lower(hex(p_brand)) || '-' || lower(hex(p_name)) || '-' || lower(hex(p_size::VARCHAR)) AS key FROM part")
def snapshot_keys(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part", "p_partkey", "p_brand", "p_name", "p_size").select("p_partkey", R.snapshot_key(F.col("p_brand"), F.col("p_name"), F.col("p_size").cast("string")).alias("key"))


@register("SELECT p_partkey, substr(md5(concat_ws(':', p_brand, p_name, p_type, p_size::VARCHAR, '')), 1, 16) AS id FROM part")
def chunk_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Five fields; a null counts as empty."""
    parts = table(spark, folder, "part", "p_partkey", "p_brand", "p_name", "p_type", "p_size")
    return parts.select("p_partkey", R.stable_id("p_brand", "p_name", "p_type", F.col("p_size").cast("string"), F.lit(None)).alias("id"))


@register("SELECT p_partkey, p_brand AS ecosystem, replace(p_name, ' ', ':') AS package, p_size::VARCHAR AS version, p_name || '/f' AS path, p_size::INT AS line_start, (p_size + p_partkey)::INT AS line_end FROM part")
def references_parsed(spark: SparkSession, folder: str) -> DataFrame:
    """eco:package:version, where the package holds colons, and path#a-b, put together and taken apart again."""
    parts = table(spark, folder, "part", "p_partkey", "p_brand", "p_name", "p_size")
    made = parts.select("p_partkey", F.concat_ws(":", "p_brand", F.regexp_replace("p_name", " ", ":"), F.col("p_size").cast("string")).alias("ref"), F.concat("p_name", F.lit("/f#L"), F.col("p_size"), F.lit("-L"), F.col("p_size") + F.col("p_partkey")).alias("place"))
    return made.select("p_partkey", *K.package_ref(F.col("ref")), *K.location(F.col("place")))


@register("SELECT event_id, date_trunc('second', ts) AS t FROM events")
def parsed_times(spark: SparkSession, folder: str) -> DataFrame:
    """Both layouts: RFC 3339 for even events, a date and a time with a blank for odd ones."""
    events = table(spark, folder, "events", "event_id", "ts")
    text = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return events.select("event_id", K.parse_time(text).cast(events.schema["ts"].dataType).alias("t"))


@register(
    "WITH v AS (SELECT p_brand, p_size % 3 AS a, p_size AS b, p_partkey % 7 AS c FROM part) SELECT p_brand, arg_max(a || '.' || b || '.' || c, (a, b, c)) AS version FROM v GROUP BY ALL"
)
def latest_versions(spark: SparkSession, folder: str) -> DataFrame:
    """The highest version of each package by number, not by text."""
    parts = table(spark, folder, "part", "p_partkey", "p_brand", "p_size").select("p_brand", F.concat_ws(".", F.col("p_size") % 3, "p_size", F.col("p_partkey") % 7).alias("version"))
    return parts.groupBy("p_brand").agg(F.max_by("version", R.semver_key(F.col("version"))).alias("version"))


@register("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'miss' WHEN ts > TIMESTAMP '2024-01-10 00:00:00' THEN 'fresh' ELSE 'stale' END AS state FROM events")
def cache_states(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events", "event_id", "ts")
    expires = F.when(F.col("event_id") % 4 != 0, F.col("ts"))
    return events.select("event_id", R.freshness(expires, F.expr("TIMESTAMP_NTZ '2024-01-10 00:00:00'").cast(events.schema["ts"].dataType)).alias("state"))


# --- sessions, recovery, plans ---------------------------------------------------------------------------------------------


@register("SELECT user_id AS id, max(ts) AS started_at, 'abandoned' AS status FROM events WHERE event_type = 'signup' GROUP BY ALL ORDER BY started_at DESC, id LIMIT 10")
def orphaned_sessions(spark: SparkSession, folder: str) -> DataFrame:
    sessions = table(spark, folder, "events", "user_id", "ts", "event_type").where("event_type = 'signup'").groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("started_at"))
    return K.session_start(sessions.withColumn("status", F.lit("active")))


@register(
    """
    SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' AND c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 'pending' WHEN o_orderstatus = 'O' THEN 'started' ELSE 'done' END AS status,
      CASE WHEN NOT (o_orderstatus = 'O' AND c_mktsegment IN ('BUILDING', 'FURNITURE')) THEN o_orderpriority END AS agent FROM orders JOIN customer ON c_custkey = o_custkey
    """
)
def crash_recovery(spark: SparkSession, folder: str) -> DataFrame:
    state = F.when(F.col("c_mktsegment") == "BUILDING", "active").when(F.col("c_mktsegment") == "FURNITURE", "paused").otherwise("done")
    workflows = table(spark, folder, "customer", "c_custkey", "c_mktsegment").select(F.col("c_custkey").alias("workflow_id"), state.alias("status"))
    orders = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    known = orders.join(workflows.select("workflow_id"), F.col("o_custkey") == F.col("workflow_id"), "left_semi")
    assignments = known.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("workflow_id"), F.when(F.col("o_orderstatus") == "O", "started").otherwise("done").alias("status"), F.col("o_orderpriority").alias("agent"))
    return K.recover(assignments, workflows).select("id", "status", "agent")


@register(
    """
    WITH f AS (SELECT doc_id::VARCHAR AS path, octet_length(encode(text))::BIGINT AS bytes FROM documents WHERE contains(lower(text), 'thble') OR contains(lower(text), 'moron'))
    SELECT path, bytes FROM (SELECT *, sum(bytes) OVER (ORDER BY path ROWS UNBOUNDED PRECEDING) AS upto FROM f) WHERE upto <= 40000
    """
)
def file_plan(spark: SparkSession, folder: str) -> DataFrame:
    return K.plan_files(table(spark, folder, "documents", "doc_id", "text"), ["thble", "moron"], budget=40_000, path="doc_id", content="text")


@register("SELECT DISTINCT l_orderkey AS source, l_partkey AS target FROM lineitem")
def reference_store(spark: SparkSession, folder: str) -> DataFrame:
    """Edges stored twice are there once."""
    links = table(spark, folder, "lineitem", "l_orderkey", "l_partkey").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"))
    return K.store_refs(K.store_refs(links.limit(0), links, ["source", "target"]), links, ["source", "target"])


# --- entities, views, chunks ---------------------------------------------------------------------------------------------


@register("SELECT p_partkey, CASE p_partkey % 3 WHEN 1 THEN NULL WHEN 2 THEN 'new' ELSE p_type END AS p_type, (CASE WHEN p_partkey % 3 = 2 THEN 1 ELSE p_size END)::BIGINT AS p_size FROM part")
def partial_update(spark: SparkSession, folder: str) -> DataFrame:
    """A missing field is kept, null sets null, a value is set."""
    parts = table(spark, folder, "part", "p_partkey", "p_type", F.col("p_size").cast("long").alias("p_size"))
    said = F.when(F.col("p_partkey") % 3 == 0, "{}").when(F.col("p_partkey") % 3 == 1, '{"p_type": null}').otherwise('{"p_type": "new", "p_size": 1}')
    return K.update(parts, parts.select("p_partkey", said.alias("data")), "p_partkey", fields=["p_type", "p_size"])


@register("SELECT n_nationkey AS id, CASE WHEN n_regionkey = 0 THEN 'open' ELSE n_name END AS status FROM nation UNION ALL SELECT 1000 + r_regionkey, 'open' FROM region")
def entity_create(spark: SparkSession, folder: str) -> DataFrame:
    """New keys are added with defaults, known ones are ignored."""
    stored = table(spark, folder, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_regionkey") == 0, "open").otherwise(F.col("n_name")).alias("status"))
    fresh = table(spark, folder, "region").select((F.col("r_regionkey") + 1000).alias("id"), F.lit(None).cast("string").alias("status"))
    return K.create(stored, fresh.unionByName(stored.select("id", F.lit("late").alias("status"))), ["id"], {"status": "open"})


@register(
    """
    WITH l AS (SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, l_linenumber AS n, l_orderkey AS o, l_returnflag AS s FROM lineitem WHERE l_linenumber <= 2),
    k AS (SELECT a, b, arg_max(s, (o, s)) FILTER (n = 1) AS first, arg_max(s, (o, s)) FILTER (n = 2) AS second FROM l GROUP BY ALL) SELECT a, b, coalesce(second, first) AS status FROM k
    """
)
def compat_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Checks of pairs under a symmetric key: the later of those that come in replaces what is stored."""
    lines = table(spark, folder, "lineitem", "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag")
    named = lines.select(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b"), "l_linenumber", "l_orderkey", F.col("l_returnflag").alias("status"))
    order = [F.col("l_orderkey"), F.col("status")]
    first = R.upsert(named.limit(0), named.where("l_linenumber = 1"), ["a", "b"], order)
    return R.upsert(first, named.where("l_linenumber = 2"), ["a", "b"], order).select("a", "b", "status")


@register(
    """
    WITH d AS (SELECT ts::DATE::VARCHAR AS day, event_type, count(*) AS n FROM events GROUP BY ALL)
    SELECT day, event_type, CASE WHEN event_type = 'click' THEN n + 1 ELSE n END AS n FROM d
    """
)
def daily_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Daily counts by kind; counts that come in again replace those of their day and kind."""
    days = table(spark, folder, "events", "ts", "event_type").groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count("*").alias("n"))
    return R.upsert(days, days.where("event_type = 'click'").withColumn("n", F.col("n") + 1), ["day", "event_type"])


@register(
    """
    SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'k: missing' WHEN 1 THEN 'k: not integer' WHEN 2 THEN 'k: not integer' WHEN 3 THEN 'k: not integer,name: not string' WHEN 4 THEN 'k: missing,name: missing' ELSE '' END AS problems FROM events
    """
)
def schema_check(spark: SparkSession, folder: str) -> DataFrame:
    """Objects without a field, with text, null or an object in the place of a number or a text, and text that is no object."""
    events = table(spark, folder, "events", "event_id", "event_type", "props")
    kind, k = F.col("event_id") % 6, F.get_json_object("props", "$.k").cast("long")
    name = F.col("event_type").alias("name")
    said = (
        F.when(kind == 0, F.to_json(F.struct(name))).when(kind == 1, F.to_json(F.struct(k.cast("string").alias("k"), name))).when(kind == 2, F.concat(F.lit('{"k": null, "name": "'), "event_type", F.lit('"}')))
        .when(kind == 3, F.to_json(F.struct(F.struct(k.alias("k")).alias("k"), F.struct(name).alias("name")))).when(kind == 4, F.col("event_type")).otherwise(F.to_json(F.struct(k.alias("k"), name)))
    )
    return events.select("event_id", F.array_join(K.schema_problems(said, {"k": "integer", "name": "string"}), ",").alias("problems"))


@register("SELECT n_name, count(*) AS customers FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL")
def memory_views(spark: SparkSession, folder: str) -> DataFrame:
    """SQL over temporary views."""
    memory_lake(spark, {"lake_customer": table(spark, folder, "customer"), "lake_nation": table(spark, folder, "nation")})
    return spark.sql("SELECT n_name, count(*) AS customers FROM lake_customer JOIN lake_nation ON n_nationkey = c_nationkey GROUP BY n_name")


@register("SELECT k AS nation, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY ALL")
def two_file_union(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of two files as one table."""
    names = [("customer", "c_nationkey"), ("supplier", "s_nationkey")]
    first, second = (table(spark, folder, name, F.col(key).alias("nation")) for name, key in names)
    return first.unionByName(second).groupBy("nation").agg(F.count("*").alias("n"))


@register("SELECT event_id, event_type AS tool, (props->>'k')::INT AS k FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    """The newest calls, flattened from JSON."""
    newest = table(spark, folder, "events", "event_id", "ts", "event_type", "props").orderBy(F.desc("ts"), F.desc("event_id")).limit(50)
    return newest.select("event_id", F.col("event_type").alias("tool"), F.get_json_object("props", "$.k").cast("int").alias("k"))


@register(
    """
    SELECT p_partkey || '.md' AS path, 0::INT AS chunk_index, 'T' || p_partkey AS title, 'T' || p_partkey AS trail, 0::BIGINT AS byte_offset, (length('' || p_partkey) + 10)::INT AS char_len FROM part
    UNION ALL SELECT p_partkey || '.md', 1, 'S' || p_partkey, 'T' || p_partkey || '/S' || p_partkey, (length('' || p_partkey) + 10)::BIGINT, (length('' || p_partkey) + 10)::INT FROM part
    """
)
def chunk_sections(spark: SparkSession, folder: str) -> DataFrame:
    """A Markdown file with a section and one within it for every part."""
    keys = table(spark, folder, "part", "p_partkey").select(F.col("p_partkey").cast("string").alias("n"))
    made = keys.select(F.concat("n", F.lit(".md")).alias("path"), F.concat(F.lit("# T"), "n", F.lit("\nalpha\n"), F.lit("## S"), "n", F.lit("\nbeta\n")).alias("content"))
    found = chunks.chunk_documents(made, path="path", content="content")
    return found.select("path", "chunk_index", "title", F.array_join("section_path", "/").alias("trail"), "byte_offset", "char_len")


@register("SELECT p_partkey::VARCHAR || '.txt' AS path, CASE WHEN n <= 2048 THEN 1 ELSE 1 + ceil((n - 2048) / 1848)::BIGINT END AS pieces, n + 200 * (CASE WHEN n <= 2048 THEN 0 ELSE ceil((n - 2048) / 1848)::BIGINT END) AS chars FROM (SELECT p_partkey, (p_size * 173 + 1)::BIGINT AS n FROM part)")
def chunk_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Texts without a line end are cut hard, at 2,048 characters with 200 of overlap."""
    made = table(spark, folder, "part", "p_partkey", "p_size").select(F.concat(F.col("p_partkey").cast("string"), F.lit(".txt")).alias("path"), F.repeat(F.lit("x"), F.col("p_size").cast("int") * 173 + 1).alias("content"))
    found = chunks.chunk_documents(made, path="path", content="content", columns=["path", "char_len"])
    return found.groupBy("path").agg(F.count("*").alias("pieces"), F.sum("char_len").alias("chars"))


@register("SELECT doc_id AS path, len(regexp_extract_all(text, '[.]\\n[A-Z]')) AS n FROM documents WHERE regexp_matches(text, '[.]\\n[A-Z]')")
def grep_multiline_count(spark: SparkSession, folder: str) -> DataFrame:
    """Matches that span a line end."""
    found = T.grep_multiline(table(spark, folder, "documents", "doc_id", "text"), r"[.]\n[A-Z]", T.GrepOptions(case="sensitive"), path="doc_id", content="text")
    return found.groupBy("path").agg(F.count("*").alias("n"))


@register("SELECT count(*) AS n, count(*) AS different, true AS formed FROM orders")
def random_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Sixteen random digits for every order: all different, all of the one form."""
    made = table(spark, folder, "orders", "o_orderkey").select(K.random_id("tsk", digits=16).alias("id"))
    return made.agg(F.count("*").alias("n"), F.count_distinct("id").alias("different"), F.every(F.col("id").rlike("^tsk-[0-9a-f]{16}$")).alias("formed"))


@register("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'fetch' WHEN ts <= TIMESTAMP '2024-01-10 00:00:00' OR (event_id % 5) = 0 THEN 'use and refresh' ELSE 'use' END AS action FROM events")
def cache_actions(spark: SparkSession, folder: str) -> DataFrame:
    states = cache_states(spark, folder)
    return states.select("event_id", K.cache_action(F.col("state"), F.col("event_id") % 5).alias("action"))


@register("SELECT user_id, event_type AS step, count(*) FILTER (value > 50) AS succeeded, count(*) FILTER (NOT value > 50) AS failed, round(count(*) FILTER (value > 50) * 100.0 / count(*), 6)::DOUBLE AS success_rate FROM events GROUP BY ALL")
def step_table(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events", "user_id", "event_type", "value").withColumnRenamed("event_type", "step")
    return K.step_metrics(events, workflow="user_id", step="step", ok=F.col("value") > 50)


@register("SELECT p_partkey::VARCHAR AS path, unnest([1, 2]) AS line_no, unnest(['doc', 'function']) AS kind FROM part UNION ALL SELECT p_partkey::VARCHAR, 4, 'struct' FROM part")
def span_fallback(spark: SparkSession, folder: str) -> DataFrame:
    made = table(spark, folder, "part", "p_partkey").select(F.col("p_partkey").cast("string").alias("path"), F.lit("/// Doc\n  pub fn f() {\n}\nstruct S;\nlet x = 1;\n").alias("content"))
    return K.fallback_spans(T.lines(made, path="path", content="content")).select("path", "line_no", "kind")


@register(
    """
    WITH e AS (SELECT user_id, event_id, ts, event_type, event_id % 4 AS r FROM events), u AS (SELECT c_custkey, c_mktsegment, c_acctbal FROM customer),
    seg AS (SELECT user_id, arg_max_null(CASE WHEN r = 0 THEN NULL ELSE event_type END, (ts, event_id)) AS v, count(*) AS n FROM e WHERE r IN (0, 1) GROUP BY user_id),
    bal AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS v FROM e WHERE r = 2 GROUP BY user_id)
    SELECT c_custkey, CASE WHEN seg.n IS NOT NULL THEN seg.v ELSE c_mktsegment END AS c_mktsegment, coalesce(bal.v::DOUBLE, c_acctbal) AS c_acctbal FROM u LEFT JOIN seg ON seg.user_id = c_custkey LEFT JOIN bal ON bal.user_id = c_custkey
    """
)
def update_in_order(spark: SparkSession, folder: str) -> DataFrame:
    """Many partial updates of each customer, by the events of the same number: each field takes its last value, null too."""
    events = table(spark, folder, "events", "event_id", "ts", "user_id", "event_type")
    r = F.col("event_id") % 4
    said = F.when(r == 0, '{"c_mktsegment": null}').when(r == 1, F.concat(F.lit('{"c_mktsegment": "'), "event_type", F.lit('"}'))).when(r == 2, F.concat(F.lit('{"c_acctbal": '), F.col("event_id").cast("string"), F.lit("}"))).otherwise("{}")
    changes = events.select(F.col("user_id").alias("c_custkey"), "ts", "event_id", said.alias("data"))
    stored = table(spark, folder, "customer", "c_custkey", "c_mktsegment", "c_acctbal")
    return K.update(stored, changes, "c_custkey", fields=["c_mktsegment", "c_acctbal"], order=[F.col("ts"), F.col("event_id")])


@register(
    """
    WITH s AS (SELECT 'last_session' AS frame, event_id::VARCHAR AS id FROM events WHERE event_type = 'signup' ORDER BY ts DESC, event_id DESC LIMIT 1),
    a AS (SELECT 'recent_audit' AS frame, event_id::VARCHAR AS id FROM events ORDER BY ts DESC, event_id DESC LIMIT 20)
    SELECT * FROM s UNION ALL SELECT * FROM a UNION ALL SELECT 'open_tasks', o_orderkey::VARCHAR FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_custkey % 3 <> 2
    UNION ALL SELECT 'pending_hypotheses', c_custkey::VARCHAR FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey % 3 <> 2
    """
)
def whats_next(spark: SparkSession, folder: str) -> DataFrame:
    """All four frames: the last session, open tasks, pending hypotheses and the last audit rows, of an org and of none."""
    events = table(spark, folder, "events", "event_id", "ts", "event_type").select(F.col("event_id").alias("id"), F.col("ts").alias("started_at"), F.col("ts").alias("created_at"), "event_type")
    org = lambda c: F.when(F.col(c) % 3 == 1, "mine").when(F.col(c) % 3 == 2, "theirs").alias("org_id")
    tasks = table(spark, folder, "orders", "o_orderkey", "o_orderstatus", "o_orderdate", "o_custkey")
    tasks = tasks.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("done").alias("status"), F.col("o_orderdate").alias("created_at"), org("o_custkey"))
    guesses = table(spark, folder, "customer", "c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey")
    status = F.when(F.col("c_mktsegment") == "BUILDING", "unverified").when(F.col("c_mktsegment") == "MACHINERY", "analyzing").otherwise("confirmed")
    guesses = guesses.select(F.col("c_custkey").alias("id"), status.alias("status"), F.col("c_acctbal").alias("created_at"), org("c_nationkey"))
    frames = K.whats_next(events.where("event_type = 'signup'"), tasks, guesses, events, org="mine")
    return reduce(DataFrame.unionByName, (rows.select(F.lit(name).alias("frame"), F.col("id").cast("string").alias("id")) for name, rows in frames.items()))


@register(
    """
    WITH l AS (SELECT l_orderkey, l_linenumber, p_partkey, p_brand || '/' || (p_size % 5) AS path, p_size, lead(p_partkey) OVER w AS next_key FROM lineitem JOIN part ON p_partkey = l_partkey WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, p_partkey)),
    e AS (SELECT DISTINCT l.p_partkey AS a, next_key AS b, l.path, t.p_brand || '/' || (t.p_size % 5) AS other, t.p_size % 7 = 0 AS outer_ FROM l JOIN part t ON t.p_partkey = next_key WHERE l.p_partkey <> next_key)
    SELECT CASE WHEN path = other THEN 'same_module' WHEN outer_ THEN 'external' WHEN split_part(path, '/', 1) = split_part(other, '/', 1) THEN 'same_crate' ELSE 'other_crate' END AS category, count(*) AS n FROM e GROUP BY ALL
    """
)
def reference_categories(spark: SparkSession, folder: str) -> DataFrame:
    """Parts that follow each other in an order refer to one another; each pair is stored once, and counted by how their paths relate."""
    parts = table(spark, folder, "part", "p_partkey", "p_brand", "p_size").select("p_partkey", F.concat_ws("/", "p_brand", (F.col("p_size") % 5).cast("string")).alias("path"), (F.col("p_size") % 7 == 0).alias("outer"))
    lines = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    pairs = lines.select(F.col("l_partkey").alias("source"), F.lead("l_partkey").over(order).alias("target")).where("target IS NOT NULL AND source <> target")
    near, far = parts.select(F.col("p_partkey").alias("source"), F.col("path").alias("near")), parts.select(F.col("p_partkey").alias("target"), F.col("path").alias("far"), "outer")
    edges = pairs.join(near, "source").join(far, "target").select("source", "target", K.edge_category(F.col("near"), F.col("far"), F.col("outer")).alias("category"))
    return K.category_counts(K.store_refs(edges.limit(0), edges, ["source", "target"]))


@register("SELECT p_name AS signature, min(p_partkey) AS ref_id FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_size = 7) GROUP BY ALL")
def references_by_signature(spark: SparkSession, folder: str) -> DataFrame:
    """References looked up by their signatures."""
    parts = table(spark, folder, "part", "p_partkey", "p_name", "p_size").select(F.col("p_partkey").alias("ref_id"), F.col("p_name").alias("signature"), "p_size")
    return K.refs_by_signature(parts, parts.where("p_size = 7"))
