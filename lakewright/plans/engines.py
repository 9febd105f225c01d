"""Graph, replay, recursive, parsing and streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakewright.operators import graph, recursive, replay
from lakewright.parsing import chunks, symbols
from lakewright.plans.registry import register
from lakewright.sources.tables import table

EDGES = """
e AS (SELECT 'customer:' || c_custkey AS src, 'nation:' || c_nationkey AS dst FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation)
"""


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """Foreign keys as a graph of typed nodes."""
    parts = [("customer", "c_custkey", "nation", "c_nationkey"), ("supplier", "s_suppkey", "nation", "s_nationkey"), ("nation", "n_nationkey", "region", "n_regionkey")]
    frames = [table(spark, folder, name, key, to_key).select(graph.node(F.lit(name), F.col(key)).alias("src"), graph.node(F.lit(to), F.col(to_key)).alias("dst")) for name, key, to, to_key in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@register(f"WITH {EDGES} SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY ALL")
def graph_nodes_degree(spark: SparkSession, folder: str) -> DataFrame:
    return graph.degrees(edges(spark, folder))


@register(
    f"""
    WITH RECURSIVE {EDGES}, r(node, depth) AS (SELECT 'customer:1', 0 UNION SELECT e.dst, depth + 1 FROM r JOIN e ON e.src = r.node WHERE depth < 4)
    SELECT node, min(depth)::INT AS depth FROM r GROUP BY ALL
    """
)
def graph_bfs(spark: SparkSession, folder: str) -> DataFrame:
    return graph.bfs(edges(spark, folder), spark.range(1).select(F.lit("customer:1").alias("node")), 4)


@register(f"WITH {EDGES} SELECT DISTINCT src AS node FROM e WHERE src NOT IN (SELECT dst FROM e)")
def graph_ready_set(spark: SparkSession, folder: str) -> DataFrame:
    return graph.ready_set(edges(spark, folder))


TREES = """
n AS (SELECT 'nation:' || n_nationkey AS node, n_regionkey AS r FROM nation UNION ALL SELECT DISTINCT 'region:' || n_regionkey, n_regionkey FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'supplier:' || s_suppkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)
"""


@register(f"WITH {TREES} SELECT node, min(node) OVER (PARTITION BY r) AS component FROM n")
def graph_components(spark: SparkSession, folder: str) -> DataFrame:
    """All customers, suppliers, nations and regions; the links make a tree of each region, which SQL can name."""
    return graph.weak_components(edges(spark, folder))


@register(f"WITH {EDGES}, {TREES} SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(DISTINCT r) FROM n) AS components, false AS cyclic, (SELECT count(*) FROM n) > 100 AS centrality_skipped")
def graph_analysis(spark: SparkSession, folder: str) -> DataFrame:
    return graph.analyse(edges(spark, folder), 100)[0]


@register(f"WITH {EDGES} SELECT src, dst FROM e WHERE src IN (SELECT 'customer:' || c_custkey FROM customer WHERE c_acctbal > 0) AND dst IN (SELECT 'nation:' || n_nationkey FROM nation WHERE n_regionkey < 3)")
def graph_visible(spark: SparkSession, folder: str) -> DataFrame:
    """Only edges both of whose ends are visible."""
    rich = table(spark, folder, "customer", "c_custkey", "c_acctbal").where("c_acctbal > 0").select(graph.node(F.lit("customer"), F.col("c_custkey")).alias("node"))
    near = table(spark, folder, "nation", "n_nationkey", "n_regionkey").where("n_regionkey < 3").select(graph.node(F.lit("nation"), F.col("n_nationkey")).alias("node"))
    return graph.visible_subgraph(edges(spark, folder), rich.unionByName(near))


@register(
    f"""
    WITH {EDGES}, k AS (SELECT node FROM (SELECT src AS node FROM e UNION SELECT dst FROM e) ORDER BY node LIMIT 60)
    SELECT src, dst FROM e WHERE src IN (SELECT node FROM k) AND dst IN (SELECT node FROM k) ORDER BY src, dst LIMIT 40
    """
)
def graph_budgeted(spark: SparkSession, folder: str) -> DataFrame:
    links = edges(spark, folder)
    return graph.budgeted(links, graph.nodes(links), 60, 40)[0].select("src", "dst")


@register("SELECT 'customer:1' AS node, 0::INT AS depth, NULL AS parent UNION ALL SELECT 'nation:' || c_nationkey, 1, 'customer:1' FROM customer WHERE c_custkey = 1 UNION ALL SELECT 'region:' || n_regionkey, 2, 'nation:' || n_nationkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 1")
def graph_dependency_tree(spark: SparkSession, folder: str) -> DataFrame:
    return graph.dependency_tree(edges(spark, folder), "customer:1")


@register(
    """
    SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_orderkey = orders.o_orderkey // 2 AND b.o_orderstatus = 'O' AND orders.o_orderkey > 0)
    """
)
def ready_work(spark: SparkSession, folder: str) -> DataFrame:
    """Open orders that no open order blocks; an order is blocked by that of half its key."""
    orders = table(spark, folder, "orders", "o_orderkey", "o_orderstatus")
    issues = orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("done").alias("status"))
    blockers = orders.where("o_orderkey > 0").select(F.col("o_orderkey").alias("id"), F.expr("o_orderkey div 2").alias("blocked_by"))
    return graph.ready_work(issues, blockers).select("id")


@register(
    f"""
    WITH RECURSIVE {EDGES}, r(node, level) AS (SELECT DISTINCT src, 0 FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT e.dst, level + 1 FROM r JOIN e ON e.src = r.node)
    SELECT node, max(level)::INT AS level FROM r GROUP BY ALL
    """
)
def graph_toposort_levels(spark: SparkSession, folder: str) -> DataFrame:
    return graph.topological_levels(edges(spark, folder))


@register("SELECT unnest([0, 1, 2]) AS step, unnest(['customer:1', 'nation:' || c_nationkey, 'region:' || n_regionkey]) AS node FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 1")
def graph_shortest_path(spark: SparkSession, folder: str) -> DataFrame:
    links = edges(spark, folder)
    goal = links.where("src = 'customer:1'").select(F.col("dst").alias("src")).join(links, "src").head().dst
    path = graph.shortest_path(links, "customer:1", goal) or []
    return spark.createDataFrame(list(enumerate(path)), "step int, node string")


@register(
    """
    WITH e AS (SELECT DISTINCT 's' || s_nationkey AS a, 'n' || n_nationkey AS b, 'r' || n_regionkey AS c FROM supplier JOIN nation ON n_nationkey = s_nationkey)
    SELECT node, round(sum(score), 6) AS score FROM (SELECT b AS node, 1.0 AS score FROM e UNION ALL SELECT a, 0.0 FROM e UNION ALL SELECT DISTINCT c, 0.0 FROM e) GROUP BY ALL
    """
)
def graph_betweenness(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers' nations to nations to regions: every nation lies on the one path from its own source to its region."""
    nation = table(spark, folder, "nation", "n_nationkey", "n_regionkey")
    used = nation.join(table(spark, folder, "supplier", "s_nationkey").distinct(), F.col("n_nationkey") == F.col("s_nationkey"), "left_semi")
    label = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    first = used.select(label("s", "n_nationkey").alias("src"), label("n", "n_nationkey").alias("dst"))
    return graph.betweenness(first.unionByName(used.select(label("n", "n_nationkey").alias("src"), label("r", "n_regionkey").alias("dst"))))


OPS = "CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'transition' ELSE 'update' END"


@register(
    f"""
    WITH o AS (SELECT user_id AS id, ts, event_id, {OPS} AS op, value FROM events),
    d AS (SELECT *, max(CASE WHEN op = 'delete' THEN (ts, event_id) END) OVER (PARTITION BY id) AS gone FROM o),
    a AS (SELECT * FROM d WHERE gone IS NULL OR (ts, event_id) > gone), b AS (SELECT *, min(CASE WHEN op = 'create' THEN (ts, event_id) END) OVER (PARTITION BY id) AS born FROM a),
    u AS (SELECT * FROM b WHERE born IS NOT NULL AND ((ts, event_id) = born OR ((ts, event_id) > born AND op IN ('update', 'transition'))))
    SELECT id::VARCHAR AS id, arg_max(value::VARCHAR, (ts, event_id))::DOUBLE AS value, count(*) AS n FROM u GROUP BY ALL
    """
)
def replay_state(spark: SparkSession, folder: str) -> DataFrame:
    """Events as an operation log of users: signup creates, error deletes, purchase moves on, the rest updates."""
    events = table(spark, folder, "events", "event_id", "ts", "user_id", "event_type", "value")
    log = events.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"),
        F.lit("events").alias("file"),
        F.col("event_id").alias("line"),
        F.expr(OPS).alias("op"),
        F.lit("user").alias("entity"),
        F.col("user_id").cast("string").alias("id"),
        F.to_json(F.struct("value", F.lit("1").alias("seen"))).alias("data"),
        F.lit("s").alias("ses"),
    )
    state = replay.entity_state(log, ["value"], {})
    part = Window.partitionBy("id")
    at = F.struct("ts", "line")
    alive = log.withColumn("gone", F.max(F.when(F.col("op") == "delete", at)).over(part)).where(F.col("gone").isNull() | (at > F.col("gone")))
    born = alive.withColumn("born", F.min(F.when(F.col("op") == "create", at)).over(part))
    counts = born.where(F.col("born").isNotNull() & ((at == F.col("born")) | ((at > F.col("born")) & F.col("op").isin("update", "transition")))).groupBy("id").agg(F.count("*").alias("n"))
    return state.join(counts, "id").select("id", F.col("value").cast("double").alias("value"), "n")


TAG_OPS = "CASE event_type WHEN 'error' THEN 'untag' WHEN 'signup' THEN 'delete' ELSE 'tag' END"


def event_log(spark: SparkSession, folder: str, op: str, data) -> DataFrame:
    """Events as a log of operations on users."""
    events = table(spark, folder, "events", "event_id", "ts", "user_id", "event_type")
    return events.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), F.lit("events").alias("file"), F.col("event_id").alias("line"), F.expr(op).alias("op"),
        F.lit("user").alias("entity"), F.col("user_id").cast("string").alias("id"), data.alias("data"), F.lit("s").alias("ses"),
    )


@register(
    f"""
    WITH o AS (SELECT user_id::VARCHAR AS id, 't' || event_id % 3 AS tag, ts, event_id, {TAG_OPS} AS op FROM events),
    d AS (SELECT *, max(CASE WHEN op = 'delete' THEN (ts, event_id) END) OVER (PARTITION BY id) AS gone FROM o)
    SELECT id, tag FROM d WHERE op <> 'delete' AND (gone IS NULL OR (ts, event_id) > gone) GROUP BY ALL HAVING arg_max(op, (ts, event_id)) = 'tag'
    """
)
def replay_tags(spark: SparkSession, folder: str) -> DataFrame:
    log = event_log(spark, folder, TAG_OPS, F.to_json(F.struct(F.concat(F.lit("t"), F.col("event_id") % 3).alias("tag"))))
    return replay.tags(log).select("id", "tag")


@register("SELECT user_id::VARCHAR AS id, arg_max(event_id, (ts, event_id))::VARCHAR AS target FROM events WHERE event_type IN ('click', 'error') GROUP BY ALL HAVING arg_max(event_type, (ts, event_id)) = 'click'")
def replay_links(spark: SparkSession, folder: str) -> DataFrame:
    """Clicks link a user to an event, errors undo it."""
    body = F.to_json(F.struct(F.lit("user").alias("source_type"), F.lit("event").alias("target_type"), F.col("event_id").cast("string").alias("target_id"), F.lit("saw").alias("relation")))
    log = event_log(spark, folder, "CASE event_type WHEN 'click' THEN 'link' WHEN 'error' THEN 'unlink' ELSE 'update' END", body)
    return replay.links(log).select("id", F.regexp_replace("target", "^event:", "").alias("target"))


@register("SELECT event_id::INT AS line, CASE event_id % 4 WHEN 0 THEN 'conflict marker' WHEN 1 THEN 'not JSON' ELSE 'missing field' END AS problem FROM events WHERE event_id % 4 < 3 AND NOT (event_id % 4 = 2 AND event_type = 'click')")
def replay_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Log lines with a conflict marker, broken JSON, or (but for clicks) no id."""
    events = table(spark, folder, "events", "event_id", "event_type")
    whole = F.to_json(F.struct(F.lit("1").alias("ts"), F.lit("create").alias("op"), F.lit("user").alias("entity"), F.when((F.col("event_id") % 4 == 3) | (F.col("event_type") == "click"), "x").alias("id")))
    value = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("<<<<<<< HEAD "), whole)).when(F.col("event_id") % 4 == 1, F.concat(F.lit("{"), whole)).otherwise(whole)
    raw = events.select(F.lit("log").alias("file"), F.col("event_id").cast("int").alias("line"), value.alias("value"))
    return replay.invalid_lines(raw).select("line", "problem")


SOURCES = {
    "py": ('def f{n}(a):\n    """Doc {n}."""\n    return a\n', "function", "f{n}", "Doc {n}.", 1, 3), "rs": ("/// Doc {n}\npub fn f{n}() {{\n}}\n", "function", "f{n}", "Doc {n}", 2, 3), "go": ("// Doc {n}\nfunc F{n}() {{\n}}\n", "function", "F{n}", "Doc {n}", 2, 3),
    "java": ("public class C{n} {{\n}}\n", "class", "C{n}", "", 1, 2), "ts": ("export function f{n}() {{\n}}\n", "function", "f{n}", "", 1, 2), "json": ('{{"k{n}": 1}}', "property", "k{n}", "", 1, 1), "md": ("# T{n}\ntext\n", "module", "T{n}", "", 1, 3),
}


@register(
    " UNION ALL ".join(
        f"SELECT p_partkey || '.{end}' AS path, '{kind}' AS kind, '{name[0]}' || p_partkey AS name, replace('{doc}', '{{n}}', p_partkey::VARCHAR) AS doc, {a}::INT AS line_start, {b}::INT AS line_end FROM part"
        for end, (_, kind, name, doc, a, b) in SOURCES.items()
    )
)
def symbols_of_files(spark: SparkSession, folder: str) -> DataFrame:
    """A small source file in each of several languages for every part, and the symbol that each declares."""
    keys = table(spark, folder, "part", "p_partkey").select(F.col("p_partkey").cast("string").alias("n"))
    made = [keys.select(F.concat("n", F.lit(f".{end}")).alias("path"), F.replace(F.lit(body.replace("{{", "{").replace("}}", "}")), F.lit("{n}"), F.col("n")).alias("content")) for end, (body, *_) in SOURCES.items()]
    files = made[0]
    for more in made[1:]:
        files = files.unionByName(more)
    return symbols.extract_symbols(files).select("path", "kind", "name", F.coalesce("doc_comment", F.lit("")).alias("doc"), "line_start", "line_end")


@register()
def chunk_documents(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.chunk_documents(table(spark, folder, "documents", "doc_id", "text"), path="doc_id", content="text").drop("section_path")


@register("SELECT doc_id::VARCHAR AS path, true AS bounded, true AS whole FROM documents WHERE trim(text, ' ' || chr(10) || chr(9) || chr(13)) <> ''")
def chunk_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: whether every chunk keeps the bound, and whether the chunks cover the text's characters but white space."""
    docs = table(spark, folder, "documents", "doc_id", "text")
    made = chunks.chunk_documents(docs, path="doc_id", content="text", columns=["path", "char_len"])
    stats = made.groupBy("path").agg(F.max("char_len").alias("most"), F.sum("char_len").alias("chars"), F.count("*").alias("n"))
    joined = stats.join(docs.select(F.col("doc_id").cast("string").alias("path"), F.length(F.regexp_replace("text", r"\s+", "")).alias("bare")), "path")
    return joined.select("path", (F.col("most") <= chunks.MOST_CHARS).alias("bounded"), (F.col("chars") >= F.col("bare")).alias("whole"))


@register(
    """
    WITH RECURSIVE p AS (SELECT source || '/' || doc_id AS path, unnest(string_split(text, chr(10))) AS signature, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line_start FROM documents),
    c AS MATERIALIZED (SELECT path, line_start, least(octet_length(encode(signature)), 3000)::BIGINT AS cost, row_number() OVER (ORDER BY path, line_start) AS i FROM p WHERE contains(lower(signature), 'thble')),
    r AS (
      SELECT 0::BIGINT AS i, ''::VARCHAR AS path, 0::BIGINT AS line_start, 0::BIGINT AS cost, false AS taken, 0::BIGINT AS used, 0 AS hits, ''::VARCHAR AS ended
      UNION ALL
      SELECT c.i, c.path, c.line_start, c.cost, c.path <> ended AND used + c.cost <= 40000, used + CASE WHEN c.path <> ended AND used + c.cost <= 40000 THEN c.cost ELSE 0 END,
        hits + (c.path <> ended AND used + c.cost <= 40000)::INT, CASE WHEN c.path <> ended AND used + c.cost > 40000 THEN c.path ELSE ended END
      FROM r JOIN c ON c.i = r.i + 1 WHERE hits < 200 AND used < 40000)
    SELECT path || '::function::p' || (line_start - 1) || '::' || line_start AS ref_id, path, cost AS bytes FROM r WHERE taken
    """
)
def recursive_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs as symbols of their document. The bytes run out: a paragraph that doesn't fit into what is left ends its document, and later ones
    take what they can."""
    docs = table(spark, folder, "documents", "doc_id", "source", "text")
    parts = docs.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.posexplode(F.split("text", "\n")).alias("at", "signature"))
    symbols = parts.select("path", F.lit("function").alias("kind"), F.concat(F.lit("p"), F.col("at")).alias("name"), "signature", F.lit(None).cast("string").alias("doc_comment"), (F.col("at") + 1).alias("line_start"))
    found = recursive.recursive_query(symbols, ["function"], ["thble"], recursive.Budget(max_bytes_per_chunk=3000, max_total_bytes=40_000))
    return found.frames(spark)[0].select("ref_id", "path", "bytes")


# --- extensions: event-time windows, rollups, as-of join --------------------------------------------------------------


@register("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Extension: tumbling windows."""
    found = table(spark, folder, "events", "ts", "event_type", "value").groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return found.select(F.col("w.start").alias("start"), "event_type", "n", "total")


@register("SELECT event_type, ts::DATE::VARCHAR AS day, count(*) AS n FROM events GROUP BY ROLLUP (event_type, ts::DATE::VARCHAR)")
def event_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Extension: rollup."""
    return table(spark, folder, "events", "event_type", "ts").withColumn("day", F.to_date("ts").cast("string")).rollup("event_type", "day").agg(F.count("*").alias("n"))


@register(
    """
    SELECT p.event_id, coalesce(max(c.event_id), -1) AS click FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    LEFT JOIN LATERAL (SELECT event_id FROM events c WHERE c.event_type = 'click' AND c.user_id = p.user_id AND c.ts <= p.ts ORDER BY c.ts DESC, c.event_id DESC LIMIT 1) c ON true GROUP BY ALL
    """
)
def asof_click(spark: SparkSession, folder: str) -> DataFrame:
    """Extension: as-of join by one union and a running last value, no pairs."""
    rows = table(spark, folder, "events", "event_id", "user_id", "event_type", "ts").where(F.col("event_type").isin("purchase", "click"))
    order = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "click", 0).otherwise(1), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    click = F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(order)
    return rows.withColumn("click", F.coalesce(click, F.lit(-1))).where("event_type = 'purchase'").select("event_id", "click")
