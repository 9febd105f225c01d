"""Queries through sinks and file sources: stores, exports, manifests, catalogs, logs, registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.operators import recursive, replay
from lakewright.operators import text as T
from lakewright.parsing import symbols
from lakewright.plans.registry import register
from lakewright.plans.stores import fresh
from lakewright.sources import files, sinks
from lakewright.sources.tables import table


@register(
    """
    SELECT p_partkey, p_brand, CASE WHEN p_size = 10 THEN 'cached' ELSE p_type END AS p_type FROM part WHERE p_partkey % 5 <> 4 AND p_size <> 20
    """
)
def store_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Bulk appends that refuse a known key, a flag that is set, a deletion: each a version of its own."""
    parts = table(spark, folder, "part", "p_partkey", "p_brand", "p_type", "p_size")
    store = sinks.Store(spark, fresh(spark, "store"))
    store.append(parts.where("p_partkey % 5 < 2"), ["p_partkey"], strict=True)
    store.append(parts.where("p_partkey % 5 IN (2, 3)"), ["p_partkey"], strict=True)
    try:
        store.append(parts.where("p_partkey % 5 IN (3, 4)"), ["p_partkey"], strict=True)
    except ValueError:
        pass  # some are stored, so none is added
    store.set_flag(F.col("p_size") == 10, "p_type", "cached")
    store.delete(F.col("p_size") == 20)
    return store.read().select("p_partkey", "p_brand", "p_type")


@register("SELECT p_brand AS package, count(*) AS symbol_count, sum(count(*)) OVER ()::BIGINT AS total, true AS stale FROM part GROUP BY p_brand")
def export_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Parts exported as ZSTD Parquet, with a manifest that is read back and found too old."""
    parts = table(spark, folder, "part", "p_partkey", "p_brand")
    home = fresh(spark, "export")
    sinks.export(parts.select(F.lit("db").alias("ecosystem"), F.col("p_brand").alias("package"), F.lit("1").alias("version"), "p_partkey"), f"{home}/symbols")
    sinks.write_manifest(spark.read.parquet(f"{home}/symbols"), f"{home}/manifest", "2024-01-01T00:00:00Z")
    manifest = spark.read.json(f"{home}/manifest")
    stale = sinks.is_stale(manifest, F.expr("TIMESTAMP '2024-01-01 02:00:00'")).select("exported_at", "stale")
    rows = manifest.select("exported_at", "total_symbols", F.explode("packages").alias("p")).join(stale, "exported_at")
    return rows.select("p.package", "p.symbol_count", F.col("total_symbols").alias("total"), "stale")


@register(
    """
    SELECT source AS package, max(doc_id) AS newest, count(*) AS registered FROM (SELECT doc_id, source, CASE doc_id % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'team' ELSE 'private' END AS visibility, doc_id % 4 AS org FROM documents)
    WHERE visibility = 'public' OR (visibility = 'team' AND org = 1) GROUP BY source
    """
)
def catalog_registered(spark: SparkSession, folder: str) -> DataFrame:
    """Data files registered in a catalog, twice without effect, and what a member of an org may see of it."""
    docs = table(spark, folder, "documents", "doc_id", "source")
    visibility = F.element_at(F.array(F.lit("public"), F.lit("team"), F.lit("private")), (F.col("doc_id") % 3 + 1).cast("int"))
    entry = docs.select(
        F.col("doc_id").alias("id"), F.lit("db").alias("ecosystem"), F.col("source").alias("package"), F.lit("1").alias("version"), F.concat_ws("/", F.lit("lance"), "source", F.col("doc_id").cast("string")).alias("path"),
        visibility.alias("visibility"), F.concat(F.lit("o"), (F.col("doc_id") % 4).cast("string")).alias("org_id"), F.lit("someone").alias("owner_sub"),
    )
    catalog = sinks.register_file(sinks.register_file(entry.limit(0), entry), entry.withColumn("id", F.col("id") + 1_000_000))
    seen = catalog.where(sinks.R.visible("nobody", "o1"))
    return seen.groupBy("package").agg(F.max("id").alias("newest"), F.count("*").alias("registered"))


@register("SELECT user_id::VARCHAR AS session_id, count(*) AS operations, count(*) FILTER (event_type = 'signup') AS created, count(DISTINCT event_type) AS actions FROM events GROUP BY user_id")
def trail_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Operations appended to a log that keeps a session together, read back, each an audit row."""
    events = table(spark, folder, "events", "event_id", "ts", "user_id", "event_type")
    rows = events.select(
        F.lit(1).alias("v"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), F.col("user_id").cast("string").alias("ses"), F.when(F.col("event_type") == "signup", "create").otherwise(F.col("event_type")).alias("op"),
        F.lit("event").alias("entity"), F.col("event_id").cast("string").alias("id"), F.struct("event_id").alias("data"),
    )
    home = fresh(spark, "trail")
    sinks.append_log(rows, home)
    stored = spark.read.schema("v int, ts string, op string, entity string, id string, data string, ses string").json(home)
    told = replay.audit(stored)
    return told.groupBy("session_id").agg(F.count("*").alias("operations"), F.count_if(F.col("action") == "create").alias("created"), F.count_distinct("action").alias("actions"))


@register("SELECT count(DISTINCT user_id) AS files, count(*) AS operations FROM events WHERE event_id % 7 <> 0")
def trail_dry_run(spark: SparkSession, folder: str) -> DataFrame:
    """Files and lines of a log that a replay would read; blank lines don't count."""
    events = table(spark, folder, "events", "event_id", "user_id")
    return replay.dry_run(events.select(F.when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(F.col("user_id")).alias("file"), F.when(F.col("event_id") % 7 == 0, "  ").otherwise("{}").alias("value")))


@register(
    """
    WITH p AS (SELECT doc_id, source || CASE doc_id % 4 WHEN 0 THEN '/docs/' WHEN 1 THEN '/src/a/' WHEN 2 THEN '/src/tests/' ELSE '/' END || doc_id || CASE doc_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.py' ELSE '.log' END AS path FROM documents)
    SELECT path, (path LIKE '%.md' OR path LIKE '%/docs/%') AS documents, CASE doc_id % 3 WHEN 1 THEN 'python' WHEN 0 THEN 'markdown' END AS language FROM p
    WHERE (path LIKE '%.md' OR path LIKE '%/src/%') AND path NOT LIKE '%/tests/%'
    """
)
def path_globs(spark: SparkSession, folder: str) -> DataFrame:
    """Paths that are included and not excluded by globs, which of them are documentation, and their languages."""
    docs = table(spark, folder, "documents", "doc_id", "source")
    place = F.element_at(F.array(F.lit("/docs/"), F.lit("/src/a/"), F.lit("/src/tests/"), F.lit("/")), (F.col("doc_id") % 4 + 1).cast("int"))
    end = F.element_at(F.array(F.lit(".md"), F.lit(".py"), F.lit(".log")), (F.col("doc_id") % 3 + 1).cast("int"))
    paths = docs.select(F.concat("source", place, F.col("doc_id").cast("string"), end).alias("path"))
    kept = paths.where(T.path_filter(F.col("path"), T.GrepOptions(include=("*.md", "**/src/**"), exclude=("**/tests/**",))))
    return kept.select("path", symbols.is_document(F.col("path")).alias("documents"), symbols.language_column(F.col("path")).alias("language"))


@register(
    """
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT (SELECT count(*) FROM documents) AS files, (SELECT sum(octet_length(encode(text)))::BIGINT FROM documents) AS bytes, (SELECT count(*) FROM l) AS symbols, (SELECT count(*) FROM l WHERE trim(line) <> '') AS doc_spans
    """
)
def plan_totals(spark: SparkSession, folder: str) -> DataFrame:
    """What a query over all documents would read: files, bytes, lines and lines that aren't blank."""
    docs = table(spark, folder, "documents", "doc_id", F.col("text").alias("content"))
    lines = docs.select(F.explode(F.split("content", "\n")).alias("line"))
    return recursive.plan_totals(docs, lines, lines.where(F.trim("line") != ""))


@register(
    """
    SELECT name, ecosystem, downloads FROM (SELECT p_name AS name, 'parts' AS ecosystem, p_size::BIGINT * 100 AS downloads FROM part UNION ALL SELECT c_name, 'customers', c_custkey FROM customer UNION ALL SELECT s_name, 'suppliers', NULL FROM supplier)
    ORDER BY downloads DESC NULLS LAST, ecosystem, name LIMIT 50
    """
)
def registry_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Packages of three registries, the most downloaded first; one registry doesn't count downloads."""
    parts = table(spark, folder, "part").select(F.col("p_name").alias("name"), F.lit("parts").alias("ecosystem"), (F.col("p_size").cast("long") * 100).alias("downloads"))
    customers = table(spark, folder, "customer").select(F.col("c_name").alias("name"), F.lit("customers").alias("ecosystem"), F.col("c_custkey").alias("downloads"))
    suppliers = table(spark, folder, "supplier").select(F.col("s_name").alias("name"), F.lit("suppliers").alias("ecosystem"))
    return files.merge_registries([parts, customers, suppliers], limit=50).select("name", "ecosystem", "downloads")


@register(
    """
    SELECT doc_id::VARCHAR AS path, 'npm' AS ecosystem, 'p' || (doc_id % 7) AS package, CASE WHEN doc_id % 2 = 0 THEN '^' || (doc_id % 5) || '.0' ELSE '*' END AS version FROM documents WHERE doc_id % 3 = 0
    UNION ALL SELECT doc_id::VARCHAR, 'pypi', 'r' || (doc_id % 7), (doc_id % 5) || '.1' FROM documents WHERE doc_id % 3 = 1
    """
)
def manifest_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Dependencies in the manifests that stand beside each document: package.json, requirements.txt, and files that are none."""
    docs = table(spark, folder, "documents", "doc_id")
    n, number = F.col("doc_id"), F.col("doc_id").cast("string")
    version = F.when(n % 2 == 0, F.concat(F.lit('"^'), n % 5, F.lit('.0"'))).otherwise('{"git": "x"}')
    npm = F.concat(F.lit('{"dependencies": {"p'), n % 7, F.lit('": '), version, F.lit("}}"))
    pypi = F.concat(F.lit("# needed\n-r other.txt\nr"), n % 7, F.lit(" == "), n % 5, F.lit(".1 # why\n"))
    rows = docs.select(
        F.concat(number, F.when(n % 3 == 0, "/package.json").when(n % 3 == 1, "/requirements.txt").otherwise("/notes.txt")).alias("path"), F.when(n % 3 == 0, npm).when(n % 3 == 1, pypi).otherwise(F.lit("x == 1")).alias("content")
    )
    return files.dependencies(rows).select(F.substring_index("path", "/", 1).alias("path"), "ecosystem", "package", "version")
