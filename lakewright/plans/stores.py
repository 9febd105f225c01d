"""Queries over stored things that change: versioned datasets, replayed state, logs of several versions, a quantised vector index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakewright.operators import indexing, lifecycle, log_versions, quantised, rebuild, search
from lakewright.plans.registry import register
from lakewright.session import ensure_checkpoint_dir
from lakewright.sources import archives
from lakewright.sources.snapshots import Dataset
from lakewright.sources.tables import table
from lakewright.sources.versions import Versions
from lakewright.streaming import timers


def fresh(spark: SparkSession, label: str) -> str:
    return Versions(spark, ensure_checkpoint_dir(spark)).fresh(label)


@register(
    """
    WITH v AS (SELECT 2 AS version, * FROM events WHERE event_id % 10 < 7 UNION ALL SELECT 3, * FROM events UNION ALL SELECT 4, * FROM events WHERE NOT (event_type = 'click' AND event_id BETWEEN 100 AND 499))
    SELECT version::INT AS version, event_type, count(*) AS n, round(sum(value), 4) AS total FROM v WHERE event_id BETWEEN 50 AND 899 GROUP BY ALL
    """
)
def dataset_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Two appends and a deletion; the last three versions are read within a range of keys, from the files that can hold it."""
    events = table(spark, folder, "events")
    data = Dataset.create(spark, fresh(spark, "dataset"), events, ["event_id"])
    versions = [data.append(events.where("event_id % 10 < 7"), files=8), data.append(events.where("event_id % 10 >= 7"), files=8)]
    versions.append(data.delete({"event_id": (100, 499)}, F.col("event_type") == "click"))
    read = None
    for version in versions:
        rows = data.read(version, {"event_id": (50, 899)}).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
        rows = rows.select(F.lit(version).alias("version"), "event_type", "n", "total")
        read = rows if read is None else read.unionByName(rows)
    return read


_OP = "CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'update' END"


@register(
    f"""
    WITH o AS (SELECT user_id::VARCHAR AS id, {_OP} AS op, (strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), event_id) AS p, value FROM events),
    d AS (SELECT *, max(CASE WHEN op = 'delete' THEN p END) OVER (PARTITION BY id) AS gone FROM o),
    b AS (SELECT *, min(CASE WHEN op = 'create' THEN p END) OVER (PARTITION BY id) AS born FROM d WHERE gone IS NULL OR p > gone)
    SELECT id, arg_max(value, p)::DOUBLE AS value FROM b WHERE born IS NOT NULL AND (p = born OR (p > born AND op = 'update')) GROUP BY id
    """
)
def replay_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """A log of which a first half is replayed, and then what has changed: the state is that of the whole log. A file holds the events of one user in
    a day."""
    events = table(spark, folder, "events", "event_id", "ts", "user_id", "event_type", "value")
    body = F.to_json(F.struct(F.col("value").cast("string").alias("value")))
    log = events.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("file"), F.col("event_id").alias("line"),
        F.expr(_OP).alias("op"), F.lit("user").alias("entity"), F.col("user_id").cast("string").alias("id"), body.alias("data"),
    )

    def part(rows: DataFrame) -> rebuild.Log:
        files = rows.groupBy("file").agg(F.concat_ws(":", F.count("*"), F.max("line")).alias("mark"))
        return rebuild.Log(files, lambda wanted: rows.join(F.broadcast(wanted), "file", "left_semi").select("file", F.col("data").alias("value")), lambda wanted: rows.join(F.broadcast(wanted), "file", "left_semi"))

    kept = rebuild.Replayed(spark, fresh(spark, "replayed"), ["value"])
    kept.refresh(part(log.where("ts < '2024-01-20'")))
    kept.refresh(part(log))
    return kept.state().select("id", F.col("value").cast("double").alias("value"))


@register(
    """
    WITH e AS (SELECT *, event_id % 5 AS r FROM events WHERE event_id % 5 <> 4 AND NOT (event_id % 5 = 2 AND event_type = 'view')),
    u AS (SELECT user_id, event_type, event_id, CASE r WHEN 0 THEN 'web' WHEN 1 THEN 'web' WHEN 2 THEN 'app' ELSE 'api' END AS channel, CASE WHEN r = 3 THEN event_id % 1000 ELSE CAST(round(value * 100) AS BIGINT) END AS cents FROM e)
    SELECT user_id::VARCHAR AS id, channel, count(*) AS n, sum(cents)::BIGINT AS cents, max(event_type) AS last_kind FROM u GROUP BY ALL
    """
)
def log_upgrade(spark: SparkSession, folder: str) -> DataFrame:
    """A log of four versions (and an unknown one) brought up to the newest: `kind` became `event`, `channel` is new, an amount became cents. Lines
    of version 3 without their event are set apart."""
    events = table(spark, folder, "events", "event_id", "user_id", "event_type", "value")
    r, kind, amount = F.col("event_id") % 5, F.col("event_type"), F.col("value").cast("string")
    cents = (F.col("event_id") % 1000).cast("string")
    data = (
        F.when(r == 0, F.to_json(F.struct(kind.alias("kind"), amount.alias("amount"))))
        .when(r == 1, F.to_json(F.struct(kind.alias("event"), amount.alias("amount"))))
        .when(r == 2, F.to_json(F.struct(F.when(kind != "view", kind).alias("event"), F.lit("app").alias("channel"), amount.alias("amount"))))
        .otherwise(F.to_json(F.struct(kind.alias("event"), F.lit("api").alias("channel"), cents.alias("cents"))))
    )
    log = events.select((r + 1).cast("int").alias("v"), F.lit("create").alias("op"), F.col("user_id").cast("string").alias("id"), data.alias("data"))
    to_cents = [log_versions.computed("amount", lambda d: F.round(d["amount"].cast("double") * 100).cast("long")), log_versions.renamed("amount", "cents")]
    registry = log_versions.Registry(
        {1: ["kind", "amount"], 2: ["event", "amount"], 3: ["event", "channel", "amount"], 4: ["event", "channel", "cents"]},
        {1: [log_versions.renamed("kind", "event")], 2: [log_versions.defaulted("channel", "web")], 3: to_cents},
    )
    done, _ = log_versions.upgrade(log, registry)
    read = done.select("id", F.from_json("data", "event string, channel string, cents string").alias("d")).select("id", "d.event", "d.channel", F.col("d.cents").cast("long").alias("cents"))
    return read.groupBy("id", "channel").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"), F.max("event").alias("last_kind"))


@register()
def vector_quantised(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 20, through cells and codes, ranked by their exact cosine. No SQL: some of the ten may
    be missed; a test holds it against the exact ten."""
    rows = table(spark, folder, "embeddings", "vec_id", "embedding")
    path = fresh(spark, "quantised")
    quantised.write_index(rows, path)
    return quantised.search(rows.where("vec_id % 20 = 0"), rows, path, k=10, probes=14)


_MOVE = "CASE event_type WHEN 'signup' THEN 'transition' WHEN 'error' THEN 'transition' WHEN 'click' THEN 'transition' WHEN 'purchase' THEN 'reopen' ELSE 'update' END"
_TO = "CASE event_type WHEN 'signup' THEN 'wrapped_up' WHEN 'error' THEN 'abandoned' WHEN 'click' THEN 'archived' END"


@register(
    f"""
    WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, {_TO} AS tgt FROM events),
    b AS (SELECT user_id, min((ts, event_id)) AS born, min(ts) AS started_at FROM e GROUP BY user_id),
    m AS (SELECT e.*, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM e JOIN b USING (user_id) WHERE event_type <> 'view' AND (ts, event_id) > born),
    r AS (
      SELECT user_id, 0::BIGINT AS i, 'active' AS status, NULL::VARCHAR AS ended_at, NULL::VARCHAR AS summary, 0::BIGINT AS accepted, 0::BIGINT AS refused FROM b
      UNION ALL
      SELECT r.user_id, m.i, CASE WHEN event_type = 'purchase' AND status <> 'active' THEN 'active' WHEN status = 'active' AND event_type IN ('signup', 'error') THEN tgt ELSE status END,
        CASE WHEN event_type = 'purchase' AND status <> 'active' THEN NULL WHEN status = 'active' AND event_type IN ('signup', 'error') THEN ts ELSE ended_at END,
        CASE WHEN event_type = 'purchase' AND status <> 'active' THEN NULL WHEN status = 'active' AND event_type = 'signup' THEN 's' || event_id WHEN status = 'active' AND event_type = 'error' THEN NULL ELSE summary END,
        accepted + ((event_type = 'purchase' AND status <> 'active') OR (status = 'active' AND event_type IN ('signup', 'error')))::INT,
        refused + (NOT ((event_type = 'purchase' AND status <> 'active') OR (status = 'active' AND event_type IN ('signup', 'error'))))::INT
      FROM r JOIN m ON m.user_id = r.user_id AND m.i = r.i + 1)
    SELECT user_id::VARCHAR AS id, status, started_at, ended_at, summary, accepted, refused FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i DESC) AS k FROM r) JOIN b USING (user_id) WHERE k = 1
    """
)
def session_life_cycle(spark: SparkSession, folder: str) -> DataFrame:
    """Events as the log of sessions: a user's first event opens a session, sign-ups wrap it up, errors abandon it, purchases reopen it, and
    clicks ask for what is never allowed."""
    events = table(spark, folder, "events", "event_id", "ts", "user_id", "event_type")
    first = F.min(F.struct("ts", "event_id")).over(Window.partitionBy("user_id"))
    log = events.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), F.lit("events").alias("file"), F.col("event_id").alias("line"), F.lit("session").alias("entity"), F.col("user_id").cast("string").alias("id"),
        F.when(F.struct("ts", "event_id") == first, "create").otherwise(F.expr(_MOVE)).alias("op"),
        F.to_json(F.struct(F.expr(_TO).alias("to"), F.when(F.col("event_type") == "signup", F.concat(F.lit("s"), "event_id")).alias("summary"))).alias("data"),
    )
    return lifecycle.life_cycles(log).select("id", "status", "started_at", "ended_at", "summary", "accepted", "refused")


@register("SELECT page_id, url, octet_length(encode(html))::BIGINT AS n_bytes, sha256(html) AS digest FROM pages")
def archive_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages written as web archives and read back, in runs of whole members that the offset index names."""
    archives.register(spark)
    home = fresh(spark, "archive")
    archives.write(archives.of_pages(table(spark, folder, "pages")), home, files=int(spark.conf.get("spark.sql.shuffle.partitions"))).count()
    archives.write_index(spark, home, f"{home}/index")
    read = spark.read.format("webarchive").option("index", f"{home}/index").option("split", str(1 << 20)).load(home)
    return read.select(F.regexp_extract("record_id", r"(\d+)", 1).cast("long").alias("page_id"), F.col("uri").alias("url"), F.octet_length("body").cast("long").alias("n_bytes"), F.sha2("body", 256).alias("digest"))


@register(
    """
    WITH e AS (SELECT user_id, list(CASE WHEN event_type = 'signup' THEN 1 WHEN event_type IN ('purchase', 'error') THEN -1 ELSE 0 END ORDER BY ts, event_id) AS d FROM events GROUP BY user_id),
    f AS (SELECT user_id, list_transform(generate_series(1, len(d)), lambda i: list_reduce([0] || d[1:i], lambda a, b: greatest(0, a + b))) AS a FROM e)
    SELECT user_id::VARCHAR AS key, a[len(a)]::BIGINT AS active, list_max(a)::BIGINT AS peak FROM f
    """
)
def active_in_order(spark: SparkSession, folder: str) -> DataFrame:
    """Sign-ups less purchases and errors of each user in the order of their times, never below zero: the last and the highest count."""
    events = table(spark, folder, "events", "event_id", "ts", "user_id", "event_type")
    told = events.select(F.col("user_id").cast("string").alias("key"), "event_type", "ts", F.col("event_id").alias("seq"))
    counted = timers.active_in_order(told, "signup", "purchase", "error")
    return counted.groupBy("key").agg(F.max_by("active", F.struct("ts", "seq")).alias("active"), F.max("active").alias("peak"))


_CUT = "SELECT doc_id, unnest(string_split(body, chr(10))) AS line, unnest(generate_series(1, len(string_split(body, chr(10))))) AS nth FROM f"


@register(
    f"""
    WITH f AS (SELECT doc_id, CASE WHEN doc_id % 100 = 0 THEN text || chr(10) || 'a widget of asia' ELSE text END AS body FROM documents WHERE doc_id % 100 <> 1),
    c AS ({_CUT}), t AS (SELECT doc_id || '#' || nth AS id, regexp_extract_all(strip_accents(lower(line)), '[\\p{{L}}\\p{{N}}]+') AS w FROM c WHERE trim(line) <> ''),
    h AS (SELECT id, len(w) AS length, len(list_filter(w, lambda x: x IN ('widget', 'widgets', 'widgeted', 'widgeting', 'widgetings'))) AS n FROM t),
    g AS (SELECT count(*) AS docs, avg(length) AS mean, count(*) FILTER (n > 0) AS d FROM h)
    SELECT id, round(greatest(ln((docs - d + 0.5) / (d + 0.5)), 1e-6) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * length / mean)), 6) AS score FROM h, g WHERE n > 0
    """
)
def index_job(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files: a first run cuts all of them into paragraphs and indexes these; of a second one, one file in a hundred has changed and
    one has gone. The answer is that of a fresh index."""
    docs = table(spark, folder, "documents", "doc_id", "text").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))

    def paragraphs(files: DataFrame) -> DataFrame:
        lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("at", "text")).where(F.trim("text") != "")
        return lines.select("path", F.concat_ws("#", "path", F.col("at") + 1).alias("id"), "text")

    job = indexing.Indexer(spark, fresh(spark, "indexed"), {"chunks": paragraphs}, ("chunks", "chunk", "id", ["text"]))
    job.run(docs.select("path", "content"))
    changed = F.when(F.col("doc_id") % 100 == 0, F.concat("content", F.lit("\na widget of asia"))).otherwise(F.col("content"))
    job.run(docs.where("doc_id % 100 <> 1").select("path", changed.alias("content")))
    return search.search(job.index(), "widgets", limit=1_000_000_000).select("id", "score")
