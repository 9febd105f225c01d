"""Records of work: state machines, references, sessions, metrics, JSON and plans over files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The state machines' transitions, as (machine, before, afters).
TRANSITIONS = [
    ("hypothesis", "unverified", ["analyzing"]),
    ("hypothesis", "analyzing", ["confirmed", "debunked", "partially_confirmed", "inconclusive"]),
    ("task", "open", ["in_progress"]),
    ("task", "in_progress", ["done", "blocked"]),
    ("task", "blocked", ["in_progress"]),
    ("issue", "open", ["in_progress"]),
    ("issue", "in_progress", ["done", "blocked", "abandoned"]),
    ("issue", "blocked", ["in_progress"]),
    ("research", "open", ["in_progress"]),
    ("research", "in_progress", ["resolved", "abandoned"]),
    ("session", "active", ["wrapped_up", "abandoned"]),
    ("study", "active", ["concluding", "abandoned"]),
    ("study", "concluding", ["completed", "abandoned"]),
]


def transitions(spark: SparkSession) -> DataFrame:
    """(machine, before, after)."""
    return spark.createDataFrame([(m, b, a) for m, b, afters in TRANSITIONS for a in afters], "machine string, before string, after string")


# --- references and times --------------------------------------------------------------------------------------------


def package_ref(ref: Column) -> list[Column]:
    """ecosystem, package and version of eco:package:version; the package may hold colons, a missing part is null."""
    first, last = F.substring_index(ref, ":", 1), F.substring_index(ref, ":", -1)
    colons = F.length(ref) - F.length(F.replace(ref, F.lit(":"), F.lit("")))
    middle = F.substring(ref, F.length(first) + 2, F.length(ref) - F.length(first) - F.length(last) - 2)
    return [
        F.when(colons >= 1, first).alias("ecosystem"),
        F.when(colons >= 2, middle).when(colons == 1, last).otherwise(ref).alias("package"),
        F.when(colons >= 2, last).alias("version"),
    ]


def location(ref: Column) -> list[Column]:
    """path, line_start and line_end of path#a-b or path#a; null where there is none."""
    numbers = r"#L?(\d+)(?:-L?(\d+))?$"
    begin, end = F.regexp_extract(ref, numbers, 1), F.regexp_extract(ref, numbers, 2)
    known = ref.rlike(numbers)
    return [
        F.regexp_replace(ref, numbers, "").alias("path"),
        F.when(known, begin.cast("int")).alias("line_start"),
        F.when(known, F.when(end == "", begin).otherwise(end).cast("int")).alias("line_end"),
    ]


def parse_time(text: Column) -> Column:
    """RFC 3339, or a date and a time with a blank between in UTC; null for all else."""
    zoned = F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"), F.upper(text)))
    plain = F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(\.\d+)?$"), F.concat(text, F.lit("Z"))))
    return F.coalesce(zoned, plain)


# --- JSON ----------------------------------------------------------------------------------------------------------


def json_group(rows: DataFrame, keys: list[str], fields: list[str], order: list[str], name: str = "items") -> DataFrame:
    """Per key a JSON array of objects of the fields, in order."""
    lead = F.struct(*order, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("_json_"))
    listed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(lead)).alias("_all_"))
    return listed.select(*keys, F.concat(F.lit("["), F.array_join(F.col("_all_._json_"), ","), F.lit("]")).alias(name))


def merge_maps(rows: DataFrame, keys: list[str], data: str, order: list[Column]) -> DataFrame:
    """(keys, field, value): the union of JSON objects of each key; of a field that several have the last in order wins."""
    parsed = F.from_json(F.col(data), "map<string,string>")
    fields = rows.select(*keys, F.struct(*order).alias("_place_"), F.explode(parsed).alias("field", "value"))
    return fields.groupBy(*keys, "field").agg(F.max_by("value", "_place_").alias("value"))


# --- metrics -------------------------------------------------------------------------------------------------------


def type_metrics(events: DataFrame, kinds: list[str], *, kind: str = "kind", outcome: str = "outcome", ms: str = "ms") -> DataFrame:
    """Per kind: started, completed, failed, success_rate and mean_ms (whole milliseconds of a completed one); kinds that
    were never started are left out."""
    sums = events.where(F.col(kind).isin(*kinds)).groupBy(kind).agg(
        F.count_if(F.col(outcome) == "started").alias("started"),
        F.count_if(F.col(outcome) == "completed").alias("completed"),
        F.count_if(F.col(outcome) == "failed").alias("failed"),
        F.coalesce(F.sum(F.when(F.col(outcome) == "completed", F.col(ms))), F.lit(0)).cast("long").alias("total_ms"),
    )
    known = sums.where("started > 0")
    rate = F.when(F.col("completed") + F.col("failed") > 0, F.col("completed") * 100.0 / (F.col("completed") + F.col("failed"))).otherwise(0.0)
    mean = F.when(F.col("completed") > 0, F.floor(F.col("total_ms") / F.col("completed"))).otherwise(0)
    return known.select(kind, "started", "completed", "failed", F.round(rate, 6).alias("success_rate"), mean.cast("long").alias("mean_ms"))


def recover(assignments: DataFrame, workflows: DataFrame) -> DataFrame:
    """After a crash: started assignments of active or paused workflows go back to pending, without an agent."""
    live = workflows.where(F.col("status").isin("active", "paused")).select("workflow_id")
    lost = assignments.join(live.withColumn("_live_", F.lit(True)), "workflow_id", "left")
    reset = F.coalesce("_live_", F.lit(False)) & (F.col("status") == "started")
    return lost.select(
        *(c for c in assignments.columns if c not in ("status", "agent")),
        F.when(reset, "pending").otherwise(F.col("status")).alias("status"),
        F.when(~reset, F.col("agent")).alias("agent"),
    )


def session_start(sessions: DataFrame, *, most: int = 10) -> DataFrame:
    """What starting a session makes of those left active: the newest `most` orphans, newest first."""
    return sessions.where("status = 'active'").orderBy(F.desc("started_at"), "id").limit(most).select("id", "started_at", F.lit("abandoned").alias("status"))


# --- reference graph and file plans -----------------------------------------------------------------------------------


#: Hits that a task may get on average; of more than so many for each of Spark's shuffle partitions, more partitions are made.
TASK_ROWS = 500_000


def store_refs(stored: DataFrame, hits: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or ignore of hits or edges; of several hits of one key the least row counts, whatever order they come in."""
    others = [c for c in stored.columns if c not in keys]
    # a task holds the tables and the sorted rows of both sides at once, so its share mustn't grow with the hits
    parts = -(-hits.count() // TASK_ROWS)
    if parts > int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        hits = hits.repartition(parts, *keys)
    once = hits.groupBy(*keys).agg(F.min(F.struct(*others)).alias("_row_")).select(*keys, "_row_.*") if others else hits.select(*keys).distinct()
    return stored.unionByName(once.join(stored.select(*keys), keys, "left_anti").select(*stored.columns))


def category_counts(edges: DataFrame) -> DataFrame:
    """(category, n) of a reference graph's edges."""
    return edges.groupBy("category").agg(F.count("*").alias("n"))


def refs_by_signature(refs: DataFrame, signatures: DataFrame) -> DataFrame:
    """(signature, ref_id) of the references that have one of the signatures; of several of one signature the least."""
    met = refs.join(signatures.select("signature").distinct(), "signature")
    return met.groupBy("signature").agg(F.min("ref_id").alias("ref_id"))


def edge_category(source: Column, target: Column, external: Column) -> Column:
    """How the paths of two references relate: one module, an outer package, one crate (first segment of the path), or another."""
    first = lambda path: F.substring_index(path, "/", 1)
    return F.when(source == target, "same_module").when(external, "external").when(first(source) == first(target), "same_crate").otherwise("other_crate")


def plan_files(files: DataFrame, keywords: list[str], *, budget: int, path: str = "path", content: str = "content") -> DataFrame:
    """(path, bytes): files that hold a keyword, in path order, as long as their bytes together keep the budget.

    The running sum is taken in two steps, within 1,024 ranges of paths and over the ranges, so no task sorts all."""
    text = F.lower(F.col(content))
    hit = reduce(lambda a, b: a | b, (text.contains(k.lower()) for k in keywords))
    found = files.where(hit).select(F.col(path).cast("string").alias("path"), F.octet_length(content).cast("long").alias("bytes"))
    ranged = found.repartitionByRange(64, "path").withColumn("_part_", F.spark_partition_id())
    inner = F.sum("bytes").over(Window.partitionBy("_part_").orderBy("path").rowsBetween(Window.unboundedPreceding, 0))
    sums = ranged.groupBy("_part_").agg(F.sum("bytes").alias("_sum_"))
    before = sums.select(F.col("_part_").alias("_of_"), (F.sum("_sum_").over(Window.orderBy("_part_")) - F.col("_sum_")).alias("_before_"))
    return ranged.withColumn("_upto_", inner).join(F.broadcast(before), F.col("_part_") == F.col("_of_")).where(F.col("_upto_") + F.col("_before_") <= budget).select("path", "bytes")


def shared_themes(left: DataFrame, right: DataFrame, themes: list[str], *, key: str = "id", text: str = "text") -> DataFrame:
    """(left_id, right_id, themes): rows of two kinds whose texts share a theme, by an equi-join on the theme, so rows
    without a common theme never meet."""

    def tagged(rows: DataFrame, name: str) -> DataFrame:
        hit = F.filter(F.array(*map(F.lit, themes)), lambda t: F.contains(F.lower(F.col(text)), t))
        return rows.select(F.col(key).alias(name), F.explode(hit).alias("theme"))

    pairs = tagged(left, "left_id").join(tagged(right, "right_id"), "theme")
    return pairs.groupBy("left_id", "right_id").agg(F.array_join(F.sort_array(F.collect_set("theme")), ",").alias("themes"))


def merged_top(parts: list[DataFrame], *, distance: str, key: str, k: int) -> DataFrame:
    """The k nearest of several result lists, each cut to its own k first; ties by key."""
    cut = [p.orderBy(distance, key).limit(k) for p in parts]
    return reduce(DataFrame.unionByName, cut).orderBy(distance, key).limit(k)


def discover(packages: DataFrame, dependencies: DataFrame, scope: Column, ecosystem: str) -> DataFrame:
    """Visible packages of an ecosystem that are among the user's dependencies."""
    return packages.where(scope & (F.col("ecosystem") == ecosystem)).join(dependencies.select("package").distinct(), "package", "left_semi")


# --- entities ----------------------------------------------------------------------------------------------------------


def create(stored: DataFrame, incoming: DataFrame, keys: list[str], defaults: dict[str, object]) -> DataFrame:
    """Adds entities whose key isn't stored, with defaults where a field is null."""
    filled = incoming.select(*(F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in incoming.columns))
    return store_refs(stored, filled, keys)


def update(stored: DataFrame, changes: DataFrame, key: str, *, data: str = "data", fields: list[str], order: list[Column] | None = None) -> DataFrame:
    """Partial updates by JSON objects; a field that they lack is kept, null sets null, a value is set in the column's own type. Of several
    changes of a key each field takes its last value by `order`, or by the objects' text without one."""
    body = F.map_entries(F.from_json(F.col(data), "map<string,string>"))
    place = F.struct(*(order or []), F.col(data))
    told = changes.select(F.col(key).alias("_key_"), place.alias("_at_"), F.explode(body).alias("_e_"))
    last = told.groupBy("_key_", F.col("_e_.key").alias("_name_")).agg(F.max_by(F.struct(F.col("_e_.value").alias("value")), "_at_").alias("_v_"))
    named = last.groupBy("_key_").agg(F.map_from_entries(F.collect_list(F.struct("_name_", F.col("_v_.value")))).alias("_body_"))
    joined = stored.join(named, F.col(key) == F.col("_key_"), "left")

    def new(c: str) -> Column:
        given = F.coalesce(F.map_contains_key("_body_", F.lit(c)), F.lit(False))
        return F.when(given, F.col("_body_").getItem(c).cast(stored.schema[c].dataType)).otherwise(F.col(c)).alias(c)

    return joined.select(*(new(c) if c in fields else F.col(c) for c in stored.columns))


def schema_problems(json: Column, required: dict[str, str]) -> Column:
    """What is wrong with a JSON object, as an array: "name: missing", or "name: not integer|number|boolean|string|object|array" by the type that
    the value is written in; null is of no type. Text that isn't an object lacks everything."""
    forms = {"integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL)", "boolean": "^BOOLEAN$", "string": "^STRING$", "object": "^OBJECT", "array": "^ARRAY"}
    parsed, found = F.try_parse_json(json), []
    for name, kind in required.items():
        value = F.try_variant_get(parsed, f"$['{name}']", "variant")
        written = F.when(F.is_variant_null(value), "VOID").otherwise(F.schema_of_variant(value))
        found.append(F.when(value.isNull(), F.lit(f"{name}: missing")).when(~written.rlike(forms[kind]), F.lit(f"{name}: not {kind}")))
    return F.array_compact(F.array(*found))


def whats_next(sessions: DataFrame, tasks: DataFrame, hypotheses: DataFrame, audit: DataFrame, *, org: str | None = None) -> dict[str, DataFrame]:
    """The four frames of what to do next: the last session, open tasks (by status, then age), pending hypotheses (newest first), the 20 last
    audit rows. With an org its rows and those of none count, without one only those of none; frames without org_id are everyone's."""

    def scoped(rows: DataFrame) -> DataFrame:
        if "org_id" not in rows.columns:
            return rows
        return rows.where(F.col("org_id").isNull() | (F.col("org_id") == org) if org is not None else F.col("org_id").isNull())

    return {
        "last_session": scoped(sessions).orderBy(F.desc("started_at"), F.desc("id")).limit(1),
        "open_tasks": scoped(tasks).where(F.col("status").isin("open", "in_progress")).orderBy("status", "created_at", "id"),
        "pending_hypotheses": scoped(hypotheses).where(F.col("status").isin("unverified", "analyzing")).orderBy(F.desc("created_at"), F.desc("id")),
        "recent_audit": audit.orderBy(F.desc("created_at"), F.desc("id")).limit(20),
    }


def random_id(prefix: str, *, digits: int = 8) -> Column:
    """prefix- and random hex digits; another one for each row and each run."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.md5(F.uuid()), 1, digits))


def cache_action(state: Column, results: Column) -> Column:
    """What a lookup does: use a fresh entry (and refresh it if it is empty), use and refresh a stale one, fetch a missing one."""
    return F.when(state == "miss", "fetch").when((state == "stale") | (results == 0), "use and refresh").otherwise("use")


def step_metrics(events: DataFrame, *, workflow: str, step: str, ok: Column) -> DataFrame:
    """(workflow, step, succeeded, failed, success_rate)."""
    sums = events.groupBy(workflow, step).agg(F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"))
    return sums.withColumn("success_rate", F.round(F.col("succeeded") * 100.0 / (F.col("succeeded") + F.col("failed")), 6))


def fallback_spans(lines: DataFrame) -> DataFrame:
    """(path, line_no, kind, line): declarations and doc lines by how a line begins, for files that no extractor reads."""
    bare = F.ltrim("line")
    kind = F.when(bare.rlike(r"^(pub )?fn "), "function").when(bare.rlike(r"^(pub )?struct "), "struct").when(bare.startswith("///") | bare.startswith("//!"), "doc")
    return lines.withColumn("kind", kind).where("kind IS NOT NULL").select("path", "line_no", "kind", "line")
