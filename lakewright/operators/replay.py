"""Replay of an append-only operation log into entity state, as aggregates instead of a sequential fold.

An operation is (ts, file, line, op, entity, id, data as JSON text). The total order is (ts, file, line), ts as text. For
each entity: the last delete drops what came before it; the first create after it makes the row; later creates are
ignored; each field takes its last value among the create and the updates that name it, where naming it with null
sets null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPERATION = T.StructType(
    [T.StructField(n, t) for n, t in (("v", T.IntegerType()), ("ts", T.StringType()), ("ses", T.StringType()), ("op", T.StringType()), ("entity", T.StringType()), ("id", T.StringType()), ("data", T.StringType()))]
)
#: A line's file, as listings of files name it.
NAME = "_metadata.file_path AS file"
#: What a create leaves open.
DEFAULTS = {"status": "open", "confidence": "medium", "priority": "3"}


def read_log(spark, folder: str) -> DataFrame:
    """Operations of a folder's .jsonl files; v is 1 where it is missing, other versions raise an error."""
    return _operations(spark.read.option("pathGlobFilter", "*.jsonl").text(folder).selectExpr("value", NAME))


def read_files(spark, paths: list[str]) -> DataFrame:
    """Operations of some files."""
    return _operations(spark.read.text(paths).selectExpr("value", NAME) if paths else spark.createDataFrame([], "value string, file string"))


def _operations(raw: DataFrame) -> DataFrame:
    numbered = raw.where(F.trim("value") != "").withColumn("line", F.monotonically_increasing_id())
    parsed = numbered.select("file", "line", F.from_json("value", OPERATION).alias("o"), F.get_json_object("value", "$.data").alias("body")).select("file", "line", "o.*", "body")
    checked = parsed.withColumn("v", F.coalesce("v", F.lit(1))).withColumn("data", F.coalesce("body", "data")).drop("body")
    return checked.where(F.when(F.col("v") == 1, True).otherwise(F.raise_error(F.concat(F.lit("unknown log version "), F.col("v").cast("string"))).cast("boolean")))


def _position() -> Column:
    return F.struct("ts", "file", "line")


def entity_state(log: DataFrame, fields: list[str], defaults: dict[str, str] | None = None) -> DataFrame:
    """(entity, id, created_at, updated_at, and each field as text) of what exists after the whole log."""
    defaults = DEFAULTS if defaults is None else defaults
    keys = ["entity", "id"]
    placed = log.withColumn("at", _position())
    part = Window.partitionBy(*keys)
    alive = placed.withColumn("dropped", F.max(F.when(F.col("op") == "delete", F.col("at"))).over(part)).where(F.col("dropped").isNull() | (F.col("at") > F.col("dropped")))
    born = alive.withColumn("born", F.min(F.when(F.col("op") == "create", F.col("at"))).over(part))
    used = born.where(F.col("born").isNotNull() & ((F.col("at") == F.col("born")) | ((F.col("at") > F.col("born")) & F.col("op").isin("update", "transition"))))
    body = used.withColumn("body", F.from_json("data", "map<string,string>"))
    picks = []
    for name in fields:
        named = F.map_contains_key("body", name)
        value = F.max(F.when(named, F.struct("at", F.struct(F.col("body").getItem(name).alias("value")).alias("v"))))
        latest = value["v"]["value"]
        picks.append(F.when(value.isNotNull(), latest).otherwise(F.lit(defaults.get(name))).alias(name))
    changed = F.max(F.when(F.col("at") > F.col("born"), F.col("ts")))
    return body.groupBy(*keys).agg(F.min(F.when(F.col("at") == F.col("born"), F.col("ts"))).alias("created_at"), changed.alias("updated_at"), *picks)


def tags(log: DataFrame) -> DataFrame:
    """(entity, id, tag) that are set: the last tag or untag of each decides, and nothing before the entity's last delete counts."""
    placed = log.withColumns({"at": _position(), "tag": F.get_json_object("data", "$.tag")})
    dropped = placed.withColumn("dropped", F.max(F.when(F.col("op") == "delete", F.col("at"))).over(Window.partitionBy("entity", "id")))
    named = dropped.where(F.col("op").isin("tag", "untag") & (F.col("dropped").isNull() | (F.col("at") > F.col("dropped"))))
    last = named.groupBy("entity", "id", "tag").agg(F.max_by("op", "at").alias("op"))
    return last.where("op = 'tag'").drop("op")


def links(log: DataFrame) -> DataFrame:
    """(id, source, target, relation) of links that were made and not undone after."""
    named = log.where(F.col("op").isin("link", "unlink")).withColumn("at", _position())
    last = named.groupBy("id").agg(F.max_by(F.struct("op", "data"), "at").alias("x"))
    read = F.from_json("x.data", "source_type string, source_id string, target_type string, target_id string, relation string")
    made = last.where("x.op = 'link'").select("id", read.alias("l"))
    return made.select("id", F.concat_ws(":", "l.source_type", "l.source_id").alias("source"), F.concat_ws(":", "l.target_type", "l.target_id").alias("target"), "l.relation")


def audit(log: DataFrame) -> DataFrame:
    """Every operation as an audit row."""
    return log.select(F.col("ses").alias("session_id"), F.col("entity").alias("entity_type"), F.col("id").alias("entity_id"), F.col("op").alias("action"), F.col("data").alias("detail"), F.col("ts").alias("created_at"))


def invalid_lines(raw: DataFrame) -> DataFrame:
    """(file, line, problem) of log lines with a byte-order mark, a conflict marker, broken JSON or a missing field; raw: file, line, value."""
    parsed = F.from_json("value", OPERATION)
    problem = (
        F.when(F.col("value").startswith("﻿"), "byte-order mark")
        .when(F.col("value").rlike(r"^(<{7}|={7}|>{7})"), "conflict marker")
        .when(F.get_json_object("value", "$").isNull(), "not JSON")
        .when(parsed["op"].isNull() | parsed["entity"].isNull() | parsed["id"].isNull() | parsed["ts"].isNull(), "missing field")
    )
    return raw.where(F.trim("value") != "").withColumn("problem", problem).where("problem IS NOT NULL").select("file", "line", "problem")


def dry_run(raw: DataFrame) -> DataFrame:
    """Files and non-blank lines of a log; raw: file, value."""
    return raw.agg(F.count_distinct("file").alias("files"), F.count_if(F.trim("value") != "").alias("operations"))
