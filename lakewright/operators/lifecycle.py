"""The status of entities from a log of moves, as a state machine with side effects, folded in two levels.

A move (`transition` with its `to`, or `reopen`) counts only if the machine of its entity kind allows it from where the entity is; else it is refused
and changes nothing. Whether it is allowed depends on all moves before it, so moves are cut into blocks of BLOCK by their places. What a block does is a
function from the status at its beginning to that at its end, worked out for all statuses at once and wherever the block is; an entity's blocks are
then chained, which takes a row a block, and each block is gone through once more from the status that it really begins with.

Side effects: every accepted move of a session overwrites its summary, and every one of a hypothesis its reason, even by null; a session that ends gets
ended_at (given, or the move's time), one that is reopened loses it; other kinds get updated_at. A delete drops what came before it; an entity begins
with its first create after that.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewright.operators.records import TRANSITIONS

#: Moves of one entity that are folded together.
BLOCK = 500
#: The status of a new entity, by kind.
INITIAL = {"session": "active", "study": "active", "hypothesis": "unverified", "task": "open", "issue": "open", "research": "open"}
#: What `reopen` leads back from, and to.
REOPENED = {"session": (["wrapped_up", "abandoned"], "active"), "issue": (["done", "abandoned"], "open"), "task": (["done"], "open")}
SEPARATOR = "\u001f"


def _allowed() -> Column:
    """kind, how, before and after of every move that a machine allows, as one text each."""
    known = [(kind, "transition", before, after) for kind, before, afters in TRANSITIONS for after in afters]
    known += [(kind, "reopen", before, after) for kind, (befores, after) in REOPENED.items() for before in befores]
    return F.array(*(F.lit(SEPARATOR.join(k)) for k in known))


def _statuses() -> Column:
    """Kind to all statuses that its machine knows."""
    pairs = []
    for kind, first in INITIAL.items():
        names = {first} | {s for k, before, afters in TRANSITIONS if k == kind for s in (before, *afters)}
        pairs += [F.lit(kind), F.array(*(F.lit(n) for n in sorted(names)))]
    return F.create_map(*pairs)


def _step(kind: Column, status: Column, move: Column) -> Column:
    wanted = F.concat_ws(SEPARATOR, kind, move["how"], status, move["to"])
    return F.array_contains(_allowed(), wanted)


def _placed(log: DataFrame) -> DataFrame:
    """Operations of entities that exist, with their place `at`."""
    at = F.struct("ts", "file", "line")
    one = Window.partitionBy("entity", "id")
    known = log.where(F.col("entity").isin(*INITIAL)).withColumn("at", at)
    alive = known.withColumn("gone", F.max(F.when(F.col("op") == "delete", F.col("at"))).over(one)).where(F.col("gone").isNull() | (F.col("at") > F.col("gone")))
    born = alive.withColumn("born", F.min(F.when(F.col("op") == "create", F.col("at"))).over(one))
    return born.where(F.col("at") >= F.col("born"))


def moves(log: DataFrame) -> DataFrame:
    """(entity, id, at, how, before, to, accepted, data) of every move of entities that exist."""
    told = F.get_json_object("data", "$.to")
    back = reduce(lambda a, kind: a.when(F.col("entity") == kind, REOPENED[kind][1]), REOPENED, F.when(F.lit(False), ""))
    asked = _placed(log).where(F.col("op").isin("transition", "reopen"))
    asked = asked.select("entity", "id", "at", F.col("op").alias("how"), F.coalesce(F.when(F.col("op") == "reopen", back).otherwise(told), F.lit("")).alias("to"), "data")
    nth = F.row_number().over(Window.partitionBy("entity", "id").orderBy("at")) - 1
    blocked = asked.withColumn("block", F.floor(nth / BLOCK))
    grouped = blocked.groupBy("entity", "id", "block").agg(F.sort_array(F.collect_list(F.struct("at", "how", "to", "data"))).alias("moves"))

    def through(start: Column) -> Column:
        return F.aggregate("moves", start, lambda s, m: F.when(_step(F.col("entity"), s, m), m["to"]).otherwise(s))

    known = F.element_at(_statuses(), F.col("entity"))
    leads = F.map_from_arrays(known, F.transform(known, through))
    ends = grouped.select("entity", "id", "block", leads.alias("leads"))
    chain = ends.groupBy("entity", "id").agg(F.sort_array(F.collect_list(F.struct("block", F.map_entries("leads").alias("leads")))).alias("all"))
    first = F.element_at(F.create_map(*(F.lit(x) for pair in INITIAL.items() for x in pair)), F.col("entity"))
    begin = F.aggregate(
        "all",
        F.array(F.struct(F.lit(-1).cast("long").alias("block"), first.alias("status"))),
        lambda done, b: F.concat(done, F.array(F.struct(b["block"].alias("block"), F.element_at(F.map_from_entries(b["leads"]), F.element_at(done, -1)["status"]).alias("status")))),
    )
    starts = chain.select("entity", "id", F.explode(begin).alias("s")).select("entity", "id", (F.col("s.block") + 1).alias("block"), F.col("s.status").alias("start"))
    empty = F.array().cast("array<struct<before:string,accepted:boolean>>")
    gone_through = F.aggregate(
        "moves",
        F.struct(F.col("start").alias("status"), empty.alias("told")),
        lambda a, m: F.struct(
            F.when(_step(F.col("entity"), a["status"], m), m["to"]).otherwise(a["status"]).alias("status"),
            F.concat(a["told"], F.array(F.struct(a["status"].alias("before"), _step(F.col("entity"), a["status"], m).alias("accepted")))).alias("told"),
        ),
    )
    judged = grouped.join(starts, ["entity", "id", "block"]).select("entity", "id", F.explode(F.arrays_zip("moves", gone_through["told"].alias("told"))).alias("z"))
    return judged.select("entity", "id", "z.moves.at", "z.moves.how", "z.told.before", "z.moves.to", "z.told.accepted", "z.moves.data")


def life_cycles(log: DataFrame) -> DataFrame:
    """(entity, id, status, started_at, ended_at, summary, reason, updated_at, accepted, refused) of every entity that exists."""
    born = _placed(log).groupBy("entity", "id").agg(F.min(F.when(F.col("op") == "create", F.col("at"))).alias("born"))
    made = moves(log)
    last = F.max_by(F.struct("at", "how", "to", "data"), F.when(F.col("accepted"), F.col("at")))
    told = made.groupBy("entity", "id").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("refused"), last.alias("last"))
    first = F.element_at(F.create_map(*(F.lit(x) for pair in INITIAL.items() for x in pair)), F.col("entity"))
    joined = born.join(told, ["entity", "id"], "left")
    session, given = F.col("entity") == "session", F.get_json_object("last.data", "$.ended_at")
    zero = F.lit(0).cast("long")
    return joined.select(
        "entity", "id", F.when(F.coalesce("accepted", zero) > 0, F.col("last.to")).otherwise(first).alias("status"), F.col("born.ts").alias("started_at"),
        F.when(session & (F.col("accepted") > 0) & (F.col("last.how") == "transition"), F.coalesce(given, F.col("last.at.ts"))).alias("ended_at"),
        F.when(session & (F.col("accepted") > 0), F.get_json_object("last.data", "$.summary")).alias("summary"),
        F.when((F.col("entity") == "hypothesis") & (F.col("accepted") > 0), F.get_json_object("last.data", "$.reason")).alias("reason"),
        F.when(~session & (F.col("accepted") > 0), F.col("last.at.ts")).alias("updated_at"),
        F.coalesce("accepted", zero).alias("accepted"), F.coalesce("refused", zero).alias("refused"),
    )


def refused(log: DataFrame) -> DataFrame:
    """(entity, id, ts, file, line, before, to) of the moves that no machine allows."""
    return moves(log).where("NOT accepted").select("entity", "id", "at.ts", "at.file", "at.line", "before", "to")
