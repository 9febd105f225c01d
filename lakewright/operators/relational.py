"""Relational building blocks: scopes, deduplication, upserts, progress counts, period metrics.

All are DataFrame to DataFrame and stay inside built-in expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_LIMIT = 20
PERIOD_DAYS = {"1d": 1, "7d": 7, "30d": 30}


def all_of(**wanted: object) -> Column:
    """Equality with every value that is not None; true if none is given."""
    return reduce(lambda a, b: a & b, (F.col(name) == value for name, value in wanted.items() if value is not None), F.lit(True))


def limit_or_default(limit: int | None, overall: int | None = None, fallback: int = DEFAULT_LIMIT) -> int:
    """The first of limit, overall and fallback that is a positive number."""
    return limit or overall or fallback


def filter_list(rows: DataFrame, where: Column, order: list[Column], limit: int | None = None, *, overfetch: bool = False) -> DataFrame:
    """Filter, sort, limit. With overfetch the newest min(5 * limit, 500) rows are taken before the filter."""
    n = limit_or_default(limit)
    if overfetch:
        return rows.orderBy(*order).limit(min(5 * n, 500)).where(where).orderBy(*order).limit(n)
    return rows.where(where).orderBy(*order).limit(n)


def org_scope(org: str | None, column: str = "org_id") -> Column:
    """Rows of the organisation and unowned ones; without an organisation only unowned ones."""
    unowned = F.col(column).isNull()
    return unowned if org is None else unowned | (F.col(column) == org)


def visible(owner: str | None = None, org: str | None = None, *, visibility: str = "visibility", org_column: str = "org_id", owner_column: str = "owner_sub") -> Column:
    """Public rows, the organisation's team rows and the owner's private rows."""
    scope = F.col(visibility) == "public"
    if org is not None:
        scope = scope | ((F.col(visibility) == "team") & (F.col(org_column) == org))
    if owner is not None:
        scope = scope | ((F.col(visibility) == "private") & (F.col(owner_column) == owner))
    return F.coalesce(scope, F.lit(False))


def symmetric_pair(a: str, b: str, x: object, y: object) -> Column:
    """Whether {a, b} = {x, y}, without an OR."""
    return (F.least(a, b) == F.least(F.lit(x), F.lit(y))) & (F.greatest(a, b) == F.greatest(F.lit(x), F.lit(y)))


def latest_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    ranked = rows.withColumn("_rank_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank_ = 1").drop("_rank_")


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Incoming rows replace stored rows of the same key. Of incoming rows of one key the last in `order` wins; without an
    order, the greatest by the other columns from left to right, so the result never depends on how rows are dealt."""
    rest = [F.struct(*(F.to_json(F.struct(c)) for c in incoming.columns if c not in keys)).alias("rest")] if len(incoming.columns) > len(keys) else []
    place = F.struct(*order) if order else F.struct(F.lit(0).alias("none"))
    last = incoming.select("*", F.struct(place.alias("place"), *rest).alias("_place_"))
    newest = latest_per_key(last, keys, [F.desc("_place_")]).drop("_place_")
    return stored.join(newest.select(*keys), keys, "left_anti").select(stored.columns).unionByName(newest, allowMissingColumns=True)


def append_new(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or ignore: incoming rows whose key is not stored yet, one for each key."""
    return incoming.join(stored.select(*keys), keys, "left_anti").dropDuplicates(keys)


def progress(rows: DataFrame, keys: list[str], status: str, done: str, running: str, waiting: str, blocked: str | None = None) -> DataFrame:
    """Counts of all rows and of each status."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if(F.col(status) == done).alias("done"),
        F.count_if(F.col(status) == running).alias("in_progress"),
        F.count_if(F.col(status) == waiting).alias("open"),
        (F.count_if(F.col(status) == blocked) if blocked else F.lit(0).cast("long")).alias("blocked"),
    )


def success_rate(done: Column, total: Column, when_none: float = 0.0) -> Column:
    """Percentage, or when_none if there is nothing."""
    return F.when(total > 0, done * 100.0 / total).otherwise(F.lit(when_none))


def lower_rank_percentile(values: str, share: float) -> Column:
    """The value at floor((n - 1) * share) of the sorted values; null for none.

    An exact rank needs all of a group's values at one place. Groups are aggregated to (value, count) pairs by
    ranked_percentiles for large inputs; this form is for groups of bounded size.
    """
    ordered = F.sort_array(F.collect_list(values))
    return F.when(F.size(ordered) > 0, F.element_at(ordered, (F.floor((F.size(ordered) - 1) * F.lit(share)) + 1).cast("int")))


def ranked_percentiles(rows: DataFrame, keys: list[str], values: str, shares: dict[str, float], *, bins: int = 1024) -> DataFrame:
    """Lower nearest ranks of groups of any size. A group's range is cut into bins of equal width and counted; the running
    count over its bins tells which bin holds each rank, and only that bin's distinct values are ranked. So no task
    sorts a group, however few groups there are."""
    known = rows.where(F.col(values).isNotNull()).select(*keys, F.col(values).alias("_v_"))
    ends = known.groupBy(*keys).agg(F.min("_v_").cast("double").alias("_low_"), F.max("_v_").cast("double").alias("_high_"), F.count("*").alias("_all_"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    met = lambda left, right, how="inner": left.alias("a").join(right.alias("b"), same, how) if keys else left.alias("a").crossJoin(F.broadcast(right).alias("b"))
    width = F.col("b._high_") - F.col("b._low_")
    cell = F.when(width > 0, F.least(F.floor((F.col("a._v_").cast("double") - F.col("b._low_")) / width * bins), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    placed = met(known, ends).select(*(F.col(f"a.{k}").alias(k) for k in keys), "a._v_", "b._all_", cell.alias("_bin_"))
    counted = placed.groupBy(*keys, "_all_", "_bin_").agg(F.count("*").alias("_n_"))
    order = Window.partitionBy(*keys).orderBy("_bin_").rowsBetween(Window.unboundedPreceding, 0)
    upto = counted.withColumn("_upto_", F.sum("_n_").over(order))
    rank = {name: F.floor((F.col("_all_") - 1) * F.lit(share)) for name, share in shares.items()}
    wanted = F.array_compact(F.array(*(F.when((r >= F.col("_upto_") - F.col("_n_")) & (r < F.col("_upto_")), F.struct(F.lit(name).alias("name"), (r - F.col("_upto_") + F.col("_n_")).alias("rest"))) for name, r in rank.items())))
    picked = upto.withColumn("_wanted_", wanted).where(F.size("_wanted_") > 0).select(*keys, "_bin_", "_wanted_")
    both = [*same, F.col("a._bin_") == F.col("b._bin_")]
    inside = placed.alias("a").join(picked.alias("b"), both).select(*(F.col(f"a.{k}").alias(k) for k in keys), "a._bin_", "_v_", "_wanted_")
    distinct = inside.groupBy(*keys, "_bin_", "_v_", "_wanted_").agg(F.count("*").alias("_n_"))
    running = distinct.withColumn("_upto_", F.sum("_n_").over(Window.partitionBy(*keys, "_bin_").orderBy("_v_").rowsBetween(Window.unboundedPreceding, 0)))
    found = running.select(*keys, "_v_", "_upto_", F.explode("_wanted_").alias("w")).where("_upto_ > w.rest")
    return found.groupBy(*keys).agg(*(F.min(F.when(F.col("w.name") == name, F.col("_v_"))).alias(name) for name in shares))


def period_start(now: Column, period: str) -> Column:
    """The beginning of the last 1d, 7d or 30d."""
    if period not in PERIOD_DAYS:
        raise ValueError(f"period must be one of {', '.join(PERIOD_DAYS)}")
    return now - F.make_dt_interval(F.lit(PERIOD_DAYS[period]))


def semver_key(version: Column) -> Column:
    """Sorts versions: those that parse by number, releases over their prereleases, above those that don't parse."""
    pattern = r"^v?(\d{1,9})\.(\d{1,9})\.(\d{1,9})(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$"
    parses = version.rlike(pattern)
    number = [F.when(parses, F.regexp_extract(version, pattern, k).cast("long")) for k in (1, 2, 3)]
    pre = F.regexp_extract(version, pattern, 4)
    return F.struct(parses.alias("parses"), number[0].alias("major"), number[1].alias("minor"), number[2].alias("patch"), (pre == "").alias("release"), F.when(parses, pre).otherwise(version).alias("rest"))


def stable_id(*parts: str | Column, length: int = 16) -> Column:
    """Hex digits of an md5 over colon-joined parts; null parts count as empty, and an id that is given may stand."""
    texts = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.substring(F.md5(F.concat_ws(":", *texts)), 1, length)


def timeline(*channels: tuple[str, DataFrame]) -> DataFrame:
    """Channels of (created_at, ref, action) as one, by time, then channel, then ref."""
    parts = [rows.select(F.lit(name).alias("source"), "created_at", "ref", "action") for name, rows in channels]
    return reduce(DataFrame.unionByName, parts).orderBy("created_at", "source", "ref")


def allowed_moves(moves: DataFrame, allowed: DataFrame) -> DataFrame:
    """Adds `permitted`: whether (machine, before, after) is a transition of its state machine."""
    known = allowed.select("machine", "before", "after").distinct().withColumn("permitted", F.lit(True))
    return moves.join(F.broadcast(known), ["machine", "before", "after"], "left").withColumn("permitted", F.coalesce("permitted", F.lit(False)))


def sanitize_segment(text: Column, cap: int = 128) -> Column:
    """A path segment: other signs than letters, digits, dot, underscore and hyphen become one underscore, trimmed and cut."""
    cut = F.substring(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", ""), 1, cap)
    return F.when(F.coalesce(cut, F.lit("")) == "", F.lit("_")).otherwise(cut)


def snapshot_key(*parts: Column) -> Column:
    """dls- and the parts in lower-case hex, joined by hyphens."""
    return F.concat(F.lit("dls-"), F.concat_ws("-", *(F.lower(F.hex(p.cast("binary"))) for p in parts)))


def normalise_locator(path: Column) -> Column:
    """A dataset path without query and fragment: `db#t` becomes db/t.lance, `x.lance?v#t` becomes x.lance."""
    base = F.regexp_replace(F.substring_index(F.substring_index(path, "#", 1), "?", 1), "/+$", "")
    name = F.when(F.instr(path, "#") > 0, F.regexp_extract(path, "#(.*)$", 1)).otherwise(F.lit(""))
    return F.when(base.endswith(".lance") | (name == ""), base).otherwise(F.concat(base, F.lit("/"), name, F.lit(".lance")))


def freshness(expires: Column, now: Column) -> Column:
    """Fresh, stale or miss of a cache entry."""
    return F.when(expires.isNull(), "miss").when(expires > now, "fresh").otherwise("stale")
