"""Operation logs whose lines are of several schema versions.

A registry has the required fields of each version and, from each version to the next, an upgrade: a function of a line's data (a map column) that
gives the data as the next version has it. Upgrades are column expressions, chained from a line's own version up to the newest, so that a log of any
mixture is brought up to date within the scan. Lines of unknown versions, and lines that lack what their version requires, are set apart with the reason.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def renamed(old: str, new: str) -> Callable[[Column], Column]:
    """A field under another name; a line that has only the new one keeps it."""

    def step(data: Column) -> Column:
        rest = F.map_filter(data, lambda k, _: k != old)
        held = F.map_contains_key(data, old) & ~F.map_contains_key(data, new)
        return F.when(held, F.map_concat(rest, F.create_map(F.lit(new), data[old]))).otherwise(rest)

    return step


def defaulted(name: str, value: str) -> Callable[[Column], Column]:
    """A field that older lines don't have."""
    return lambda data: F.when(F.map_contains_key(data, name), data).otherwise(F.map_concat(data, F.create_map(F.lit(name), F.lit(value))))


def computed(name: str, value: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A field whose new value follows from the data; a line without the field is left alone."""

    def step(data: Column) -> Column:
        rest = F.map_filter(data, lambda k, _: k != name)
        return F.when(F.map_contains_key(data, name), F.map_concat(rest, F.create_map(F.lit(name), value(data).cast("string")))).otherwise(data)

    return step


def dropped(name: str) -> Callable[[Column], Column]:
    return lambda data: F.map_filter(data, lambda k, _: k != name)


@dataclass
class Registry:
    """required: by version, the fields that its lines need for an operation of kind `create`. upgrades: by version, the steps to the next one."""

    required: dict[int, list[str]] = field(default_factory=dict)
    upgrades: dict[int, list[Callable[[Column], Column]]] = field(default_factory=dict)

    def __post_init__(self):
        versions = sorted(self.required)
        if versions != list(range(versions[0], versions[-1] + 1)) or sorted(self.upgrades) != versions[:-1]:
            raise ValueError("versions must follow one another, each but the last with its upgrade")

    @property
    def newest(self) -> int:
        return max(self.required)


def upgrade(log: DataFrame, registry: Registry) -> tuple[DataFrame, DataFrame]:
    """(operations of the newest version, lines set apart with `reason`). log: v (null means 1), op, data as JSON text, and other columns,
    which stay."""
    known = log.withColumn("v", F.coalesce("v", F.lit(1))).withColumn("_data_", F.from_json("data", "map<string,string>"))
    unknown = ~F.col("v").isin(*registry.required)
    lacking = F.lit(None).cast("string")
    for version, names in registry.required.items():
        missing = F.array_join(F.filter(F.array(*map(F.lit, names)), lambda n: ~F.coalesce(F.map_contains_key("_data_", n), F.lit(False))), ",") if names else F.lit("")
        lacking = F.when((F.col("v") == version) & (F.col("op") == "create") & (missing != ""), F.concat(F.lit("missing "), missing)).otherwise(lacking)
    reason = F.when(unknown, F.concat(F.lit("unknown version "), F.col("v").cast("string"))).when(F.col("data").isNotNull() & F.col("_data_").isNull(), "not an object").otherwise(lacking)
    judged = known.withColumn("reason", reason)
    good = judged.where("reason IS NULL").drop("reason")
    for version in sorted(registry.upgrades):
        # a column of its own for each version: what an upgrade reads is worked out once
        data = F.col("_data_")
        for number, step in enumerate(registry.upgrades[version]):
            good = good.withColumn("_data_", F.when((F.col("v") <= version) & data.isNotNull(), step(data)).otherwise(data))
    done = good.withColumn("data", F.to_json("_data_", {"ignoreNullFields": "false"})).withColumn("v", F.lit(registry.newest)).drop("_data_")
    return done, judged.where("reason IS NOT NULL").drop("_data_")
