"""Connected components of an edge table by alternating large and small stars, without gathering a group anywhere.

Each round replaces edges by edges to the smallest neighbour; minima are aggregated before they are shuffled and
joined back, so a node with very many neighbours is dealt with by skew-splitting joins, or by broadcast if edges are few. Rounds end
when the edges are stars, which is seen from how often each node is on either side, and each is cut from its lineage by a table
in the shared folder. The driver remembers the tasks of each of Spark's stages, so rounds take few stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.llm.common import discard, materialise

#: Edges up to which the smallest neighbours, at most one for each end, are broadcast.
FEW_EDGES = 100_000


def _downward(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def _large_star(edges: DataFrame, held: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """As many edges as before at most, some of them twice."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(held(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, held: Callable[[DataFrame], DataFrame]) -> DataFrame:
    down = _downward(edges)
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    ends = F.explode(F.array("v", "u")).alias("u")
    return down.join(held(least), "u").select(ends, F.col("m").alias("v")).where("u <> v").distinct()


def _are_stars(edges: DataFrame) -> tuple[int, bool]:
    """The number of edges, and whether each u has one v, which is nobody's u."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
    nodes = edges.select(ends.alias("e")).groupBy("e.node").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
    row = nodes.agg(F.coalesce(F.sum("up"), F.lit(0)).alias("n"), F.max((F.col("up") + F.col("down") > 1) & (F.col("up") > 0)).alias("other")).head()
    return row.n, not row.other


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root): for every node of an edge (u, v) the smallest node that it is linked to; node = root is left out."""
    current = materialise(_downward(edges.select("u", "v")).distinct(), label)
    number, done = _are_stars(current)
    while not done:
        last = current
        held = F.broadcast if number <= FEW_EDGES else (lambda least: least)
        current = materialise(_small_star(_large_star(last, held), held), label)
        discard(last)
        number, done = _are_stars(current)
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
