"""Graph operators on edge tables (src, dst). Iterations cut their lineage with tables in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.session import ensure_checkpoint_dir

#: The default bound of nodes for betweenness, as its adjacency goes to every task.
CENTRALITY_NODES = 1000


def cut(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def node(kind: Column, key: Column) -> Column:
    """kind:key, the label of a typed node."""
    return F.concat_ws(":", kind.cast("string"), key.cast("string"))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree), parallel edges counted."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def ready_set(edges: DataFrame) -> DataFrame:
    """Nodes that no edge leads to."""
    return nodes(edges).join(edges.select(F.col("dst").alias("node")), "node", "left_anti")


def bfs(edges: DataFrame, start: DataFrame, max_depth: int) -> DataFrame:
    """(node, depth): what is reached from the start nodes within max_depth steps, at its smallest depth. A step writes its
    frontier only; what was reached before is read from the frontiers so far."""
    links = edges.select("src", "dst").distinct()
    frontier = cut(start.select("node").distinct().withColumn("depth", F.lit(0)), "bfs")
    reached = frontier
    for depth in range(1, max_depth + 1):
        found = frontier.join(links, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = cut(found.join(reached, "node", "left_anti").withColumn("depth", F.lit(depth)), "bfs")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def shortest_path(edges: DataFrame, source: str, target: str, max_depth: int = 50) -> list[str] | None:
    """The lexicographically smallest of the shortest directed paths, or None.

    Levels are found backwards from the target; only nodes on the walk come to the driver, one a step.
    """
    spark = edges.sparkSession
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    levels = bfs(back, spark.range(1).select(F.lit(target).alias("node")), max_depth)
    at = levels.where(F.col("node") == source).head()
    if at is None:
        return None
    path, left = [source], at.depth
    while left:
        step = edges.where(F.col("src") == path[-1]).join(levels.where(F.col("depth") == left - 1), F.col("dst") == F.col("node"))
        path.append(step.agg(F.min("dst").alias("dst")).head().dst)
        left -= 1
    return path


def topological_levels(edges: DataFrame) -> DataFrame | None:
    """(node, level): level 0 depends on nothing, level n on something of level n - 1; None if there is a cycle."""
    links = cut(edges.select("src", "dst").distinct(), "topo")
    left = cut(nodes(links), "topo")
    done, level = None, 0
    while not left.isEmpty():
        free = left.join(links.select(F.col("dst").alias("node")), "node", "left_anti")
        found = cut(free.withColumn("level", F.lit(level)), "topo")
        if found.isEmpty():
            return None
        done = found if done is None else done.unionByName(found)
        left = cut(left.join(found, "node", "left_anti"), "topo")
        links = cut(links.join(found, links.src == found.node, "left_anti"), "topo")
        level += 1
    return done


def has_cycle(edges: DataFrame) -> bool:
    return not edges.isEmpty() and topological_levels(edges) is None


def weak_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest label that is reachable either way, by labels that jump."""
    both = cut(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "links")
    labels = cut(nodes(edges).withColumn("component", F.col("node")), "labels")
    while True:
        near = both.join(labels, F.col("dst") == F.col("node")).groupBy("src").agg(F.min("component").alias("least"))
        lowered = labels.join(near, F.col("node") == F.col("src"), "left").select("node", "component", F.least("component", "least").alias("new"))
        jump = lowered.select(F.col("node").alias("to"), F.col("new").alias("beyond"))
        joined = lowered.join(jump, F.col("new") == F.col("to"), "left")
        step = cut(joined.select("node", F.col("component").alias("old"), F.least("new", "beyond").alias("component")), "labels")
        labels_next = step.select("node", "component")
        if step.where("old <> component").isEmpty():
            return labels_next
        labels = labels_next


def analyse(edges: DataFrame, max_nodes: int = CENTRALITY_NODES) -> tuple[DataFrame, DataFrame | None]:
    """One row (nodes, edges, components, cyclic, centrality_skipped), and the betweenness, or None where it was skipped
    because the graph has more than max_nodes nodes."""
    sizes = edges.agg(F.count("*").alias("edges")).crossJoin(nodes(edges).agg(F.count("*").alias("nodes")))
    parts = weak_components(edges).agg(F.count_distinct("component").alias("components"))
    skipped = nodes(edges).limit(max_nodes + 1).count() > max_nodes
    row = sizes.crossJoin(parts).select("nodes", "edges", "components", F.lit(has_cycle(edges)).alias("cyclic"), F.lit(skipped).alias("centrality_skipped"))
    return row, None if skipped else betweenness(edges, max_nodes)


def dependency_tree(edges: DataFrame, root: str, max_depth: int = 50) -> DataFrame:
    """(node, parent, depth): what root depends on, each node once, below its smallest parent among those one step nearer."""
    found = bfs(edges, edges.sparkSession.range(1).select(F.lit(root).alias("node")), max_depth)
    nearer = found.select(F.col("node").alias("src"), (F.col("depth") + 1).alias("depth"))
    parents = edges.select("src", F.col("dst").alias("node")).distinct().join(nearer, "src")
    return found.join(parents, ["node", "depth"], "left").groupBy("node", "depth").agg(F.min("src").alias("parent"))


def betweenness(edges: DataFrame, max_nodes: int = CENTRALITY_NODES) -> DataFrame:
    """(node, score): directed, unnormalised, without end points, parallel edges once; best first, ties by label.

    Brandes' accumulation from each source is independent, so sources are spread over tasks; each task holds the
    adjacency, which max_nodes bounds. A larger graph is an error; `analyse` tells beforehand.
    """
    spark = edges.sparkSession
    every = nodes(edges)
    if every.limit(max_nodes + 1).count() > max_nodes:
        raise ValueError(f"betweenness was asked of more than {max_nodes} nodes")
    adjacency = {r.src: sorted(r.out) for r in edges.groupBy("src").agg(F.collect_set("dst").alias("out")).collect()}
    shared = spark.sparkContext.broadcast(adjacency)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sums: dict[str, float] = {}
            for source in frame.node:
                _accumulate(shared.value, source, sums)
            yield pd.DataFrame({"node": list(sums), "part": list(sums.values())})

    parts = every.repartition(max(1, spark.sparkContext.defaultParallelism)).mapInPandas(run, "node string, part double")
    summed = parts.groupBy("node").agg(F.sum("part").alias("part"))
    return every.join(summed, "node", "left").select("node", F.round(F.coalesce("part", F.lit(0.0)), 6).alias("score")).orderBy(F.desc("score"), "node")


def _accumulate(adjacency: dict[str, list[str]], source: str, sums: dict[str, float]) -> None:
    """Adds the pair dependencies of one source (Brandes 2001)."""
    depth, paths, order, parents = {source: 0}, {source: 1.0}, [source], {source: []}
    for at in order:
        for to in adjacency.get(at, ()):
            if to not in depth:
                depth[to], paths[to], parents[to] = depth[at] + 1, 0.0, []
                order.append(to)
            if depth[to] == depth[at] + 1:
                paths[to] += paths[at]
                parents[to].append(at)
    share = dict.fromkeys(order, 0.0)
    for at in reversed(order):
        for parent in parents[at]:
            share[parent] += paths[parent] / paths[at] * (1 + share[at])
        if at != source:
            sums[at] = sums.get(at, 0.0) + share[at]


def budgeted(edges: DataFrame, known: DataFrame, max_nodes: int, max_edges: int) -> tuple[DataFrame, str | None]:
    """The first max_nodes nodes by label and max_edges edges between them; and why it was cut, if it was."""
    kept = known.select("node").distinct().orderBy("node").limit(max_nodes)
    inside = edges.join(kept, F.col("src") == kept.node, "left_semi").join(kept, F.col("dst") == kept.node, "left_semi")
    reason = "node budget" if known.select("node").distinct().count() > max_nodes else "edge budget" if inside.limit(max_edges + 1).count() > max_edges else None
    return inside.orderBy("src", "dst").limit(max_edges), reason


def visible_subgraph(edges: DataFrame, seen: DataFrame) -> DataFrame:
    """Edges both of whose ends are among the seen nodes."""
    ends = seen.select("node")
    return edges.join(ends, F.col("src") == ends.node, "left_semi").join(ends, F.col("dst") == ends.node, "left_semi")


def ready_work(issues: DataFrame, blockers: DataFrame) -> DataFrame:
    """Open issues (id, status) that no open issue blocks; blockers: (id, blocked_by)."""
    open_ids = issues.where("status = 'open'").select(F.col("id").alias("blocked_by"))
    held = blockers.join(open_ids, "blocked_by", "left_semi").select("id")
    return issues.where("status = 'open'").join(held, "id", "left_anti")
