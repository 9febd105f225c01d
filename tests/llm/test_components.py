import random

import pytest
from pyspark.sql import functions as F

from lakewright.llm import components as module


def written(monkeypatch) -> list[str]:
    labels, write = [], module.materialise
    monkeypatch.setattr(module, "materialise", lambda df, label: labels.append(label) or write(df, label))
    return labels


def brute(edges: list[tuple]) -> list[tuple]:
    root = {x: x for edge in edges for x in edge}
    for _ in root:
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    return sorted((x, r) for x, r in root.items() if x != r)


@pytest.mark.parametrize("few", [0, 100_000])
def test_against_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(module, "FEW_EDGES", few)
    draw = random.Random(5)
    path = list(range(200, 240))
    draw.shuffle(path)
    edges = [*zip(path, path[1:], strict=False), *((300, x) for x in range(301, 360)), *((draw.randrange(150), draw.randrange(150)) for _ in range(110)), (7, 7), (301, 300)]
    found = module.components(spark.createDataFrame(edges, "u long, v long"), "test")
    assert sorted(map(tuple, found.collect())) == brute(edges)


def test_missing_ids(spark):
    edges = spark.createDataFrame([(3, None), (None, 5), (9, 8)], "a int, b int")
    place = lambda c: F.struct(F.col(c).isNull().alias("nameless"), F.col(c).alias("doc_id"))
    found = module.components(edges.select(place("a").alias("u"), place("b").alias("v")), "test")
    assert sorted((str(r.node.doc_id), r.root.doc_id) for r in found.collect()) == [("5", 3), ("9", 8), ("None", 3)]


@pytest.mark.parametrize("few", [0, 100_000])
def test_few_tables_and_few_shuffles(spark, monkeypatch, few):
    """The driver remembers the tasks of its last stages, so stars need no round and a round few shuffles."""
    monkeypatch.setattr(module, "FEW_EDGES", few)
    labels, plans = written(monkeypatch), []
    stars = spark.range(1, 400).select(F.col("id").alias("u"), F.pmod("id", F.lit(7)).alias("v")).where("u >= 7")
    assert module.components(stars, "test").count() == 393
    assert len(labels) == 1
    write = module.materialise
    monkeypatch.setattr(module, "materialise", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, label))
    assert module.components(spark.range(8).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")), "test").count() == 8
    assert max(plan.count("Exchange hashpartitioning") for plan in plans) <= (4 if few else 6)  # one is in the plan twice and is used again
    assert not module.components(stars.limit(0), "test").take(1)
