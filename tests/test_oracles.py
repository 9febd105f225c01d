"""Every engine query against its DuckDB equivalent on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from lakewright.plans.catalogue import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    return connection


def plain(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value) or value is pd.NA:
        return "null"
    if isinstance(value, float):
        return f"{value:.6g}"
    return str(pd.Timestamp(value)) if hasattr(value, "year") else str(value)


def rows(frame):
    ordered = frame.reindex(sorted(frame.columns), axis=1)
    return sorted(tuple(map(plain, row)) for row in ordered.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    mine, theirs = QUERIES[name](spark, FOLDER).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, FOLDER).limit(5).count() == 5


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
