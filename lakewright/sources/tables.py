"""Readers for the Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Table `name` of `folder`; naming columns narrows the scan's read schema."""
    frame = spark.read.parquet(f"{folder}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def memory_lake(spark: SparkSession, frames: dict[str, DataFrame]) -> None:
    """Names frames as temporary views, so that SQL can ask them without anything being written."""
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)
