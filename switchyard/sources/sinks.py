"""Sinks: metric trees as JSON, cross-tabs as CSV, long tables as parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_metrics_json(metrics: DataFrame, path: str) -> None:
    """A one-row frame of nested structs written as JSON (one file)."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def read_metrics_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def write_crosstab_csv(wide: DataFrame, path: str) -> None:
    """Wide cross-tab (a handful of rows) with a header line."""
    wide.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_long_parquet(long_df: DataFrame, path: str, partition_by: str | None = None) -> None:
    w = long_df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
