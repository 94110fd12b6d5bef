"""Table readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One Parquet table below ``base``; only Spark's reader touches the path, so any Hadoop store works."""
    return spark.read.parquet(f"{base}/{name}.parquet")
