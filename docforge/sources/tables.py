"""Reading of the tables a query names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The whole parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
