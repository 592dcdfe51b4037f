"""Readers of the driver's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The table ``name`` under ``base``, read by Spark alone, so that any Hadoop path will do."""
    return spark.read.parquet(f"{base}/{name}.parquet")
