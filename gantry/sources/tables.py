"""Readers of the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the input folder; all tables are Parquet with a known schema in the footer."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
