"""Readers for the flat Parquet tables that the queries run over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` below `sf_dir`, through Spark's own reader (any file system Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
