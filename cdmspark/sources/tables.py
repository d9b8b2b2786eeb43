"""Scan of the driver's Parquet tables (S5, S6): explicit columns keep the scan pruned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import small_methods

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table scan; with ``columns`` only those reach the Parquet reader."""
    small_methods(spark)
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df
