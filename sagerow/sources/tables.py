"""Reading the driver tables (parquet, one file or folder per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table_path(d: str, name: str) -> str:
    return f"{d.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """Parquet scan; Catalyst prunes columns and pushes filters into it."""
    return spark.read.parquet(table_path(d, name))
