"""Prefix files (SRC-8): ``nonbreaking_prefix.<language>``, one prefix a line."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FALLBACK = "en"


def write_prefixes(table: DataFrame, folder: str, lang: str) -> None:
    """Write (prefix, kind) rows as a prefix file; kind 2 is marked as numeric only."""
    line = F.when(F.col("kind") == 2, F.concat("prefix", F.lit(" #NUMERIC_ONLY#"))).otherwise(F.col("prefix"))
    table.select(line.alias("value")).write.text(f"{folder.rstrip('/')}/nonbreaking_prefix.{lang}")


def read_prefixes(spark: SparkSession, folder: str, lang: str) -> DataFrame:
    """(lang, prefix, kind) of a language; one without a file takes the English one.

    Blank lines and ``#`` comments are skipped, a trailing ``#NUMERIC_ONLY#``
    makes kind 2, anything else is kind 1; of a prefix given twice the last
    kind is not defined by a distributed read, so the larger one holds."""
    try:
        lines = spark.read.text(f"{folder.rstrip('/')}/nonbreaking_prefix.{lang}")
    except AnalysisException:
        if lang == FALLBACK:
            raise
        return read_prefixes(spark, folder, FALLBACK).withColumn("lang", F.lit(lang))
    used = lines.filter((F.col("value") != "") & ~F.col("value").startswith("#"))
    numeric = F.col("value").rlike(r"\s#NUMERIC_ONLY#")
    prefix = F.when(numeric, F.regexp_extract("value", r"^(.*)\s+#NUMERIC_ONLY#", 1)).otherwise(F.col("value"))
    rows = used.select(F.rtrim(prefix).alias("prefix"), F.when(numeric, 2).otherwise(1).alias("kind"))
    return rows.groupBy("prefix").agg(F.max("kind").alias("kind")).select(F.lit(lang).alias("lang"), "prefix", "kind")
