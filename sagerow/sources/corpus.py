"""Raw web-document sources and corpus sinks (SRC-5, SNK-3, SCA-11).

Raw documents are JSON lines (zstd) whose ``text`` is a string or a list of
paragraphs, with ``meta.lang``. The union type is resolved per row from the
parsed JSON, never by guessing from a leading ``[``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARA_JOINER = "\n\n"


def write_raw_docs(
    docs: DataFrame, path: str, paragraph_rows: Column | None = None, compression: str = "gzip"
) -> None:
    """(doc_id, text, lang) → compressed JSON-line records ``{doc_id, text, meta:{lang}}``;
    rows matching ``paragraph_rows`` store ``text`` as a paragraph list.
    (This Hadoop build cannot write zstd; ``read_raw_docs`` reads
    ``*.jsonl.zst`` produced elsewhere.)"""
    as_list = F.split(F.col("text"), PARA_JOINER, -1)
    rec = F.to_json(
        F.struct(
            F.col("doc_id"),
            F.col("text").alias("text"),
            F.struct(F.col("lang")).alias("meta"),
        )
    )
    rec_list = F.to_json(
        F.struct(F.col("doc_id"), as_list.alias("text"), F.struct(F.col("lang")).alias("meta"))
    )
    line = F.when(paragraph_rows, rec_list).otherwise(rec) if paragraph_rows is not None else rec
    docs.select(line.alias("value")).write.mode("overwrite").option("compression", compression).text(path)


def resolve_text(v: Column, joiner: str = PARA_JOINER) -> Column:
    """``text`` as string, or its paragraphs joined by ``joiner`` (SCA-11)."""
    return F.coalesce(
        F.array_join(F.try_variant_get(v, "$.text", "array<string>"), joiner),
        F.try_variant_get(v, "$.text", "string"),
    )


def read_raw_docs(spark: SparkSession, path: str, joiner: str = PARA_JOINER) -> DataFrame:
    """(doc_id, text, lang, file) from JSONL(.zst) files. An empty match is
    an error (Spark raises on a path with no files)."""
    raw = spark.read.text(path)
    v = F.parse_json(F.col("value"))
    return raw.select(
        F.try_variant_get(v, "$.doc_id", "bigint").alias("doc_id"),
        resolve_text(v, joiner).alias("text"),
        F.try_variant_get(v, "$.meta.lang", "string").alias("lang"),
        F.col("_metadata.file_path").alias("file"),
    )


def write_splits(df: DataFrame, path: str, order: str, shards: int, files: int = 1) -> None:
    """Val file + train shards as JSON lines, one folder per (split, shard) with ``files`` files each (SNK-3).

    ``order`` is the shuffled position. A shard's rows are cut into ``files``
    ranges of it, each sorted and written by one task, and file names sort
    like the ranges: read by name, a shard comes back in shuffled order. The
    validation split is one shard. Ranges without rows have no file."""
    total = df.groupBy("split").agg((F.max(order) + 1).alias("_end"), F.min(order).alias("_start"))
    ranged = df.join(F.broadcast(total), "split")  # a row a split
    part = F.floor((F.col(order) - F.col("_start")) * files / (F.col("_end") - F.col("_start")))
    folder = F.when(F.col("split") == "val", F.lit(shards)).otherwise(F.col("shard"))
    ranged = ranged.withColumn("_file", (folder * files + part).cast("int")).drop("_start", "_end")
    dealt = ranged.repartitionById((shards + 1) * files, F.col("_file")).sortWithinPartitions(order)
    dealt.drop("_file", order).write.mode("overwrite").partitionBy("split", "shard").json(path)


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id bigint, text string, split string, shard int").json(path).select(
        "doc_id", "text", "split", "shard"
    )
