"""Corpus-preparation queries (P1) over ``documents`` and ``orders``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rank as rk
from ..session import checkpoint_root
from ..sources import corpus as sc
from ..sources.tables import read_table
from .registry import query

N_VAL = 100       # validation documents (the reference keeps 100 000 of a web corpus)
N_SHARDS = 8


def english(spark: SparkSession, d: str) -> DataFrame:
    """``lang = 'en'`` first; the predicate is pushed into the parquet scan."""
    return read_table(spark, d, "documents").filter(F.col("lang") == "en")


SPLIT_SQL = f"""
WITH en AS (SELECT doc_id, text FROM documents WHERE lang = 'en'),
r AS (SELECT doc_id, text, row_number() OVER (ORDER BY md5('0:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS shuffle_rank FROM en)
"""


@query(
    "corpus_split",
    "FIL-3 SRT-1 WIN-1 SRT-8 SET-2",
    SPLIT_SQL
    + f"""
SELECT doc_id, CAST(shuffle_rank AS BIGINT) AS shuffle_rank,
       CASE WHEN shuffle_rank < {N_VAL} THEN 'val' ELSE 'train' END AS split,
       CASE WHEN shuffle_rank < {N_VAL} THEN NULL ELSE CAST((shuffle_rank - {N_VAL}) % {N_SHARDS} AS INTEGER) END AS shard
FROM r""",
)
def corpus_split(spark: SparkSession, d: str) -> DataFrame:
    """English docs, seeded shuffle (md5 of ``seed:doc_id``), first N = val,
    the rest round-robin over 8 train shards."""
    s = rk.split_val_train(english(spark, d).select("doc_id"), "doc_id", N_VAL, N_SHARDS, seed=0)
    return s.select("doc_id", "shuffle_rank", "split", "shard")


@query(
    "corpus_split_sizes",
    "SET-2 AGG-8 SRT-8",
    SPLIT_SQL
    + f"""
SELECT CASE WHEN shuffle_rank < {N_VAL} THEN 'val' ELSE 'train' END AS split,
       CASE WHEN shuffle_rank < {N_VAL} THEN NULL ELSE CAST((shuffle_rank - {N_VAL}) % {N_SHARDS} AS INTEGER) END AS shard,
       CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM r GROUP BY 1, 2""",
)
def corpus_split_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Docs and characters per split/shard: disjoint and complete by construction."""
    s = rk.split_val_train(english(spark, d).select("doc_id", "text"), "doc_id", N_VAL, N_SHARDS, seed=0)
    return s.groupBy("split", "shard").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.char_length("text")).cast("bigint").alias("n_chars")
    )


@query(
    "corpus_size",
    "AGG-8 FIL-3",
    """
SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars,
       round(sum(length(text)) / 1073741824.0, 9) AS gib
FROM documents WHERE lang = 'en'""",
)
def corpus_size(spark: SparkSession, d: str) -> DataFrame:
    e = english(spark, d)
    return e.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(F.char_length("text")).cast("bigint").alias("n_chars"),
        F.round(F.sum(F.char_length("text")) / 1073741824.0, 9).alias("gib"),
    )


@query(
    "shuffle_first_n",
    "SRT-2 SRT-1",
    """
SELECT doc_id, lang FROM documents ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100""",
)
def shuffle_first_n(spark: SparkSession, d: str) -> DataFrame:
    """First 100 documents of a seed-42 shuffle: a bounded top-k."""
    return rk.first_n_of_shuffle(read_table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 100, seed=42)


@query(
    "orders_two_key_sort",
    "SRT-5 WIN-1",
    """
SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderdate, o_totalprice DESC, o_orderkey) - 1 AS BIGINT) AS pos
FROM orders""",
)
def orders_two_key_sort(spark: SparkSession, d: str) -> DataFrame:
    """Orders by date ascending then price descending, as dense positions
    (range-partitioned rank, no single-task sort)."""
    o = read_table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    r = rk.global_index(o, ["o_orderdate", F.col("o_totalprice").desc(), "o_orderkey"], out="pos")
    return r.select("o_orderkey", "pos")


@query(
    "round_robin_shards",
    "SRT-7 WIN-1",
    """
SELECT CAST((row_number() OVER (ORDER BY doc_id) - 1) % 4 AS INTEGER) AS worker, doc_id FROM documents""",
)
def round_robin_shards(spark: SparkSession, d: str) -> DataFrame:
    """Strided ``rank mod 4`` worker assignment in document order, no padding."""
    r = rk.global_index(read_table(spark, d, "documents").select("doc_id"), ["doc_id"], out="rank")
    return rk.round_robin(r, "rank", 4).select("worker", "doc_id")


@query(
    "systematic_sample",
    "SRT-9 SRT-1",
    """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('3:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS k FROM documents)
SELECT doc_id FROM r WHERE k % 4 = 1""",
)
def systematic_sample(spark: SparkSession, d: str) -> DataFrame:
    """Every 4th document of a seeded order, from offset 1 (a 25 % sample)."""
    r = rk.seeded_shuffle(read_table(spark, d, "documents").select("doc_id"), "doc_id", seed=3, out="k")
    return rk.systematic_sample(r, "k", 4, 1).select("doc_id")


@query(
    "repeat_epochs",
    "SET-3 SRT-1 WIN-1",
    """
WITH e AS (SELECT doc_id, epoch FROM documents, range(3) t(epoch))
SELECT CAST(epoch AS INTEGER) AS epoch, doc_id,
       CAST(row_number() OVER (ORDER BY epoch, md5(CAST(epoch AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS BIGINT) AS pos
FROM e""",
)
def repeat_epochs(spark: SparkSession, d: str) -> DataFrame:
    """Three passes over the documents, reshuffled per epoch (seed = epoch)."""
    e = rk.repeat_epochs(read_table(spark, d, "documents").select("doc_id"), 3)
    key = F.md5(F.concat(F.col("epoch").cast("string"), F.lit(":"), F.col("doc_id").cast("string")))
    e = e.withColumn("_k", key)
    r = rk.global_index(e, ["epoch", "_k", "doc_id"], out="pos")
    return r.select("epoch", "doc_id", "pos")


@query(
    "jsonl_corpus_roundtrip",
    "SRC-5 SNK-3 SCA-11 FIL-3 SRT-8",
    SPLIT_SQL
    + f"""
SELECT doc_id, text, CASE WHEN shuffle_rank < {N_VAL} THEN 'val' ELSE 'train' END AS split,
       CASE WHEN shuffle_rank < {N_VAL} THEN NULL ELSE CAST((shuffle_rank - {N_VAL}) % {N_SHARDS} AS INTEGER) END AS shard
FROM r""",
)
def jsonl_corpus_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Raw documents as compressed JSON lines with ``text`` either a string or a
    list of paragraphs, read back (union type resolved per row), English
    only, split and written as val + train shards, then read back."""
    root = checkpoint_root(spark).rstrip("/")
    raw = f"{root}/raw-docs-{uuid.uuid4().hex}"
    docs = read_table(spark, d, "documents").select("doc_id", "text", "lang")
    sc.write_raw_docs(docs, raw, paragraph_rows=F.pmod(F.col("doc_id"), F.lit(2)) == 0)
    back = sc.read_raw_docs(spark, raw)
    en = back.filter(F.col("lang") == "en")
    split = rk.split_val_train(en, "doc_id", N_VAL, N_SHARDS, seed=0)
    out = f"{root}/corpus-{uuid.uuid4().hex}"
    sc.write_splits(split.select("doc_id", "text", "split", "shard", "shuffle_rank"), out, "shuffle_rank", N_SHARDS)
    return sc.read_splits(spark, out)
