"""Exact dedup: static binary fuse filters per immutable snapshot.

Documents arrive in batches. What is already there is an immutable snapshot
of segments, one a batch: one filter per hash shard, and behind it the exact
buckets, the segment's rows by the 64-bit key of their normalised text. An
incoming batch groups its own repeated keys by their bytes; its distinct
keys are screened by each segment's filters, and only the positives (true
copies and about 1 in 256 others) meet that segment's buckets, again byte
for byte. Everything else is decided on 8-byte keys. A text is normalised
and hashed once, when its batch is stored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .common import sized, staged, text_key, without_rows
from .fuse import build, contains

#: Keys of one shard's filter (about 5 KB).
SHARD_KEYS = 4096
#: Candidate digests that may be broadcast (one long each, about 40 MB); beyond it the texts are shuffled to them.
WANTED_KEYS = 1_000_000


def normalised(text_col: str = "text") -> Column:
    """Each run of ``[\\x20\\x09-\\x0D]`` as one space; null as empty.

    Lone spaces, by far the most, stay as they are and cost no match.
    """
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x09-\x0D\x20]{2,}|[\x09-\x0D]", " ")


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One staged row per document: i (id), h (raw text hash), key (64 bits), sha (32 bytes), t (normalised text)."""
    norm = docs.select(F.col(id_col).alias("i"), text_key(text_col).alias("h"), normalised(text_col).alias("t"))
    return staged(norm.select("i", "h", F.xxhash64("t").alias("key"), F.unhex(F.sha2("t", 256)).alias("sha"), "t"), "texts")


@dataclass(frozen=True)
class Batch:
    """Rows as ``stored`` gives them, and their distinct keys with their counts."""

    rows: DataFrame  # i, h, key, sha, t
    keys: DataFrame  # key, n


@dataclass(frozen=True)
class Segment:
    """One immutable batch of a snapshot: a filter for each shard of its keys, its rows as the exact buckets."""

    filters: DataFrame  # shard, filter
    shards: int
    buckets: DataFrame  # i, h, key, sha, t


#: The segments in the order of their batches.
Snapshot = tuple[Segment, ...]


def as_batch(rows: DataFrame) -> Batch:
    return Batch(rows, staged(rows.groupBy("key").agg(F.count("*").alias("n")), "batch-keys"))


def segment(batch: Batch) -> Segment:
    """One filter per shard of the batch's keys; each task holds a few thousand keys."""

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "filter": [build(pdf["key"].to_numpy().view(np.uint64))]})

    shards = max(1, -(-batch.keys.count() // SHARD_KEYS))
    sharded = batch.keys.select("key", F.pmod("key", F.lit(shards)).alias("shard"))
    filters = staged(sharded.groupBy("shard").applyInPandas(make, "shard long, filter binary"), "filters")
    return Segment(filters, shards, batch.rows)


def screen(incoming: DataFrame, old: Segment) -> DataFrame:
    """The incoming distinct keys that the segment's filters let through."""

    def ask(keys: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        if keys.empty or filters.empty:
            return pd.DataFrame({"key": np.zeros(0, np.int64)})
        maybe = contains(filters["filter"].iloc[0], keys["key"].to_numpy().view(np.uint64))
        return keys.loc[maybe, ["key"]]

    sharded = incoming.select("key", F.pmod("key", F.lit(old.shards)).alias("shard"))
    return sharded.groupBy("shard").cogroup(old.filters.groupBy("shard")).applyInPandas(ask, "key long")


def _by_bytes(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of the wanted keys, grouped by their bytes: equal keys of different texts stay apart."""
    suspects = rows.select("i", "key", "t").join(sized(wanted, WANTED_KEYS), "key", "left_semi")
    return suspects.groupBy("key", "t").agg(F.min("i").alias("keep_id"), F.count("*").alias("size"))


def copies(snapshot: Sequence[Segment], batch: Batch) -> DataFrame:
    """The batch's texts that the snapshot holds or the batch repeats (staged).

    sha, keep_id (the smallest id of the snapshot's and the batch's rows of
    that text, nulls last), size (their number).
    """
    asked = [staged(screen(batch.keys, old), "positive-keys") for old in snapshot]
    wanted = batch.keys.where("n > 1").select("key")
    for positive in asked:
        wanted = wanted.unionByName(positive)
    own = staged(_by_bytes(batch.rows, staged(wanted.distinct(), "candidate-keys")), "batch-groups")
    met = own
    for old, positive in zip(snapshot, asked):
        held = _by_bytes(old.buckets, positive)
        # a bucket's rows whose bytes no row of the batch has are a filter's false positive
        met = met.unionByName(held.join(own, ["key", "t"], "left_semi"))
    total = met.groupBy("key", "t").agg(F.min("keep_id").alias("keep_id"), F.sum("size").alias("size"))
    return staged(total.where("size > 1").select(F.unhex(F.sha2("t", 256)).alias("sha"), "keep_id", "size"), "exact-copies")


def add(snapshot: Sequence[Segment], rows: DataFrame) -> tuple[Snapshot, DataFrame]:
    """The snapshot with one more segment, and the ``copies`` of the rows (as ``stored``) against it.

    An empty batch gives a segment whose filters let nothing through.
    """
    batch = as_batch(rows)
    return (*snapshot, segment(batch)), copies(snapshot, batch)


def latest(reports: Sequence[DataFrame]) -> DataFrame:
    """The ``copies`` of several batches as one table: a later report counts the earlier batches' rows too."""
    every = reports[0]
    for r in reports[1:]:
        every = every.unionByName(r)
    return staged(every.groupBy("sha").agg(F.min("keep_id").alias("keep_id"), F.max("size").alias("size")), "copy-groups")


def halves(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows as two batches in id order (ids that aren't numbers by their hash); null ids come with the second."""
    if isinstance(rows.schema["i"].dataType, NumericType):
        middle = rows.agg(F.percentile_approx("i", 0.5).alias("m")).first()["m"]
        old = F.coalesce(F.col("i") <= F.lit(middle), F.lit(False))
    else:
        old = F.coalesce(F.pmod(F.xxhash64("i"), F.lit(2)) == 0, F.lit(False))
    return rows.where(old), rows.where(~old)


def groups_of(rows: DataFrame) -> DataFrame:
    """sha, keep_id and size of the texts that several rows (as ``stored``) share.

    The lower half of the ids becomes the snapshot that the upper half meets.
    """
    first, second = map(as_batch, halves(rows))
    return latest([copies((), first), copies((segment(first),), second)])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row.

    Null texts count as empty, and empty texts equal each other. Null ids
    come last, so one is a keep_id only where a group has no other. Rows
    repeated with the same id are one document: each of them is kept or
    none. Texts of any length are compared whole; an empty table gives no
    rows. Other columns are not read.
    """
    rows = stored(docs, id_col, text_col)
    groups = groups_of(rows)
    joined = rows.join(sized(groups), "sha", "left")
    keep = F.when(F.col("size").isNull(), F.col("i")).otherwise(F.col("keep_id"))
    return joined.select(
        F.col("i").alias("doc_id"),
        keep.alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.col("i").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, columns unchanged.

    Here exactly one row stays even among rows repeated with the same id.
    """
    rows = stored(docs, id_col, text_col)
    groups = groups_of(rows)
    members = rows.join(sized(groups), "sha").select("sha", "i", "h", F.col("i").eqNullSafe(F.col("keep_id")).alias("least"))
    # Rows of the smallest id may differ in their white space: the one with the smallest text hash stays.
    kept_h = staged(members.where("least").groupBy("sha").agg(F.min("h").alias("keep_h")), "copy-kept")
    stays = F.col("least") & (F.col("h") == F.col("keep_h"))
    members = members.join(sized(kept_h), "sha").groupBy("i", "h", stays.alias("stays")).agg(F.count("*").alias("n"))
    members = staged(members, "copy-members")
    return without_rows(
        docs, members.where("not stays").select("i", "h"), members.where("stays and n > 1").select("i", "h"), id_col, text_col
    )


ORACLE = """
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM n
"""
