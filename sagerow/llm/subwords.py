"""Hashed word and character n-gram features, and the bounded labelled sample."""

from __future__ import annotations

from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, staged, unit_hash

#: Remainder classes of crc32(doc_id); class 0 is held out and never trains.
FOLDS = 5
#: Words hashed at a time.
CHUNK_WORDS = 1 << 16
#: UTF-8 bytes of a sample's texts; each class has its share of rows of them.
SAMPLE_BYTES = 24_000_000


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % FOLDS == 0


def feature_table(words: list[bytes], bits: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of all words, and the index of the word each belongs to.

    A word's features are ``<word>`` itself and the byte n-grams of ``<word>``
    of ``least`` to ``most`` bytes. N-grams are hashed for all words at once.
    """
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    if len(words) > CHUNK_WORDS:
        parts = [feature_table(words[k : k + CHUNK_WORDS], bits, least, most) for k in range(0, len(words), CHUNK_WORDS)]
        owners = [p[1] + np.int32(k * CHUNK_WORDS) for k, p in enumerate(parts)]
        return np.concatenate([p[0] for p in parts]), np.concatenate(owners)
    mask = np.uint32((1 << bits) - 1)
    raw = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8).astype(np.uint32)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word_of = np.repeat(np.arange(len(words)), lens)
    end = np.repeat(np.cumsum(lens), lens)
    ids = [np.fromiter(map(crc32, words), np.uint32, len(words)) & mask]
    owners = [np.arange(len(words))]
    for n in range(least, most + 1):
        k = len(raw) - n + 1
        if k <= 0:
            break
        h = np.full(k, n, np.uint32)
        for j in range(n):
            h = h * np.uint32(0x01000193) + raw[j : j + k]
        inside = np.flatnonzero(np.arange(k) + n <= end[:k])
        h = h[inside]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        ids.append((h ^ (h >> np.uint32(13))) & mask)
        owners.append(word_of[inside])
    return np.concatenate(ids).astype(np.int32), np.concatenate(owners).astype(np.int32)


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    per_class: dict[int, int],
    id_col: str = "doc_id",
    text_col: str = "text",
    most_bytes: int = SAMPLE_BYTES,
) -> tuple[list[tuple[bytes, int]], dict[int, int]]:
    """At most ``per_class[c]`` training texts of each class c, and how many labels the class has.

    Rows are drawn by a hash of their id from the labels whose id is not
    held out, and taken whole in the hash's order, whatever their length;
    one that no longer fits its class's share of ``most_bytes`` is passed
    over (trains nothing, is scored whole). Of repeated labels the largest
    counts, of repeated ids the smallest text.
    """
    known = (
        labels.select(F.col("doc_id").alias("k"), F.col(label).cast("int").alias("y"))
        .where(F.col("k").isNotNull() & F.col("y").isin(*per_class) & ~held_out("k"))
        .groupBy("k")
        .agg(F.max("y").alias("y"))
    )
    counts = {int(r["y"]): int(r["n"]) for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    drawn = None
    for c, most in per_class.items():
        one = known.where(F.col("y") == c).orderBy(unit_hash(f"sample-{label}", F.col("k")), "k").limit(most)
        drawn = one if drawn is None else drawn.unionByName(one)
    texts = staged(
        docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
        .join(F.broadcast(drawn), F.col("i") == F.col("k"))
        .groupBy("k", "y")
        .agg(F.min("t").alias("t")),
        f"sample-{label}",
    )
    # Keys and sizes of the drawn rows only: a bounded number.
    sizes = texts.select("k", "y", F.coalesce(F.octet_length("t"), F.lit(0)).alias("n"))
    left = {c: most_bytes * most // sum(per_class.values()) for c, most in per_class.items()}
    over = []
    for r in sizes.orderBy(unit_hash(f"sample-{label}", F.col("k")), "k").collect():
        if r["n"] <= left[r["y"]]:
            left[r["y"]] -= r["n"]
        else:
            over.append(r["k"])
    kept = texts.where(~F.col("k").isin(over)) if over else texts
    rows = kept.orderBy(unit_hash(f"order-{label}", F.col("k")), "k").collect()
    drop_staged(texts)
    return [((r["t"] or "").encode(), int(r["y"])) for r in rows], counts
