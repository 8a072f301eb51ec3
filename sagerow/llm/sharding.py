"""Sharding by a hypergeometric communication matrix.

How many rows each partition sends to each shard is drawn first, exactly as
a uniform shuffle would deal them, so the shard sizes are exact. Each
partition then permutes its rows and cuts them by its line of the matrix,
the rows are exchanged, and each shard permutes what it received.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, sized, staged

#: Partitions whose lines of the matrix one task draws; the driver draws one line for each such block.
BLOCK_PARTS = 1024
#: Mean rows of the buckets that a shard's permutation is numbered by.
BUCKET_ROWS = 8192


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws without replacement are good; numpy's own up to its limit of 10^9."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    low, high = max(0, n - bad), min(n, good)
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))

    def log_choose(a: int, b: int) -> float:
        return math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)

    top = math.exp(log_choose(good, mode) + log_choose(bad, n - mode) - log_choose(good + bad, n))
    u, up, down, p_up, p_down = rng.random() - top, mode, mode, top, top
    while u >= 0 and (p_up > 0 or p_down > 0):
        p_up *= (good - up) * (n - up) / ((up + 1) * (bad - n + up + 1)) if up < high else 0
        up += p_up > 0
        u -= p_up
        if u < 0:
            return up
        p_down *= down * (bad - n + down) / ((good - down + 1) * (n - down + 1)) if down > low else 0
        down -= p_down > 0
        u -= p_down
        if u < 0:
            return down
    return mode


def deal(rng: np.random.Generator, capacities: list[int], counts: list[int]) -> list[list[int]]:
    """One line per count: how many go to each shard; the lines add up to at most the capacities."""
    left, lines = list(capacities), []
    for n in counts:
        line, rest, total = [], n, sum(left)
        for c in left:
            total -= c
            k = hypergeometric(rng, c, total, rest) if rest else 0
            line.append(k)
            rest -= k
        left = [c - k for c, k in zip(left, line)]
        lines.append(line)
    return lines


def hypergeometric_shards(df: DataFrame, n_shards: int = 16, seed: int = 7) -> DataFrame:
    """``df`` with shard (0 to n_shards - 1) and slot (gapless from 0 in each shard).

    Shard sizes differ by one row at most, whatever the partitions, keys or
    copies; nulls and repeated rows are rows like any other. Input columns
    named shard or slot are replaced.
    """
    df = df.drop("shard", "slot")
    part, row, rank, bounds, mix, bucket, before = fresh(df, "part", "row", "rank", "bounds", "mix", "bucket", "before")
    cols = [F.col(f"`{c}`") for c in df.columns]
    rows = staged(
        df.select(*cols, F.spark_partition_id().alias(part), F.monotonically_increasing_id().alias(row)), "shard-input"
    )
    counts = staged(rows.groupBy(F.col(part).alias("p")).agg(F.count("*").alias("n")), "shard-counts")
    block = F.floor(F.col("p") / BLOCK_PARTS)
    per_block = [
        (int(r["b"]), int(r["n"])) for r in counts.groupBy(block.alias("b")).agg(F.sum("n").alias("n")).sort("b").collect()
    ]
    total = sum(n for _, n in per_block)
    sizes = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    lines = deal(np.random.default_rng([seed, 0]), sizes, [n for _, n in per_block])
    share = df.sparkSession.createDataFrame(
        [(b, line) for (b, _), line in zip(per_block, lines)], "b long, line array<long>"
    )

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("p")
        rng = np.random.default_rng([seed, 1, int(pdf["b"].iloc[0])])
        own = deal(rng, [int(x) for x in pdf["line"].iloc[0]], [int(n) for n in pdf["n"]])
        return pd.DataFrame({"p": pdf["p"], "bounds": [np.cumsum(line) for line in own]})

    matrix = counts.select("p", "n", block.alias("b")).join(share, "b").groupBy("b").applyInPandas(
        draw, "p int, bounds array<long>"
    )
    matrix = staged(matrix.select(F.col("p").alias(part), F.col("bounds").alias(bounds)), "shard-matrix")

    local = Window.partitionBy(part).orderBy(F.xxhash64(F.lit(seed), F.col(row)), row)
    ranked = rows.withColumn(rank, F.row_number().over(local) - 1).join(sized(matrix), part)
    shard = F.size(F.filter(F.col(bounds), lambda b: b <= F.col(rank)))
    n_buckets = max(1, -(-(total // n_shards + 1) // BUCKET_ROWS))
    again = F.xxhash64(F.lit(seed + 1), F.col(row))
    dealt = staged(
        ranked.select(
            *cols, row, shard.alias("shard"), again.alias(mix), F.pmod(F.shiftright(again, 20), F.lit(n_buckets)).alias(bucket)
        ),
        "shard-dealt",
    )
    filled = dealt.groupBy("shard", bucket).agg(F.count("*").alias(before))
    earlier = Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = staged(
        filled.select("shard", bucket, F.coalesce(F.sum(before).over(earlier), F.lit(0)).alias(before)), "shard-offsets"
    )
    inside = Window.partitionBy("shard", bucket).orderBy(mix, row)
    numbered = dealt.withColumn(rank, F.row_number().over(inside) - 1).join(sized(offsets), ["shard", bucket])
    return numbered.select(*cols, "shard", (F.col(before) + F.col(rank)).alias("slot"))


def shard_digests(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1; null: 1), text_crc32, law ``rows``, shard, slot, grown_shard (null)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return hypergeometric_shards(narrow, n_shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
