"""A blocked Bloom filter over 64-bit keys, built by tasks and broadcast with a bounded size (JOI-6).

Keys are dealt to regions of at most about ``REGION_KEYS`` by hash; each
region's bitmap is built by one task from its distinct keys, and all of them
together are the filter. A key is looked up in its region alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, drop_stage

#: Keys and bits (a power of two) of a region, probes a key, and bytes of a whole filter at most.
REGION_KEYS, REGION_BITS, PROBES, FILTER_BYTES = 65_536, 1 << 20, 4, 64 << 20


def _slots(keys: np.ndarray) -> np.ndarray:
    """The places of each key's bits in its region: (probes, keys)."""
    h = keys.astype(np.int64).view(np.uint64)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    first, step = h >> np.uint64(32), (h & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    return np.stack([(first + np.uint64(i) * step) & np.uint64(REGION_BITS - 1) for i in range(PROBES)]).astype(np.int64)


def build_filter(keys: DataFrame) -> np.ndarray | None:
    """(regions, bytes) bitmaps of the one long column's keys; None if they are too many for ``FILTER_BYTES``."""
    distinct = cut_lineage(keys.toDF("key").where("key is not null").distinct(), "filter-keys")
    regions = max(1, -(-distinct.count() // REGION_KEYS))
    if regions * REGION_BITS // 8 > FILTER_BYTES:
        drop_stage(distinct)
        return None

    def make(table: pa.Table) -> pa.Table:
        bits = np.zeros(REGION_BITS, np.uint8)
        bits[_slots(table.column("key").to_numpy()).ravel()] = 1
        return pa.table({"region": table.column("region").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()])})

    dealt = distinct.withColumn("region", F.pmod("key", F.lit(regions)))
    out = np.zeros((regions, REGION_BITS // 8), np.uint8)
    for row in dealt.groupBy("region").applyInArrow(make, "region long, bits binary").collect():  # bounded above
        out[row["region"]] = np.frombuffer(row["bits"], np.uint8)
    drop_stage(distinct)
    return out


def may_hold(bitmaps: np.ndarray, key: Column, df: DataFrame) -> Column:
    """Whether the filter may hold the (non-null) key: true for all its keys and for few others."""
    shared = df.sparkSession.sparkContext.broadcast(bitmaps)

    def ask(keys: pa.Array) -> pa.Array:
        bits = shared.value
        values = keys.to_numpy(zero_copy_only=False).astype(np.int64)
        slots = _slots(values)
        found = bits[np.mod(values, len(bits)), slots >> 3] >> (slots & 7).astype(np.uint8) & 1
        return pa.array(found.all(axis=0))

    return F.arrow_udf(ask, T.BooleanType())(key)
