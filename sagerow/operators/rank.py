"""Global positions, seeded orders, splits and shards (WIN-1, SRT-*, SET-2/3).

``global_index`` is the distributed replacement for an unpartitioned
``row_number() over (order by ...)`` (which runs in one task): rows are
range-partitioned on the whole order tuple by sampled quantiles, sorted
inside their partition and written once with their local position; the
partitions' row counts (one row per partition) give the offsets. A heavy
value, an outlier or a hot group moves the sampled bounds, so no partition
holds much more than the mean.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_LOCAL_BITS = 33  # of monotonically_increasing_id: the position inside a partition


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL equals NULL; the keys come from ``left``."""
    if not keys:
        return left.crossJoin(right)  # the right side is one row
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def range_sorted(df: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """The rows written in the order of ``keys`` (sampled range partitions), with
    ``_task`` (the partition) and ``_local`` (the position inside it)."""
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = cut_lineage(ranged.withColumn("_mid", F.monotonically_increasing_id()), "ranked")
    local = F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    return rows.select(*df.columns, F.shiftright("_mid", _LOCAL_BITS).alias("_task"), local.alias("_local"))


def global_index(
    df: DataFrame,
    order: Sequence[str | Column],
    out: str = "idx",
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Add a dense 0-based position in the total order ``order`` (WIN-1),
    optionally restarting per ``partition_by`` group.

    ``order`` must be a total order inside a group (break ties with a
    unique column). NULL order keys come first (unless the order says
    otherwise) and NULL groups are groups like any other. The rows are
    written once, range-partitioned, to the shared folder; Spark samples the
    input for the bounds.
    """
    parts = list(partition_by)
    rows = range_sorted(df, [*parts, *order])
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_task").agg(F.count(F.lit(1)).alias("_n"))
    # one row per range partition, whatever the data: safe to broadcast
    offsets = F.broadcast(offsets.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")))
    ranked = rows.join(offsets, "_task").withColumn(out, (F.col("_off") + F.col("_local")).cast("bigint"))
    ranked = ranked.drop("_task", "_local", "_off")
    if not parts:
        return ranked
    # groups are contiguous in the global order: a group's first position is its start
    starts = ranked.groupBy(*parts).agg(F.min(out).alias("_start"))
    return join_null_safe(ranked, starts, parts).withColumn(out, F.col(out) - F.col("_start")).drop("_start")


# ---- seeded order (SRT-1/2) ---------------------------------------------

def shuffle_key(seed: int | str, id_col: str | Column) -> Column:
    """Reproducible random order key: md5 of ``seed:id`` (same in DuckDB)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


def seeded_shuffle(df: DataFrame, id_col: str, seed: int = 0, out: str = "shuffle_rank") -> DataFrame:
    """Global seeded shuffle as a dense position (SRT-1)."""
    keyed = df.withColumn("_skey", shuffle_key(seed, id_col))
    return global_index(keyed, ["_skey", id_col], out=out).drop("_skey")


def first_n_of_shuffle(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """First ``n`` rows of a seeded shuffle (SRT-2): a bounded top-k, no full sort."""
    keyed = df.withColumn("_skey", shuffle_key(seed, id_col))
    return keyed.orderBy("_skey", id_col).limit(n).drop("_skey")


# ---- splits, shards and samples (SRT-7/8/9, SET-2/3) ----------------------

def split_val_train(
    df: DataFrame, id_col: str, n_val: int, n_shards: int = 8, seed: int = 0
) -> DataFrame:
    """Seeded shuffle; the first ``n_val`` rows are validation, the rest go
    round-robin to ``n_shards`` train shards by shuffled position (SRT-8)."""
    r = seeded_shuffle(df, id_col, seed=seed, out="shuffle_rank")
    is_val = F.col("shuffle_rank") < n_val
    return r.withColumn("split", F.when(is_val, "val").otherwise("train")).withColumn(
        "shard",
        F.when(is_val, F.lit(None).cast("int")).otherwise(
            F.pmod(F.col("shuffle_rank") - n_val, F.lit(n_shards)).cast("int")
        ),
    )


def round_robin(df: DataFrame, rank_col: str, world: int, out: str = "worker") -> DataFrame:
    """Strided assignment ``rank mod world`` (SRT-7); no padding rows."""
    return df.withColumn(out, F.pmod(F.col(rank_col), F.lit(world)).cast("int"))


def systematic_sample(df: DataFrame, rank_col: str, every: int, offset: int) -> DataFrame:
    """Every ``every``-th row starting at ``offset`` (SRT-9); a sampling operator."""
    return df.filter(F.pmod(F.col(rank_col), F.lit(every)) == offset)


def repeat_epochs(df: DataFrame, epochs: int, out: str = "epoch") -> DataFrame:
    """Bag-repeat for ``epochs`` passes (SET-3), as a per-row generator (no join)."""
    return df.withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))


# ---- halo chunks for bounded look-back windows ----------------------------------

def halo_chunks(df: DataFrame, pos_col: str, chunk: int, halo: int) -> DataFrame:
    """Split each key's rows into chunks of ``chunk`` consecutive positions;
    the last ``halo`` rows of a chunk are also copied into the next chunk
    (``_halo = true``). A window partitioned by (keys, ``_chunk``) whose
    frame reaches back at most ``halo`` rows then sees the same rows as the
    unsplit window, so a hot key is spread over many tasks. Drop the halo
    copies afterwards. ``pos_col`` must be a dense 0-based position per key.
    """
    if halo >= chunk:
        raise ValueError("halo must be smaller than chunk")
    c = F.floor(F.col(pos_col) / chunk)
    tail = F.pmod(F.col(pos_col), F.lit(chunk)) >= chunk - halo
    return df.withColumn("_home", c).withColumn(
        "_chunk", F.explode(F.when(tail, F.array(c, c + 1)).otherwise(F.array(c)))
    ).withColumn("_halo", F.col("_chunk") != F.col("_home")).drop("_home")
