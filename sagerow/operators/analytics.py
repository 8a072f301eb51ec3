"""Run analytics (P5): power-law and isoFLOP fits, group bounds, bucket
means, rolling quantiles, EMAs, interpolation, KL and quantile clipping.

Fits are closed forms over per-group sums (one aggregate, map-side
combined), so a group of any size is reduced without collecting it.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .rank import global_index, halo_chunks, join_null_safe, range_sorted

#: Entries folded at a time by the EMA's scan; each level up has a FAN-th of the rows.
FAN = 64


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- power laws ------------------------------------------------------------------------

def power_law_fit(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """``y = a·x^b`` by least squares in log-log space, per group (AGG-13)."""
    lx, ly = F.log(_c(x)), F.log(_c(y))
    return df.groupBy(*keys).agg(
        F.exp(F.regr_intercept(ly, lx)).alias("a"),
        F.regr_slope(ly, lx).alias("b"),
        F.count(F.lit(1)).alias("n"),
    )


#: Points of one group that one task takes through the whole grid, and partial results merged at a time.
GRID_POINTS, GRID_MERGE = 20_000, 64


def _grid_cells(x: np.ndarray, y: np.ndarray, floor: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """The points in small runs, each with its (points, grid) table of y - floor."""
    step = max(1, (1 << 20) // len(floor))
    for k in range(0, len(x), step):
        yield slice(k, k + step), y[k : k + step, None] - floor


def _summed(parts: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Element-wise sums of array columns (as bytes of doubles) by group, ``GRID_MERGE`` rows at a time.

    ``parts`` holds the number of its rows' slice in ``_part``; slices are merged level by level, so
    a group of any number of them never meets whole in one task."""

    def add(table: pa.Table) -> pa.Table:
        out = table.slice(0, 1)
        for c in columns:
            total = sum(np.frombuffer(v, np.float64) for v in table.column(c).to_pylist())
            out = out.set_column(out.schema.get_field_index(c), out.schema.field(c), pa.array([total.tobytes()], pa.binary()))
        return out

    last = parts.agg(F.max("_part")).first()[0] or 0
    while True:
        last //= GRID_MERGE
        parts = parts.withColumn("_part", F.floor(F.col("_part") / GRID_MERGE))
        parts = parts.groupBy(*keys, "_part").applyInArrow(add, parts.schema)
        if last == 0:
            return parts.drop("_part")


def power_law_plus_constant_fit(df: DataFrame, keys: list[str], x: str, y: str, grid: int = 10_000) -> DataFrame:
    """``y = y0 + a·x^b``: y0 on an even grid of ``grid`` points over
    [0, min y]; per y0 a log-log fit of y − y0; keep the lowest MSE, the
    first one on ties (AGG-14). A y0 that makes any y − y0 ≤ 0 cannot be
    fitted and never wins. Equal (x, y) pairs are pre-aggregated.

    No row is repeated for the grid: slices of up to ``GRID_POINTS`` points
    sum all grid values as arrays, and one array a slice leaves the task.
    What is shuffled are the distinct points and a slice's arrays."""
    k_ = [f"_k{i}" for i in range(len(keys))]
    pts = df.groupBy(*[F.col(c).alias(n) for c, n in zip(keys, k_)], F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    pts = cut_lineage(pts.agg(F.count(F.lit(1)).cast("double").alias("_w")).where("_x is not null and _y is not null"), "grid-points")
    of = pts.groupBy(*k_).agg(F.min("_y").alias("_ymin"), F.ceil(F.count(F.lit(1)) / GRID_POINTS).alias("_slices"))
    sliced = join_null_safe(pts, of, k_).withColumn("_part", F.pmod(F.xxhash64("_x", "_y"), "_slices")).drop("_slices")
    key_fields = ", ".join(f"{n} {df.schema[c].dataType.simpleString()}" for c, n in zip(keys, k_))
    steps = np.arange(grid, dtype=float)

    def columns(table: pa.Table) -> list[np.ndarray]:
        return [table.column(c).to_numpy() for c in ("_x", "_y", "_w")]

    def one_row(table: pa.Table, **arrays: np.ndarray) -> pa.Table:
        out = table.slice(0, 1).select([*k_, "_part"])
        for name, v in arrays.items():
            out = out.append_column(name, pa.array([np.asarray(v, float).tobytes()], pa.binary()))
        return out

    def sums(table: pa.Table) -> pa.Table:
        xs, ys, ws = columns(table)
        floor = table.column("_ymin")[0].as_py() * steps / max(1, grid - 1)
        with np.errstate(invalid="ignore", divide="ignore"):
            lx = np.log(xs)
            sy, sxy, bad = np.zeros(grid), np.zeros(grid), np.zeros(grid)
            for part, d in _grid_cells(xs, ys, floor):
                bad += (d <= 0).sum(axis=0)
                ld = np.log(d) * ws[part, None]
                sy += ld.sum(axis=0)
                sxy += (ld * lx[part, None]).sum(axis=0)
        plain = np.array([ws.sum(), (ws * lx).sum(), (ws * lx * lx).sum()])
        return one_row(table, plain=plain, sy=sy, sxy=sxy, bad=bad)

    arrays_of = ["plain", "sy", "sxy", "bad"]
    fields = ", ".join(f"{c} binary" for c in arrays_of)
    parts = sliced.groupBy(*k_, "_part").applyInArrow(sums, f"{key_fields}, _part long, {fields}")
    fits = cut_lineage(_summed(parts, k_, arrays_of), "grid-fits")

    def solved(fit: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        (n, sx, sxx), sy, sxy, bad = (np.frombuffer(fit.column(c)[0].as_py(), np.float64) for c in ("plain", "sy", "sxy", "bad"))
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            spread = n * sxx - sx * sx  # one x value leaves the slope open: no fit
            b = (n * sxy - sx * sy) / spread if spread != 0 else np.full(grid, np.nan)
            return np.exp((sy - b * sx) / n), b, (bad == 0) & np.isfinite(b)

    def errors(table: pa.Table, fit: pa.Table) -> pa.Table:
        xs, ys, ws = columns(table)
        a, b, ok = solved(fit)
        floor = table.column("_ymin")[0].as_py() * steps / max(1, grid - 1)
        err = np.zeros(grid)
        with np.errstate(invalid="ignore", over="ignore"):
            for part, d in _grid_cells(xs, ys, floor):
                e = d - a * np.power(xs[part, None], b)
                err += (ws[part, None] * e * e).sum(axis=0)
        return one_row(table, err=np.where(ok, err, 0.0))

    every = join_null_safe(sliced.select(*k_, "_part").distinct(), fits, k_)
    named = [f"_of{c}" for c in (*k_, "_part")]
    every = every.select(*[F.col(c).alias(n) for c, n in zip((*k_, "_part"), named)], *arrays_of)
    errs = sliced.groupBy(*k_, "_part").cogroup(every.groupBy(*named)).applyInArrow(errors, f"{key_fields}, _part long, err binary")
    whole = join_null_safe(join_null_safe(_summed(errs, k_, ["err"]), fits, k_), of.drop("_slices"), k_)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                fit = pa.Table.from_batches([batch.slice(i, 1)])
                a, b, ok = solved(fit)
                mse = np.frombuffer(fit.column("err")[0].as_py(), np.float64) / np.frombuffer(fit.column("plain")[0].as_py(), np.float64)[0]
                mse = np.where(ok & ~np.isnan(mse), mse, np.inf)
                k = int(mse.argmin())
                floor = fit.column("_ymin")[0].as_py() * steps / max(1, grid - 1)
                rows.append((i, float(a[k]), float(b[k]), float(floor[k]), float(mse[k])) if ok.any() else None)
            kept = [r for r in rows if r is not None]
            cols = list(zip(*kept)) or [[]] * 5
            keep = batch.select(k_).take(pa.array(cols[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([*keep.columns, *[pa.array(c, pa.float64()) for c in cols[1:]]], [*k_, "a", "b", "y0", "mse"])

    out = whole.mapInArrow(best, f"{key_fields}, a double, b double, y0 double, mse double")
    return out.select(*[F.col(n).alias(c) for c, n in zip(keys, k_)], "a", "b", "y0", "mse")


def isoflop_optimum(df: DataFrame, keys: list[str], params: str, loss: str, grid: int = 1000, margin: float = 0.2) -> DataFrame:
    """Per group: quadratic fit of loss on ln(params), evaluated on ``grid``
    points from min−margin to max+margin of ln(params); returns the first
    grid argmin and its loss (AGG-15). Sums are centred on the group mean of
    ln(params) for conditioning; the 3×3 normal equations are solved by
    Cramer's rule as column expressions. A group with fewer than three
    sizes has no quadratic: its optimum is NULL."""
    lx = F.log(_c(params))
    m = df.groupBy(*keys).agg(F.avg(lx).alias("_mx"), F.min(lx).alias("_lo"), F.max(lx).alias("_hi"))
    u = F.log(F.col(params)) - F.col("_mx")
    yv = F.col(loss)
    s = df.join(m, keys).groupBy(*keys, "_mx", "_lo", "_hi").agg(
        F.count(F.lit(1)).cast("double").alias("s0"),
        F.sum(u).alias("s1"),
        F.sum(u * u).alias("s2"),
        F.sum(u * u * u).alias("s3"),
        F.sum(u * u * u * u).alias("s4"),
        F.sum(yv).alias("t0"),
        F.sum(u * yv).alias("t1"),
        F.sum(u * u * yv).alias("t2"),
    )
    c = {k: F.col(k) for k in ("s0", "s1", "s2", "s3", "s4", "t0", "t1", "t2")}

    def det3(a, b, cc, d, e, f, g, h, i):
        return a * (e * i - f * h) - b * (d * i - f * g) + cc * (d * h - e * g)

    # [s0 s1 s2; s1 s2 s3; s2 s3 s4] · [c0 c1 c2] = [t0 t1 t2]
    det = det3(c["s0"], c["s1"], c["s2"], c["s1"], c["s2"], c["s3"], c["s2"], c["s3"], c["s4"])
    c0 = F.try_divide(det3(c["t0"], c["s1"], c["s2"], c["t1"], c["s2"], c["s3"], c["t2"], c["s3"], c["s4"]), det)
    c1 = F.try_divide(det3(c["s0"], c["t0"], c["s2"], c["s1"], c["t1"], c["s3"], c["s2"], c["t2"], c["s4"]), det)
    c2 = F.try_divide(det3(c["s0"], c["s1"], c["t0"], c["s1"], c["s2"], c["t1"], c["s2"], c["s3"], c["t2"]), det)
    coef = s.select(*keys, "_mx", (F.col("_lo") - margin).alias("lo"), (F.col("_hi") + margin).alias("hi"),
                    c0.alias("c0"), c1.alias("c1"), c2.alias("c2"))
    t = F.col("lo") + F.col("_i") * (F.col("hi") - F.col("lo")) / F.lit(grid - 1)
    du = t - F.col("_mx")
    pts = coef.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))).withColumn(
        "_t", t).withColumn("_f", F.col("c0") + F.col("c1") * du + F.col("c2") * du * du)
    best = pts.groupBy(*keys).agg(F.min_by(F.struct("_t", "_f"), F.struct("_f", "_i")).alias("b"))
    return best.select(*keys, F.exp(F.col("b._t")).alias("opt_params"), F.col("b._t").alias("opt_log_params"),
                       F.col("b._f").alias("opt_loss"))


# ---- bounds, buckets, weighted means ---------------------------------------------------

def exact_quantiles(df: DataFrame, keys: list[str], x: Column, qs: dict[str, float]) -> DataFrame:
    """Per group the linear-interpolated quantiles ``{column: q}`` of ``x`` (NULLs left out).

    Equal values are counted first, the distinct (keys, value) rows are
    range-sorted once, and running counts give every value its span of
    positions; a group of any size, hot or not, is spread over its ranges
    and no task holds all its values. A group without values gets no row."""
    counted = df.select(*keys, x.alias("_x")).filter(F.col("_x").isNotNull()).groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_n"))
    rows = range_sorted(counted, [*keys, "_x"])
    inside = Window.partitionBy("_task").orderBy("_local").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    per_task = rows.groupBy("_task").agg(F.sum("_n").alias("_t"))
    # one row per range partition, whatever the data
    offsets = F.broadcast(per_task.select("_task", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off")))
    spans = rows.withColumn("_run", F.sum("_n").over(inside)).join(offsets, "_task")
    spans = spans.withColumn("_end", F.col("_off") + F.col("_run")).withColumn("_start", F.col("_end") - F.col("_n"))
    groups = spans.groupBy(*keys).agg(F.min("_start").alias("_gs"), F.sum("_n").alias("_gn"))
    placed = join_null_safe(spans, groups, keys)
    ends = []
    for name, q in qs.items():
        pos = (F.col("_gn") - 1) * F.lit(float(q))
        for part, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            holds = (F.col("_start") - F.col("_gs") <= at) & (F.col("_end") - F.col("_gs") > at)
            ends.append(F.max(F.when(holds, F.col("_x"))).alias(f"_{part}_{name}"))
    found = placed.groupBy(*keys).agg(F.first("_gn").alias("_gn"), *ends)
    values = []
    for name, q in qs.items():
        pos = (F.col("_gn") - 1) * F.lit(float(q))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        values.append((lo + (hi - lo) * (pos - F.floor(pos))).cast("double").alias(name))
    return found.select(*keys, *values)


def group_bounds(df: DataFrame, keys: list[str], x: str, lo_q: float, hi_q: float) -> DataFrame:
    """Per-group (lo, hi) as exact percentiles of ``x`` (JOI-3 bounds)."""
    return exact_quantiles(df, keys, F.col(x), {"lo": lo_q, "hi": hi_q})


def within_group_bounds(df: DataFrame, bounds: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Rows with lo ≤ x ≤ hi of their own group (FIL-9). The bounds table has
    one row per group; the number of groups is not bounded, so AQE decides
    at run time whether it is small enough to broadcast."""
    return join_null_safe(df, bounds, keys).filter(F.col(x).between(F.col("lo"), F.col("hi")))


def masked_weighted_mean(df: DataFrame, keys: list[str], x: str, mask: Column, w: Column) -> DataFrame:
    """``Σ(x·mask·w) / (Σmask + 0.01)`` per group (AGG-18)."""
    m = mask.cast("double")
    return df.groupBy(*keys).agg((F.sum(_c(x) * m * w) / (F.sum(m) + 0.01)).alias("masked_mean"))


def bucket_of(step: Column | str, every: int) -> Column:
    """Step 0 alone, then buckets that close when ``step % every == every-1`` (AGG-19)."""
    s = _c(step)
    return F.when(s == 0, F.lit(0)).otherwise(F.floor(s / every) + 1).cast("bigint")


def bucket_means(metrics: DataFrame, every: int) -> DataFrame:
    """Mean of each closed bucket per (run, name); the open tail bucket of a
    run is not reported (it has not been flushed yet)."""
    b = metrics.withColumn("bucket", bucket_of("step", every))
    g = b.groupBy("run_id", "name", "bucket").agg(
        F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"), F.max("step").alias("_last")
    )
    closed = (F.col("bucket") == 0) | (F.pmod(F.col("_last"), F.lit(every)) == every - 1)
    return g.filter(closed).drop("_last")


def gaussian_kl(mu_p: Column, sd_p: Column, mu_q: Column, sd_q: Column) -> Column:
    """KL(p‖q) of two normals (AGG-20)."""
    return F.log(sd_q) - F.log(sd_p) + (sd_p * sd_p + (mu_p - mu_q) * (mu_p - mu_q)) / (2 * sd_q * sd_q) - 0.5


def quantile_clip(df: DataFrame, keys: list[str], x: str, p: float, floor_val: float) -> DataFrame:
    """``s = max(quantile(|x|, p), floor)`` per group; ``clamp(x, −s, s)/s``
    (AGG-22); a group without values clips at the floor."""
    q = exact_quantiles(df, keys, F.abs(_c(x)), {"_q": p})
    j = join_null_safe(df, q, keys, "left").withColumn("_s", F.greatest(F.col("_q"), F.lit(floor_val))).drop("_q")
    return j.withColumn("clipped", F.least(F.greatest(_c(x), -F.col("_s")), F.col("_s")) / F.col("_s")).drop("_s")


# ---- ordered windows ------------------------------------------------------------------

def window_quantiles(values: list[float | None], starts: list[int], q: float, fill: float | None, window: int) -> list[float | None]:
    """For each place, the interpolated quantile of the values from its start up to the one before it.

    The window's values are kept sorted and moved one step a place: a binary
    search and a shift to put one in, the same to take one out. Nulls don't
    count; with ``fill`` the window is topped up with that value."""
    held: list[float] = [fill] * window if fill is not None else []
    out: list[float | None] = []
    left = 0
    for k, start in enumerate(starts):
        while left < start:  # these have left the window
            if (v := values[left]) is not None:
                del held[bisect_left(held, v)]
                if fill is not None:
                    insort(held, fill)
            left += 1
        if k and (v := values[k - 1]) is not None:
            insort(held, v)
            if fill is not None:
                del held[bisect_left(held, fill)]
        if not held:
            out.append(None)
            continue
        at = (len(held) - 1) * q
        low, high = held[math.floor(at)], held[math.ceil(at)]
        out.append(low + (high - low) * (at - math.floor(at)))
    return out


def rolling_quantile_clip(
    df: DataFrame, keys: list[str], order: str, x: str, q: float = 0.95, window: int = 1000,
    fill: float | None = None, chunk: int = 200_000, dense_order: bool = False,
) -> DataFrame:
    """Quantile of the previous ``window`` values (current excluded), and
    the value clipped to it (WIN-7). With ``fill`` the history starts as a
    full buffer of ``fill`` values, as a pre-filled ring buffer does.

    Rows get a dense per-key position (distributed rank) and are cut into
    chunks of ``chunk`` positions with a ``window``-row halo, so one long
    series is spread over many tasks. In a chunk the sorted window moves one
    step a row (``window_quantiles``). ``dense_order`` says ``order`` already
    is that position (0, 1, 2, ... per key) and skips the ranking."""
    if dense_order:
        pos = df.withColumn("_rpos", F.col(order).cast("bigint"))
    else:
        pos = global_index(df, [order], out="_rpos", partition_by=keys)
    h = halo_chunks(pos.withColumn("_rx", _c(x).cast("double")), "_rpos", max(chunk, 2 * window), window)
    schema = T.StructType([*h.schema.fields, T.StructField("q", T.DoubleType())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_rpos")
        # A row's window begins ``window`` rows before it, in the halo or the chunk.
        starts = np.maximum(np.arange(table.num_rows) - window, 0).tolist()
        found = window_quantiles(table.column("_rx").to_pylist(), starts, q, None if fill is None else float(fill), window)
        return table.append_column("q", pa.array(found, pa.float64()))

    out = h.groupBy(*keys, "_chunk").applyInArrow(run, schema)
    out = out.filter(~F.col("_halo")).drop("_halo", "_chunk", "_rpos", "_rx")
    return out.withColumn("clipped", F.when(F.col("q").isNull(), _c(x)).otherwise(F.least(_c(x), F.col("q"))))


def _fold(history: Column, decay: float) -> Column:
    """``acc·decay + entry`` over (p1, p2) entries, oldest first (at most FAN of them)."""
    zero = F.struct(F.lit(0.0).alias("p1"), F.lit(0.0).alias("p2"))
    return F.aggregate(
        history, zero,
        lambda acc, e: F.struct((acc["p1"] * decay + e["p1"]).alias("p1"), (acc["p2"] * decay + e["p2"]).alias("p2")),
    )


def _entering_state(totals: DataFrame, keys: list[str], span: int, log_beta: float, last: int) -> DataFrame:
    """(keys, idx, c): the folded state before each of the ``totals`` (keys, idx, t).

    Every total stands for ``span`` rows. Totals are folded in groups of
    FAN; the groups' own totals go up one level, whose state comes back
    down, so any series length takes log_FAN levels of bounded folds and
    nothing older is dropped."""
    decay = math.exp(span * log_beta)
    grouped = totals.withColumn("_g", F.floor(F.col("idx") / FAN))
    inside = Window.partitionBy(*keys, "_g").orderBy("idx")
    own = _fold(F.collect_list("t").over(inside.rowsBetween(Window.unboundedPreceding, -1)), decay)
    state = grouped.withColumn("c", own)
    if last >= FAN:
        full = grouped.withColumn("_s", _fold(F.collect_list("t").over(inside.rowsBetween(Window.unboundedPreceding, 0)), decay))
        up = full.groupBy(*keys, F.col("_g").alias("idx")).agg(F.max_by("_s", "idx").alias("t"))
        above = _entering_state(up, keys, span * FAN, log_beta, last // FAN)
        above = above.select(*keys, F.col("idx").alias("_g"), F.col("c").alias("_u"))
        passed = F.exp((F.col("idx") - F.col("_g") * FAN) * F.lit(span * log_beta))
        state = join_null_safe(state, above, [*keys, "_g"]).withColumn(
            "c",
            F.struct(
                (F.col("c.p1") + passed * F.col("_u.p1")).alias("p1"), (F.col("c.p2") + passed * F.col("_u.p2")).alias("p2")
            ),
        )
    return state.select(*keys, "idx", "c")


def ema_stats(
    df: DataFrame, keys: list[str], order: str, x: str, beta: float, init: float = 1e-8, dense_order: bool = False,
) -> DataFrame:
    """Bias-corrected EMA mean and std per key, in step order (WIN-8).

    ``ema_n = β·ema_{n−1} + (1−β)·x_n`` from ``init``; the bias term follows
    the same recursion towards 1. The recursion is an associative fold: rows
    are folded in blocks of FAN consecutive positions, block totals in
    blocks of FAN blocks, and so on; each block's entering state comes down
    from the level above. Every row counts at every distance, a long series
    spreads over many tasks, and no power overflows."""
    lb = math.log(beta)
    # dense per-key position without a whole-key window (or given)
    if dense_order:
        d = df.withColumn("_n", F.col(order).cast("bigint"))
    else:
        d = global_index(df, [order], out="_n", partition_by=keys)
    last = d.agg(F.max("_n")).first()[0] or 0
    v = _c(x).cast("double")
    d = d.withColumn("_b", F.floor(F.col("_n") / FAN)).withColumn("_e", F.struct(v.alias("p1"), (v * v).alias("p2")))
    inb = Window.partitionBy(*keys, "_b").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_p", _fold(F.collect_list("_e").over(inb), beta))
    totals = d.groupBy(*keys, F.col("_b").alias("idx")).agg(F.max_by("_p", "_n").alias("t"))
    carry = _entering_state(totals, keys, FAN, lb, last // FAN)
    j = join_null_safe(d, carry.withColumnRenamed("idx", "_b"), [*keys, "_b"])
    decay = F.exp((F.col("_n") - F.col("_b") * FAN + 1) * lb)  # the entering state's weight in this row
    bn = F.exp((F.col("_n") + 1) * lb)
    e1 = F.lit(init) * bn + (1 - beta) * (decay * F.col("c.p1") + F.col("_p.p1"))
    e2 = F.lit(init) * bn + (1 - beta) * (decay * F.col("c.p2") + F.col("_p.p2"))
    bias = F.lit(init) * bn + (1 - bn)
    mean = e1 / bias
    std = F.sqrt(F.greatest(e2 / bias - mean * mean, F.lit(0.0)))
    return j.withColumn("ema_mean", mean).withColumn("ema_std", std).drop("_n", "_b", "_e", "_p", "c")


def interpolate(keypoints: DataFrame, probes: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Piecewise-linear ``y(x)`` through each key's keypoints at the probe
    x's; outside the keypoint range the end segments are extended (JOI-9).

    A key with one keypoint has that value everywhere; between keypoints of
    one x the value is the left one's. Probes of a key without keypoints
    give no row.

    One sort: keypoints and probes are range-partitioned together on (key,
    x), so a key holding a third of the rows is spread like any other. Each
    (partition, key) gets the two keypoints before and after it from the
    other partitions as border rows (one set a partition and key), and
    windows inside (partition, key) then see every neighbour a probe needs:
    one on either side, or the two outermost past an end."""
    w = [*keys, "_x", "_probe", "_y"]
    kp = keypoints.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"), F.lit(0).alias("_probe"))
    nothing = F.lit(None).cast(kp.schema["_y"].dataType)
    pr = probes.select(*keys, F.col(x).alias("_x"), nothing.alias("_y"), F.lit(1).alias("_probe"))
    rows = range_sorted(kp.unionByName(pr), w).withColumn("_kp", F.when(F.col("_probe") == 0, F.struct("_x", "_y")))
    span = ["_task", *keys]
    borders = _border_keypoints(rows, span).withColumn("_x", F.lit(None).cast(rows.schema["_x"].dataType))
    seen = rows.select(*span, "_local", "_x", "_probe", "_kp").unionByName(borders.withColumn("_probe", F.lit(0)))
    for order, near, far in ((F.col("_local").asc(), "_l1", "_l2"), (F.col("_local").desc(), "_r1", "_r2")):
        up = Window.partitionBy(*span).orderBy(order)
        seen = seen.withColumn("_next", F.last("_kp", ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, -1)))
        pair = F.when(F.col("_kp").isNotNull(), F.struct(F.col("_kp").alias("a"), F.col("_next").alias("b")))
        last = seen.withColumn("_pair", pair).withColumn(
            "_pair", F.last("_pair", ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0))
        )
        seen = last.withColumn(near, F.col("_pair.a")).withColumn(far, F.col("_pair.b")).drop("_next", "_pair")
    j = seen.filter((F.col("_probe") == 1) & (F.col("_l1").isNotNull() | F.col("_r1").isNotNull()))
    p0 = F.when(F.col("_l1").isNull(), F.col("_r1")).when(F.col("_r1").isNull(), F.coalesce("_l2", "_l1")).otherwise(F.col("_l1"))
    p1 = F.when(F.col("_l1").isNull(), F.coalesce("_r2", "_r1")).when(F.col("_r1").isNull(), F.col("_l1")).otherwise(F.col("_r1"))
    j = j.select(*keys, "_x", p0.alias("_p0"), p1.alias("_p1"))
    slope = F.try_divide(F.col("_p1._y") - F.col("_p0._y"), F.col("_p1._x") - F.col("_p0._x"))
    val = F.col("_p0._y") + F.coalesce((F.col("_x") - F.col("_p0._x")) * slope, F.lit(0.0))
    return j.select(*keys, F.col("_x").alias(x), val.alias(y))


def _border_keypoints(rows: DataFrame, span: list[str]) -> DataFrame:
    """For each (partition, key): the key's last two keypoints in earlier
    partitions at ``_local`` -2 and -1, and its next two in later ones past
    every real position. A key that goes on in another partition is a
    partition's first or last key, so the spans are at most two a partition,
    and only their keypoints are looked at."""
    last = F.broadcast(rows.groupBy("_task").agg(F.max("_local").alias("_last")))  # one row a partition
    outer = rows.join(last, "_task").filter((F.col("_local") == 0) | (F.col("_local") == F.col("_last")))
    spans = cut_lineage(outer.select(*span).distinct(), "border-keys")
    near = join_null_safe(rows.filter("_probe = 0"), F.broadcast(spans), span, "left_semi")
    for order, name in ((F.col("_local").asc(), "_f"), (F.col("_local").desc(), "_t")):
        nth = F.row_number().over(Window.partitionBy(*span).orderBy(order))
        ends = near.select(*span, "_local", "_kp").withColumn("_nth", nth).filter("_nth <= 2")
        first, second = (F.max(F.when(F.col("_nth") == k, F.col("_kp"))) for k in (1, 2))
        spans = join_null_safe(spans, ends.groupBy(*span).agg(first.alias(f"{name}1"), second.alias(f"{name}2")), span, "left")
    spans = cut_lineage(spans, "border-keypoints")
    far = 1 << 40  # past every position inside a partition
    out = []
    for order, name, places in ((F.col("_task").asc(), "_t", (-1, -2)), (F.col("_task").desc(), "_f", (far, far + 1))):
        before = Window.partitionBy(*span[1:]).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        # a partition with one keypoint takes its second from the partition before
        second = F.coalesce(F.col(f"{name}2"), F.last(f"{name}1", ignorenulls=True).over(before))
        pair = spans.withColumn("_second", second)
        pair = pair.withColumn("_pair", F.when(F.col(f"{name}1").isNotNull(), F.struct(F.col(f"{name}1").alias("a"), F.col("_second").alias("b"))))
        pair = pair.withColumn("_pair", F.last("_pair", ignorenulls=True).over(before))
        for field, place in zip("ab", places):
            out.append(pair.select(*span, F.lit(place).cast("bigint").alias("_local"), F.col(f"_pair.{field}").alias("_kp")))
    every = out[0]
    for o in out[1:]:
        every = every.unionByName(o)
    return every.filter(F.col("_kp").isNotNull())
