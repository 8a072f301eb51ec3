"""Run-analytics queries (P5) over ``part`` (training runs), ``lineitem``
and ``events`` (metric histories)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scaling import VAL_FREQ, flops_per_step, param_count
from ..operators import analytics as an
from ..session import checkpoint_root
from ..sources import runs as sr
from ..sources.tables import read_table
from . import fixtures as fx
from .registry import query, with_ctes

BUDGET = 1e13 * 2**4
PLUS_CONST_GRID = 10_000
BUCKET_EVERY = 10
EMA_BETA = 0.9
PROBE_SECONDS = 21600


def _runs_with_fps(spark: SparkSession, d: str) -> DataFrame:
    r = fx.runs(spark, d)
    return r.withColumn("params", param_count("n_blocks", "dim")).withColumn(
        "fps", flops_per_step("n_blocks", "dim", "batch_size", "model_type")
    )


@query(
    "run_flops",
    "SCA-20 SCA-21",
    with_ctes(fx.RUNS_SQL) + """
SELECT run_id, model_type, CAST(params AS BIGINT) AS params, round(fps / 1e9, 3) AS gflops_per_step FROM runs_fps""",
)
def run_flops(spark: SparkSession, d: str) -> DataFrame:
    r = _runs_with_fps(spark, d)
    return r.select("run_id", "model_type", F.col("params").cast("bigint"), F.round(F.col("fps") / 1e9, 3).alias("gflops_per_step"))


@query(
    "run_curves",
    "SCA-24 SCA-21",
    with_ctes(fx.RUNS_SQL) + f"""
SELECT r.run_id, CAST({VAL_FREQ} * i AS BIGINT) AS step, round({VAL_FREQ} * i * f.fps / 1e15, 6) AS pflops,
       round(r.val_nlls[i], 6) AS loss
FROM (SELECT run_id, val_nlls, unnest(generate_series(1, len(val_nlls))) AS i FROM runs) r
JOIN runs_fps f USING (run_id)""",
)
def run_curves(spark: SparkSession, d: str) -> DataFrame:
    """One row per validation point: step = 1000·(i+1), FLOPs = step × FLOPs/step."""
    r = _runs_with_fps(spark, d).select("run_id", "fps", F.posexplode("val_nlls").alias("i", "loss"))
    step = (F.col("i") + 1) * VAL_FREQ
    return r.select(
        "run_id", step.cast("bigint").alias("step"), F.round(step * F.col("fps") / 1e15, 6).alias("pflops"),
        F.round("loss", 6).alias("loss"),
    )


@query(
    "runs_jsonl_roundtrip",
    "SRC-6 SNK-4",
    with_ctes(fx.RUNS_SQL) + """
SELECT run_id, model_type, steps, CAST(len(val_nlls) AS INTEGER) AS n_vals, round(final_val_nll, 6) AS final_val_nll FROM runs""",
)
def runs_jsonl_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Run records appended as JSON lines (one append per model type), read
    back with the declared run schema."""
    path = f"{checkpoint_root(spark).rstrip('/')}/runs-{uuid.uuid4().hex}"
    r = fx.runs(spark, d)
    for mt in ("diffusion", "autoregressive"):
        sr.append_runs(r.filter(F.col("model_type") == mt), path)
    back = sr.read_runs(spark, path)
    return back.select(
        "run_id", "model_type", "steps", F.size("val_nlls").cast("int").alias("n_vals"),
        F.round("final_val_nll", 6).alias("final_val_nll"),
    )


@query(
    "flop_budgets",
    "AGG-16",
    with_ctes(fx.RUNS_SQL) + """
SELECT model_type, flops, CAST(row_number() OVER (PARTITION BY model_type ORDER BY flops) - 1 AS INTEGER) AS budget_rank
FROM (SELECT DISTINCT model_type, flops FROM runs)""",
)
def flop_budgets(spark: SparkSession, d: str) -> DataFrame:
    """Distinct budgets per model type in ascending order (a handful of rows)."""
    from pyspark.sql import Window

    b = fx.runs(spark, d).select("model_type", "flops").distinct()
    return b.withColumn("budget_rank", (F.row_number().over(Window.partitionBy("model_type").orderBy("flops")) - 1).cast("int"))


@query(
    "runs_at_budget",
    "FIL-12",
    with_ctes(fx.RUNS_SQL) + f"""
SELECT model_type, CAST(count(*) AS BIGINT) AS n_runs, round(avg(final_val_nll), 6) AS mean_loss
FROM runs WHERE flops = {BUDGET!r} GROUP BY model_type""",
)
def runs_at_budget(spark: SparkSession, d: str) -> DataFrame:
    """Runs whose stored budget equals one exact double."""
    r = fx.runs(spark, d).filter(F.col("flops") == F.lit(BUDGET))
    return r.groupBy("model_type").agg(F.count(F.lit(1)).alias("n_runs"), F.round(F.avg("final_val_nll"), 6).alias("mean_loss"))


def _isoflop_sql() -> str:
    return with_ctes(
        fx.RUNS_SQL,
        """pts AS (SELECT model_type, flops, ln(12.0 * n_blocks * dim * dim) AS lx, final_val_nll AS y FROM runs)""",
        """m AS (SELECT model_type, flops, avg(lx) AS mx, min(lx) - 0.2 AS lo, max(lx) + 0.2 AS hi FROM pts GROUP BY 1, 2)""",
        """s AS (SELECT model_type, flops, mx, lo, hi, CAST(count(*) AS DOUBLE) AS s0, sum(lx - mx) AS s1,
                 sum((lx - mx) * (lx - mx)) AS s2, sum((lx - mx) * (lx - mx) * (lx - mx)) AS s3,
                 sum((lx - mx) * (lx - mx) * (lx - mx) * (lx - mx)) AS s4,
                 sum(y) AS t0, sum((lx - mx) * y) AS t1, sum((lx - mx) * (lx - mx) * y) AS t2
          FROM pts JOIN m USING (model_type, flops) GROUP BY model_type, flops, mx, lo, hi)""",
        """d AS (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2) AS det FROM s)""",
        """coef AS (SELECT model_type, flops, mx, lo, hi,
            (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / det AS c0,
            (s0 * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s3 * s2) + s2 * (s1 * t2 - t1 * s2)) / det AS c1,
            (s0 * (s2 * t2 - t1 * s3) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s3 - s2 * s2)) / det AS c2
          FROM d)""",
        """grid AS (SELECT model_type, flops, i, lo + i * (hi - lo) / 999 AS t, c0, c1, c2, mx
          FROM coef, range(1000) r(i))""",
        """val AS (SELECT model_type, flops, i, t, c0 + c1 * (t - mx) + c2 * (t - mx) * (t - mx) AS f FROM grid)""",
        """opt AS (SELECT model_type, flops, t, f FROM
            (SELECT *, row_number() OVER (PARTITION BY model_type, flops ORDER BY f, i) AS rn FROM val) WHERE rn = 1)""",
    )


@query(
    "isoflop_optima",
    "AGG-15",
    _isoflop_sql() + "\nSELECT model_type, flops, round(t, 6) AS opt_log_params, round(f, 6) AS opt_loss FROM opt",
)
def isoflop_optima(spark: SparkSession, d: str) -> DataFrame:
    r = _runs_with_fps(spark, d)
    o = an.isoflop_optimum(r, ["model_type", "flops"], "params", "final_val_nll")
    return o.select("model_type", "flops", F.round("opt_log_params", 6).alias("opt_log_params"), F.round("opt_loss", 6).alias("opt_loss"))


@query(
    "compute_optimal_law",
    "AGG-17 AGG-15 AGG-13",
    _isoflop_sql()
    + """
SELECT model_type, round(exp(regr_intercept(t, ln(flops))), 6) AS a_params, round(regr_slope(t, ln(flops)), 6) AS b_params,
       round(exp(regr_intercept(ln(f), ln(flops))), 6) AS a_loss, round(regr_slope(ln(f), ln(flops)), 6) AS b_loss
FROM opt GROUP BY model_type""",
)
def compute_optimal_law(spark: SparkSession, d: str) -> DataFrame:
    """Power laws of the isoFLOP optima (parameters and loss) against budget."""
    r = _runs_with_fps(spark, d)
    o = an.isoflop_optimum(r, ["model_type", "flops"], "params", "final_val_nll")
    p = an.power_law_fit(o, ["model_type"], "flops", "opt_params").select("model_type", F.col("a").alias("a_params"), F.col("b").alias("b_params"))
    lo = an.power_law_fit(o, ["model_type"], "flops", "opt_loss").select("model_type", F.col("a").alias("a_loss"), F.col("b").alias("b_loss"))
    j = p.join(lo, "model_type")
    return j.select("model_type", *[F.round(c, 6).alias(c) for c in ("a_params", "b_params", "a_loss", "b_loss")])


@query(
    "power_law_plus_constant",
    "AGG-14 AGG-13",
    with_ctes(
        fx.RUNS_SQL,
        """pts AS (SELECT model_type, CAST(12 * n_blocks * dim * dim AS DOUBLE) AS x, final_val_nll AS y, count(*) AS w
                   FROM runs GROUP BY 1, 2, 3)""",
        f"""g AS (SELECT p.*, k, ymin * k / {PLUS_CONST_GRID - 1} AS y0
                  FROM pts p JOIN (SELECT model_type, min(y) AS ymin FROM pts GROUP BY 1) USING (model_type),
                       range({PLUS_CONST_GRID}) r(k))""",
        """fits AS (SELECT model_type, k, y0, sum(w) AS n, sum(w * ln(x)) AS sx, sum(w * ln(y - y0)) AS sy,
                    sum(w * ln(x) * ln(x)) AS sxx, sum(w * ln(x) * ln(y - y0)) AS sxy
                    FROM g GROUP BY 1, 2, 3 HAVING min(y - y0) > 0)""",
        """ab AS (SELECT *, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b FROM fits)""",
        """ab2 AS (SELECT model_type, k, y0, b, exp((sy - b * sx) / n) AS a FROM ab)""",
        """mse AS (SELECT model_type, k, y0, a, b, sum(w * (y - (a * pow(x, b) + y0)) * (y - (a * pow(x, b) + y0))) / sum(w) AS mse
                   FROM g JOIN ab2 USING (model_type, k, y0) GROUP BY 1, 2, 3, 4, 5)""",
    )
    + """
SELECT model_type, round(a, 6) AS a, round(b, 6) AS b, round(y0, 6) AS y0, round(mse, 9) AS mse
FROM (SELECT *, row_number() OVER (PARTITION BY model_type ORDER BY mse, k) AS rn FROM mse) WHERE rn = 1""",
)
def power_law_plus_constant(spark: SparkSession, d: str) -> DataFrame:
    r = _runs_with_fps(spark, d).withColumn("params", F.col("params").cast("double"))
    f = an.power_law_plus_constant_fit(r, ["model_type"], "params", "final_val_nll", grid=PLUS_CONST_GRID)
    return f.select("model_type", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.round("y0", 6).alias("y0"),
                    F.round("mse", 9).alias("mse"))


@query(
    "lineitem_power_law",
    "AGG-13",
    """
SELECT l_returnflag, round(exp(regr_intercept(ln(l_extendedprice), ln(l_quantity))), 6) AS a,
       round(regr_slope(ln(l_extendedprice), ln(l_quantity)), 6) AS b, CAST(count(*) AS BIGINT) AS n
FROM lineitem GROUP BY l_returnflag""",
)
def lineitem_power_law(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    f = an.power_law_fit(li, ["l_returnflag"], "l_quantity", "l_extendedprice")
    return f.select("l_returnflag", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.col("n").cast("bigint"))


@query(
    "lineitem_within_bounds",
    "JOI-3 FIL-9",
    """
WITH b AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.1) AS lo, quantile_cont(l_extendedprice, 0.9) AS hi
           FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(lo, 6) AS lo, round(hi, 6) AS hi, CAST(count(*) AS BIGINT) AS n_kept
FROM lineitem JOIN b USING (l_returnflag) WHERE l_extendedprice BETWEEN lo AND hi GROUP BY 1, 2, 3""",
)
def lineitem_within_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Per-flag price bounds (10th/90th percentile) joined back; rows inside both ends kept."""
    li = read_table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice")
    b = an.group_bounds(li, ["l_returnflag"], "l_extendedprice", 0.1, 0.9)
    k = an.within_group_bounds(li, b, ["l_returnflag"], "l_extendedprice")
    return k.groupBy("l_returnflag", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi")).agg(
        F.count(F.lit(1)).alias("n_kept")
    )


@query(
    "masked_mean_by_user",
    "AGG-18",
    """
SELECT user_id, round(sum(value * CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END
                              * CASE WHEN event_type = 'purchase' THEN 2.0 ELSE 1.0 END)
                      / (sum(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) + 0.01), 6) AS masked_mean
FROM events GROUP BY user_id""",
)
def masked_mean_by_user(spark: SparkSession, d: str) -> DataFrame:
    """Error events masked out, purchases weighted double."""
    e = read_table(spark, d, "events")
    m = an.masked_weighted_mean(
        e, ["user_id"], "value", F.col("event_type") != "error",
        F.when(F.col("event_type") == "purchase", 2.0).otherwise(1.0),
    )
    return m.select("user_id", F.round("masked_mean", 6).alias("masked_mean"))


@query(
    "metric_bucket_means",
    "AGG-19",
    with_ctes(fx.METRICS_SQL) + f"""
SELECT run_id, name, bucket, round(avg(value), 6) AS mean, CAST(count(*) AS BIGINT) AS n
FROM (SELECT *, CASE WHEN step = 0 THEN 0 ELSE CAST(floor(step / {BUCKET_EVERY}) AS BIGINT) + 1 END AS bucket FROM metrics)
GROUP BY run_id, name, bucket
HAVING bucket = 0 OR max(step) % {BUCKET_EVERY} = {BUCKET_EVERY - 1}""",
)
def metric_bucket_means(spark: SparkSession, d: str) -> DataFrame:
    b = an.bucket_means(fx.metrics(spark, d), BUCKET_EVERY)
    return b.select("run_id", "name", "bucket", F.round("mean", 6).alias("mean"), F.col("n").cast("bigint"))


@query(
    "event_type_kl",
    "AGG-20",
    """
WITH g AS (SELECT avg(value) AS mq, stddev_pop(value) AS sq FROM events),
t AS (SELECT event_type, avg(value) AS mp, stddev_pop(value) AS sp FROM events GROUP BY 1)
SELECT event_type, round(ln(sq) - ln(sp) + (sp * sp + (mp - mq) * (mp - mq)) / (2 * sq * sq) - 0.5, 6) AS kl
FROM t, g""",
)
def event_type_kl(spark: SparkSession, d: str) -> DataFrame:
    """KL of each event type's value distribution (as a normal) from the whole table's."""
    e = read_table(spark, d, "events").select("event_type", "value")
    mq, sq = e.agg(F.avg("value"), F.stddev_pop("value")).first()  # two numbers
    t = e.groupBy("event_type").agg(F.avg("value").alias("mp"), F.stddev_pop("value").alias("sp"))
    return t.select("event_type", F.round(an.gaussian_kl(F.col("mp"), F.col("sp"), F.lit(mq), F.lit(sq)), 6).alias("kl"))


@query(
    "user_quantile_clip",
    "AGG-22",
    """
WITH s AS (SELECT user_id, greatest(quantile_cont(abs(value), 0.9), 20.0) AS s FROM events GROUP BY 1)
SELECT event_id, round(least(greatest(value, -s), s) / s, 6) AS clipped FROM events JOIN s USING (user_id)""",
)
def user_quantile_clip(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").select("event_id", "user_id", "value")
    c = an.quantile_clip(e, ["user_id"], "value", 0.9, 20.0)
    return c.select("event_id", F.round("clipped", 6).alias("clipped"))


@query(
    "rolling_quantile",
    "WIN-7",
    with_ctes(fx.METRICS_SQL) + """
SELECT run_id, step, round(q, 6) AS q, round(CASE WHEN q IS NULL THEN value ELSE least(value, q) END, 6) AS clipped
FROM (SELECT *, quantile_cont(value, 0.95) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN 1000 PRECEDING AND 1 PRECEDING) AS q
      FROM metrics)""",
)
def rolling_quantile(spark: SparkSession, d: str) -> DataFrame:
    # metric steps are dense per run (0, 1, 2, ...), so no re-ranking
    r = an.rolling_quantile_clip(fx.metrics(spark, d), ["run_id"], "step", "value", 0.95, 1000, dense_order=True)
    return r.select("run_id", "step", F.round("q", 6).alias("q"), F.round("clipped", 6).alias("clipped"))


@query(
    "rolling_quantile_filled",
    "WIN-7",
    with_ctes(
        fx.METRICS_SQL,
        """h AS (SELECT *, coalesce(list(value) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN 1000 PRECEDING AND 1 PRECEDING), [])
                 AS hist FROM metrics)""",
        """b AS (SELECT *, list_sort(list_concat(hist, list_transform(range(1000 - len(hist)), lambda x: 1e8))) AS buf FROM h)""",
        """p AS (SELECT *, 999 * 0.95 AS pos FROM b)""",
    )
    + """
SELECT run_id, step,
       round(buf[CAST(floor(pos) AS INTEGER) + 1] + (buf[CAST(ceil(pos) AS INTEGER) + 1] - buf[CAST(floor(pos) AS INTEGER) + 1]) * (pos - floor(pos)), 6) AS q,
       round(least(value, buf[CAST(floor(pos) AS INTEGER) + 1] + (buf[CAST(ceil(pos) AS INTEGER) + 1] - buf[CAST(floor(pos) AS INTEGER) + 1]) * (pos - floor(pos))), 6) AS clipped
FROM p""",
)
def rolling_quantile_filled(spark: SparkSession, d: str) -> DataFrame:
    """Ring-buffer form: the history starts as 1000 copies of 1e8."""
    r = an.rolling_quantile_clip(fx.metrics(spark, d), ["run_id"], "step", "value", 0.95, 1000, fill=1e8, dense_order=True)
    return r.select("run_id", "step", F.round("q", 6).alias("q"), F.round("clipped", 6).alias("clipped"))


@query(
    "ema_metrics",
    "WIN-8",
    with_ctes(
        fx.METRICS_SQL,
        f"""e AS (SELECT run_id, step,
            pow({EMA_BETA}, step + 1) * sum(value * pow({EMA_BETA}, -(step + 1))) OVER w AS s1,
            pow({EMA_BETA}, step + 1) * sum(value * value * pow({EMA_BETA}, -(step + 1))) OVER w AS s2
          FROM metrics WINDOW w AS (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
        f"""m AS (SELECT run_id, step,
            (1e-8 * pow({EMA_BETA}, step + 1) + {1 - EMA_BETA!r} * s1) / (1e-8 * pow({EMA_BETA}, step + 1) + 1 - pow({EMA_BETA}, step + 1)) AS mean,
            (1e-8 * pow({EMA_BETA}, step + 1) + {1 - EMA_BETA!r} * s2) / (1e-8 * pow({EMA_BETA}, step + 1) + 1 - pow({EMA_BETA}, step + 1)) AS sq
          FROM e)""",
    )
    + """
SELECT run_id, step, round(mean, 6) AS ema_mean, round(sqrt(greatest(sq - mean * mean, 0)), 6) AS ema_std FROM m""",
)
def ema_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = an.ema_stats(fx.metrics(spark, d), ["run_id"], "step", "value", EMA_BETA, dense_order=True)
    return e.select("run_id", "step", F.round("ema_mean", 6).alias("ema_mean"), F.round("ema_std", 6).alias("ema_std"))


INTERP_SQL = f"""
WITH kp AS (SELECT user_id, epoch_us(ts) / 1e6 AS x, value AS y FROM events),
rng AS (SELECT user_id, CAST(floor(min(x) / {PROBE_SECONDS}) AS BIGINT) - 1 AS k0, CAST(floor(max(x) / {PROBE_SECONDS}) AS BIGINT) + 1 AS k1
        FROM kp GROUP BY 1),
pr AS (SELECT user_id, CAST(k * {PROBE_SECONDS} AS DOUBLE) AS x FROM (SELECT user_id, unnest(range(k0, k1 + 1)) AS k FROM rng)),
u AS (SELECT user_id, x, y, 0 AS probe FROM kp UNION ALL SELECT user_id, x, NULL, 1 FROM pr),
nb AS (SELECT *,
  last_value(CASE WHEN probe = 0 THEN x END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY x, probe ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lx,
  last_value(CASE WHEN probe = 0 THEN y END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY x, probe ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ly,
  first_value(CASE WHEN probe = 0 THEN x END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY x, probe ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rx,
  first_value(CASE WHEN probe = 0 THEN y END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY x, probe ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ry
  FROM u),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY x) AS a, row_number() OVER (PARTITION BY user_id ORDER BY x DESC) AS z FROM kp),
ends AS (SELECT user_id,
  max(CASE WHEN a = 1 THEN x END) AS fx0, max(CASE WHEN a = 1 THEN y END) AS fy0,
  coalesce(max(CASE WHEN a = 2 THEN x END), max(CASE WHEN a = 1 THEN x END)) AS fx1, coalesce(max(CASE WHEN a = 2 THEN y END), max(CASE WHEN a = 1 THEN y END)) AS fy1,
  coalesce(max(CASE WHEN z = 2 THEN x END), max(CASE WHEN z = 1 THEN x END)) AS lx0, coalesce(max(CASE WHEN z = 2 THEN y END), max(CASE WHEN z = 1 THEN y END)) AS ly0,
  max(CASE WHEN z = 1 THEN x END) AS lx1, max(CASE WHEN z = 1 THEN y END) AS ly1 FROM r GROUP BY 1),
seg AS (SELECT nb.user_id, nb.x,
  CASE WHEN lx IS NULL THEN fx0 WHEN rx IS NULL THEN ends.lx0 ELSE lx END AS x0,
  CASE WHEN lx IS NULL THEN fy0 WHEN rx IS NULL THEN ends.ly0 ELSE ly END AS y0,
  CASE WHEN lx IS NULL THEN fx1 WHEN rx IS NULL THEN ends.lx1 ELSE rx END AS x1,
  CASE WHEN lx IS NULL THEN fy1 WHEN rx IS NULL THEN ends.ly1 ELSE ry END AS y1
  FROM nb JOIN ends USING (user_id) WHERE probe = 1)
SELECT user_id, CAST(x AS BIGINT) AS t, round(y0 + coalesce((x - x0) * (y1 - y0) / nullif(x1 - x0, 0), 0), 6) AS value FROM seg"""


@query("interpolate_user_values", "JOI-9", INTERP_SQL)
def interpolate_user_values(spark: SparkSession, d: str) -> DataFrame:
    """Each user's value series read at a 6-hour grid spanning one step
    beyond its first and last event (end segments extended)."""
    e = read_table(spark, d, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("x"), F.col("value").alias("y"))
    rng = e.groupBy("user_id").agg(
        (F.floor(F.min("x") / PROBE_SECONDS) - 1).alias("k0"), (F.floor(F.max("x") / PROBE_SECONDS) + 1).alias("k1")
    )
    probes = rng.select("user_id", F.explode(F.sequence("k0", "k1")).alias("k")).select(
        "user_id", (F.col("k") * PROBE_SECONDS).cast("double").alias("x")
    )
    out = an.interpolate(e, probes, ["user_id"], "x", "y")
    return out.select("user_id", F.col("x").cast("bigint").alias("t"), F.round("y", 6).alias("value"))
