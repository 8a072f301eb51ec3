"""Streaming queries: their final output is compared with the batch oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_root
from ..streaming.curation import run_curation_stream
from ..streaming.metrics import run_metric_stream
from . import fixtures as fx
from .analytics import BUCKET_EVERY
from .curation import CURATED_SQL
from .registry import query, with_ctes


@query("stream_curated_samples", "STR-1 AGG-9 FIL-4 FIL-2", CURATED_SQL + "\nSELECT seq, question, answer FROM curated")
def stream_curated_samples(spark: SparkSession, d: str) -> DataFrame:
    """``qa_dup`` arrives in three drops (by seq); after each drop the stream
    catches up. The accepted set equals the batch curation."""
    root = f"{checkpoint_root(spark).rstrip('/')}/str1-{uuid.uuid4().hex}"
    src, out, ck = f"{root}/in", f"{root}/out", f"{root}/ckpt"
    rows = fx.qa_dup(spark, d).select("seq", "question", "answer")
    hi = rows.agg(F.max("seq")).first()[0] + 1  # one number
    cuts = [0, hi // 3, 2 * hi // 3, hi]
    result = None
    for lo, up in zip(cuts, cuts[1:]):
        rows.filter((F.col("seq") >= lo) & (F.col("seq") < up)).write.mode("append").json(src)
        result = run_curation_stream(spark, src, out, ck)
    return result.select(F.col("seq").cast("bigint"), "question", "answer")


@query(
    "stream_metric_buckets",
    "STR-2 AGG-19",
    with_ctes(fx.METRICS_SQL) + f"""
SELECT run_id, name, bucket, round(avg(value), 6) AS mean, CAST(count(*) AS BIGINT) AS n
FROM (SELECT *, CASE WHEN step = 0 THEN 0 ELSE CAST(floor(step / {BUCKET_EVERY}) AS BIGINT) + 1 END AS bucket FROM metrics)
GROUP BY run_id, name, bucket
HAVING bucket = 0 OR max(step) % {BUCKET_EVERY} = {BUCKET_EVERY - 1}""",
)
def stream_metric_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Metric rows arrive in three drops by step; stateful bucket sums in
    update mode; the final state's closed buckets equal the batch means."""
    root = f"{checkpoint_root(spark).rstrip('/')}/str2-{uuid.uuid4().hex}"
    src, out, ck = f"{root}/in", f"{root}/out", f"{root}/ckpt"
    m = fx.metrics(spark, d).select(F.col("run_id").cast("bigint"), F.col("step").cast("bigint"), "name", "value")
    for lo, up in ((0, 30), (30, 60), (60, 1 << 62)):
        m.filter((F.col("step") >= lo) & (F.col("step") < up)).write.mode("append").parquet(src)
    r = run_metric_stream(spark, src, out, ck, BUCKET_EVERY)
    return r.select("run_id", "name", "bucket", F.round("mean", 6).alias("mean"), F.col("n").cast("bigint"))
