"""Incremental sample curation as a Structured Streaming job (STR-1).

Arriving sample files → strip / drop empties → first arrival per question
wins (inside the micro-batch by ``seq``, and against every question seen
in earlier micro-batches) → length filter → append. As in the batch
operator, a question is marked seen before the length test.

Each micro-batch writes its seen questions and accepted rows under its own
``epoch=<id>`` folder with overwrite, so a retried epoch replaces its own
output instead of duplicating it. Seen questions lie in hash buckets, and a
batch reads only the buckets that its own questions fall into. The streaming checkpoint lives in the
shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from ..operators.curate import dedup_first_wins, length_filter, not_seen, strip_nonempty

SEEN_BUCKETS = 64

SAMPLE_STREAM_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("question", T.StringType()),
        T.StructField("answer", T.StringType()),
    ]
)


def _epochs(spark: SparkSession, path: str, schema: str, before: int) -> DataFrame | None:
    """Rows written by earlier epochs, or None before the first write."""
    try:
        df = spark.read.schema(schema).parquet(path)
        df.schema  # resolves the path
    except AnalysisException:
        return None
    return df.filter(F.col("epoch") < before)


def curate_batch(spark: SparkSession, batch: DataFrame, epoch: int, out_dir: str) -> None:
    """One micro-batch of incremental curation."""
    seen_path, acc_path = f"{out_dir}/seen", f"{out_dir}/accepted"
    bucket = F.pmod(F.xxhash64("question"), F.lit(SEEN_BUCKETS)).cast("int").alias("bucket")
    # Deduplicated once: the buckets, the filter of new questions and the join all read it.
    new = dedup_first_wins(strip_nonempty(batch)).select(*batch.columns).persist()
    firsts = new
    seen = _epochs(spark, seen_path, "question string, epoch int, bucket int", epoch)
    if seen is not None:
        touched = [r["bucket"] for r in new.select(bucket).distinct().collect()]  # at most SEEN_BUCKETS numbers
        firsts = not_seen(new, seen.filter(F.col("bucket").isin(touched)))
        firsts = firsts.select(*batch.columns).persist()
    firsts.select("question", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{seen_path}/epoch={epoch}")
    length_filter(firsts).write.mode("overwrite").parquet(f"{acc_path}/epoch={epoch}")
    firsts.unpersist()
    new.unpersist()


def run_curation_stream(
    spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str, files_per_trigger: int | None = None
) -> DataFrame:
    """Process the files that arrived in ``source_dir`` since the last run
    (the checkpoint remembers them), then stop; return all accepted samples.
    Rows of one micro-batch are ordered by ``seq``; across batches, arrival
    order wins."""
    reader = spark.readStream.schema(SAMPLE_STREAM_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    stream = reader.json(source_dir)
    q = (
        stream.writeStream.foreachBatch(lambda b, e: curate_batch(spark, b, int(e), out_dir))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.schema("seq bigint, question string, answer string, epoch int").parquet(f"{out_dir}/accepted").drop("epoch")
