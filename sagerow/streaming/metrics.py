"""Running metric log as a Structured Streaming job (STR-2).

Arriving (run_id, step, name, value) rows are folded into per-bucket sums,
batch by batch. The state between batches is a small table of the buckets
still open and each series' last closed bucket: a bucket whose closing step
has arrived is written out under its batch's ``epoch=<id>`` folder and leaves
the state. A series' steps arrive in order across batches (in any order
inside one), so a row for a bucket at or before the last closed one is late
and left out, as behind a watermark, and an open bucket that a later one
overtakes never closes and is dropped. A batch reads the state its
predecessor wrote and overwrites its own folders, so a repeated batch gives
the same result; states older than the predecessor's are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.analytics import bucket_of
from ..operators.rank import join_null_safe
from ..session import cut_lineage

METRIC_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.LongType()),
        T.StructField("step", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)


STATE = "run_id long, name string, bucket long, s double, n long, last_step long"
SERIES = ["run_id", "name"]


def fold_batch(state: DataFrame, rows: DataFrame, every: int) -> tuple[DataFrame, DataFrame]:
    """(closed, state): the buckets that a batch of rows closes, and the next state.

    State rows without a count mark a series' last closed bucket."""
    new = rows.groupBy(*SERIES, bucket_of("step", every).alias("bucket")).agg(
        F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"), F.max("step").alias("last_step")
    )
    marks = state.where("n is null").select(*SERIES, F.col("bucket").alias("_mark"))
    both = new.unionByName(state.where("n is not null")).groupBy(*SERIES, "bucket")
    merged = both.agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.max("last_step").alias("last_step"))
    on_time = join_null_safe(merged, marks, SERIES, "left").where(F.col("_mark").isNull() | (F.col("bucket") > F.col("_mark")))
    ends = (F.col("bucket") == 0) | (F.pmod(F.col("last_step"), F.lit(every)) == every - 1)
    folded = cut_lineage(on_time.drop("_mark").withColumn("ends", ends), "metric-fold")
    closed = folded.where("ends").drop("ends")
    last = closed.select(*SERIES, "bucket").unionByName(marks.withColumnRenamed("_mark", "bucket"))
    last = last.groupBy(*SERIES).agg(F.max("bucket").alias("_last"))
    still = join_null_safe(folded.where("not ends").drop("ends"), last, SERIES, "left")
    still = still.where(F.col("_last").isNull() | (F.col("bucket") > F.col("_last"))).drop("_last")
    none = {"s": "double", "n": "long", "last_step": "long"}
    return closed, still.unionByName(
        last.select(*SERIES, F.col("_last").alias("bucket"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    )


def run_metric_stream(
    spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str, every: int, files_per_trigger: int | None = None
) -> DataFrame:
    """Stream the metric drops in ``source_dir`` and return the closed
    buckets (run_id, name, bucket, mean, n). ``files_per_trigger`` bounds a
    micro-batch; without it each takes all files that have arrived."""
    reader = spark.readStream.schema(METRIC_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.parquet(source_dir)
    states = f"{checkpoint}-open"

    def write(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        before = f"{states}/epoch={epoch - 1}"
        state = session.read.schema(STATE).parquet(before) if epoch else session.createDataFrame([], STATE)
        closed, state = fold_batch(state, batch, every)
        closed.write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch}")
        state.write.mode("overwrite").parquet(f"{states}/epoch={epoch}")
        old = session._jvm.org.apache.hadoop.fs.Path(f"{states}/epoch={epoch - 2}")
        old.getFileSystem(session._jsc.hadoopConfiguration()).delete(old, True)

    q = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    closed = spark.read.schema(f"{STATE}, epoch long").parquet(out_dir)
    return closed.select("run_id", "name", "bucket", (F.col("s") / F.col("n")).alias("mean"), "n")
