"""Session helpers.

Library code never creates its own session; it takes the caller's. These
helpers are for scripts and tests, and for finding the shared folder used to
cut lineage in iterative jobs.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(
    cores: int | str = "*", partitions: int = 8, app: str = "sagerow", extra: dict[str, str] | None = None
) -> SparkSession:
    """A local session configured like the test/bench runs, with ``extra`` settings on top."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SAGEROW_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
    )
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_PRIVATE_ROOTS: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    On a cluster this must be set by the operator (a shared file system);
    without it this raises. Only a single-process ``local[...]`` session
    (tests, laptops), whose tasks see the driver's disk, gets a private
    scratch folder instead.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _PRIVATE_ROOTS:
            _PRIVATE_ROOTS[context.applicationId] = tempfile.mkdtemp(prefix="sagerow-ckpt-")
        path = _PRIVATE_ROOTS[context.applicationId]
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(path)
    return path


@contextmanager
def shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    """Spark deletes a query's shuffle files when the query ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut_lineage(df: DataFrame, name: str = "stage", partitions: int | None = None, by: str | None = None) -> DataFrame:
    """Materialise ``df`` as parquet in the shared checkpoint folder and read it back.

    Survives executor loss (the files live on shared storage), unlike
    ``localCheckpoint``. ``partitions`` spreads the rows over that many
    files so later rounds read them in parallel; ``by`` gives each value of
    that column a folder, which a filter on it reads alone. The files are
    zstd, and the shuffle files of the steps before them go with the write.
    """
    spark = df.sparkSession
    root = checkpoint_root(spark).rstrip("/")
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    if partitions:
        df = df.repartition(partitions)
    writer = df.write.mode("overwrite").option("compression", "zstd")
    with shuffles_cleaned(spark):
        (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stage(df: DataFrame) -> None:
    """Delete the folders a ``cut_lineage`` table was read from (once nothing reads it any more)."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
