"""Training-run records as JSON lines (SRC-6, SNK-4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RUN_SCHEMA = (
    "run_id bigint, model_type string, dim bigint, n_blocks bigint, n_heads bigint, batch_size bigint, "
    "steps bigint, val_nlls array<double>, final_val_nll double, flops double"
)


def append_runs(runs: DataFrame, path: str) -> None:
    """Append run records; each append adds files, earlier ones stay."""
    runs.write.mode("append").json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run records with the declared schema (no inference)."""
    return spark.read.schema(RUN_SCHEMA).json(path)
