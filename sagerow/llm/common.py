"""Helpers shared by the operators: staged tables, bounded broadcasts, text batches."""

from __future__ import annotations

import ctypes
import gc
import sys
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_root

#: The six characters ``[\x20\x09-\x0D]`` that separate words in the contracts.
SPACE_BYTES = b" \t\n\x0b\x0c\r"

#: Rows of a (key) table that may be broadcast once its size has been counted.
BROADCAST_ROWS = 200_000


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    What follows starts from files every executor sees, so a lost executor
    costs the tasks that ran on it and nothing before them.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete the folders a staged table was read from (once nothing reads it any more)."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def sized(keys: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """A staged table, hinted for broadcast only if its counted rows stay under ``bound``.

    Above the bound the hint is absent and Spark shuffles both sides.
    """
    return F.broadcast(keys) if keys.count() <= bound else keys


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, one for each of ``names``."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"{n}_"
        taken.add(n.lower())
        out.append(n)
    return out


def unit_hash(seed: str, *cols: Column) -> Column:
    """A uniform double in [0, 1) from the MD5 of the seed and the columns (null reads as 'null').

    The first 13 hex digits (52 bits) fill a double exactly, and any SQL
    engine with MD5 gives the same value.
    """
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's values as bytes; null counts as empty."""
    return [b"" if v is None else v for v in batch.column(column).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ``rows``, so that few texts at a time become Python objects.

    After the last one the worker, which Spark keeps for later tasks, gives
    its freed memory back to the system.
    """
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def groups(texts: list[bytes], most: int = 1 << 19) -> Iterator[list[bytes]]:
    """The texts in order, in runs of about ``most`` bytes (a longer text is a run of its own)."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def over_texts(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    fields: str,
    make: Callable[[], Callable[[list[bytes]], Iterable[list]]],
) -> DataFrame:
    """``id`` plus the columns that ``make()(texts)`` gives for whole texts (UTF-8 bytes).

    ``make`` runs once per task and returns the function for a batch, which
    gives one list per field. One row out for each row in; the id column
    passes through with its type and nulls.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("body"))
    schema = f"doc_id {id_type}, {fields}"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for batch in slices(batches):
            cols = score(texts_of(batch, "body"))
            arrays = [pa.array(c, type=f.type) for c, f in zip(cols, out)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *out.names])

    return src.mapInArrow(run, schema)


def text_key(text_col: str) -> Column:
    """A 64-bit hash of the raw text; with the id it names a row (up to exact repeats)."""
    return F.xxhash64(F.col(text_col))


def without_rows(
    docs: DataFrame, drop: DataFrame, once: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` without the rows named in ``drop``, and one row of each named in ``once``.

    Both are staged tables with columns (i, h): the id and ``text_key`` of
    the row. They are broadcast while their counted size allows, else the
    rows are shuffled to them. All columns of ``docs`` come back unchanged.
    """
    i, h = fresh(docs, "row_i", "row_h")
    rows = docs.withColumn(h, text_key(text_col))

    def keyed(keys: DataFrame) -> DataFrame:
        return sized(keys.select(F.col("i").alias(i), F.col("h").alias(h)))

    def on(left: DataFrame, right: DataFrame) -> Column:
        return (left[h] == right[h]) & left[id_col].eqNullSafe(right[i])

    gone = keyed(drop)
    kept = rows.join(gone, on(rows, gone), "left_anti")
    if once.isEmpty():
        return kept.drop(h)
    twice = keyed(once)
    single = kept.join(twice, on(kept, twice), "left_anti").drop(h)
    repeated = kept.join(twice, on(kept, twice), "left_semi")
    one = repeated.groupBy(id_col, h).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias(i))
    return single.unionByName(one.select(f"{i}.*"))
