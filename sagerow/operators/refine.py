"""Multi-pass refinement (UDF-3): run a user model over the unfinished rows
for up to ``rounds`` passes; between passes the SEP id is moved behind the
newly written span (SCA-18). A row's passes need no other row, so all of them
run where the row lies: finished rows (FIL-10) leave at once, the others wait
for enough rows of their next pass. The outcome is materialised once in the
shared checkpoint folder, so the model runs once per row and pass, however
often the result is read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.serializers import ArrowStreamPandasSerializer
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from ..config import DEFAULT_TOKENS, Tokens
from ..functions.arrays import finished_lists, shift_sep_to_pad_lists
from ..session import cut_lineage

ModelFn = Callable[[pd.DataFrame], pd.Series]


def _passes(
    batches: Iterator[pa.RecordBatch], frame: Callable[[pa.RecordBatch], pd.DataFrame], model: ModelFn, rounds: int, seq_len: int, ids: str, tokens: Tokens
) -> Iterator[pa.RecordBatch]:
    """Every row with ``finished`` and ``rounds_used``, as soon as it is finished or out of passes.

    Only the model sees pandas rows (made once by ``frame``); the other columns stay in Arrow."""
    waiting: list[list[tuple[pa.RecordBatch, pd.DataFrame]]] = [[] for _ in range(rounds)]  # rows ahead of each pass

    def left(rows: pa.RecordBatch, new: pa.Array, finished: bool, used: int) -> pa.RecordBatch:
        at = rows.schema.get_field_index(ids)
        flags = pa.repeat(pa.scalar(finished), len(rows)), pa.repeat(pa.scalar(used, pa.int32()), len(rows))
        columns = [*rows.columns[:at], new, *rows.columns[at + 1 :], *flags]
        return pa.RecordBatch.from_arrays(columns, [*rows.schema.names, "finished", "rounds_used"])

    def one(r: int) -> Iterator[pa.RecordBatch]:
        rows = pa.concat_batches([x for x, _ in waiting[r]])
        pdf = pd.concat([x for _, x in waiting[r]], ignore_index=True)
        waiting[r] = []
        pdf["round"] = np.int32(r)
        pdf[ids] = model(pdf)
        new = pa.array(pdf[ids], rows.schema.field(ids).type, from_pandas=True)
        new = new.combine_chunks() if isinstance(new, pa.ChunkedArray) else new
        over = finished_lists(new, tokens)
        if over.any():
            yield left(rows.filter(pa.array(over)), new.filter(pa.array(over)), True, r + 1)
        if not over.all():
            rows = rows.filter(pa.array(~over))
            moved = shift_sep_to_pad_lists(new.filter(pa.array(~over)), seq_len, tokens)
            if r + 1 == rounds:
                yield left(rows, moved, False, rounds)
            else:
                pdf = pdf[~over].reset_index(drop=True)
                pdf[ids] = moved.to_pandas()
                waiting[r + 1].append((rows, pdf))

    size = 0
    for batch in batches:
        if not len(batch):
            continue
        waiting[0].append((batch, frame(batch)))
        size = max(size, len(batch))
        for r in range(rounds):  # a later pass starts with a quarter of a batch, which bounds the rows that wait
            if waiting[r] and (r == 0 or sum(len(x) for x, _ in waiting[r]) >= size / 4):
                yield from one(r)
    for r in range(rounds):
        if waiting[r]:
            yield from one(r)


def refine(
    df: DataFrame, model: ModelFn, rounds: int, seq_len: int, ids: str = "ids", tokens: Tokens = DEFAULT_TOKENS
) -> DataFrame:
    """Rows get ``finished`` and ``rounds_used``. ``model`` receives a pandas
    batch (with a ``round`` column) and returns the new id lists."""
    df = df.drop("round", "finished", "rounds_used")
    if rounds <= 0:
        return df.withColumn("finished", F.lit(False)).withColumn("rounds_used", F.lit(0))
    schema = StructType([*df.schema.fields, StructField("finished", BooleanType()), StructField("rounds_used", IntegerType())])
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = ArrowStreamPandasSerializer(zone, True, False)  # pandas columns as mapInPandas has them

        def frame(batch: pa.RecordBatch) -> pd.DataFrame:
            return pd.concat([made.arrow_to_pandas(x, i).rename(n) for i, (n, x) in enumerate(zip(batch.schema.names, batch.columns))], axis=1)

        return _passes(batches, frame, model, rounds, seq_len, ids, tokens)

    return cut_lineage(df.mapInArrow(run, schema), "refine")
