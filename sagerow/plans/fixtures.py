"""Canonical inputs derived from the driver tables.

Each fixture has a Spark builder and the same definition as a SQL CTE so
the DuckDB oracles start from identical rows. Every fixture is a function
of whole driver tables: its size grows with theirs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.rank import global_index
from ..sources.tables import read_table

# ---- fixed values: gold answers for the prediction fixture ----------------
GOLD_CYCLE = ["click", "view", "purchase", "signup", "error"]
# ---------------------------------------------------------------------------


# ---- task_lines: one `src||tgt` line per order (plus malformed lines) ------

def _joined_runs(part: pa.RecordBatch, texts: dict[str, str]) -> pa.RecordBatch:
    """Rows in order: per run of equal keys each text column joined, NULLs left out, and the sum of ``amount``."""
    key = part["l_orderkey"]
    value, missing = key.fill_null(0).to_numpy(), key.is_null().to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.concatenate(([True], (value[1:] != value[:-1]) | (missing[1:] != missing[:-1]))))

    def per_run(x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x.astype(np.int64), starts)

    columns = [key.take(pa.array(starts))]
    for name, sep in texts.items():
        column = part[name]
        kept = per_run(column.is_valid().to_numpy(zero_copy_only=False))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(kept))), pa.int32()), column.drop_null())
        columns.append(pc.if_else(pa.array(kept > 0), pc.binary_join(lists, sep), None))
    amount = part["amount"]
    some = per_run(amount.is_valid().to_numpy(zero_copy_only=False)) > 0
    columns.append(pa.array(per_run(amount.fill_null(0).to_numpy()), mask=~some))
    return pa.RecordBatch.from_arrays(columns, ["l_orderkey", *texts, "total"])


def order_rationales(spark: SparkSession, d: str, texts: Sequence[str] = ("thoughts", "amounts")) -> DataFrame:
    """Per order: ordered thoughts ``<<q*c=q·c>>`` joined by spaces, the amounts joined by plus signs, and the total.

    The lines are dealt by order and sorted once; a run of lines is joined
    where it lies, so no list is aggregated or shuffled.
    """
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    li = read_table(spark, d, "lineitem").select("l_orderkey", *order)
    li = li.repartition("l_orderkey").sortWithinPartitions("l_orderkey", *order)
    q = F.col("l_quantity").cast("bigint")
    c = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    made = {
        "thoughts": F.concat(F.lit("<<"), q, F.lit("*"), c, F.lit("="), q * c, F.lit(">>")),
        "amounts": (q * c).cast("string"),
    }
    seps = {name: {"thoughts": " ", "amounts": " + "}[name] for name in texts}
    rows = li.select("l_orderkey", *[made[name].alias(name) for name in texts], (q * c).alias("amount"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last run of a batch, which may go on in the next
        for batch in batches:
            if not len(batch):
                continue
            key = batch.column("l_orderkey")
            last = key[-1]
            same = pc.equal(key, last).fill_null(False) if last.is_valid else key.is_null()
            cut = int(np.flatnonzero(same.to_numpy(zero_copy_only=False))[0])
            if cut or (held and not held[-1]["l_orderkey"][-1].equals(last)):
                done = [*held, batch.slice(0, cut)] if cut else held
                yield _joined_runs(pa.concat_batches(done), seps)
                held = []
            held.append(batch.slice(cut))
        if held:
            yield _joined_runs(pa.concat_batches(held), seps)

    kind = dict(li.dtypes)["l_orderkey"]
    return rows.mapInArrow(run, f"l_orderkey {kind}, {', '.join(f'{name} string' for name in texts)}, total bigint")


def task_lines(spark: SparkSession, d: str) -> DataFrame:
    """(line_no, value): the text-file view of the task set."""
    o = order_rationales(spark, d, ["thoughts"])
    good = F.concat(F.lit("order "), F.col("l_orderkey"), F.lit("||"), F.col("thoughts"), F.lit(" #### "), F.col("total"))
    k = F.col("l_orderkey")
    variants = F.array(
        F.struct(F.lit(0).alias("v"), good.alias("value")),
        F.struct(F.lit(1).alias("v"), F.concat(good, F.lit("||")).alias("value")),
        F.struct(F.lit(2).alias("v"), F.lit("   ").alias("value")),
    )
    keep = F.filter(
        variants,
        lambda s: (s["v"] == 0) | ((s["v"] == 1) & (F.pmod(k, F.lit(10)) == 3)) | ((s["v"] == 2) & (F.pmod(k, F.lit(10)) == 7)),
    )
    return o.select(k, F.explode(keep).alias("s")).select(
        (F.col("l_orderkey") * 3 + F.col("s.v")).cast("bigint").alias("line_no"), F.col("s.value").alias("value")
    )


TASK_LINES_SQL = """
li_t AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
         CAST(l_quantity AS BIGINT) AS q, CAST(round(l_extendedprice * 100) AS BIGINT) AS c
  FROM lineitem),
order_rationales AS (
  SELECT l_orderkey,
         string_agg('<<' || q || '*' || c || '=' || (q * c) || '>>', ' '
                    ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS thoughts,
         string_agg(CAST(q * c AS VARCHAR), ' + '
                    ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS amounts,
         CAST(sum(q * c) AS BIGINT) AS total
  FROM li_t GROUP BY l_orderkey),
task_lines AS (
  SELECT CAST(l_orderkey * 3 AS BIGINT) AS line_no,
         'order ' || l_orderkey || '||' || thoughts || ' #### ' || total AS value FROM order_rationales
  UNION ALL
  SELECT CAST(l_orderkey * 3 + 1 AS BIGINT), 'order ' || l_orderkey || '||' || thoughts || ' #### ' || total || '||'
  FROM order_rationales WHERE l_orderkey % 10 = 3
  UNION ALL
  SELECT CAST(l_orderkey * 3 + 2 AS BIGINT), '   ' FROM order_rationales WHERE l_orderkey % 10 = 7)
"""


# ---- qa: user turn + next assistant turn -------------------------------------

def qa(spark: SparkSession, d: str) -> DataFrame:
    """Question/answer pairs (JOI-10): a ``user`` turn and the next turn of
    the same conversation when it is ``assistant``. A window, not a self-join."""
    conv = read_table(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return (
        conv.withColumn("_nrole", F.lead("role").over(w))
        .withColumn("_ntext", F.lead("text").over(w))
        .filter((F.col("role") == "user") & (F.col("_nrole") == "assistant"))
        .select("conv_id", "turn", F.col("text").alias("question"), F.col("_ntext").alias("answer"))
    )


def mult_lines(spark: SparkSession, d: str) -> DataFrame:
    """(line_no, value) lines in the multiplication form ``a + b + c #### total``."""
    o = order_rationales(spark, d, ["amounts"])
    return o.select(
        F.col("l_orderkey").cast("bigint").alias("line_no"),
        F.concat(F.lit("order "), F.col("l_orderkey"), F.lit("||"), F.col("amounts"), F.lit(" #### "), F.col("total")).alias("value"),
    )


MULT_LINES_SQL = """
mult_lines AS (
  SELECT CAST(l_orderkey AS BIGINT) AS line_no, 'order ' || l_orderkey || '||' || amounts || ' #### ' || total AS value
  FROM order_rationales)
"""


QA_SQL = """
conv_t AS (
  SELECT conv_id, turn, role, text,
         lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nrole,
         lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS ntext
  FROM conversations),
qa AS (
  SELECT conv_id, turn, text AS question, ntext AS answer
  FROM conv_t WHERE role = 'user' AND nrole = 'assistant')
"""


def qa_dup(spark: SparkSession, d: str) -> DataFrame:
    """``qa`` in arrival order ``seq`` with injected repeats: a short padded
    copy before the original (conv_id % 3 = 0), a copy after it (% 3 = 1)
    and a blank-answer copy after it (% 3 = 2)."""
    base = global_index(qa(spark, d), ["conv_id", "turn"], out="pos")
    k = F.pmod(F.col("conv_id"), F.lit(3))
    short = F.concat(F.lit("  "), F.substring("answer", 1, 10), F.lit("\n"))
    rows = F.array(
        F.struct((F.col("pos") * 3 + 1).alias("seq"), F.col("answer").alias("answer"), F.lit(True).alias("keep")),
        F.struct((F.col("pos") * 3).alias("seq"), short.alias("answer"), (k == 0).alias("keep")),
        F.struct((F.col("pos") * 3 + 2).alias("seq"), F.col("answer").alias("answer"), (k == 1).alias("keep")),
        F.struct((F.col("pos") * 3 + 2).alias("seq"), F.lit(" \t ").alias("answer"), (k == 2).alias("keep")),
    )
    return base.select(
        "conv_id", "turn", "question", F.explode(F.filter(rows, lambda r: r["keep"])).alias("r")
    ).select(
        F.col("r.seq").cast("bigint").alias("seq"), "conv_id", "turn", "question", F.col("r.answer").alias("answer")
    )


QA_DUP_SQL = QA_SQL + """,
qa_pos AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS pos FROM qa),
qa_dup AS (
  SELECT CAST(pos * 3 + 1 AS BIGINT) AS seq, conv_id, turn, question, answer FROM qa_pos
  UNION ALL
  SELECT CAST(pos * 3 AS BIGINT), conv_id, turn, question, '  ' || substring(answer, 1, 10) || chr(10)
  FROM qa_pos WHERE conv_id % 3 = 0
  UNION ALL
  SELECT CAST(pos * 3 + 2 AS BIGINT), conv_id, turn, question, answer FROM qa_pos WHERE conv_id % 3 = 1
  UNION ALL
  SELECT CAST(pos * 3 + 2 AS BIGINT), conv_id, turn, question, ' ' || chr(9) || ' ' FROM qa_pos WHERE conv_id % 3 = 2)
"""


# ---- preds: one prediction per (run, task) ----------------------------------

def gold_of(task: F.Column) -> F.Column:
    return F.element_at(F.array(*[F.lit(g) for g in GOLD_CYCLE]), (F.pmod(task, F.lit(len(GOLD_CYCLE))) + 1).cast("int"))


def raw_preds(spark: SparkSession, d: str) -> DataFrame:
    """(run, task_id, pred) from ``events``: run = 0-based position of the
    event inside its user, by (ts, event_id). Distributed per-user rank,
    so a hot user is spread over many tasks."""
    ev = read_table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    r = global_index(ev, ["ts", "event_id"], out="run", partition_by=["user_id"])
    return r.select(
        F.col("run").cast("bigint").alias("run"),
        F.col("user_id").alias("task_id"),
        F.col("event_type").alias("pred"),
    )


def gold_table(spark: SparkSession, d: str) -> DataFrame:
    tasks = read_table(spark, d, "events").select(F.col("user_id").alias("task_id")).distinct()
    return tasks.select("task_id", gold_of(F.col("task_id")).alias("gold"))


def preds(spark: SparkSession, d: str) -> DataFrame:
    """(run, task_id, pred, gold): predictions joined with gold by key (JOI-4)."""
    return raw_preds(spark, d).join(gold_table(spark, d), "task_id")


GOLD_SQL_LIST = "[" + ", ".join(f"'{g}'" for g in GOLD_CYCLE) + "]"

PREDS_SQL = f"""
preds AS (
  SELECT CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS run,
         user_id AS task_id, event_type AS pred,
         {GOLD_SQL_LIST}[CAST(user_id % 5 AS INTEGER) + 1] AS gold
  FROM events)
"""


# ---- metrics: (run_id, step, name, value) ------------------------------------

def metrics(spark: SparkSession, d: str) -> DataFrame:
    ev = read_table(spark, d, "events").select("user_id", "ts", "event_id", "value")
    r = global_index(ev, ["ts", "event_id"], out="step", partition_by=["user_id"])
    return r.select(
        F.col("user_id").alias("run_id"), F.col("step").cast("bigint").alias("step"), F.lit("value").alias("name"), "value"
    )


METRICS_SQL = """
metrics AS (
  SELECT user_id AS run_id,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS step,
         'value' AS name, value
  FROM events)
"""


# ---- runs: training-run records derived from `part` ---------------------------

# A run per part row: model type, shape, FLOP budget, steps and a loss curve
# from a closed form perturbed by the part's price.
RUNS_SQL = """
runs_base AS (
  SELECT p_partkey AS run_id,
         CASE WHEN p_partkey % 2 = 0 THEN 'diffusion' ELSE 'autoregressive' END AS model_type,
         CAST(64 * (1 + p_partkey % 8) AS BIGINT) AS dim,
         CAST(2 + p_size % 10 AS BIGINT) AS n_blocks,
         CAST(1 + p_partkey % 8 AS BIGINT) AS n_heads,
         CAST(CASE WHEN p_partkey % 2 = 0 THEN 128 ELSE 64 END AS BIGINT) AS batch_size,
         1e13 * pow(2.0, 2 * (p_partkey % 5)) AS flops,
         (p_retailprice - floor(p_retailprice)) / 100.0 AS jitter
  FROM part),
runs_fps AS (
  SELECT *, CAST(12 * n_blocks * dim * dim AS DOUBLE) AS params,
         CASE WHEN model_type = 'autoregressive'
              THEN (6.0 * 12 * n_blocks * dim * dim + n_blocks * 256.0 * dim) * 256.0 * batch_size
              ELSE (6.0 * 12 * n_blocks * dim * dim + 2.0 * n_blocks * 256.0 * dim) * (1.0 + 0.33 * 0.25) * 256.0 * batch_size
         END AS fps
  FROM runs_base),
runs AS (
  SELECT run_id, model_type, dim, n_blocks, n_heads, batch_size,
         CAST(floor(flops / fps) AS BIGINT) AS steps,
         CASE WHEN floor(flops / fps) >= 1000
              THEN list_transform(range(1, CAST(floor(floor(flops / fps) / 1000) AS BIGINT) + 1),
                   lambda i: 1.7 + 40.0 * pow(params, -0.3) + 25.0 * pow(1000.0 * i * batch_size * 256.0, -0.2) + jitter)
              ELSE [] END AS val_nlls,
         1.7 + 40.0 * pow(params, -0.3) + 25.0 * pow(greatest(floor(flops / fps), 1) * batch_size * 256.0, -0.2) + jitter
           AS final_val_nll,
         flops
  FROM runs_fps)
"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    part = read_table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    k = F.col("p_partkey")
    base = part.select(
        k.alias("run_id"),
        F.when(F.pmod(k, F.lit(2)) == 0, "diffusion").otherwise("autoregressive").alias("model_type"),
        (64 * (1 + F.pmod(k, F.lit(8)))).cast("bigint").alias("dim"),
        (2 + F.pmod(F.col("p_size"), F.lit(10))).cast("bigint").alias("n_blocks"),
        (1 + F.pmod(k, F.lit(8))).cast("bigint").alias("n_heads"),
        F.when(F.pmod(k, F.lit(2)) == 0, 128).otherwise(64).cast("bigint").alias("batch_size"),
        (F.lit(1e13) * F.pow(F.lit(2.0), 2 * F.pmod(k, F.lit(5)))).alias("flops"),
        ((F.col("p_retailprice") - F.floor("p_retailprice")) / 100.0).alias("jitter"),
    )
    from ..functions.scaling import flops_per_step, param_count

    fps = base.withColumn("params", param_count("n_blocks", "dim").cast("double")).withColumn(
        "fps", flops_per_step("n_blocks", "dim", "batch_size", "model_type")
    )
    steps = F.floor(F.col("flops") / F.col("fps"))
    n_evals = F.floor(steps / 1000).cast("int")

    def loss_at(tokens):
        return F.lit(1.7) + 40.0 * F.pow(F.col("params"), -0.3) + 25.0 * F.pow(tokens, -0.2) + F.col("jitter")

    curve = F.when(
        n_evals >= 1,
        F.transform(
            F.sequence(F.lit(1), F.greatest(n_evals, F.lit(1))),
            lambda i: loss_at(1000.0 * i * F.col("batch_size") * 256.0),
        ),
    ).otherwise(F.array().cast("array<double>"))
    return fps.select(
        "run_id",
        "model_type",
        "dim",
        "n_blocks",
        "n_heads",
        "batch_size",
        steps.cast("bigint").alias("steps"),
        curve.alias("val_nlls"),
        loss_at(F.greatest(steps, F.lit(1)) * F.col("batch_size") * 256.0).alias("final_val_nll"),
        "flops",
    )
