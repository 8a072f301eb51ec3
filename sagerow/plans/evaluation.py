"""Evaluation queries (P4) over the ``preds`` fixture derived from ``events``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EOS_TOKEN, PAD_TOKEN, SEP_TOKEN
from ..functions import text as tx
from ..operators import evaluate as ev
from ..operators.rank import global_index, round_robin
from ..session import checkpoint_root, cut_lineage
from ..sources.tables import read_table
from . import fixtures as fx
from .registry import query, with_ctes

R = 6  # digits kept for floating results in reports


def _sc(spark: SparkSession, d: str) -> DataFrame:
    out = ev.self_consistency(fx.preds(spark, d))
    return out.withColumn("acc", F.round("acc", R))


SC_SQL = with_ctes(
    fx.PREDS_SQL,
    """ks AS (SELECT range AS k FROM range(1, (SELECT max(run) + 2 FROM preds)))""",
    """cnt AS (SELECT k, task_id, pred, count(*) AS n, min(run) AS f FROM preds JOIN ks ON run < k
               GROUP BY k, task_id, pred)""",
    """votes AS (SELECT k, task_id, pred AS vote,
                 row_number() OVER (PARTITION BY k, task_id ORDER BY n DESC, f DESC) AS rn FROM cnt)""",
    """gold AS (SELECT DISTINCT task_id, gold FROM preds)""",
) + """
SELECT CAST(k AS BIGINT) AS k, CAST(count(*) AS BIGINT) AS total,
       CAST(sum(CASE WHEN vote = gold THEN 1 ELSE 0 END) AS BIGINT) AS correct,
       round(sum(CASE WHEN vote = gold THEN 1 ELSE 0 END) / count(*), 6) AS acc
FROM votes JOIN gold USING (task_id) WHERE rn = 1 GROUP BY k
"""

query("self_consistency_at_k", "AGG-2 AGG-3 JOI-4 WIN-5", SC_SQL)(_sc)


@query(
    "accuracy_by_run",
    "AGG-1 JOI-4",
    with_ctes(fx.PREDS_SQL)
    + """
SELECT run, CAST(count(*) AS BIGINT) AS total,
       CAST(sum(CASE WHEN pred IS NOT DISTINCT FROM gold THEN 1 ELSE 0 END) AS BIGINT) AS correct,
       round(sum(CASE WHEN pred IS NOT DISTINCT FROM gold THEN 1 ELSE 0 END) / count(*), 6) AS acc
FROM preds GROUP BY run""",
)
def accuracy_by_run(spark: SparkSession, d: str) -> DataFrame:
    return ev.accuracy_by_run(fx.preds(spark, d)).withColumn("acc", F.round("acc", R))


@query(
    "accuracy_mean_std",
    "AGG-4 AGG-1",
    with_ctes(
        fx.PREDS_SQL,
        """per_run AS (SELECT run, sum(CASE WHEN pred IS NOT DISTINCT FROM gold THEN 1 ELSE 0 END) / count(*) AS acc
                       FROM preds GROUP BY run)""",
    )
    + """
SELECT CAST(count(*) AS BIGINT) AS runs, round(avg(acc), 6) AS mean_acc, round(stddev_pop(acc), 6) AS std_acc
FROM per_run""",
)
def accuracy_mean_std(spark: SparkSession, d: str) -> DataFrame:
    m = ev.mean_std(ev.accuracy_by_run(fx.preds(spark, d)))
    return m.select(F.col("runs").cast("bigint"), F.round("mean_acc", R).alias("mean_acc"), F.round("std_acc", R).alias("std_acc"))


@query(
    "majority_vote",
    "AGG-2",
    with_ctes(
        fx.PREDS_SQL,
        """cnt AS (SELECT task_id, pred, count(*) AS n, min(run) AS f FROM preds GROUP BY task_id, pred)""",
        """ranked AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY n DESC, f DESC) AS rn,
                     sum(n) OVER (PARTITION BY task_id) AS total FROM cnt)""",
    )
    + """
SELECT task_id, pred AS vote, CAST(n AS BIGINT) AS votes, CAST(total AS BIGINT) AS n_preds FROM ranked WHERE rn = 1""",
)
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    v = ev.majority_vote(fx.preds(spark, d))
    return v.select("task_id", "vote", F.col("votes").cast("bigint"), F.col("n_preds").cast("bigint"))


@query(
    "vote_first_5_runs",
    "WIN-5 AGG-2",
    with_ctes(
        fx.PREDS_SQL,
        """cnt AS (SELECT task_id, pred, count(*) AS n, min(run) AS f FROM preds WHERE run < 5 GROUP BY task_id, pred)""",
        """ranked AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY n DESC, f DESC) AS rn FROM cnt)""",
    )
    + """
SELECT task_id, pred AS vote, CAST(n AS BIGINT) AS votes FROM ranked WHERE rn = 1""",
)
def vote_first_5_runs(spark: SparkSession, d: str) -> DataFrame:
    v = ev.majority_vote(ev.first_k_runs(fx.preds(spark, d), 5))
    return v.select("task_id", "vote", F.col("votes").cast("bigint"))


@query(
    "gold_per_task",
    "JOI-5 JOI-4",
    with_ctes(fx.PREDS_SQL)
    + """
SELECT task_id, CAST(count(*) AS BIGINT) AS n_preds, max(gold) AS gold FROM preds GROUP BY task_id
HAVING count(DISTINCT gold) <= 1""",
)
def gold_per_task(spark: SparkSession, d: str) -> DataFrame:
    return ev.check_one_gold(fx.preds(spark, d)).select("task_id", F.col("n_preds").cast("bigint"), "gold")


# ---- decorated completions: answer extraction (SCA-3/4/5) -------------------

def decorated(spark: SparkSession, d: str) -> DataFrame:
    """Completion texts built from each prediction, covering the marker,
    no-marker and PAD branches of the extractors."""
    p = fx.preds(spark, d)
    branch = F.pmod(F.col("run"), F.lit(3))
    t0 = F.concat(F.lit("q"), F.lit(SEP_TOKEN), F.lit(" "), F.col("pred"), F.lit(" #### 1,"), F.col("task_id").cast("string"),
                  F.lit(" "), F.lit(EOS_TOKEN), F.lit("junk #### 9"))
    t1 = F.concat(F.lit("q "), F.lit(SEP_TOKEN), F.lit(" "), F.col("task_id").cast("string"), F.lit(",000 = 1 + "),
                  F.col("run").cast("string"), F.lit(" +\n"), F.lit(PAD_TOKEN))
    t2 = F.concat(F.col("pred"), F.lit(" ####"), F.lit(SEP_TOKEN), F.lit(" 5,"), F.col("run").cast("string"), F.lit(EOS_TOKEN))
    return p.select("run", "task_id", F.when(branch == 0, t0).when(branch == 1, t1).otherwise(t2).alias("text"))


def _decorated_sql() -> str:
    sep, eos, pad = SEP_TOKEN, EOS_TOKEN, PAD_TOKEN
    return f"""
dec AS (
  SELECT run, task_id,
    CASE run % 3
      WHEN 0 THEN 'q' || '{sep}' || ' ' || pred || ' #### 1,' || CAST(task_id AS VARCHAR) || ' ' || '{eos}' || 'junk #### 9'
      WHEN 1 THEN 'q ' || '{sep}' || ' ' || CAST(task_id AS VARCHAR) || ',000 = 1 + ' || CAST(run AS VARCHAR) || ' +' || chr(10) || '{pad}'
      ELSE pred || ' ####' || '{sep}' || ' 5,' || CAST(run AS VARCHAR) || '{eos}'
    END AS text
  FROM preds),
cut AS (SELECT run, task_id, text, split_part(text, '{eos}', 1) AS t FROM dec)"""


_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _strip(x: str) -> str:
    return _STRIP.format(x=x)


def _extract_sql() -> str:
    after_sep = f"string_split(t, '{SEP_TOKEN}')[-1]"
    s = _strip(after_sep)
    marker_part = _strip(f"replace(substr(t, instr(t, '####') + 4), '{SEP_TOKEN}', '')")
    return with_ctes(fx.PREDS_SQL, _decorated_sql()) + f"""
SELECT run, task_id,
  CASE WHEN instr(t, '####') > 0 THEN replace({marker_part}, ',', '')
       ELSE replace({s}, ',', '') END AS ans_gsm8k,
  CASE WHEN instr({s}, '####') > 0 THEN {_strip(f"string_split({s}, '####')[-1]")}
       ELSE trim(string_split({s}, '=')[-1], ' +') END AS ans_mult,
  replace(replace(text, '{SEP_TOKEN}', ''), '{PAD_TOKEN}', '') AS display
FROM cut
"""


EXTRACT_SQL = _extract_sql()


@query("extract_answers", "SCA-3 SCA-4 SCA-5 SCA-9", EXTRACT_SQL)
def extract_answers(spark: SparkSession, d: str) -> DataFrame:
    t = decorated(spark, d)
    return t.select(
        "run",
        "task_id",
        tx.extract_gsm8k_answer("text").alias("ans_gsm8k"),
        tx.extract_mult_answer("text").alias("ans_mult"),
        tx.strip_special("text").alias("display"),
    )


# ---- limited evaluation, sharding, reductions ----------------------------------

BATCH = 8


@query(
    "limited_eval_accuracy",
    "SRT-4 WIN-1 WIN-9 AGG-1",
    with_ctes(
        fx.PREDS_SQL,
        """tasks AS (SELECT task_id, row_number() OVER (ORDER BY task_id) - 1 AS pos FROM (SELECT DISTINCT task_id FROM preds))""",
    )
    + f"""
SELECT run, CAST(count(*) AS BIGINT) AS total,
       CAST(sum(CASE WHEN pred = gold THEN 1 ELSE 0 END) AS BIGINT) AS correct
FROM preds JOIN tasks USING (task_id) WHERE floor(pos / {BATCH}) <= 5 GROUP BY run""",
)
def limited_eval_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy over the first six test batches (the ``limit`` flag stops
    after batch index 5)."""
    p = fx.preds(spark, d)
    tasks = global_index(p.select("task_id").distinct(), ["task_id"], out="pos")
    batched = tasks.withColumn("batch_id", F.floor(F.col("pos") / BATCH)).filter(F.col("batch_id") <= 5)
    acc = ev.accuracy_by_run(p.join(batched, "task_id"))
    return acc.select("run", F.col("total").cast("bigint"), F.col("correct").cast("bigint"))


@query(
    "preds_by_worker",
    "SRT-7 AGG-5",
    with_ctes(
        fx.PREDS_SQL,
        """tasks AS (SELECT task_id, row_number() OVER (ORDER BY task_id) - 1 AS pos FROM (SELECT DISTINCT task_id FROM preds))""",
    )
    + """
SELECT CAST(pos % 4 AS INTEGER) AS worker, CAST(count(*) AS BIGINT) AS n_preds,
       CAST(count(DISTINCT task_id) AS BIGINT) AS n_tasks
FROM preds JOIN tasks USING (task_id) GROUP BY 1""",
)
def preds_by_worker(spark: SparkSession, d: str) -> DataFrame:
    """Round-robin test sharding over 4 workers by task position; the
    gathered result is the plain union (no sampler padding)."""
    p = fx.preds(spark, d)
    tasks = round_robin(global_index(p.select("task_id").distinct(), ["task_id"], out="pos"), "pos", 4)
    return p.join(tasks, "task_id").groupBy("worker").agg(
        F.count(F.lit(1)).alias("n_preds"), F.count_distinct("task_id").alias("n_tasks")
    )


@query(
    "event_value_reductions",
    "AGG-6 AGG-7",
    """
WITH shard AS (SELECT CAST(event_id % 8 AS INTEGER) AS worker, count(*) AS n, sum(value) AS s, avg(value) AS m
               FROM events GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(s), 4) AS total_value,
       round(avg(m), 6) AS macro_mean, round(sum(s) / sum(n), 6) AS global_mean
FROM shard""",
)
def event_value_reductions(spark: SparkSession, d: str) -> DataFrame:
    """Sum over workers, and the mean of per-worker means next to the global mean."""
    e = read_table(spark, d, "events").select("event_id", "value")
    per = e.groupBy(F.pmod("event_id", F.lit(8)).alias("worker")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.avg("value").alias("m")
    )
    return per.agg(
        F.sum("n").cast("bigint").alias("n"),
        F.round(F.sum("s"), 4).alias("total_value"),
        F.round(F.avg("m"), R).alias("macro_mean"),
        F.round(F.sum("s") / F.sum("n"), R).alias("global_mean"),
    )


EVAL_LOG_SQL = with_ctes(
    fx.PREDS_SQL,
    """per_run AS (SELECT run, count(*) AS total,
                   sum(CASE WHEN pred IS NOT DISTINCT FROM gold THEN 1 ELSE 0 END) AS correct FROM preds GROUP BY run)""",
) + """
SELECT 'acc' AS metric, CAST(run AS BIGINT) AS k, round(correct / total, 6) AS value FROM per_run
UNION ALL SELECT 'total', CAST(run AS BIGINT), CAST(total AS DOUBLE) FROM per_run
UNION ALL SELECT 'mean_acc', CAST(-1 AS BIGINT), round(avg(correct / total), 6) FROM per_run
UNION ALL SELECT 'std_acc', CAST(-1 AS BIGINT), round(stddev_pop(correct / total), 6) FROM per_run
"""


@query("eval_log", "SNK-5 AGG-1 AGG-4", EVAL_LOG_SQL)
def eval_log(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation log: the runs' rows, then the summary's, appended to one log and read back."""
    per = cut_lineage(ev.accuracy_by_run(fx.preds(spark, d)), "accuracy")  # the log and its summary both read it
    log = f"{checkpoint_root(spark).rstrip('/')}/eval-log-{uuid.uuid4().hex}"
    run_values = F.array(
        F.struct(F.lit("acc").alias("metric"), F.round("acc", R).alias("value")),
        F.struct(F.lit("total").alias("metric"), F.col("total").cast("double").alias("value")),
    )
    append_log(per.select(F.col("run").cast("bigint").alias("k"), F.explode(run_values).alias("v")).select("v.metric", "k", "v.value"), log)
    totals = F.array(
        F.struct(F.lit("mean_acc").alias("metric"), F.round("mean_acc", R).alias("value")),
        F.struct(F.lit("std_acc").alias("metric"), F.round("std_acc", R).alias("value")),
    )
    append_log(ev.mean_std(per).select(F.lit(-1).cast("bigint").alias("k"), F.explode(totals).alias("v")).select("v.metric", "k", "v.value"), log)
    return spark.read.schema("metric string, k bigint, value double").parquet(log)


def append_log(rows: DataFrame, path: str) -> None:
    """Append evaluation rows to the log at ``path`` (SNK-5); earlier rows stay."""
    rows.write.mode("append").parquet(path)
