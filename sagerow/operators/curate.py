"""Synthetic-sample curation (P3): prompts, generation hook, parsing,
first-wins dedup, length and score filters, SFT rows.

Model inference is a user callable run over Arrow batches with
``mapInPandas``; the engine ships no model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import judge_prompt, parse_generation, parse_score, ustrip
from ..session import cut_lineage
from .prefilter import build_filter, may_hold

# ---- fixed values: prompt templates for generation ------------------------------
PROMPT_TEMPLATES = [
    "Solve the following math problem:\n\nQuestion: {}\nAnswer:",
    "Here's a math question for you:\n\nQuestion: {}\nAnswer:",
    "Please provide a detailed solution to the following problem:\n\nQuestion: {}\nAnswer:",
    "Math Challenge:\n\nQuestion: {}\nAnswer:",
    "Can you help me solve this math problem?\n\nQuestion: {}\nAnswer:",
    "Attempt the following math question:\n\nQuestion: {}\nAnswer:",
    "Let's work through this math problem together:\n\nQuestion: {}\nAnswer:",
    "Provide a step-by-step solution for the following math problem:\n\nQuestion: {}\nAnswer:",
]
# ---- end of fixed values -----------------------------------------------------------

MIN_CHARS = 20
DEFAULT_THRESHOLD = 0.7


def templates_df(spark) -> DataFrame:
    """The 8 templates as a table (constant size, safe to broadcast)."""
    rows = [(i, t) for i, t in enumerate(PROMPT_TEMPLATES)]
    return spark.createDataFrame(rows, "template_id int, template string")


def draw_index(seed: int, *cols: str, n: int) -> F.Column:
    """Reproducible uniform draw in [0, n) from md5(seed:cols...)."""
    key = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols])
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint"), F.lit(n)).cast("int")


def attach_prompts(questions: DataFrame, id_cols: list[str], seed: int = 0, q_col: str = "question") -> DataFrame:
    """Pick a template per question by a seeded draw and fill it (JOI-1):
    an equi-join with the 8-row template table."""
    spark = questions.sparkSession
    t = F.broadcast(templates_df(spark))
    q = questions.withColumn("template_id", draw_index(seed, *id_cols, n=len(PROMPT_TEMPLATES)))
    return q.join(t, "template_id").withColumn(
        "prompt", F.replace(F.col("template"), F.lit("{}"), F.col(q_col))
    ).drop("template")


def run_model(
    df: DataFrame,
    fn: Callable[[pd.Series], pd.Series] | None,
    in_col: str,
    out_col: str,
    setup: Callable[[], Callable[[pd.Series], pd.Series]] | None = None,
) -> DataFrame:
    """Apply a user batch callable (prompts → texts) over Arrow batches
    (UDF-1 / UDF-2 hook). Runs where the partitions are; nothing is
    gathered on the driver. ``setup`` runs once per task and returns the
    callable (loading a model there), in place of ``fn``."""
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.StringType())])

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = setup() if setup is not None else fn
        for pdf in it:
            pdf[out_col] = call(pdf[in_col]).astype(object)
            yield pdf

    return df.mapInPandas(batches, schema)


def parse_samples(gen: DataFrame, text_col: str = "text") -> DataFrame:
    """Generation text → (question, answer); malformed texts become empty
    and are dropped (SCA-10, FIL-8)."""
    p = gen.withColumn("_qa", parse_generation(F.col(text_col)))
    return p.select("*", "_qa.question", "_qa.answer").drop("_qa").filter(
        (F.col("question") != "") & (F.col("answer") != "")
    )


def draw_until_valid(
    questions: DataFrame, n: int, make: Callable[[DataFrame], DataFrame], seed: int = 0, oversample: float = 1.5, max_rounds: int = 50
) -> DataFrame:
    """Draw questions until ``n`` valid samples exist (SRT-11): the first n by draw order.

    ``questions`` have a dense 0-based ``pos``; draw i takes the question at
    a seeded position. ``make`` turns rows with ``draw_id`` into valid
    samples (prompt, model, parse). A round draws ``oversample`` times what
    is missing, so the model runs on about that many rows, not on the table;
    rounds repeat until n are valid. Raises if ``max_rounds`` don't suffice."""
    spark = questions.sparkSession
    total = questions.count()
    if not total:
        raise ValueError("no questions to draw from")
    found, have, start = None, 0, 0
    for _ in range(max_rounds):
        size = int((n - have) * oversample) + 1
        draws = spark.range(start, start + size).select(
            F.col("id").alias("draw_id"), (_draw_hash(seed, "id") % F.lit(total)).alias("pos")
        )
        rows = cut_lineage(make(draws.join(questions, "pos").drop("pos")), "drawn-samples")
        have, start = have + rows.count(), start + size
        found = rows if found is None else found.unionByName(rows)
        if have >= n:
            return found.orderBy("draw_id").limit(n)
    raise RuntimeError(f"{have} of {n} samples valid after {start} draws")


def _draw_hash(seed: int, col: str) -> F.Column:
    key = F.concat_ws(":", F.lit(str(seed)), F.col(col).cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def strip_nonempty(df: DataFrame) -> DataFrame:
    """Strip question and answer; keep rows where both are non-empty (FIL-2)."""
    s = df.withColumn("question", ustrip("question")).withColumn("answer", ustrip("answer"))
    return s.filter((F.col("question") != "") & (F.col("answer") != ""))


def dedup_first_wins(df: DataFrame, key: str = "question", order_col: str = "seq") -> DataFrame:
    """Keep the first arrival per key (AGG-9).

    The first position per key is a hash aggregate on the key's 64-bit hash
    and the key itself, pre-reduced before the shuffle; the rows then join
    their first position, so no row is sorted by its text. Of rows that
    share both key and position one stays."""
    hashed = df.withColumn("_h", F.xxhash64(key))
    firsts = hashed.groupBy("_h", key).agg(F.min(order_col).alias("_first"))
    firsts = firsts.select(F.col("_h").alias("_fh"), F.col(key).alias("_fk"), "_first")
    same = (F.col("_h") == F.col("_fh")) & F.col(key).eqNullSafe(F.col("_fk")) & F.col(order_col).eqNullSafe(F.col("_first"))
    kept = hashed.join(firsts, same, "left_semi")
    return kept.dropDuplicates(["_h", order_col, key]).select(*df.columns)


def length_filter(df: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Keep when both texts have at least ``min_chars`` code points (FIL-4)."""
    return df.filter((F.char_length("question") >= min_chars) & (F.char_length("answer") >= min_chars))


def curate(df: DataFrame, min_chars: int = MIN_CHARS, filter_first: bool = False) -> DataFrame:
    """Dedup marks a question seen before the length test, so a short first
    copy removes a later good one (kept); ``filter_first`` flips the order."""
    if filter_first:
        return dedup_first_wins(length_filter(df, min_chars))
    return length_filter(dedup_first_wins(df), min_chars)


def not_seen(new: DataFrame, seen: DataFrame, key: str = "question") -> DataFrame:
    """New samples whose question was not accepted before (JOI-6).

    A Bloom filter of the new questions' hashes goes to the history, so that
    of it only rows that may equal a new question are shuffled; the join
    compares the texts. A batch too large for the filter's bound joins the
    whole history."""
    old = seen.where(F.col(key).isNotNull()).select(F.xxhash64(key).alias("_sh"), F.col(key).alias("_sk"))
    bitmaps = build_filter(new.select(F.xxhash64(key)))
    if bitmaps is not None:
        old = old.where(may_hold(bitmaps, F.col("_sh"), old))
    return new.join(old, (F.xxhash64(new[key]) == F.col("_sh")) & (new[key] == F.col("_sk")), "left_anti")


def score_filter(df: DataFrame, score_text: str, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Parse the judge output; keep ``score/10 >= threshold``; unparsable
    scores (NULL, NaN) are dropped (SCA-8, FIL-5)."""
    s = df.withColumn("score", parse_score(F.col(score_text)))
    return s.filter(F.col("score").isNotNull() & ~F.isnan("score") & (F.col("score") / 10.0 >= threshold))


def judge_inputs(df: DataFrame) -> DataFrame:
    """Judge prompt per sample (SCA-7)."""
    return df.withColumn("judge_prompt", judge_prompt("question", "answer"))


def validate_samples(df: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows with both keys present, and a quarantine with the reason (FIL-6).
    ``strict`` raises on the first bad row instead."""
    bad = F.col("question").isNull() | F.col("answer").isNull()
    reason = F.when(F.col("question").isNull(), "missing question").otherwise("missing answer")
    if strict:
        checked = df.withColumn(
            "question",
            F.when(~bad, F.col("question")).otherwise(
                F.raise_error(F.concat(F.lit("sample is missing 'question' or 'answer' at index "), F.col("seq").cast("string")))
            ),
        )
        return checked, df.limit(0).withColumn("reason", F.lit(None).cast("string"))
    return df.filter(~bad), df.filter(bad).withColumn("reason", reason)
