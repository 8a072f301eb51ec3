"""Curation queries (P3) over ``qa`` / ``qa_dup`` (from ``conversations``),
``documents ⋈ labels`` and ``orders``."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays as ar
from ..functions import text as tx
from ..operators import curate as cu
from ..operators import vocab as vb
from ..operators.rank import first_n_of_shuffle, global_index
from ..session import checkpoint_root
from ..sources import samples as ss
from ..sources.tables import read_table
from . import fixtures as fx
from .registry import query, with_ctes
from .tasks import GSM_TASKS_SQL, WORD_TOKENS, sql_pieces, sql_split_gsm8k, sql_strip

N_VALID = 100
SFT_MAX_LEN = 512
JUDGE_THRESHOLD = 0.8


# ---- deterministic stand-ins for the model callables (tests, registry) ------------

def demo_generator(prompts: pd.Series) -> pd.Series:
    """Prompt → completion. Some completions repeat ``Answer:`` and some
    lose it, so the parser's drop rules are exercised."""
    n = prompts.str.len()
    out = prompts + " The answer is " + n.astype(str) + " after careful steps."
    out = out.where(n % 7 != 0, out + "\nAnswer: again")
    return out.where(n % 11 != 0, prompts.str.replace("Answer:", "Reply:", regex=False) + " no marker")


def demo_judge(prompts: pd.Series) -> pd.Series:
    """Judge prompt → prompt followed by a score."""
    return prompts + " " + (prompts.str.len() % 11).astype(str)


# ---- SQL mirrors ----------------------------------------------------------------------

def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


TEMPLATES_SQL = "templates AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {_sql_str(t)})" for i, t in enumerate(cu.PROMPT_TEMPLATES)
) + ") AS t(template_id, template))"


def _sql_draw(seed: int, *cols: str, n: int) -> str:
    key = f"'{seed}:' || " + " || ':' || ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return f"CAST(CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT) % {n} AS INTEGER)"


GEN_SQL = with_ctes(
    fx.QA_SQL,
    TEMPLATES_SQL,
    f"""qa_draw AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS draw_id,
                   {_sql_draw(0, 'conv_id', 'turn', n=8)} AS template_id FROM qa)""",
    """prompts AS (SELECT draw_id, conv_id, turn, replace(template, '{}', question) AS prompt
                  FROM qa_draw JOIN templates USING (template_id))""",
    """gen AS (SELECT draw_id, CASE
         WHEN length(prompt) % 11 = 0 THEN replace(prompt, 'Answer:', 'Reply:') || ' no marker'
         WHEN length(prompt) % 7 = 0 THEN prompt || ' The answer is ' || length(prompt) || ' after careful steps.' || chr(10) || 'Answer: again'
         ELSE prompt || ' The answer is ' || length(prompt) || ' after careful steps.' END AS text FROM prompts)""",
    f"""parsed AS (SELECT draw_id,
         {sql_strip("replace(split_part(text, 'Answer:', 1), 'Question:', '')")} AS question,
         {sql_strip("split_part(text, 'Answer:', 2)")} AS answer
       FROM gen WHERE len(string_split(text, 'Answer:')) = 2)""",
)


def generated(spark: SparkSession, d: str) -> DataFrame:
    q = global_index(fx.qa(spark, d), ["conv_id", "turn"], out="draw_id")
    p = cu.attach_prompts(q, ["conv_id", "turn"], seed=0)
    g = cu.run_model(p.select("draw_id", "conv_id", "turn", "prompt"), demo_generator, "prompt", "text")
    return cu.parse_samples(g)


@query(
    "generated_questions",
    "JOI-1 UDF-1 SCA-10 FIL-8",
    GEN_SQL + "\nSELECT draw_id, question, answer FROM parsed WHERE question <> '' AND answer <> ''",
)
def generated_questions(spark: SparkSession, d: str) -> DataFrame:
    """Every question once: a prompt from the template table, the generator
    callable over Arrow batches, parse and drop malformed texts."""
    return generated(spark, d).select(F.col("draw_id").cast("bigint"), "question", "answer")


# Draws as the loop makes them; far more than N valid samples need.
DRAWN_SQL = GEN_SQL.replace(
    "FROM qa)",
    """FROM qa),
qa_drawn AS (SELECT i AS draw_id, q.conv_id, q.turn, q.question, q.template_id FROM range(20 * """ + str(N_VALID) + """) t(i)
             JOIN qa_draw q ON q.draw_id = CAST('0x' || substr(md5('5:' || CAST(i AS VARCHAR)), 1, 8) AS BIGINT) % (SELECT count(*) FROM qa))""",
    1,
).replace("FROM qa_draw JOIN templates", "FROM qa_drawn JOIN templates")


@query(
    "generated_samples",
    "JOI-1 UDF-1 SCA-10 FIL-8 SRT-11",
    DRAWN_SQL + f"\nSELECT draw_id, question, answer FROM parsed WHERE question <> '' AND answer <> '' ORDER BY draw_id LIMIT {N_VALID}",
)
def generated_samples(spark: SparkSession, d: str) -> DataFrame:
    """Seeded draws of questions, prompted and generated round by round until
    N samples are valid; the model runs on the draws alone."""
    q = global_index(fx.qa(spark, d), ["conv_id", "turn"], out="pos")

    def make(draws: DataFrame) -> DataFrame:
        p = cu.attach_prompts(draws, ["conv_id", "turn"], seed=0)
        return cu.parse_samples(cu.run_model(p.select("draw_id", "prompt"), demo_generator, "prompt", "text"))

    return cu.draw_until_valid(q, N_VALID, make, seed=5).select(F.col("draw_id").cast("bigint"), "question", "answer")


CURATED_SQL = with_ctes(
    fx.QA_DUP_SQL,
    f"""clean AS (SELECT seq, {sql_strip('question')} AS question, {sql_strip('answer')} AS answer FROM qa_dup)""",
    """ne AS (SELECT * FROM clean WHERE question <> '' AND answer <> '')""",
    """firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY seq) AS rn FROM ne) WHERE rn = 1)""",
    """curated AS (SELECT seq, question, answer FROM firsts WHERE length(question) >= 20 AND length(answer) >= 20)""",
)


def curated(spark: SparkSession, d: str) -> DataFrame:
    s = cu.strip_nonempty(fx.qa_dup(spark, d).select("seq", "question", "answer"))
    return cu.curate(s)


@query("curated_samples", "FIL-2 SCA-9 AGG-9 FIL-4", CURATED_SQL + "\nSELECT seq, question, answer FROM curated")
def curated_samples(spark: SparkSession, d: str) -> DataFrame:
    """Strip, drop empties, first arrival per question wins, then length ≥ 20."""
    return curated(spark, d)


UNSEEN_SQL = with_ctes(
    fx.QA_DUP_SQL,
    f"""clean AS (SELECT seq, {sql_strip('question')} AS question, {sql_strip('answer')} AS answer FROM qa_dup)""",
    """ne AS (SELECT * FROM clean WHERE question <> '' AND answer <> '')""",
    """cut AS (SELECT max(seq) / 2 AS m FROM qa_dup)""",
    """b1 AS (SELECT * FROM ne, cut WHERE seq <= m)""",
    """b2 AS (SELECT seq, question, answer FROM ne, cut WHERE seq > m)""",
    """seen AS (SELECT question FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY seq) rn FROM b1)
               WHERE rn = 1 AND length(question) >= 20 AND length(answer) >= 20)""",
) + "\nSELECT seq, question, answer FROM b2 WHERE question NOT IN (SELECT question FROM seen)"


@query("unseen_samples", "JOI-6", UNSEEN_SQL)
def unseen_samples(spark: SparkSession, d: str) -> DataFrame:
    """Second batch minus questions accepted from the first batch."""
    s = cu.strip_nonempty(fx.qa_dup(spark, d).select("seq", "question", "answer"))
    # the batch boundary is one number
    m = fx.qa_dup(spark, d).agg(F.max("seq")).first()[0] / 2
    b1 = s.filter(F.col("seq") <= F.lit(m))
    b2 = s.filter(F.col("seq") > F.lit(m))
    return cu.not_seen(b2, cu.curate(b1))


JUDGED_SQL = CURATED_SQL + """,
judged AS (SELECT seq, 'Evaluate the quality of the following QA pair:' || chr(10) || chr(10) || 'Question: ' || question
                 || chr(10) || 'Answer: ' || answer || chr(10) || chr(10) || 'Quality (1-10):' AS prompt FROM curated),
scored AS (SELECT seq, CAST(length(prompt) % 11 AS DOUBLE) AS score FROM judged)
"""


def judged(spark: SparkSession, d: str) -> DataFrame:
    j = cu.judge_inputs(curated(spark, d))
    out = cu.run_model(j.select("seq", "judge_prompt"), demo_judge, "judge_prompt", "judgement")
    return cu.score_filter(out, "judgement", JUDGE_THRESHOLD)


@query("judged_samples", "SCA-7 UDF-2 SCA-8 FIL-5", JUDGED_SQL + "\nSELECT seq, score FROM scored WHERE score / 10.0 >= 0.8")
def judged_samples(spark: SparkSession, d: str) -> DataFrame:
    """Judge prompt → judge callable → last token as score → keep ≥ 0.8."""
    return judged(spark, d).select("seq", "score")


@query(
    "funnel_counts",
    "AGG-21",
    with_ctes(JUDGED_SQL.removeprefix("WITH "))
    + """
SELECT (SELECT CAST(count(*) AS BIGINT) FROM qa_dup) AS raw,
       (SELECT CAST(count(*) AS BIGINT) FROM curated) AS clean,
       (SELECT CAST(count(*) AS BIGINT) FROM scored WHERE score / 10.0 >= 0.8) AS verified""",
)
def funnel_counts(spark: SparkSession, d: str) -> DataFrame:
    """raw → clean → verified in one aggregate over a staged union."""
    raw = fx.qa_dup(spark, d).select(F.lit("raw").alias("stage"))
    clean = curated(spark, d).select(F.lit("clean").alias("stage"))
    ver = judged(spark, d).select(F.lit("verified").alias("stage"))
    u = raw.unionByName(clean).unionByName(ver)
    return u.agg(
        F.count(F.when(F.col("stage") == "raw", 1)).alias("raw"),
        F.count(F.when(F.col("stage") == "clean", 1)).alias("clean"),
        F.count(F.when(F.col("stage") == "verified", 1)).alias("verified"),
    )


# score texts attached to documents from their labels
def _score_text_spark() -> F.Column:
    q, t = F.col("quality"), F.col("toxic")
    s = (F.lit(4) + 4 * q).cast("string")
    k = F.pmod(F.col("doc_id"), F.lit(6))
    return (
        F.when(k == 0, F.concat(F.lit("Quality (1-10): "), s))
        .when(k == 1, F.concat(F.lit("Quality (1-10): "), (F.lit(7) - t).cast("string"), F.lit(".0")))
        .when(k == 2, F.concat(F.lit("Quality (1-10): "), s, F.lit("/10")))
        .when(k == 3, F.lit("Quality (1-10): nan"))
        .when(k == 4, F.concat(F.lit("Quality (1-10): "), s, F.lit("d")))
        .otherwise(F.lit("Quality (1-10):  "))
    )


LABEL_SCORE_SQL = """
WITH st AS (
  SELECT d.doc_id, CASE d.doc_id % 6
      WHEN 0 THEN 'Quality (1-10): ' || CAST(4 + 4 * quality AS VARCHAR)
      WHEN 1 THEN 'Quality (1-10): ' || CAST(7 - toxic AS VARCHAR) || '.0'
      WHEN 2 THEN 'Quality (1-10): ' || CAST(4 + 4 * quality AS VARCHAR) || '/10'
      WHEN 3 THEN 'Quality (1-10): nan'
      WHEN 4 THEN 'Quality (1-10): ' || CAST(4 + 4 * quality AS VARCHAR) || 'd'
      ELSE 'Quality (1-10):  ' END AS t
  FROM documents d JOIN labels l USING (doc_id)),
tok AS (SELECT doc_id, string_split_regex(regexp_replace(t, '^\\s+|\\s+$', '', 'g'), '\\s+')[-1] AS last FROM st),
sc AS (SELECT doc_id, CASE WHEN regexp_full_match(last, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')
                          THEN TRY_CAST(last AS DOUBLE) END AS score FROM tok)
SELECT doc_id, score, coalesce(score / 10.0 >= 0.7, false) AS kept FROM sc"""


@query("label_scores", "SCA-8 FIL-5", LABEL_SCORE_SQL)
def label_scores(spark: SparkSession, d: str) -> DataFrame:
    """Score texts from ``labels`` (plain, decimal, ``8/10``, ``nan``,
    ``5d``, empty): parse, then the 0.7 threshold; unparsable → dropped."""
    docs = read_table(spark, d, "documents").select("doc_id")
    lab = read_table(spark, d, "labels")
    j = docs.join(lab, "doc_id").withColumn("t", _score_text_spark())
    s = j.withColumn("score", tx.parse_score("t"))
    kept = F.coalesce(s["score"].isNotNull() & ~F.isnan("score") & (F.col("score") / 10.0 >= 0.7), F.lit(False))
    return s.select("doc_id", "score", kept.alias("kept"))


SFT_SQL = CURATED_SQL + f""",
sft AS (SELECT seq, 'Question: ' || question || chr(10) || 'Answer:' AS prompt,
               'Question: ' || question || chr(10) || 'Answer:' || ' ' || answer AS full_text
        FROM curated),
pieces AS (SELECT seq, kind, unnest(p) AS token, generate_subscripts(p, 1) AS pos
           FROM (SELECT seq, 'p' AS kind, {sql_pieces('prompt')} AS p FROM sft
                 UNION ALL SELECT seq, 'f', {sql_pieces('full_text')} FROM sft)),
vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) + 2 AS INTEGER) AS id
          FROM (SELECT token, count(*) AS n FROM pieces WHERE kind = 'f' GROUP BY token)),
enc AS (SELECT seq, kind, list(id ORDER BY pos) AS ids FROM pieces JOIN vocab USING (token) GROUP BY seq, kind),
pair AS (SELECT f.seq, f.ids AS full_ids, least(len(p.ids), {SFT_MAX_LEN}) AS plen
         FROM enc f JOIN enc p ON f.seq = p.seq AND f.kind = 'f' AND p.kind = 'p'),
padded AS (SELECT seq, plen, least(len(full_ids), {SFT_MAX_LEN}) AS n_real,
                  list_concat(list_slice(full_ids, 1, {SFT_MAX_LEN}),
                              list_transform(range(greatest({SFT_MAX_LEN} - len(full_ids), 0)), lambda x: 2)) AS input_ids
           FROM pair)
"""


@query(
    "sft_rows",
    "SCA-6 SCA-19 TOK-5 JOI-7",
    SFT_SQL
    + f"""
SELECT seq, CAST(plen AS INTEGER) AS prompt_len, CAST(n_real AS INTEGER) AS n_real,
       array_to_string(input_ids, '|') AS input_ids,
       array_to_string(list_transform(input_ids, lambda x, i: CASE WHEN i - 1 < plen THEN -100 ELSE x END), '|') AS labels,
       array_to_string(list_transform(range({SFT_MAX_LEN}), lambda i: CASE WHEN i < n_real THEN 1 ELSE 0 END), '|') AS attention_mask
FROM padded""",
)
def sft_rows(spark: SparkSession, d: str) -> DataFrame:
    """SFT rows: prompt and full text, a piece vocabulary over the full
    texts, encode, truncate/pad to the max length, mask the prompt in labels."""
    c = curated(spark, d)
    t = c.select(
        "seq",
        tx.sft_prompt("question").alias("prompt"),
        tx.sft_full_text("question", "answer").alias("full_text"),
    )
    counts = vb.piece_counts(t, ["full_text"])
    vocab = vb.vocab_from_counts(counts, first_id=3)
    full = vb.encode(t, ["seq"], "full_text", vocab, out="full_ids")
    pr = vb.encode(t, ["seq"], "prompt", vocab, out="prompt_ids")
    j = full.join(pr, "seq").withColumn("plen", F.least(F.size("prompt_ids"), F.lit(SFT_MAX_LEN)))
    r = j.select("seq", "plen", ar.sft_labels("full_ids", "plen", SFT_MAX_LEN, WORD_TOKENS).alias("s"))
    return r.select(
        "seq",
        F.col("plen").cast("int").alias("prompt_len"),
        F.aggregate("s.attention_mask", F.lit(0), lambda a, x: a + x).cast("int").alias("n_real"),
        tx.show_array("s.input_ids").alias("input_ids"),
        tx.show_array("s.labels").alias("labels"),
        tx.show_array("s.attention_mask").alias("attention_mask"),
    )


@query(
    "samples_jsonl_roundtrip",
    "SNK-1 SRC-4 FIL-6",
    with_ctes(fx.QA_DUP_SQL)
    + f"""
SELECT seq, question, CASE WHEN {sql_strip('answer')} = '' THEN NULL ELSE answer END AS answer,
       CASE WHEN {sql_strip('answer')} = '' THEN 'missing answer' ELSE 'ok' END AS status
FROM qa_dup""",
)
def samples_jsonl_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Samples written as UTF-8 JSON lines (blank answers written without
    the key), read back with a declared schema and validated."""
    path = f"{checkpoint_root(spark).rstrip('/')}/samples-{uuid.uuid4().hex}"
    q = fx.qa_dup(spark, d).select(
        "seq", "question", F.when(tx.ustrip("answer") == "", F.lit(None)).otherwise(F.col("answer")).alias("answer")
    )
    ss.write_samples_jsonl(q, path)
    back = ss.read_samples(spark, path, extra_fields=[T.StructField("seq", T.LongType())])
    ok, bad = cu.validate_samples(back)
    return ok.withColumn("status", F.lit("ok")).unionByName(bad.withColumnRenamed("reason", "status")).select(
        "seq", "question", "answer", "status"
    )


@query("samples_csv_roundtrip", "SNK-2", with_ctes(fx.QA_SQL) + "\nSELECT conv_id, turn, question, answer FROM qa")
def samples_csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """QA pairs through CSV with a header and quoted multi-line fields."""
    path = f"{checkpoint_root(spark).rstrip('/')}/samples-csv-{uuid.uuid4().hex}"
    ss.write_samples_csv(fx.qa(spark, d), path)
    return ss.read_samples_csv(spark, path, "conv_id bigint, turn bigint, question string, answer string")


PROG_SQL = f"""
WITH o AS (SELECT o_orderkey,
  CAST('0x' || substr(md5('7:' || CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) AS h1,
  CAST('0x' || substr(md5('7:' || CAST(o_orderkey AS VARCHAR)), 9, 8) AS BIGINT) AS h2,
  CAST('0x' || substr(md5('7:' || CAST(o_orderkey AS VARCHAR)), 17, 8) AS BIGINT) AS h3,
  CAST('0x' || substr(md5('7:' || CAST(o_orderkey AS VARCHAR)), 25, 8) AS BIGINT) AS h4
  FROM orders)
SELECT o_orderkey,
  CASE h3 % 4
    WHEN 0 THEN 'What is ' || CAST(h1 % 100 + 1 AS VARCHAR) || ' plus ' || CAST(h2 % 100 + 1 AS VARCHAR) || '?'
    WHEN 1 THEN 'What is ' || CAST(h1 % 100 + 1 AS VARCHAR) || ' minus ' || CAST(h2 % 100 + 1 AS VARCHAR) || '?'
    WHEN 2 THEN 'What is the product of ' || CAST(h1 % 100 + 1 AS VARCHAR) || ' and ' || CAST(h2 % 100 + 1 AS VARCHAR) || '?'
    ELSE 'What is ' || CAST((h4 % 100 + 1) * (h1 % 10 + 1) AS VARCHAR) || ' divided by ' || CAST(h4 % 100 + 1 AS VARCHAR) || '?'
  END AS question
FROM o"""


def programmatic(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders").select("o_orderkey")
    return ss.programmatic_questions(o, "o_orderkey", seed=7)


@query("programmatic_questions", "SRC-10", PROG_SQL)
def programmatic_questions(spark: SparkSession, d: str) -> DataFrame:
    """One arithmetic question per order, operands from a seeded hash."""
    return programmatic(spark, d)


SEED_SQL = with_ctes(
    fx.QA_SQL,
    "lit AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {_sql_str(q)})" for i, q in enumerate(ss.SAMPLE_QUESTIONS)) + ") AS t(qid, question))",
    "sampled AS (SELECT * FROM qa ORDER BY md5('42:' || CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)), conv_id, turn LIMIT 100)",
    "prog AS (" + PROG_SQL.replace("\n", "\n  ") + ")",
) + """
SELECT 'literal' AS origin, CAST(qid AS BIGINT) AS qid, question FROM lit
UNION ALL SELECT 'sampled', CAST(conv_id * 1000 + turn AS BIGINT), question FROM sampled
UNION ALL SELECT 'programmatic', CAST(o_orderkey AS BIGINT), question FROM prog"""


@query("seed_questions", "SRC-11 SRC-7 SRT-2 SRC-10", SEED_SQL)
def seed_questions(spark: SparkSession, d: str) -> DataFrame:
    """Literal list ∪ first 100 of a seeded shuffle of the QA set ∪ programmatic."""
    lit = ss.sample_questions_df(spark).select(F.lit("literal").alias("origin"), F.col("qid").cast("bigint"), "question")
    qa = fx.qa(spark, d).withColumn("_k", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    top = first_n_of_shuffle(qa, "_k", 100, seed=42)
    sampled = top.select(F.lit("sampled").alias("origin"), (F.col("conv_id") * 1000 + F.col("turn")).cast("bigint").alias("qid"), "question")
    prog = programmatic(spark, d).select(F.lit("programmatic").alias("origin"), F.col("o_orderkey").cast("bigint").alias("qid"), "question")
    return lit.unionByName(sampled).unionByName(prog)


COMBINED_SQL = with_ctes(fx.TASK_LINES_SQL, GSM_TASKS_SQL, CURATED_SQL.removeprefix("WITH ")) + f"""
SELECT task_id, 'original' AS origin, src, CAST(len(tgt) AS INTEGER) AS n_thoughts FROM gsm_tasks
UNION ALL
SELECT CAST(greatest(8000, (SELECT count(*) FROM gsm_tasks)) + row_number() OVER (ORDER BY seq) - 1 AS BIGINT), 'generated', question,
       CAST(len({sql_split_gsm8k('answer')}) AS INTEGER) FROM curated"""


@query("combined_training_set", "SET-1 WIN-2 FIL-2", COMBINED_SQL)
def combined_training_set(spark: SparkSession, d: str) -> DataFrame:
    """Original tasks ∪ curated generated samples; generated ids follow in
    order of the valid rows, from 8000 or the number of originals, whichever
    is larger, so no id occurs twice."""
    from ..config import GENERATED_TASK_ID_START
    from ..sources.tasks import gsm8k_tasks

    orig = gsm8k_tasks(fx.task_lines(spark, d)).select("task_id", F.lit("original").alias("origin"), "src", "tgt")
    first = max(GENERATED_TASK_ID_START, orig.count())
    gen = global_index(curated(spark, d), ["seq"], out="_r").select(
        (F.col("_r") + first).cast("bigint").alias("task_id"),
        F.lit("generated").alias("origin"),
        F.col("question").alias("src"),
        tx.split_gsm8k_target("answer").alias("tgt"),
    )
    u = orig.unionByName(gen)
    return u.select("task_id", "origin", "src", F.size("tgt").cast("int").alias("n_thoughts"))


@query(
    "qa_pairs",
    "JOI-10 SRC-7",
    with_ctes(fx.QA_SQL)
    + """
SELECT conv_id, turn, question, answer,
       CASE WHEN substr(md5('42:' || CAST(conv_id AS VARCHAR)), 1, 1) < '4' THEN 'test' ELSE 'train' END AS split
FROM qa""",
)
def qa_pairs(spark: SparkSession, d: str) -> DataFrame:
    """User turn + next assistant turn, with a seeded conversation-level
    train/test split (a conversation never straddles the split)."""
    q = fx.qa(spark, d)
    key = F.md5(F.concat(F.lit("42:"), F.col("conv_id").cast("string")))
    return q.withColumn("split", F.when(F.substring(key, 1, 1) < "4", "test").otherwise("train"))
