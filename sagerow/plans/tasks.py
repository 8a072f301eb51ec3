"""Task-data queries (P2): task files → tasks → CoT examples → id layouts."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import EOS_TOKEN, Tokens
from ..functions import arrays as ar
from ..functions import text as tx
from ..operators import vocab as vb
from ..operators.rank import global_index
from ..session import checkpoint_root, cut_lineage, drop_stage
from ..sources import tasks as st
from . import fixtures as fx
from .registry import query, with_ctes

# word-level vocabulary built from the task text: specials first
WORD_TOKENS = Tokens(eos_id=0, sep_id=1, pad_id=2)
SEQ_LEN = 256
TEST_SEQ_LEN = 256
BATCH = 8


# ---- SQL building blocks (DuckDB) -------------------------------------------

def sql_split_gsm8k(x: str) -> str:
    s = f"string_split({x}, ' ')"
    head = f"list_slice({s}, 1, greatest(len({s}) - 3, 0))"
    tail = f"array_to_string(list_slice({s}, greatest(len({s}) - 2, 1), len({s})), ' ')"
    return f"list_transform(list_concat({head}, [{tail}]), lambda y: ' ' || y)"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def sql_split_mult(x: str) -> str:
    left = f"string_split({sql_strip(f'split_part({x}, {chr(39)}####{chr(39)}, 1)')}, '+')"
    right = sql_strip(f"split_part({x}, '####', 2)")
    steps = f"list_transform({left}, lambda r, i: {sql_strip('r')} || CASE WHEN i < len({left}) THEN ' + ' ELSE ' = ' END)"
    return f"list_concat({steps}, [{right}])"


def valid_sql(v: str) -> str:
    return f"length({v}) > 0 AND NOT regexp_matches({v}, '^\\s*$') AND len(string_split({v}, '||')) = 2"


GSM_TASKS_SQL = f"""
gsm_tasks AS (
  SELECT CAST(row_number() OVER (ORDER BY line_no) - 1 AS BIGINT) AS task_id,
         split_part(value, '||', 1) AS src,
         {sql_split_gsm8k("split_part(value, '||', 2)")} AS tgt,
         split_part(value, '||', 2) AS tgt_text
  FROM task_lines WHERE {valid_sql('value')})
"""

# White space by code point, as the engine's Unicode class has it.
SQL_WS = r"\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SQL_MARK = "\ue000"
GPT2_NO_LOOKAHEAD = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SQL_WS}\p{{L}}\p{{N}}{SQL_MARK}]+|[{SQL_WS}]+|{SQL_MARK}"
)


def sql_pieces(x: str) -> str:
    """GPT-2 pieces without look-ahead: a white-space run before text is cut
    before its last character by a mark, which is dropped again."""
    pattern = GPT2_NO_LOOKAHEAD.replace("'", "''")
    cut = f"regexp_replace({x}, '([{SQL_WS}]+)([{SQL_WS}])([^{SQL_WS}])', '\\1{SQL_MARK}\\2\\3', 'g')"
    return f"list_filter(regexp_extract_all({cut}, '{pattern}'), lambda q: q <> '{SQL_MARK}')"


# pieces of src (k = 0) and of each thought (k = 1..n) with their positions
TASK_PIECES_SQL = f"""
task_texts AS (
  SELECT task_id, 0 AS k, src AS t FROM gsm_tasks
  UNION ALL
  SELECT task_id, k, t FROM (SELECT task_id, unnest(tgt) AS t, generate_subscripts(tgt, 1) AS k FROM gsm_tasks)),
task_pieces AS (
  SELECT task_id, k, unnest(p) AS token, generate_subscripts(p, 1) AS pos
  FROM (SELECT task_id, k, {sql_pieces('t')} AS p FROM task_texts)),
vocab AS (
  SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) + 2 AS INTEGER) AS id, n
  FROM (SELECT token, count(*) AS n FROM task_pieces GROUP BY token)),
enc AS (
  SELECT task_id, k, list(id ORDER BY pos) AS ids FROM task_pieces JOIN vocab USING (token) GROUP BY task_id, k),
task_ids AS (
  SELECT t.task_id,
         coalesce((SELECT ids FROM enc e WHERE e.task_id = t.task_id AND e.k = 0), []) AS src_ids,
         (SELECT list(ids ORDER BY k) FROM enc e WHERE e.task_id = t.task_id AND e.k > 0) AS tgt_ids_list
  FROM gsm_tasks t)
"""


# ---- Spark building blocks ----------------------------------------------------

def gsm_tasks_df(spark: SparkSession, d: str) -> DataFrame:
    return st.gsm8k_tasks(fx.task_lines(spark, d))


def task_pieces(tasks: DataFrame) -> DataFrame:
    """(task_id, texts): byte-level pieces of the source (first) and of every
    thought, a list a text, from one pass over the tasks where they lie,
    written once to the shared checkpoint folder (the vocabulary and the
    encoding both read it)."""
    none = F.array().cast("array<string>")
    texts = F.transform(F.concat(F.array("src"), "tgt"), lambda t: F.coalesce(tx.byte_level_pieces(t), none))
    return cut_lineage(tasks.select("task_id", texts.alias("texts")), "task-pieces")


def task_vocab(tasks: DataFrame, pieces: DataFrame | None = None) -> DataFrame:
    p = task_pieces(tasks) if pieces is None else pieces
    counts = p.select(F.explode(F.flatten("texts")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return vb.vocab_from_counts(counts, first_id=3)


def task_ids(tasks: DataFrame, vocab: DataFrame | None = None, pieces: DataFrame | None = None) -> DataFrame:
    """(task_id, src_ids, tgt_ids_list): every thought encoded on its own,
    with one join of the rare pieces against the vocabulary."""
    p = task_pieces(tasks) if pieces is None else pieces
    v = task_vocab(tasks, p) if vocab is None else vocab
    ids = vb.encode_lists(p, "task_id", "texts", v)
    if pieces is None:
        drop_stage(p)  # coded, and counted where the vocabulary is our own
    return ids.select(
        "task_id",
        F.get("ids", 0).alias("src_ids"),
        F.slice("ids", F.lit(2), F.size("ids") - 1).alias("tgt_ids_list"),
    )


def ids_of_tasks(spark: SparkSession, d: str) -> DataFrame:
    """``task_ids`` of all tasks; their texts and pieces leave the disk once they are read."""
    tasks = gsm_tasks_df(spark, d)
    pieces = task_pieces(tasks)
    drop_stage(tasks)
    ids = task_ids(tasks, pieces=pieces)
    drop_stage(pieces)
    return ids


# ---- queries ---------------------------------------------------------------------

@query(
    "gsm8k_tasks",
    "SRC-1 FIL-1 SCA-1 WIN-1",
    with_ctes(fx.TASK_LINES_SQL, GSM_TASKS_SQL)
    + """
SELECT task_id, src, CAST(len(tgt) AS INTEGER) AS n_thoughts, array_to_string(tgt, '|') AS thoughts, tgt[-1] AS last_thought
FROM gsm_tasks""",
)
def gsm8k_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Task lines are written as a text file in the shared folder and read
    back through the file-order text source."""
    path = f"{checkpoint_root(spark).rstrip('/')}/task-lines-{uuid.uuid4().hex}"
    fx.task_lines(spark, d).orderBy("line_no").select("value").write.text(path)
    t = st.gsm8k_tasks(st.read_lines(spark, path))
    return t.select(
        "task_id",
        "src",
        F.size("tgt").alias("n_thoughts"),
        F.array_join("tgt", "|").alias("thoughts"),
        F.element_at("tgt", -1).alias("last_thought"),
    )


MULT_SQL = with_ctes(
    fx.TASK_LINES_SQL,
    fx.MULT_LINES_SQL,
    f"""mult_tasks AS (
  SELECT CAST(row_number() OVER (ORDER BY line_no) - 1 AS BIGINT) AS task_id,
         split_part(value, '||', 1) || ' = ' AS src,
         {sql_split_mult("split_part(value, '||', 2)")} AS tgt,
         split_part(value, '||', 2) AS tgt_text
  FROM mult_lines WHERE {valid_sql('value')})""",
) + f"""
SELECT task_id, src, array_to_string(tgt, '|') AS thoughts,
       {sql_strip("string_split(tgt_text, '####')[-1]")} AS gold
FROM mult_tasks"""


@query("multiplication_tasks", "SRC-2 SRC-3 SCA-2 SCA-4", MULT_SQL)
def multiplication_tasks(spark: SparkSession, d: str) -> DataFrame:
    t = st.multiplication_tasks(fx.mult_lines(spark, d))
    return t.select("task_id", "src", F.array_join("tgt", "|").alias("thoughts"), tx.extract_mult_answer("tgt_text").alias("gold"))


@query(
    "cot_examples",
    "WIN-3",
    with_ctes(fx.TASK_LINES_SQL, GSM_TASKS_SQL)
    + """
SELECT task_id, CAST(k - 1 AS INTEGER) AS k,
       src || array_to_string(list_slice(tgt, 1, k - 1), '') AS source,
       tgt[k] AS target,
       CASE WHEN k < len(tgt) THEN tgt[k + 1] END AS next_thought
FROM (SELECT task_id, src, tgt, generate_subscripts(tgt, 1) AS k FROM gsm_tasks)""",
)
def cot_examples(spark: SparkSession, d: str) -> DataFrame:
    """Every CoT prefix of every task: k thoughts join the source, thought k
    is the target and thought k+1 the look-ahead (all k, not one draw)."""
    t = gsm_tasks_df(spark, d)
    e = t.select("task_id", "src", "tgt", F.posexplode("tgt").alias("k", "target"))
    return e.select(
        "task_id",
        F.col("k").cast("int").alias("k"),
        F.concat(F.col("src"), F.array_join(F.slice("tgt", F.lit(1), F.col("k")), "")).alias("source"),
        "target",
        F.get(F.col("tgt"), F.col("k") + 1).alias("next_thought"),
    )


@query(
    "full_targets",
    "WIN-4",
    with_ctes(fx.TASK_LINES_SQL, GSM_TASKS_SQL)
    + f"""
SELECT task_id, src, array_to_string(tgt, '') || '{EOS_TOKEN}' AS target FROM gsm_tasks""",
)
def full_targets(spark: SparkSession, d: str) -> DataFrame:
    """Non-CoT target: all thoughts concatenated, EOS after the last."""
    t = gsm_tasks_df(spark, d)
    return t.select("task_id", "src", F.concat(F.array_join("tgt", ""), F.lit(EOS_TOKEN)).alias("target"))


@query(
    "first_n_tasks",
    "SRT-3",
    with_ctes(fx.TASK_LINES_SQL, GSM_TASKS_SQL) + "\nSELECT task_id, src FROM gsm_tasks WHERE task_id < 100",
)
def first_n_tasks(spark: SparkSession, d: str) -> DataFrame:
    """The first N train rows in file order (N = 100 here)."""
    return st.take_first(gsm_tasks_df(spark, d), 100).select("task_id", "src")


@query(
    "task_vocab",
    "TOK-3 TOK-8",
    with_ctes(fx.TASK_LINES_SQL, GSM_TASKS_SQL, TASK_PIECES_SQL) + "\nSELECT token, id, CAST(n AS BIGINT) AS n FROM vocab",
)
def task_vocab_q(spark: SparkSession, d: str) -> DataFrame:
    v = task_vocab(gsm_tasks_df(spark, d))
    return v.select("token", "id", F.col("n").cast("bigint"))


LAYOUT_SQL = with_ctes(
    fx.TASK_LINES_SQL,
    GSM_TASKS_SQL,
    TASK_PIECES_SQL,
    f"""lay AS (
  SELECT task_id, tgt, src,
         CASE WHEN {SEQ_LEN} - len(tgt) > 0
              THEN list_slice(src_ids, greatest(len(src_ids) - ({SEQ_LEN} - len(tgt)), 0) + 1, len(src_ids))
              ELSE [] END AS src2
  FROM (SELECT task_id, src_ids AS src_ids,
               list_slice(flatten(list_transform(tgt_ids_list, lambda x, i: CASE WHEN i = len(tgt_ids_list) THEN list_concat(x, [0]) ELSE x END)), 1, {SEQ_LEN}) AS tgt,
               src_ids AS src
        FROM task_ids))""",
    """lay2 AS (SELECT task_id, list_concat(src2, [1], tgt) AS ids, len(src2) + 1 AS src_len,
                   CAST(floor(task_id / 8) AS BIGINT) AS batch_id FROM lay)""",
    """lay3 AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS L FROM lay2)""",
) + """
SELECT task_id, batch_id, CAST(L AS INTEGER) AS max_len,
       array_to_string(list_concat(ids, list_transform(range(L - len(ids)), lambda x: 2)), '|') AS ids,
       array_to_string(list_transform(range(L), lambda i: i < len(ids)), '|') AS attn_mask,
       array_to_string(list_transform(range(L), lambda i: i < src_len), '|') AS src_mask,
       list_contains(ids, 0) AS finished
FROM lay3"""


@query("task_token_layout", "TOK-5 JOI-7 SCA-14 SCA-15 SCA-16 SCA-17 WIN-4 WIN-9 FIL-10", LAYOUT_SQL)
def task_token_layout(spark: SparkSession, d: str) -> DataFrame:
    """Training rows: encode, EOS after the last thought, truncate to the
    sequence budget, ``src + SEP + tgt``, batches of 8 padded to the batch max."""
    tk = WORD_TOKENS
    ids = ids_of_tasks(spark, d)
    tgt = F.flatten(ar.with_eos("tgt_ids_list", tk))
    tr = ids.select("task_id", ar.truncate_pair("src_ids", tgt, SEQ_LEN).alias("p"))
    lay = tr.select("task_id", ar.sep_layout("p.src_ids", "p.tgt_ids", tk).alias("l")).select("task_id", "l.ids", "l.src_len")
    lay = lay.withColumn("batch_id", F.floor(F.col("task_id") / BATCH).cast("bigint"))
    lay = lay.withColumnRenamed("ids", "_ids").withColumn("L", F.max(F.size("_ids")).over(Window.partitionBy("batch_id")))
    return lay.select(
        "task_id",
        "batch_id",
        F.col("L").cast("int").alias("max_len"),
        tx.show_long_array(ar.right_pad("_ids", F.col("L"), tk)).alias("ids"),
        tx.show_long_array(ar.length_mask(F.size("_ids"), F.col("L"))).alias("attn_mask"),
        tx.show_long_array(ar.length_mask(F.col("src_len"), F.col("L"))).alias("src_mask"),
        ar.finished("_ids", tk).alias("finished"),
    )


TEST_SQL = with_ctes(
    fx.TASK_LINES_SQL,
    GSM_TASKS_SQL,
    TASK_PIECES_SQL,
    f"""tst AS (
  SELECT task_id, list_concat(src_ids, [1]) AS s, len(src_ids) + 1 AS src_len, tgt_ids_list[1] AS first_thought
  FROM task_ids)""",
    f"""gen AS (
  SELECT task_id, s, src_len,
         list_concat(s, first_thought, list_transform(range({TEST_SEQ_LEN} - len(s) - len(first_thought)), lambda x: 2)) AS g
  FROM tst)""",
    """shifted AS (
  SELECT task_id, s, src_len, g,
         CASE WHEN list_position(g, 2) IS NULL THEN g ELSE list_slice(g, 1, list_position(g, 2) - 1) END AS b FROM gen)""",
    """moved AS (
  SELECT *, list_concat(list_slice(b, 1, list_position(b, 1) - 1), list_slice(b, list_position(b, 1) + 1, len(b)), [1]) AS m
  FROM shifted)""",
) + f"""
SELECT task_id,
       array_to_string(list_concat(s, list_transform(range({TEST_SEQ_LEN} - len(s)), lambda x: 2)), '|') AS ids,
       array_to_string(list_transform(range({TEST_SEQ_LEN}), lambda i: i < src_len), '|') AS src_mask,
       array_to_string(list_concat(m, list_transform(range(greatest({TEST_SEQ_LEN}, len(m)) - len(m)), lambda x: 2)), '|') AS shifted_ids,
       CAST(len(m) AS INTEGER) AS shifted_len
FROM moved"""


@query("test_collation_shift_sep", "FIL-7 SCA-14 SCA-15 SCA-18", TEST_SQL)
def test_collation_shift_sep(spark: SparkSession, d: str) -> DataFrame:
    """Test rows ``src + SEP`` padded to the sequence length (a source that
    does not fit stops the job), then one refinement round: the first thought
    is written after SEP and the SEP is moved to the first pad position."""
    tk = WORD_TOKENS
    ids = strict_test_rows(ids_of_tasks(spark, d), TEST_SEQ_LEN)
    s = F.concat(F.col("src_ids"), F.array(F.lit(tk.sep_id)))
    x = ids.select("task_id", s.alias("s"), (F.size("src_ids") + 1).alias("src_len"), F.get("tgt_ids_list", 0).alias("first"))
    gen = x.withColumn("g", ar.right_pad(F.concat("s", "first"), TEST_SEQ_LEN, tk))
    sh = gen.withColumn("sh", ar.shift_sep_to_pad("g", TEST_SEQ_LEN, tk))
    return sh.select(
        "task_id",
        tx.show_long_array(ar.right_pad("s", TEST_SEQ_LEN, tk)).alias("ids"),
        tx.show_long_array(ar.length_mask("src_len", TEST_SEQ_LEN)).alias("src_mask"),
        tx.show_long_array("sh.ids").alias("shifted_ids"),
        F.size(F.array_remove("sh.mask", False)).cast("int").alias("shifted_len"),
    )


def strict_test_rows(ids: DataFrame, seq_len: int) -> DataFrame:
    """FIL-7 as an error: a source that does not fit ``seq_len - 1`` stops the job."""
    return ids.withColumn(
        "src_ids",
        F.when(F.size("src_ids") < seq_len, F.col("src_ids")).otherwise(
            F.raise_error(F.concat(F.lit(f"seq_len={seq_len} is too short for task "), F.col("task_id").cast("string")))
        ),
    )


@query(
    "length_bucketed_batches",
    "SRT-10 WIN-1 WIN-9",
    with_ctes(fx.TASK_LINES_SQL, GSM_TASKS_SQL, TASK_PIECES_SQL)
    + """
SELECT CAST(floor(pos / 8) AS BIGINT) AS batch_id, CAST(count(*) AS BIGINT) AS n_rows,
       CAST(max(len) AS INTEGER) AS max_len, CAST(sum(max_in - len) AS BIGINT) AS pad_tokens
FROM (SELECT *, max(len) OVER (PARTITION BY floor(pos / 8)) AS max_in FROM (
      SELECT task_id, len(src_ids) + 1 + len(flatten(tgt_ids_list)) + 1 AS len,
             row_number() OVER (ORDER BY len(src_ids) + 1 + len(flatten(tgt_ids_list)) + 1, task_id) - 1 AS pos
      FROM task_ids))
GROUP BY 1""",
)
def length_bucketed_batches(spark: SparkSession, d: str) -> DataFrame:
    """True length-sorted batching: rows ranked by sequence length, batches
    of 8 consecutive ranks, padding measured per batch."""
    ids = ids_of_tasks(spark, d).select(
        "task_id", (F.size("src_ids") + 1 + F.size(F.flatten("tgt_ids_list")) + 1).alias("len")
    )
    r = global_index(ids, ["len", "task_id"], out="pos")
    b = r.withColumn("batch_id", F.floor(F.col("pos") / BATCH).cast("bigint"))
    b = b.withColumn("max_in", F.max("len").over(Window.partitionBy("batch_id")))
    return b.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max("len").cast("int").alias("max_len"),
        F.sum(F.col("max_in") - F.col("len")).cast("bigint").alias("pad_tokens"),
    )


REFINE_LEN = 256
REFINE_ROUNDS = 12


def demo_thought_writer(tokens: Tokens = WORD_TOKENS):
    """Stand-in model for refinement: writes the row's next gold thought
    right after the first SEP (EOS after the last thought), then pads."""

    def flattened(lists) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.concatenate([np.empty(0, np.int32), *lists]).astype(np.int32), np.cumsum(sizes) - sizes, sizes

    def step(pdf):
        ids, start, size = flattened(pdf["ids"])
        head = ar.first_places(ids == tokens.sep_id, start, size) + 1
        if (head > size).any():
            raise ValueError(f"{tokens.sep_id} is not in list")
        turns = [*zip(pdf["tgt_ids_list"], pdf["round"])]
        new, at, wrote = flattened([thoughts[r] if r < len(thoughts) else () for thoughts, r in turns])
        last = np.array([r == len(thoughts) - 1 for thoughts, r in turns], bool)
        length = np.maximum(head + wrote + last, REFINE_LEN)
        begin = np.cumsum(length) - length
        out = np.full(length.sum(), tokens.pad_id, np.int32)
        out[ar.places(begin, head)] = ids[ar.places(start, head)]
        out[ar.places(begin + head, wrote)] = new[ar.places(at, wrote)]
        out[(begin + head + wrote)[last]] = tokens.eos_id
        return pd.Series([out[a:b] for a, b in zip(begin, begin + length)], index=pdf.index, dtype=object)

    return step


REFINE_SQL = with_ctes(fx.TASK_LINES_SQL, GSM_TASKS_SQL, TASK_PIECES_SQL) + f"""
SELECT task_id, CAST(least(n, {REFINE_ROUNDS}) AS INTEGER) AS rounds_used, n <= {REFINE_ROUNDS} AS finished,
       array_to_string(list_concat(x, list_transform(range({REFINE_LEN} - len(x)), lambda y: 2)), '|') AS ids
FROM (SELECT task_id, n,
        CASE WHEN n <= {REFINE_ROUNDS}
             THEN list_concat(src_ids, flatten(list_slice(tgt_ids_list, 1, n - 1)), [1], tgt_ids_list[n], [0])
             ELSE list_concat(src_ids, flatten(list_slice(tgt_ids_list, 1, {REFINE_ROUNDS})), [1]) END AS x
      FROM (SELECT *, len(tgt_ids_list) AS n FROM task_ids))"""


@query("refine_cot", "UDF-3 SCA-18 FIL-10", REFINE_SQL)
def refine_cot(spark: SparkSession, d: str) -> DataFrame:
    """Up to 12 refinement passes over the test rows ``src + SEP``: the model
    writes one thought per pass, finished rows leave the loop, the others
    get their SEP moved behind the new thought."""
    from ..operators.refine import refine

    tk = WORD_TOKENS
    ids = ids_of_tasks(spark, d)
    start = ids.select(
        "task_id", "tgt_ids_list",
        ar.right_pad(F.concat("src_ids", F.array(F.lit(tk.sep_id))), REFINE_LEN, tk).alias("ids"),
    )
    out = refine(start, demo_thought_writer(tk), REFINE_ROUNDS, REFINE_LEN, "ids", tk)
    return out.select("task_id", F.col("rounds_used").cast("int"), "finished", tx.show_long_array("ids").alias("ids"))


def cot_rows(ids: DataFrame, tokens: Tokens, seq_len: int, epoch: int | None, glance: float = 0.0, batch: int = BATCH) -> DataFrame:
    """(task_id, k, ids, src_len): token-level CoT training rows (WIN-3).

    k thoughts join the source and thought k is the target, EOS closing the
    last thought. ``epoch`` draws one k per task by a seeded hash; ``None``
    gives a row for every k. The target keeps ``seq_len`` ids, the source
    the tail of what is left. With ``glance``, that share of the first two
    rows of each batch (by a seeded draw, where a next thought exists) puts
    SEP between the target and the next thought."""
    closed = ids.withColumn("_th", ar.with_eos("tgt_ids_list", tokens)).withColumn("_n", F.size("tgt_ids_list"))
    if epoch is None:
        rows = closed.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    else:
        draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"cot:{epoch}:"), F.col("task_id").cast("string"))), 1, 8), 16, 10)
        rows = closed.withColumn("k", F.pmod(draw.cast("bigint"), F.col("_n")).cast("int"))
    source = F.concat("src_ids", F.flatten(F.slice("_th", F.lit(1), F.col("k"))))
    pair = ar.truncate_pair(source, F.get("_th", F.col("k")), seq_len)
    rows = rows.select("task_id", "k", pair.alias("_p"), F.coalesce(F.get("_th", F.col("k") + 1), F.array().cast("array<int>")).alias("_next"))
    plain = ar.sep_layout("_p.src_ids", "_p.tgt_ids", tokens)
    if not glance:
        return rows.select("task_id", "k", plain.alias("_l")).select("task_id", "k", "_l.ids", "_l.src_len")
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"glance:{epoch}:"), F.col("task_id").cast("string"))), 1, 8), 16, 10).cast("double") / 2**32
    ahead = (F.size("_next") > 0) & (F.pmod(F.col("task_id"), F.lit(batch)) < 2) & (u < glance)
    layout = F.when(ahead, ar.glance_layout("_p.src_ids", "_p.tgt_ids", "_next", tokens)).otherwise(plain)
    return rows.select("task_id", "k", layout.alias("_l")).select("task_id", "k", "_l.ids", "_l.src_len")


def _cot_sql(pick: str, glance: str) -> str:
    hashed = "CAST('0x' || substr(md5('{}:0:' || CAST(task_id AS VARCHAR)), 1, 8) AS BIGINT)"
    return with_ctes(
        fx.TASK_LINES_SQL,
        GSM_TASKS_SQL,
        TASK_PIECES_SQL,
        f"""closed AS (
  SELECT task_id, src_ids, len(tgt_ids_list) AS n, {hashed.format('cot')} AS h, {hashed.format('glance')} / 4294967296.0 AS u,
         list_transform(tgt_ids_list, lambda x, i: CASE WHEN i = len(tgt_ids_list) THEN list_concat(x, [0]) ELSE x END) AS th
  FROM task_ids)""",
        f"""drawn AS (SELECT *, {pick} AS k FROM closed)""",
        f"""parts AS (
  SELECT task_id, k, u, list_slice(th[k + 1], 1, {SEQ_LEN}) AS tgt, coalesce(th[k + 2], []) AS nxt,
         list_concat(src_ids, flatten(list_slice(th, 1, k))) AS s FROM drawn)""",
        f"""cut AS (
  SELECT *, CASE WHEN {SEQ_LEN} > len(tgt) THEN list_slice(s, greatest(len(s) - ({SEQ_LEN} - len(tgt)), 0) + 1, len(s)) ELSE [] END AS src,
         {glance} AS ahead FROM parts)""",
    ) + """
SELECT task_id, CAST(k AS INTEGER) AS k, CAST(len(src) + CASE WHEN ahead THEN 0 ELSE 1 END AS INTEGER) AS src_len,
       array_to_string(CASE WHEN ahead THEN list_concat(src, tgt, [1], nxt) ELSE list_concat(src, [1], tgt) END, '|') AS ids
FROM cut"""


def _show_cot(rows: DataFrame) -> DataFrame:
    return rows.select("task_id", F.col("k").cast("int").alias("k"), F.col("src_len").cast("int").alias("src_len"), tx.show_long_array("ids").alias("ids"))


@query("cot_token_rows", "WIN-3 SCA-16 SCA-17 WIN-4", _cot_sql("h % n", "len(nxt) > 0 AND task_id % 8 < 2 AND u < 0.1"))
def cot_token_rows(spark: SparkSession, d: str) -> DataFrame:
    """One CoT row per task for epoch 0: seeded k, truncated to 256 ids, one
    row in ten of each batch's first two with the look-ahead layout."""
    return _show_cot(cot_rows(ids_of_tasks(spark, d), WORD_TOKENS, SEQ_LEN, epoch=0, glance=0.1))


@query("cot_token_rows_all", "WIN-3 SCA-16 SCA-17", _cot_sql("unnest(range(n))", "false"))
def cot_token_rows_all(spark: SparkSession, d: str) -> DataFrame:
    """A CoT row for every k of every task."""
    return _show_cot(cot_rows(ids_of_tasks(spark, d), WORD_TOKENS, SEQ_LEN, epoch=None))


@query(
    "vocab_file_roundtrip",
    "SRC-9 JOI-7 TOK-7 TOK-8",
    with_ctes(fx.TASK_LINES_SQL, GSM_TASKS_SQL) + "\nSELECT task_id, true AS roundtrip_ok FROM gsm_tasks",
)
def vocab_file_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The task vocabulary is written as a (token, id) parquet table, loaded
    back, and used both ways: token → id to encode every source, id → token
    to decode it; the decoded source equals the original."""
    t = gsm_tasks_df(spark, d)
    path = f"{checkpoint_root(spark).rstrip('/')}/vocab-{uuid.uuid4().hex}"
    task_vocab(t).select("token", "id").write.mode("overwrite").parquet(path)
    vocab = spark.read.parquet(path)
    enc = vb.encode(t, ["task_id"], "src", vocab, out="ids")
    dec = vb.decode(enc, ["task_id"], "ids", vocab, out="back")
    return t.join(dec, "task_id", "left").select("task_id", F.coalesce(F.col("back") == F.col("src"), F.lit(False)).alias("roundtrip_ok"))
