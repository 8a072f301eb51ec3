"""Text column functions (SCA-1..11, TOK-1/2). Pure Column expressions.

Everything here but ``show_long_array`` is a built-in Spark expression, so it
stays inside whole-stage codegen; no Python runs per row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT_TOKENS, Tokens

# ---- fixed values (patterns and templates) --------------------------------
# Published GPT-2 byte-level pre-tokenisation pattern.
GPT2_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Digit isolation: every numeric char alone, runs of anything else whole.
DIGIT_PATTERN = r"\p{N}|[^\p{N}]+"
# SFT prompt and judge prompt templates.
SFT_PROMPT = "Question: {q}\nAnswer:"
JUDGE_PROMPT = "Evaluate the quality of the following QA pair:\n\nQuestion: {q}\nAnswer: {a}\n\nQuality (1-10):"
# Plain number accepted as a score (Python float() minus nan/inf/underscores).
SCORE_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
# ---- end of fixed values --------------------------------------------------


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


WS = r"\p{IsWhite_Space}"  # what (?U)\s means in Java, without the flag's cost


def ustrip(x: Column | str) -> Column:
    """Python ``str.strip()``: Unicode whitespace at both ends (SCA-9)."""
    return F.regexp_replace(_c(x), rf"^{WS}+|{WS}+$", "")


def is_blank(x: Column | str) -> Column:
    return _c(x).rlike(r"(?U)^\s*$")


def split_gsm8k_target(t: Column | str) -> Column:
    """Split a rationale on single spaces; the last three pieces stay
    joined; every piece gets a leading space (SCA-1)."""
    s = F.split(_c(t), " ", -1)
    n = F.size(s)
    head = F.slice(s, F.lit(1), F.greatest(n - 3, F.lit(0)))
    tail = F.array_join(F.slice(s, F.greatest(n - 2, F.lit(1)), F.lit(3)), " ")
    return F.transform(F.concat(head, F.array(tail)), lambda x: F.concat(F.lit(" "), x))


def split_mult_target(t: Column | str) -> Column:
    """Multiplication rationale ``a + b + c #### ans`` → ``['a + ','b + ','c = ','ans']`` (SCA-2).
    More or fewer than one ``####`` is an error."""
    parts = F.split(_c(t), "####", -1)
    checked = F.when(F.size(parts) == 2, parts).otherwise(
        F.raise_error(F.concat(F.lit("expected exactly one #### in: "), _c(t)))
    )
    rs = F.split(ustrip(F.get(checked, 0)), r"\+", -1)
    n = F.size(rs)
    steps = F.transform(
        rs, lambda r, i: F.concat(ustrip(r), F.when(i < n - 1, F.lit(" + ")).otherwise(F.lit(" = ")))
    )
    return F.concat(steps, F.array(ustrip(F.get(checked, 1))))


def extract_gsm8k_answer(text: Column | str, tokens: Tokens = DEFAULT_TOKENS) -> Column:
    """Answer of a GSM8K-style completion (SCA-3)."""
    t = F.substring_index(_c(text), tokens.eos, 1)
    after_marker = F.substring(t, F.instr(t, "####") + 4, 1 << 30)
    with_marker = F.replace(ustrip(F.replace(after_marker, F.lit(tokens.sep), F.lit(""))), F.lit(","), F.lit(""))
    no_marker = F.replace(ustrip(F.substring_index(t, tokens.sep, -1)), F.lit(","), F.lit(""))
    return F.when(F.instr(t, "####") > 0, with_marker).otherwise(no_marker)


def extract_mult_answer(text: Column | str, tokens: Tokens = DEFAULT_TOKENS) -> Column:
    """Answer of a 4x4 / 5x5 multiplication completion (SCA-4)."""
    t = ustrip(F.substring_index(F.substring_index(_c(text), tokens.eos, 1), tokens.sep, -1))
    gold = ustrip(F.substring_index(t, "####", -1))
    pred = F.regexp_replace(F.substring_index(t, "=", -1), r"^[ +]+|[ +]+$", "")
    return F.when(F.instr(t, "####") > 0, gold).otherwise(pred)


def strip_special(text: Column | str, tokens: Tokens = DEFAULT_TOKENS) -> Column:
    """Remove SEP and PAD strings for display (SCA-5)."""
    return F.replace(F.replace(_c(text), F.lit(tokens.sep), F.lit("")), F.lit(tokens.pad), F.lit(""))


def sft_prompt(q: Column | str) -> Column:
    """``Question: {q}\\nAnswer:`` (SCA-6)."""
    return F.concat(F.lit("Question: "), _c(q), F.lit("\nAnswer:"))


def sft_full_text(q: Column | str, a: Column | str) -> Column:
    return F.concat(sft_prompt(q), F.lit(" "), _c(a))


def judge_prompt(q: Column | str, a: Column | str) -> Column:
    """Quality-judge prompt (SCA-7)."""
    return F.concat(
        F.lit("Evaluate the quality of the following QA pair:\n\nQuestion: "),
        _c(q),
        F.lit("\nAnswer: "),
        _c(a),
        F.lit("\n\nQuality (1-10):"),
    )


def parse_score(text: Column | str) -> Column:
    """Last whitespace token as a number, else NULL (SCA-8)."""
    last = F.element_at(F.split(ustrip(text), r"(?U)\s+", -1), -1)
    return F.when(last.rlike(SCORE_NUMBER), last.try_cast("double"))


def parse_generation(text: Column | str) -> Column:
    """Split a generation at ``Answer:`` (exactly one); question side has
    every ``Question:`` removed; both stripped (SCA-10, FIL-8).
    Returns struct(question, answer); both empty when malformed."""
    parts = F.split(_c(text), "Answer:", -1)
    ok = F.size(parts) == 2
    q = ustrip(F.replace(F.get(parts, 0), F.lit("Question:"), F.lit("")))
    a = ustrip(F.get(parts, 1))
    return F.struct(
        F.when(ok, q).otherwise(F.lit("")).alias("question"),
        F.when(ok, a).otherwise(F.lit("")).alias("answer"),
    )


def digit_chunks(text: Column | str) -> Column:
    """Digit isolation pre-tokeniser (TOK-1)."""
    return F.regexp_extract_all(_c(text), F.lit(DIGIT_PATTERN), 0)


_GPT2_JAVA = GPT2_PATTERN.replace(r"\s", WS).replace(r"\S", r"\P{IsWhite_Space}")


def byte_level_pieces(text: Column | str) -> Column:
    """GPT-2 byte-level pre-tokeniser pieces (TOK-2); Unicode whitespace."""
    return F.regexp_extract_all(_c(text), F.lit(_GPT2_JAVA), 0)


def show_array(arr: Column | str, sep: str = "|") -> Column:
    """Render an array as one delimited string (for reports and cross-engine checks)."""
    return F.array_join(_c(arr).cast("array<string>"), sep)


def show_long_array(arr: Column | str, sep: str = "|") -> Column:
    """``show_array`` for long arrays: whole batches are rendered at once, in Arrow."""

    def run(lists: pa.Array) -> pa.Array:
        items = lists.flatten()
        sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
        if items.null_count:  # left out, as in array_join
            row = np.repeat(np.arange(len(sizes)), sizes)[items.is_valid().to_numpy(zero_copy_only=False)]
            sizes, items = np.bincount(row, minlength=len(sizes)), items.drop_null()
        ends = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
        joined = pc.binary_join(pa.ListArray.from_arrays(ends, items.cast(pa.string())), sep)
        return pc.if_else(lists.is_valid(), joined, None)

    return F.arrow_udf(run, T.StringType())(_c(arr))
