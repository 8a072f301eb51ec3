"""Quality rules as weak supervision.

Rules over a document's signals vote good, bad, or abstain. Expectation-
maximisation over the counts of vote patterns estimates how each rule votes
on good and on bad documents (and their share), and a document is kept by
its posterior probability of being good instead of by passing every rule.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BYTES, over_texts, staged

SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))
_UPPER = bytes(range(65, 91))
_PLAIN = bytes(range(97, 123)) + bytes(range(48, 58))
_ASCII = bytes(range(128))
WINDOW = 5
_MIX = np.random.default_rng(5).integers(1, 2**63, WINDOW).astype(np.uint64) * np.uint64(2) + np.uint64(1)

SIGNALS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_upper long, n_alnum long, n_bangs long, n_again long, n_distinct long, n_marked long"
)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows of ``window`` words that the text has at least twice."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    wide = ids.astype(np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h += (wide[k : k + n] + np.uint64(1)) * _MIX[k]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    rows = np.lib.stride_tricks.sliding_window_view(ids, window)
    if not (rows[order[1:][same]] == rows[order[:-1][same]]).all():
        # Two windows share a hash: sort the windows themselves.
        order = np.lexsort(rows.T)
        same = (rows[order[1:]] == rows[order[:-1]]).all(1)
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def signals(text: bytes) -> tuple:
    """The values of ``SIGNALS`` for one whole text."""
    words = text.split()
    lines, seen, dup = 0, set(), 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            dup += line in seen
            seen.add(line)
    size = len(text)
    symbols = size - len(text.translate(None, SYMBOLS))
    upper = size - len(text.translate(None, _UPPER))
    plain = size - len(text.translate(None, _PLAIN))
    wide = len(text.translate(None, _ASCII + _CONTINUATION))
    return (
        len(words),
        len(text.translate(None, _CONTINUATION + SPACE_BYTES)),
        symbols,
        dup,
        repeated_words(words),
        lines,
        upper,
        upper + plain + wide,
        text.count(b"!"),
        sum(map(eq, words, words[1:])),
        len(set(words)),
        sum(len(w.translate(None, SYMBOLS)) < len(w) for w in words) if symbols else 0,
    )


def document_signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``SIGNALS`` of every row; a null text counts as empty."""
    return over_texts(docs, id_col, text_col, SIGNALS, lambda: lambda texts: list(zip(*map(signals, texts))) or [[]] * 12)


#: Name, when the rule votes good, when it votes bad; else it abstains.
RULES = (
    ("length", "n_words >= 50", "n_words < 10"),
    ("word_length", "word_chars between 3 * n_words and 10 * n_words", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    ("symbols", "100 * n_symbols < word_chars", "100 * n_symbols > 5 * word_chars"),
    ("marked_words", "100 * n_marked < 2 * n_words", "100 * n_marked > 10 * n_words"),
    ("letters_and_digits", "100 * n_alnum >= 90 * word_chars", "100 * n_alnum < 80 * word_chars"),
    ("capitals", "100 * n_upper < 20 * n_alnum", "100 * n_upper > 50 * n_alnum"),
    ("exclamations", "100 * n_bangs < 5 * n_words", "100 * n_bangs > 30 * n_words"),
    ("duplicate_lines", "n_dup_lines = 0 and n_lines >= 2", "100 * n_dup_lines > 30 * n_lines"),
    ("repeated_windows", "100 * n_repeat_words < 5 * n_words", "100 * n_repeat_words > 20 * n_words"),
    ("stutter", "100 * n_again < 5 * n_words", "100 * n_again > 10 * n_words"),
    ("variety", "100 * n_distinct >= 40 * n_words", "100 * n_distinct < 15 * n_words and n_words < 2000"),
)


def votes() -> list[Column]:
    """One byte per rule: 1 good, 0 bad, -1 abstains."""
    return [F.when(F.expr(bad), 0).when(F.expr(good), 1).otherwise(-1).alias(f"vote_{name}") for name, good, bad in RULES]


@dataclass
class LabelModel:
    """P(good), and per rule the chance of a good vote (where it votes) on good and on bad documents."""

    share: float
    on_good: np.ndarray
    on_bad: np.ndarray

    def log_odds(self) -> tuple[float, np.ndarray, np.ndarray]:
        """Of the share, of each rule's good vote, and of its bad vote."""
        return (
            float(np.log(self.share / (1 - self.share))),
            np.log(self.on_good / self.on_bad),
            np.log((1 - self.on_good) / (1 - self.on_bad)),
        )


def fit(patterns: np.ndarray, counts: np.ndarray, steps: int = 200, prior: float = 1.0) -> LabelModel:
    """EM over distinct vote patterns (rows of 1, 0, -1) and how many documents have each.

    It starts from rules that pass nearly every good document and most bad
    ones (a rule knows one fault among several). ``prior`` documents a cell
    smooth the estimates, so unanimous rules stay finite.
    """
    j = patterns.shape[1]
    model = LabelModel(0.8, np.full(j, 0.97), np.full(j, 0.65))
    if not len(counts):
        return model
    good, bad = (patterns == 1).astype(float), (patterns == 0).astype(float)
    n = counts.astype(float)
    for _ in range(steps):
        base, up, down = model.log_odds()
        p = 1 / (1 + np.exp(-np.clip(base + good @ up + bad @ down, -500, 500)))
        w1, w0 = n * p, n * (1 - p)
        share = (w1.sum() + prior) / (n.sum() + 2 * prior)
        on_good = (w1 @ good + prior) / (w1 @ (good + bad) + 2 * prior)
        on_bad = (w0 @ good + prior) / (w0 @ (good + bad) + 2 * prior)
        change = abs(share - model.share) + np.abs(on_good - model.on_good).max() + np.abs(on_bad - model.on_bad).max()
        model = LabelModel(float(share), on_good, on_bad)
        if change < 1e-10:
            break
    return model


def learn(voted: DataFrame) -> LabelModel:
    """Fit on the vote patterns of all documents: at most 3^11 rows reach the driver, whatever the corpus."""
    names = [f"vote_{r[0]}" for r in RULES]
    rows = voted.groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names).collect()
    table = np.array([list(r) for r in rows], np.int64).reshape(-1, len(names) + 1)
    return fit(table[:, :-1], table[:, -1])


def quality(model: LabelModel) -> Column:
    """The posterior probability that a voted row is good."""
    base, up, down = model.log_odds()
    z = F.lit(base)
    for (name, _, _), g, b in zip(RULES, up.tolist(), down.tolist()):
        vote = F.col(f"vote_{name}")
        z = z + F.when(vote == 1, g).when(vote == 0, b).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and quality.

    A null or empty text has zero of everything and fails the base.
    Repeated rows are judged alike; null ids pass through; other columns
    are not read.
    """
    seen = staged(document_signals(docs, id_col, text_col), "signals").select("*", *votes())
    model = learn(seen)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    p = quality(model)
    return seen.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (p >= threshold)).alias("kept"),
        p.alias("quality"),
    )
