"""Toxicity: a counterfactual-regularised classifier.

A document is toxic if any of its words is. Every distinct word has a score
from hashed word and n-gram weights, and the document's probability is the
noisy-or of its words, so a toxic word is not outweighed by a long text. A
word's rate falls off with the square of its evidence below ``BACKGROUND``, in
training as in scoring, so clean words add next to nothing, however many
there are. Training swaps the identity terms of labelled sentences for one
another and penalises the change of the sentence's score, which keeps the
bare mention of a group from carrying weight of its own.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups, over_texts, slices, texts_of
from .subwords import feature_table, held_out, labelled_sample

#: Identity terms, by kind; a term is swapped for the others of its kind.
IDENTITY_TERMS = (
    ("woman", "man", "transgender", "nonbinary", "female", "male"),
    ("women", "men", "girls", "boys"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "african", "european", "latino", "hispanic", "arab"),
    ("gay", "lesbian", "bisexual", "straight", "queer", "heterosexual", "homosexual"),
    ("deaf", "blind", "disabled", "autistic", "paralyzed"),
    ("old", "young", "elderly", "teenage"),
    ("immigrant", "refugee", "foreigner", "citizen"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("american", "mexican", "chinese", "indian", "russian", "german", "french", "spanish"),
)

BITS, LEAST, MOST = 20, 3, 5
#: Log-odds of a word before training.
START = -8.0
CACHE_WORDS = 200_000
#: Evidence (the softplus of a word's log-odds) below which its rate falls off.
BACKGROUND = 0.02

# ASCII letters to lower case; every other ASCII character but digits separates words.
_FOLD = bytes(
    (c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32) for c in range(256)
)


def words_of(text: bytes) -> set[bytes]:
    """Distinct words: runs of digits, letters and non-ASCII bytes, A-Z lower-cased."""
    return set(text.translate(_FOLD).split())


def swaps(texts: list[bytes], kinds=IDENTITY_TERMS) -> list[tuple[frozenset[bytes], bytes, bytes]]:
    """(words of the sentence, its term, another term of that kind) for every swap in the texts' sentences."""
    kind_of = {t.encode(): [o.encode() for o in k if o != t] for k in kinds for t in k}
    out = []
    for text in texts:
        for sentence in re.split(rb"[.!?\n]+", text):
            words = frozenset(words_of(sentence))
            out += [(words, term, other) for term in sorted(words & kind_of.keys()) for other in kind_of[term]]
    return out


def word_rates(log_odds: np.ndarray, floor: float = BACKGROUND) -> tuple[np.ndarray, np.ndarray]:
    """Each word's rate, the parts of a document's noisy-or, and its slope: evidence e gives e * e / (e + floor)."""
    e = np.logaddexp(0.0, log_odds)
    slope = np.exp(-np.logaddexp(0.0, -log_odds))  # of the evidence: a sigmoid that can't overflow
    part = e / np.maximum(e + floor, 1e-300)
    return e * part, slope * part * (2 - part)


def spread(to: np.ndarray, values: np.ndarray, of: np.ndarray, n: int, step: int = 1 << 21) -> np.ndarray:
    """The sums of ``values[of]`` by ``to``, taken in runs so that the driver never holds them all."""
    out = np.zeros(n)
    for k in range(0, len(to), step):
        out += np.bincount(to[k : k + step], values[of[k : k + step]], n)
    return out


@dataclass
class ToxicityModel:
    """Feature weights and the bias of a word's log-odds."""

    weights: np.ndarray
    bias: float

    def rates(self, words: list[bytes]) -> np.ndarray:
        """The rates that a document's noisy-or adds up."""
        if not words:
            return np.zeros(0)
        ids, owner = feature_table(words, BITS, LEAST, MOST)
        return word_rates(self.bias + np.bincount(owner, self.weights[ids], len(words)))[0]

    def scorer(self):
        """A function from texts to scores that remembers the rates of words seen (a bounded number)."""
        known: dict[bytes, float] = {}

        def score(texts: list[bytes]) -> list[float]:
            out = []
            for group in groups(texts):
                if len(known) > CACHE_WORDS:
                    known.clear()
                bags = [words_of(t) for t in group]
                new = list(set().union(*bags) - known.keys())
                known.update(zip(new, self.rates(new).tolist()))
                out += [-math.expm1(-math.fsum(map(known.__getitem__, bag))) for bag in bags]
            return out

        return score


def fit(
    sample: list[tuple[bytes, int]],
    counts: dict[int, int] | None = None,
    fairness: float = 1.0,
    l2: float = 2e-5,
    steps: int = 100,
    rate: float = 0.3,
) -> ToxicityModel:
    """Full-batch AdaGrad on the noisy-or likelihood plus ``fairness`` times the mean squared score change of the swaps.

    ``counts`` (labels per class) weighs the classes back to their real
    shares. Without both classes the model scores every text near zero.
    """
    model = ToxicityModel(np.zeros(1 << BITS, np.float32), -12.0)
    ys = np.array([y for _, y in sample], float)
    if len(ys) == 0 or ys.min() == ys.max():
        return model
    bags = [sorted(words_of(t)) for t, _ in sample]
    swapped = swaps([t for t, _ in sample])
    sentences = {b: i for i, b in enumerate(dict.fromkeys(b for b, _, _ in swapped))}
    vocab = sorted({w for b in bags for w in b} | {other for _, _, other in swapped})
    at = {w: i for i, w in enumerate(vocab)}
    ids, word_of = feature_table(vocab, BITS, LEAST, MOST)
    present = np.zeros(1 << BITS, bool)
    present[ids] = True
    used = np.flatnonzero(present)
    ids = (np.cumsum(present, dtype=np.int32) - 1)[ids]
    bag_words = np.array([at[w] for b in bags for w in b], np.int64)
    bag_of = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    said_words = np.array([at[w] for b in sentences for w in sorted(b)], np.int64)
    said_in = np.repeat(np.arange(len(sentences)), [len(b) for b in sentences])
    swap_in = np.array([sentences[b] for b, _, _ in swapped], np.int64)
    term, other = (np.array([at[x[k]] for x in swapped], np.int64) for k in (1, 2))
    added = np.array([float(o not in b) for b, _, o in swapped])  # 0 where the sentence already holds the other term
    seen = {c: max(1, int((ys == c).sum())) for c in (0, 1)}
    total = {c: (counts or {}).get(c, seen[c]) for c in (0, 1)}
    weight = np.where(ys == 1, total[1] / seen[1], total[0] / seen[0])
    weight /= weight.sum()

    n = len(vocab)
    w, bias = np.zeros(len(used)), START
    g2, b2 = np.full(len(used), 1e-8), 1e-8
    for step in range(steps):
        # The floor rises from nothing to its full height over the middle of the training.
        floor = BACKGROUND * min(1.0, max(0.0, 4 * step / steps - 1))
        lam, slope = word_rates(bias + spread(word_of, w, ids, n), floor)
        p = -np.expm1(-np.bincount(bag_of, lam[bag_words], len(bags)))
        down = weight * np.where(ys == 1, -(1 - p) / np.maximum(p, 1e-9), 1.0)
        ds = np.bincount(bag_words, down[bag_of], n)
        if len(swapped):
            before = np.bincount(said_in, lam[said_words], len(sentences))[swap_in]
            after = np.exp(lam[term] - added * lam[other] - before)
            before = np.exp(-before)
            change = 2 * fairness / len(swapped) * (after - before)
            both = np.bincount(swap_in, change * (before - after), len(sentences))
            ds += np.bincount(said_words, both[said_in], n)
            ds += np.bincount(term, change * after, n) - np.bincount(other, change * after * added, n)
        ds *= slope
        gw = spread(ids, ds, word_of, len(used)) + l2 * w
        gb = ds.sum()
        g2 += gw * gw
        b2 += gb * gb
        w -= rate * gw / np.sqrt(g2)
        bias -= rate * gb / np.sqrt(b2)
    model.weights[used] = w
    model.bias = float(bias)
    return model


#: The bounded training sample: toxic and other texts at most.
SAMPLE = {1: 1500, 0: 2000}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Fit on at most 3,500 labelled texts (``SAMPLE``) whose crc32(doc_id) mod 5 is not 0."""
    return fit(*labelled_sample(docs, labels, "toxic", SAMPLE, id_col, text_col))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for every row.

    A null or empty text has no words and scores 0; a null id counts as ''
    for the fold; repeated rows score alike; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = over_texts(
        docs, id_col, text_col, "score double", lambda: (lambda f: lambda texts: [f(texts)])(shared.value.scorer())
    )
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` scoring below ``threshold``, all columns as they were.

    Runs without a shuffle; null and empty texts score 0 and stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.scorer()
        for batch in slices(batches):
            named = pa.RecordBatch.from_arrays([batch.column(at).cast(pa.binary())], ["t"])
            yield batch.filter(pa.array([s < threshold for s in score(texts_of(named, "t"))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
