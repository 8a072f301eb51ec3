"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed words and byte
n-grams; a softmax over that average gives the class. Vectors and output
weights are trained by stochastic gradient descent in numpy. Because the
average and the output are linear, scoring needs one number per distinct
word (its vectors' sum times the output difference) and its feature count.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups, over_texts
from .subwords import feature_table, held_out, labelled_sample

BITS, LEAST, MOST, DIM = 18, 2, 4, 8
CACHE_WORDS = 200_000
#: Stands for "the same word as the one before"; no word holds a space.
AGAIN = b" again "

#: The bounded training sample: texts of each class at most.
SAMPLE = {1: 1500, 0: 1000}


def bag(text: bytes) -> Counter:
    """Words (runs without ASCII white space) and the repeat feature, with their counts."""
    words = text.split()
    out = Counter(words)
    again = sum(map(eq, words, words[1:]))
    if again:
        out[AGAIN] = again
    return out


@dataclass
class QualityModel:
    vectors: np.ndarray  # buckets x DIM
    output: np.ndarray  # DIM x 2
    bias: np.ndarray  # 2

    def scorer(self):
        """A function from texts to P(label 1) that remembers words seen (a bounded number)."""
        known: dict[bytes, tuple[float, int]] = {}
        gain = self.vectors @ (self.output[:, 1] - self.output[:, 0])
        bias = float(self.bias[1] - self.bias[0])

        def score(texts: list[bytes]) -> list[float]:
            out = []
            for group in groups(texts):
                if len(known) > CACHE_WORDS:
                    known.clear()
                bags = [bag(t) for t in group]
                new = list(set().union(*bags) - known.keys())
                if new:
                    ids, owner = feature_table(new, BITS, LEAST, MOST)
                    share, size = np.bincount(owner, gain[ids], len(new)), np.bincount(owner, minlength=len(new))
                    known.update(zip(new, zip(share.tolist(), size.tolist())))
                for b in bags:
                    parts = [known[w] for w in b]
                    n = sum(c * p[1] for c, p in zip(b.values(), parts))
                    z = bias + (math.fsum(c * p[0] for c, p in zip(b.values(), parts)) / n if n else 0.0)
                    out.append(1 / (1 + math.exp(-max(-700.0, min(700.0, z)))))
            return out

        return score


def fit(
    sample: list[tuple[bytes, int]], counts: dict[int, int] | None = None, epochs: int = 6, rate: float = 4.0
) -> QualityModel:
    """SGD over the sample in its (hashed) order, the rate falling to zero, classes at their real shares.

    Without both classes the model gives the share of the class there is
    (0.5 without any label).
    """
    rng = np.random.default_rng(1)
    model = QualityModel(
        rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32),
        rng.uniform(-1 / DIM, 1 / DIM, (DIM, 2)),
        np.zeros(2),
    )
    ys = [y for _, y in sample]
    if len(set(ys)) < 2:
        model.output[:] = 0
        model.bias[:] = [ys.count(0), ys.count(1)]
        model.bias = np.sign(model.bias) * 2
        return model
    seen = {c: ys.count(c) for c in (0, 1)}
    total = {c: (counts or {}).get(c, seen[c]) for c in (0, 1)}
    weight = {c: total[c] / seen[c] for c in (0, 1)}
    mean = sum(weight[y] for y in ys) / len(ys)

    bags = [bag(t) for t, _ in sample]
    vocab = list(dict.fromkeys(w for b in bags for w in b))
    at = {w: i for i, w in enumerate(vocab)}
    ids, owner = feature_table(vocab, BITS, LEAST, MOST)
    size = np.bincount(owner, minlength=len(vocab))
    ids = ids[np.argsort(owner, kind="stable")].astype(np.int32)
    del owner
    first = np.cumsum(size) - size
    docs = []
    for b in bags:
        k = np.array([at[w] for w in b], np.int64)
        c = np.array(list(b.values()), float)
        n = size[k]
        where = np.arange(n.sum()) + np.repeat(first[k] - (np.cumsum(n) - n), n)
        f, inv = np.unique(ids[where], return_inverse=True)
        share = np.bincount(inv, np.repeat(c, n), len(f)) if len(f) else np.zeros(0)
        docs.append((f, (share / max(1.0, share.sum())).astype(np.float32)))

    step, steps = 0, epochs * len(docs)
    for _ in range(epochs):
        for (f, share), y in zip(docs, ys):
            lr = rate * (1 - step / steps) * weight[y] / mean
            step += 1
            v = model.vectors[f]
            h = share @ v
            z = h @ model.output + model.bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = (model.output @ p).astype(np.float32)
            model.output -= 0.1 * lr * np.outer(h, p)
            model.bias -= 0.01 * lr * p
            # The step on a vector is scaled by the document's feature count, as if each feature were one example.
            model.vectors[f] = v - np.outer(np.minimum(share * len(f), 20.0) * (lr * 0.05), back)
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Fit on at most 2,500 labelled texts (``SAMPLE``) whose crc32(doc_id) mod 5 is not 0."""
    return fit(*labelled_sample(docs, labels, "quality", SAMPLE, id_col, text_col))


def score_quality(
    docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3
) -> DataFrame:
    """doc_id, held_out, score and predicted for every row.

    A null or empty text has no features and gets the score of the bias
    alone; a null id counts as '' for the fold; repeated rows score alike;
    other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = over_texts(
        docs, id_col, text_col, "score double", lambda: (lambda f: lambda texts: [f(texts)])(shared.value.scorer())
    )
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
