"""Periodic runs: seed-and-extend along the diagonals of each document.

A run is a maximal stretch of words with smallest period q that is at least
``max(LEAST_RUN, POWER * q)`` long. On the diagonal at lag q (words i and
i + q equal) it shows as a stretch of at least ``max(LEAST_RUN - q,
(POWER - 1) * q)`` matches, the guaranteed overlap. The k-grams of a text are
indexed by a rolling hash; for a class of lags [Q, 2Q) every guaranteed
stretch holds a whole k-gram that starts at a multiple of Q, so the
occurrence pairs to look at are those of one k-gram in Q with the Q positions
that the class's lags reach: about n a class, n log n a document, however
often a word or a line repeats. Pairs that agree are extended word by word in
both directions; a table of the furthest position covered on each lag, and
the runs found at divisors of a lag, keep a stretch from being extended twice.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction
from hashlib import sha256
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import groups, over_texts, slices, texts_of
from .words import Grams, word_hashes

LEAST_RUN = 24
POWER = 3


class Run(NamedTuple):
    start: int
    length: int
    period: int


def seed_pairs(words: np.ndarray, least: int = LEAST_RUN, power: int = POWER) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, lag, start) arrays of equal k-grams at ``start`` and ``start + lag``, class by class, lags rising in each.

    Every diagonal stretch of ``max(least - q, (power - 1) * q)`` matches at a
    lag q with ``power * q`` words in all holds one of them.
    """
    n = len(words)
    if n < least:
        return
    grams = Grams(words)
    most = n // power
    # Lags below the crossing of the two bounds share the least overlap there is.
    small = min(most, max(1, -(-least // power) * 2 - 1))
    overlap = min(max(least - q, (power - 1) * q) for q in range(1, small + 1))
    step = max(1, overlap // 2)
    k = overlap - step + 1
    hashes = grams.of(k)
    anchors = np.arange(0, len(hashes), step)
    lags, starts = [], []
    for q in range(1, small + 1):
        a = anchors[: np.searchsorted(anchors, len(hashes) - q)]
        hit = a[hashes[a] == hashes[a + q]]
        lags.append(np.full(len(hit), q))
        starts.append(hit)
    yield k, np.concatenate(lags), np.concatenate(starts)
    q0 = small + 1
    while q0 <= most:
        # Lags in [q0, 2 q0): a stretch of (power - 1) * q0 matches holds a k-gram at a multiple of q0.
        k = max(1, (power - 2) * q0 + 1)
        hashes = grams.of(k)
        rows = (len(hashes) - q0) // q0 + 1
        if len(hashes) <= q0:
            break
        reach = np.zeros(rows * q0, np.uint64)
        reach[: len(hashes) - q0] = hashes[q0 : q0 + rows * q0]
        seeds = hashes[: rows * q0 : q0]
        row, off = np.nonzero(reach.reshape(rows, q0) == seeds[:, None])
        inside = row * q0 + q0 + off < len(hashes)
        row, off = row[inside], off[inside]
        order = np.lexsort((row, off))
        yield k, (off + q0)[order], (row * q0)[order]
        q0 *= 2


def _matches(words: np.ndarray, i: int, j: int, sign: int) -> int:
    """How many words from i and j (i < j) on agree, going up (1) or down (-1)."""
    n, done, chunk = len(words), 0, 64
    most = n - j if sign > 0 else i + 1
    while done < most:
        c = min(chunk, most - done)
        if sign > 0:
            differ = words[i + done : i + done + c] != words[j + done : j + done + c]
        else:
            differ = (words[i - done - c + 1 : i - done + 1] != words[j - done - c + 1 : j - done + 1])[::-1]
        at = int(differ.argmax())
        if differ[at]:
            return done + at
        done += c
        chunk *= 4
    return most


def runs_of(words: np.ndarray, least: int = LEAST_RUN, power: int = POWER) -> list[Run]:
    """All runs of a sequence, by start, then period.

    An interval with period q and ``power * q`` words or more (``power`` at
    least 2) has its smallest period among the divisors of q, whose diagonal
    gives the very same interval, so the smallest lag seen for an interval is
    its period.
    """
    found: dict[tuple[int, int], int] = {}
    covered: dict[int, tuple[list[int], list[int]]] = {}  # period -> starts and ends of its runs, rising
    for k, lags, starts in seed_pairs(words, least, power):
        if len(covered) <= 32:  # whole arrays at once; more periods are met pair by pair below
            for p, (begins, ends) in covered.items():
                at = np.searchsorted(begins, starts, "right") - 1
                held = (lags % p == 0) & (at >= 0) & (np.array(ends)[at] >= starts + lags + k)
                lags, starts = lags[~held], starts[~held]
        furthest: dict[int, int] = {}
        periods: list[int] = []
        last = 0
        for q, i in zip(lags.tolist(), starts.tolist()):
            if i < furthest.get(q, 0):
                continue
            if q != last:
                periods, last = [p for p in covered if q % p == 0], q
            if any(_holds(covered[p], i, i + q + k) for p in periods):
                continue
            up = _matches(words, i, i + q, 1)
            furthest[q] = i + up
            if up < k:
                continue  # two different k-grams of one hash
            down = _matches(words, i - 1, i + q - 1, -1) if i else 0
            s, e = i - down, i + up + q
            if e - s >= max(least, power * q) and (s, e) not in found:
                found[s, e] = q
                begins, ends = covered.setdefault(q, ([], []))
                at = bisect_right(begins, s)
                begins.insert(at, s)
                ends.insert(at, e)
    return sorted(Run(s, e - s, q) for (s, e), q in found.items())


def _holds(runs: tuple[list[int], list[int]], a: int, b: int) -> bool:
    """Whether one of the runs (their starts and ends both rise) holds the words [a, b)."""
    at = bisect_right(runs[0], a) - 1
    return at >= 0 and runs[1][at] >= b


def collapsed(n: int, runs: list[Run]) -> np.ndarray:
    """Which of the n words stay: all but those that a run holds after its first period."""
    edges = np.zeros(n + 1, np.int64)
    for r in runs:
        edges[r.start + r.period] += 1
        edges[r.start + r.length] -= 1
    return np.cumsum(edges[:n]) == 0


def strongest(runs: list[Run]) -> Run | None:
    """The run of the greatest exact length/period; of equals the smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r.length, r.period), r.start, r.period)) if runs else None


FIELDS = "n_words long, runs array<struct<start:long,length:long,period:long>>, kept binary"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period of each) and kept (the collapsed words joined by a space).

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text. A null or empty text
    has no words, no runs and an empty ``kept``; ids pass through with their
    nulls; repeated rows each get a row; texts of any length are taken whole
    (memory: a few numbers a word); an empty table gives an empty one; other
    columns are not read. No shuffle.
    """

    def make():
        def score(texts: list[bytes]) -> list[list]:
            counts, found, kept = [], [], []
            for group in groups(texts):
                hashes, lens = word_hashes(group)
                at = 0
                for text, n in zip(group, lens.tolist()):
                    runs = runs_of(hashes[at : at + n])
                    at += n
                    words = text.split()
                    if runs:
                        words = [words[i] for i in np.flatnonzero(collapsed(n, runs)).tolist()]
                    counts.append(n)
                    found.append([r._asdict() for r in runs])
                    kept.append(b" ".join(words))
            return [counts, found, kept]

        return score

    return over_texts(docs, id_col, text_col, FIELDS, make)


def plant_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and body: the text with a periodic tail in a tenth of the documents.

    With h the CRC-32 of the decimal id (of nothing for a null id) and
    g = h // 10: where h % 10 is 0 and the text has words, each word
    i >= a = g % n becomes word a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8).
    Texts come back as UTF-8 bytes, null ones as empty.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    src = docs.selectExpr(
        f"`{id_col}` as doc_id", f"cast(`{id_col}` as string) as name", f"cast(`{text_col}` as binary) as body"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for name, text in zip(batch.column("name").to_pylist(), texts_of(batch, "body")):
                g, left = divmod(crc32((name or "").encode()), 10)
                if left == 0 and (words := text.split()):
                    n = len(words)
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    text = b" ".join(words[:a] + [words[a + i % p] for i in range(n - a)])
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "body"])

    return src.mapInArrow(run, f"doc_id {id_type}, body binary")


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_runs, the strongest run's start, length, period and exponent_milli, runs_sha256, collapsed_sha256.

    The rows of ``periodic_runs``, reduced: without a run the four numbers
    are null and ``runs_sha256`` is that of an empty string.
    """
    found = periodic_runs(docs, id_col, text_col)
    id_type = found.schema["doc_id"].dataType.simpleString()
    schema = pa.schema(
        [(c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")]
        + [(c, pa.string()) for c in ("runs_sha256", "collapsed_sha256")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for listed, kept in zip(batch.column("runs").to_pylist(), batch.column("kept").to_pylist()):
                runs = [Run(r["start"], r["length"], r["period"]) for r in listed]
                best = strongest(runs)
                lines = "".join(f"{r.start},{r.length},{r.period}\n" for r in runs)
                rows.append(
                    (len(runs), *(best or (None,) * 3), best and 1000 * best.length // best.period)
                    + (sha256(lines.encode()).hexdigest(), sha256(kept).hexdigest())
                )
            cols = list(zip(*rows)) or [[]] * len(schema)
            arrays = [pa.array(c, f.type) for c, f in zip(cols, schema)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *schema.names])

    fields = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in schema)
    return found.mapInArrow(run, f"doc_id {id_type}, {fields}")
