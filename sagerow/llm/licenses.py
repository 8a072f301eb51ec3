"""License scans: ordered signature rules.

Hundreds of patterns run over a text's words, but only those whose keyword
an Aho-Corasick pass has found. Overlapping detections are resolved by
priority: tier, then length, then the rules' order; what lies within the
interval of a kept detection is suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_texts
from .license_rules import TIERS, signatures

#: Base phrases: every place counts, whatever the signatures say.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
BASE_CONFIDENCE = 0.6

# A-Z to a-z; ASCII but digits and letters to spaces; every other byte stays.
_FOLD = bytes(
    (c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32) for c in range(256)
)


def resolve(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Detections (tier, rule, start, end) that no kept one of higher priority contains."""
    kept: list[tuple[int, int, int, int]] = []
    starts: list[int] = []  # kept intervals that no other kept one contains: starts and ends both rise
    ends: list[int] = []
    for one in sorted(set(found), key=lambda d: (d[0], d[2] - d[3], d[1], d[2])):
        _, _, a, b = one
        k = bisect_right(starts, a)
        if k and ends[k - 1] >= b:
            continue
        kept.append(one)
        # Intervals within the new one end before it does and so sit next to it; they no longer matter here.
        low = k
        while low and starts[low - 1] == a:
            low -= 1
        high = low
        while high < len(ends) and ends[high] <= b:
            high += 1
        starts[low:high], ends[low:high] = [a], [b]
    return kept


class Scanner:
    """The compiled rules; one per task."""

    def __init__(self, rules: list[tuple[str, str, str, str]] | None = None):
        self.rules = signatures() if rules is None else rules
        whole = lambda p: re.compile(f"(?<= )(?:{p})(?= )")
        self.patterns = [whole(pattern) for _, _, _, pattern in self.rules]
        by_keyword: dict[str, list[int]] = {}
        for k, (_, _, keyword, _) in enumerate(self.rules):
            by_keyword.setdefault(" " + keyword, []).append(k)
        self.base = [(re.compile(f"(?<= )(?={phrase} )"), label) for phrase, label in BASE.items()]
        for k, phrase in enumerate(BASE):
            by_keyword.setdefault(f" {phrase} ", []).append(-1 - k)
        self.finder = ahocorasick.Automaton()
        for keyword, rules_of in by_keyword.items():
            self.finder.add_word(keyword, tuple(rules_of))
        self.finder.make_automaton()

    def __call__(self, text: bytes) -> tuple:
        """n_words, the base (place count, first and last start, labels), all labels, score and the kept spans."""
        words = text.translate(_FOLD).split()
        line = (b" " + b" ".join(words) + b" ").decode("latin-1")
        wanted = {k for _, rules in self.finder.iter(line) for k in rules}
        if not wanted:
            return len(words), 0, None, None, "", "", 0.0, []

        places, base_labels, found = [], set(), []
        for k in sorted(wanted):
            if k < 0:
                pattern, label = self.base[-1 - k]
                at = [m.start() for m in pattern.finditer(line)]
                places += at
                base_labels.add(label)
            else:
                tier = TIERS[self.rules[k][0]][0]
                found += [(tier, k, m.start(), m.end()) for m in self.patterns[k].finditer(line)]
        kept = sorted(resolve(found), key=lambda d: (d[2], d[3]))
        word_at = self._word_numbers(line, {p for p in places} | {d[2] for d in kept} | {d[3] for d in kept})
        spans = [
            {"label": self.rules[k][1], "kind": self.rules[k][0], "first": word_at[a], "last": word_at[b] - 1}
            for _, k, a, b in kept
        ]
        miss = 1.0
        confidence = {label: BASE_CONFIDENCE for label in base_labels}
        for s in spans:
            confidence[s["label"]] = max(TIERS[s["kind"]][1], confidence.get(s["label"], 0.0))
        for label in sorted(confidence):
            miss *= 1 - confidence[label]
        starts = [word_at[p] for p in places]
        return (
            len(words),
            len(places),
            min(starts, default=None),
            max(starts, default=None),
            ",".join(sorted(base_labels)),
            ",".join(sorted(confidence)),
            1 - miss,
            spans,
        )

    @staticmethod
    def _word_numbers(line: str, offsets: set[int]) -> dict[int, int]:
        """Number of the word that begins at each offset (for an end: of the word after it)."""
        out, at, n = {}, 0, -1
        for p in sorted(offsets):
            n += line.count(" ", at, p)
            at = p
            out[p] = n if line[p - 1] == " " else n + 1
        return out


FIELDS = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label: string, kind: string, first: long, last: long>>"
)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans of every row.

    ``spans`` are the kept detections with their first and last word. A
    null or empty text has no words, no labels ('') and score 0. Repeated
    rows scan alike; null ids pass through; other columns are not read.
    """

    def make() -> Callable[[list[bytes]], Iterator]:
        scan = Scanner()
        return lambda texts: list(zip(*map(scan, texts))) or [[]] * 8

    return over_texts(docs, id_col, text_col, FIELDS, make)


def license_report(docs: DataFrame) -> DataFrame:
    """The scan with the number of kept detections in place of the spans."""
    return scan_licenses(docs).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
        F.size("spans").cast("long").alias("n_detections"),
    )


