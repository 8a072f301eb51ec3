"""The FM-index and substring dedup against brute force."""

import re
from hashlib import sha256

import numpy as np
import pytest

from sagerow.llm import substring_dedup
from sagerow.llm.fm_index import FmIndex, WaveletMatrix


def test_wavelet_rank():
    rng = np.random.default_rng(3)
    for n, symbols in ((0, 1), (1, 1), (63, 2), (64, 5), (65, 300), (1000, 17)):
        seq = rng.integers(0, symbols, n)
        at = rng.integers(0, n + 1, 200)
        symbol = rng.integers(0, symbols, 200)
        want = [int((seq[:i] == s).sum()) for s, i in zip(symbol, at)]
        assert WaveletMatrix(seq, symbols).rank(symbol, at).tolist() == want


def test_matches_are_the_first_equal_windows():
    rng = np.random.default_rng(0)
    for _ in range(150):
        n, letters, k = int(rng.integers(1, 150)), int(rng.integers(1, 5)), int(rng.integers(1, 23))
        text = rng.integers(int(rng.integers(0, 2)), letters + 1, n)
        query = np.concatenate([rng.integers(-1, letters + 3, 60), text])
        starts, lengths = np.array([0, 30, 60]), np.array([30, 30, n])
        at, first = FmIndex(text, k).matches(query, starts, lengths)
        seen, want = {}, {}
        for i in range(n - k + 1):
            if 0 not in text[i : i + k]:
                seen.setdefault(tuple(text[i : i + k]), i)
        for s, length in zip(starts, lengths):
            for i in range(s, s + length - k + 1):
                if tuple(query[i : i + k]) in seen:
                    want[i] = seen[tuple(query[i : i + k])]
        assert dict(zip(at.tolist(), first.tolist())) == want


def without_repeats(rows, window):
    """(id, n, removed, kept words) of each distinct (id, text), windows compared one by one in id order (nulls last)."""
    import xxhash

    texts = {(i, t): re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}

    def place(key):
        h = 42 if key[1] is None else xxhash.xxh64_intdigest(key[1].encode(), 42)
        return (key[0] is None, key[0] or 0, h - (1 << 64) if h >> 63 else h)

    seen, out = set(), {}
    for key in sorted(texts, key=place):
        words, gone = texts[key], set()
        for s in range(len(words) - window + 1):
            w = tuple(words[s : s + window])
            if w in seen:
                gone.update(range(s, s + window))
            seen.add(w)
        kept = [x for p, x in enumerate(words) if p not in gone]
        out[key] = (key[0], len(words), len(gone), " ".join(kept))
    return [out[r] for r in rows]


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    words = np.array([f"w{k}" for k in range(12)] + ["é", "ß-"])
    passages = [" ".join(rng.choice(words, int(rng.integers(5, 60)))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(int(rng.integers(0, 5))):
            parts.append(passages[int(rng.integers(0, 8))] if rng.random() < 0.5 else " ".join(rng.choice(words, int(rng.integers(0, 40)))))
        rows.append((i, " \n".join(parts)))
    rows += [(i + 1000, rows[i][1]) for i in range(0, n, 3)]
    rows += [(2000, None), (2001, ""), (2002, " \t "), (None, passages[0]), (None, None), (7, passages[1]), (7, passages[1])]
    return rows + [(3000, "same " * 30000), (2999, "same " * 50), (3001, " ".join(rng.choice(words, 5000)))]


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("window,gram,heavy", [(20, 5, False), (20, 5, True), (8, 3, False), (6, 6, True)])
def test_removed_words_equal_brute_force(spark, monkeypatch, window, gram, heavy):
    monkeypatch.setattr(substring_dedup, "SHARD_PASSAGES", 40)
    if heavy:  # some grams go window by window
        monkeypatch.setattr(substring_dedup, "SAMPLED", 1)
        monkeypatch.setattr(substring_dedup, "HEAVY_PASSAGES", 20)
    rows = corpus(window, 60)
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, gram string, i int, SHARD int")
    got = substring_dedup.without_repeats(df, window=window, gram=gram).collect()
    assert ordered((r[0], r[1], r[2], r[3].decode()) for r in got) == ordered(without_repeats(rows, window))


def test_digests_empty_tables_and_other_id_types(spark):
    rows = [(1, "a " * 25), (2, "b " + "a " * 21), (3, "b"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(i, n, r, sha256(k.encode()).hexdigest()) for i, n, r, k in without_repeats(rows, 20)]
    assert ordered(substring_dedup.kept_digests(df).collect()) == ordered(want)
    named = substring_dedup.kept_digests(df.selectExpr("cast(doc_id as string) AS doc_id", "text"))
    assert ordered(named.collect()) == ordered((str(w[0]), *w[1:]) for w in want)
    assert substring_dedup.kept_digests(df.limit(0)).collect() == []
    assert len(substring_dedup.kept_digests(df.where("text is null")).collect()) == 1
