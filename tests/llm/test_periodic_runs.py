"""Periodic runs against a search of every lag, and the query's columns against plain Python on a whole table."""

import random
import re
from fractions import Fraction
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sagerow.llm import periodic_runs, queries
from sagerow.llm.words import word_hashes
from sagerow.sources.tables import read_table

SF = "/root/testdata/sf0.001"


def every_run(w, least=24, power=3):
    """(start, length, period) by trying each lag over the whole sequence."""
    ids = {x: k for k, x in enumerate(dict.fromkeys(w))}
    x = np.array([ids[v] for v in w], int)
    out = set()
    for q in range(1, len(x) // power + 1):
        same = np.concatenate(([False], x[q:] == x[:-q], [False]))
        edges = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
        for s, e in zip(edges[:, 0].tolist(), (edges[:, 1] + q).tolist()):
            shorter = any((x[s : e - p] == x[s + p : e]).all() for p in range(1, q)) if e - s >= max(least, power * q) else True
            if not shorter:
                out.add((s, e - s, q))
    return sorted(out)


def numbers(w):
    return np.array(w, np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def test_runs_equal_those_of_every_lag():
    rng = random.Random(1)
    for _ in range(600):
        letters = rng.choice([1, 2, 3, 30])
        w = [rng.randrange(letters) for _ in range(rng.randrange(0, 140))]
        for _ in range(rng.randrange(0, 3)):
            block = [rng.randrange(letters) for _ in range(rng.randrange(1, 30))]
            at = rng.randrange(0, len(w) + 1)
            w[at:at] = [block[x % len(block)] for x in range(rng.randrange(0, 120))]
        assert [tuple(r) for r in periodic_runs.runs_of(numbers(w))] == every_run(w)
        assert [tuple(r) for r in periodic_runs.runs_of(numbers(w), 8, 2)] == every_run(w, 8, 2)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=90), st.integers(24, 40))
def test_binary_words(w, least):
    got = periodic_runs.runs_of(numbers([ord(c) for c in w]), least)
    assert [tuple(r) for r in got] == every_run(w, least)


def test_long_repetitive_sequences_take_few_extensions(monkeypatch):
    calls = []
    plain = periodic_runs._matches
    monkeypatch.setattr(periodic_runs, "_matches", lambda *a: calls.append(1) or plain(*a))
    assert periodic_runs.runs_of(np.full(60_000, 7, np.uint64)) == [(0, 60_000, 1)]
    assert periodic_runs.runs_of(numbers(np.arange(60_000) % 1000)) == [(0, 60_000, 1000)]
    assert len(calls) < 100


def test_word_hashes_of_odd_texts():
    texts = [b"a  b\tc\xc3\xa9\n", b"", b" \n ", b"x" * 700 + b" y", b"a b"]
    hashes, lens = word_hashes(texts)
    assert lens.tolist() == [len(t.split()) for t in texts]
    flat = [w for t in texts for w in t.split()]
    assert all((hashes[i] == hashes[j]) == (a == b) for i, a in enumerate(flat) for j, b in enumerate(flat))
    assert [len(x) for x in word_hashes([])] == [0, 0]


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    g, left = divmod(crc32(("" if doc_id is None else str(doc_id)).encode()), 10)
    if left == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = every_run(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    lines = "".join("%d,%d,%d\n" % r for r in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *head, sha256(lines.encode()).hexdigest(), sha256(kept.encode()).hexdigest())


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def test_query_on_a_whole_table(spark):
    docs = read_table(spark, SF, "documents").select("doc_id", "text").collect()
    got = queries.QUERIES["op12_periodic_runs"](spark, SF)
    assert got.columns[:6] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli"]
    assert ordered(got.collect()) == ordered(expected(*r) for r in docs)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "a " * 30), (None, None), (5, "x y z " * 9), (5, "x y z " * 9)]
    rows += [(7, "one two " * 30 + "three " + "four " * 25), (8, "w " * 20000), (9, "é   " * 40), (10, "a" * 5000)]
    rows += [(i, " ".join(f"w{k % 11}" for k in range(5 * i))) for i in range(20, 60)]
    df = spark.createDataFrame([(i, t, "k", 1, 2) for i, t in rows], "doc_id long, text string, body string, runs int, KEPT int")
    query = lambda d: periodic_runs.run_digests(periodic_runs.plant_periods(d), text_col="body")
    want = [expected(*r) for r in rows if r[0] != 8]
    got = query(df).collect()
    assert ordered(r for r in got if r["doc_id"] != 8) == ordered(want)
    assert [tuple(r)[1:6] for r in got if r["doc_id"] == 8] == [(1, 0, 20000, 1, 20000000)]
    assert query(df.limit(0)).collect() == []
    named = df.where("doc_id = 7").selectExpr("cast(doc_id as string) AS doc_id", "text")
    assert [r["doc_id"] for r in periodic_runs.periodic_runs(named).collect()] == ["7"]
    found = periodic_runs.periodic_runs(df.where("doc_id = 7")).first()
    assert [tuple(r) for r in found["runs"]] == [(0, 60, 2), (61, 25, 1)]
    assert found["kept"] == b"one two three four" and found["n_words"] == 86


@pytest.mark.parametrize("n", [1, 2, 3])
def test_strongest_breaks_ties_by_start_then_period(n):
    runs = [periodic_runs.Run(50, 30, 5), periodic_runs.Run(0, 60, 10), periodic_runs.Run(0, 30, 5)]
    assert periodic_runs.strongest(runs[:n]) == runs[n - 1]
    assert periodic_runs.strongest([]) is None
