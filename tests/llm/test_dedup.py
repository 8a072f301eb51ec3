"""Exact dedup and SimHash against brute force, with nulls, ties, empties and repeats."""

import hashlib
import re

import numpy as np
import pytest
import xxhash

from sagerow.llm import exact_dedup, fuse, simhash

SCHEMA = "doc_id long, text string, source string, row_h string, KEY string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", "x", "y") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(60)]
    base = [" ".join(rng.choice(words, int(rng.integers(1, 60)))) for _ in range(80)]
    out = [(i, t) for i, t in enumerate(base)]
    for i in range(80, 160):
        t = base[int(rng.integers(0, 80))].split(" ")
        kind = i % 4
        if kind == 1:
            t[int(rng.integers(0, len(t)))] = "changed"
        if kind == 2:
            t = ["\t".join(t)]
        if kind == 3:
            t.append("more")
        out.append((i, " ".join(t)))
    out += [(200, None), (201, ""), (202, " "), (203, "  \n"), (204, "a b"), (205, "A b C"), (206, "a b c")]
    out += [(None, "w1 w2"), (None, None), (300, "tie tie"), (300, "tie tie"), (301, "tie  tie"), (299, "x " * 30000)]
    return out


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 100, 5000])
def test_fuse_filter_has_no_false_negatives(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**63, n).astype(np.uint64)
    blob = fuse.build(np.concatenate([keys, keys]))
    assert fuse.contains(blob, keys).all()
    assert fuse.contains(blob, rng.integers(0, 2**63, 20000).astype(np.uint64)).mean() < 0.01


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_duplicates(spark, rows):
    got = exact_dedup.exact_duplicates(frame(spark, rows)).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    want = []
    for i, t in rows:
        g = groups[norm(t)]
        keep = min((x for x in g if x is not None), default=None)
        want.append((i, keep, len(g), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_drop_exact_duplicates_keeps_one_row_of_each(spark, rows):
    kept = exact_dedup.drop_exact_duplicates(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "source", "row_h", "KEY"]
    got = sorted(norm(r["text"]) for r in kept.collect())
    assert got == sorted({norm(t) for _, t in rows})


def test_batches_meet_a_growing_snapshot(spark, rows):
    """Three batches added in turn: each report against brute force over all rows so far."""
    snapshot, so_far, reports = (), [], []
    for part in (rows[::3], rows[1::3], rows[2::3]):
        before = len(snapshot)
        snapshot, report = exact_dedup.add(snapshot, exact_dedup.stored(frame(spark, part)))
        assert len(snapshot) == before + 1
        so_far += part
        reports.append(report)
        want = set()
        for text in {norm(t) for _, t in part}:
            ids = [i for i, t in so_far if norm(t) == text]
            if len(ids) > 1:
                want.add((hashlib.sha256(text.encode()).digest(), min((i for i in ids if i is not None), default=None), len(ids)))
        assert {(bytes(r["sha"]), r["keep_id"], r["size"]) for r in report.collect()} == want
    every = exact_dedup.latest(reports).collect()
    repeated = [t for t in {norm(t) for _, t in rows} if sum(norm(u) == t for _, u in rows) > 1]
    assert len(every) == len(repeated)
    # an empty batch changes nothing, and nothing meets its segment
    snapshot, report = exact_dedup.add(snapshot, exact_dedup.stored(frame(spark, []).limit(0)))
    assert report.collect() == []
    positive = exact_dedup.screen(exact_dedup.as_batch(exact_dedup.stored(frame(spark, rows))).keys, snapshot[-1])
    assert positive.collect() == []


def test_equal_keys_of_different_texts_stay_apart(spark):
    """Rows forged to share one 64-bit key: the buckets compare bytes."""
    import pyspark.sql.functions as F

    docs = frame(spark, [(1, "a b"), (2, "c d"), (3, "a  b"), (4, "c d"), (5, "e")])
    rows = exact_dedup.stored(docs).withColumn("key", F.lit(7).cast("long"))
    snapshot, first = exact_dedup.add((), rows.where("i <= 2"))
    assert first.collect() == []
    _, second = exact_dedup.add(snapshot, rows.where("i > 2"))
    assert sorted((r["keep_id"], r["size"]) for r in second.collect()) == [(1, 2), (2, 2)]


def slow_print(text, n=4):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w]
    if not words:
        return 0
    sh = [" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(points, near):
    parent = list(range(len(points)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for x in range(len(points)):
        for y in range(x):
            if near(points[x], points[y]):
                parent[find(x)] = find(y)
    return [find(k) for k in range(len(points))]


def test_simhash_components(spark, rows):
    got = simhash.simhash_components(frame(spark, rows)).collect()
    prints = [slow_print(t) for _, t in rows]
    root = classes(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    want = []
    for (i, _), p, r in zip(rows, prints, root):
        ids = [j for (j, _), q in zip(rows, root) if q == r and j is not None]
        want.append((i, f"{p:016x}", min(ids, default=None)))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_spark_xxhash_is_the_contract_hash(spark):
    texts = ["", "a", "abcd", "abcdefgh", "x" * 31, "é" * 40]
    got = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("xxhash64(t) h").collect()
    assert [r["h"] % 2**64 for r in got] == [xxhash.xxh64_intdigest(t.encode(), 42) for t in texts]


@pytest.mark.parametrize("small, block", [(32, 1024), (2, 4)])
def test_links_join_all_close_prints(spark, monkeypatch, small, block):
    """Planted pairs at 1 to 5 bits, and a dense cluster, also through the blocked path."""
    monkeypatch.setattr(simhash, "SMALL_CELL", small)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(3)
    points = set()
    for k in range(120):
        p = int(rng.integers(0, 2**63))
        q = p
        for b in rng.choice(64, 1 + k % 5, replace=False):
            q ^= 1 << int(b)
        points |= {p, q}
    for k in range(60):
        q = 0xF0F0
        for b in rng.choice(64, 2, replace=False):
            q ^= 1 << int(b)
        points.add(q)
    points = sorted(x - 2**64 if x >> 63 else x for x in points)
    df = spark.createDataFrame([(p,) for p in points], "fp long")
    got = {r["node"]: r["root"] for r in simhash.components(simhash.near_links(df)).collect()}
    root = classes(points, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4)
    for p, r in zip(points, root):
        group = [q for q, s in zip(points, root) if s == r]
        assert got.get(p, p) == min(group)


def test_drop_near_duplicates(spark, rows):
    df = frame(spark, rows)
    kept = simhash.drop_near_duplicates(df)
    prints = [slow_print(t) for _, t in rows]
    root = classes(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    want = []
    for r in set(root):
        ids = [i for (i, _), q in zip(rows, root) if q == r]
        want.append(min((i for i in ids if i is not None), default=None))
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted(want, key=repr)


def test_chain_components(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 2000), (5, 5)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(201)}, 1000: 1000, 2000: 1000}


def test_empty_table(spark):
    df = frame(spark, []).limit(0)
    assert exact_dedup.exact_duplicates(df).collect() == []
    assert exact_dedup.drop_exact_duplicates(df).collect() == []
    assert simhash.simhash_components(df).collect() == []
    assert simhash.drop_near_duplicates(df).collect() == []


def test_ids_of_another_type(spark):
    df = spark.createDataFrame([("b", "x  y"), ("a", "x y"), (None, "x y"), ("c", "z")], "doc_id string, text string")
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.exact_duplicates(df).collect()}
    assert got == {"b": ("a", False), "a": ("a", True), None: ("a", False), "c": ("c", True)}
    assert sorted(r["doc_id"] for r in exact_dedup.drop_exact_duplicates(df).collect()) == ["a", "c"]
    assert {r["component_id"] for r in simhash.simhash_components(df).collect()} <= {"a", "c"}
