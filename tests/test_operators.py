"""Operators against brute-force restatements and properties."""

import random
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sagerow.operators import analytics as an
from sagerow.operators import bpe as bp
from sagerow.operators import curate as cu
from sagerow.operators import evaluate as ev
from sagerow.operators import prefilter as pf
from sagerow.operators.rank import global_index, range_sorted, split_val_train
from sagerow.streaming.metrics import METRIC_SCHEMA, STATE, fold_batch


def py_vote(preds):
    counts = {}
    for p in preds:
        counts[p] = counts.get(p, 0) + 1
    return sorted(counts.items(), key=lambda x: x[1])[-1][0]


def test_vote_tie_rule(spark):
    rows = []
    for t, preds in enumerate([["a", "b"], ["a", "b", "b", "a"], ["a", "b", "a"]]):
        rows += [(r, t, p, "g") for r, p in enumerate(preds)]
    df = spark.createDataFrame(rows, "run long, task_id long, pred string, gold string")
    got = {r.task_id: r.vote for r in ev.majority_vote(df).collect()}
    assert got == {0: "b", 1: "b", 2: "a"}


def test_self_consistency_matches_python(spark):
    rnd = random.Random(3)
    rows, gold = [], {}
    for t in range(40):
        gold[t] = rnd.choice("xyz")
        for r in range(rnd.randint(1, 9)):
            rows.append((r, t, rnd.choice("xyz"), gold[t]))
    df = spark.createDataFrame(rows, "run long, task_id long, pred string, gold string")
    got = {r.k: r.correct for r in ev.self_consistency(df).collect()}
    by_task = {}
    for r, t, p, _ in sorted(rows):
        by_task.setdefault(t, []).append(p)
    k_max = max(len(v) for v in by_task.values())
    for k in range(1, k_max + 1):
        assert got[k] == sum(py_vote(v[:k]) == gold[t] for t, v in by_task.items())


def test_sc_golden(spark):
    rows = [(0, 1, "x", "y"), (1, 1, "y", "y"), (2, 1, "y", "y"), (0, 2, "z", "z"), (1, 2, "z", "z"), (2, 2, "w", "z")]
    df = spark.createDataFrame(rows, "run long, task_id long, pred string, gold string")
    got = {r.k: r.acc for r in ev.self_consistency(df).collect()}
    assert got == {1: 0.5, 2: 1.0, 3: 1.0}


def test_global_index_matches_row_number_and_partitioning(spark):
    rnd = random.Random(1)
    data = [(i, rnd.randint(0, 50)) for i in range(500)]
    df = spark.createDataFrame(data, "id long, k long")
    expect = {i: pos for pos, (i, _) in enumerate(sorted(data, key=lambda x: (x[1], x[0])))}
    for parts in (1, 7):
        got = {r.id: r.idx for r in global_index(df.repartition(parts), ["k", "id"]).collect()}
        assert got == expect
    # per-group positions
    got = {r.id: r.idx for r in global_index(df, ["id"], partition_by=["k"]).collect()}
    per = {}
    for i, k in sorted(data):
        per.setdefault(k, []).append(i)
    assert got == {i: pos for ids in per.values() for pos, i in enumerate(ids)}


def test_split_disjoint_complete_and_balanced(spark):
    df = spark.range(1000).withColumnRenamed("id", "doc_id")
    s = split_val_train(df, "doc_id", 100, 8).collect()
    assert len(s) == 1000 and len({r.doc_id for r in s}) == 1000
    assert sum(r.split == "val" for r in s) == 100
    sizes = Counter(r.shard for r in s if r.split == "train")
    assert max(sizes.values()) - min(sizes.values()) <= 1


def test_dedup_first_wins_before_length(spark):
    q = "a question that is long enough"
    rows = [(0, q, "short"), (1, q, "a long enough answer to keep it")]
    df = spark.createDataFrame(rows, "seq long, question string, answer string")
    assert cu.curate(df).count() == 0
    assert cu.curate(df, filter_first=True).count() == 1


def brute_bpe(words, merges):
    seqs = {tuple(w): n for w, n in words.items()}
    out = []
    for _ in range(merges):
        pc = Counter()
        for s, n in seqs.items():
            for a, b in zip(s, s[1:]):
                pc[(a, b)] += n
        if not pc:
            break
        (a, b), c = sorted(pc.items(), key=lambda x: (-x[1], x[0]))[0]
        out.append((a, b, c))
        new = {}
        for s, n in seqs.items():
            m, i = [], 0
            while i < len(s):
                if i < len(s) - 1 and s[i] == a and s[i + 1] == b:
                    m.append(a + b)
                    i += 2
                else:
                    m.append(s[i])
                    i += 1
            new[tuple(m)] = new.get(tuple(m), 0) + n
        seqs = new
    return out


def test_bpe_training_matches_brute_force(spark):
    rnd = random.Random(7)
    words = {"".join(rnd.choice("abcab ") for _ in range(rnd.randint(1, 7))).replace(" ", "a"): rnd.randint(1, 9) for _ in range(60)}
    df = spark.createDataFrame(list(words.items()), "token string, n long")
    got = [(r["a"], r["b"], r["count"]) for r in bp.train_bpe(df, 12).orderBy("rank").collect()]
    assert got == brute_bpe(words, 12)


def test_bpe_whole_vocabulary_matches_brute_force(spark, monkeypatch):
    rnd = random.Random(11)
    words = {"".join(rnd.choice("aaabc") for _ in range(rnd.randint(1, 12))): rnd.randint(1, 9) for _ in range(80)}
    df = spark.createDataFrame(list(words.items()), "token string, n long")
    every = brute_bpe(words, 10**6)  # until every word is one symbol

    def got(merges, **kw):
        return [(r["a"], r["b"], r["count"]) for r in bp.train_bpe_vocab(df, 257 + merges, **kw).orderBy("rank").collect()]

    assert got(10**6, least=1) == every and got(40, least=1) == every[:40]
    often = [m for m in every if m[2] > 9]
    assert 0 < len(often) < len(every) and got(10**6, least=10) == often
    monkeypatch.setattr(bp, "ROUND_PAIRS", 3)  # many rounds
    assert got(10**6, least=1) == every
    monkeypatch.setattr(bp, "SEGMENT_BYTES", 200)  # rounds that have to mark fewer pairs
    assert got(25, least=1) == every[:25]
    monkeypatch.setattr(bp, "MOST_PAIRS", 1)  # more pairs of one count than the driver sees
    assert got(8, least=1) == every[:8]


def slow_merge(symbols, ranks):
    """Each merge in rank order over the whole word, from the left."""
    for pair, (_, new) in sorted(ranks.items(), key=lambda x: x[1]):
        out, i = [], 0
        while i < len(symbols):
            if i + 1 < len(symbols) and symbols[i] << 32 | symbols[i + 1] == pair:
                out.append(new)
                i += 2
            else:
                out.append(symbols[i])
                i += 1
        symbols = out
    return symbols


@settings(max_examples=200, deadline=None)
@given(st.text("abcd", max_size=60), st.lists(st.text("abcd", min_size=1, max_size=12), min_size=1, max_size=12))
def test_merge_word_applies_merges_in_rank_order(text, words):
    names = bp.base_alphabet()
    wide = [b"".join(bytes([ord(c), 0, 0, 0]) for c in w) for w in words]
    learned, after = bp.learn_merges(wide, [1 + k for k in range(len(words))], names, 30)
    ids = {n: i for i, n in enumerate(names)}
    ranks = {ids[a] << 32 | ids[b]: (k + 1, ids[a + b]) for k, (a, b, _) in enumerate(learned)}
    assert bp.merge_word([ord(c) for c in text], ranks) == slow_merge([ord(c) for c in text], ranks)
    for w, got in zip(words, after):
        want = slow_merge([ord(c) for c in w], ranks)
        assert [int.from_bytes(got[k : k + 4], "little") for k in range(0, len(got), 4)] == want


def test_merge_word_on_long_pieces_is_not_quadratic():
    names = bp.base_alphabet()
    learned, _ = bp.learn_merges([b"a\0\0\0" * 64 + b"b\0\0\0"], [1], names, 8)
    ids = {n: i for i, n in enumerate(names)}
    ranks = {ids[a] << 32 | ids[b]: (k + 1, ids[a + b]) for k, (a, b, _) in enumerate(learned)}
    start = time.process_time()
    got = bp.merge_word([ord("a")] * 256_000, ranks)
    assert time.process_time() - start < 20 and len(got) < 256_000 // 30


def test_full_bpe_queries_go_past_fifty_merges(spark):
    import __spark_entry__ as entry

    merges = entry.queries()["bpe_full_merges"](spark, "/root/testdata/sf0.001")
    assert merges.count() > 1000
    assert {r["roundtrip_ok"] for r in entry.queries()["bpe_full_roundtrip"](spark, "/root/testdata/sf0.001").collect()} == {True}


def test_bpe_roundtrip_non_ascii(spark):
    words = {"héllo": 3, " wörld": 2, "日本": 1, "hello": 4}
    df = spark.createDataFrame(list(words.items()), "token string, n long")
    m = bp.train_bpe(df, 5)
    v = bp.bpe_vocab(spark, m, ("<eos>",))
    texts = spark.createDataFrame([(1, "héllo wörld 日本"), (2, "")], "k long, t string")
    enc = bp.bpe_encode(texts, ["k"], F.col("t"), m, v)
    dec = {r.k: r.text for r in bp.bpe_decode(enc, ["k"], "ids", v, ("<eos>",)).collect()}
    assert dec == {1: "héllo wörld 日本", 2: ""}


def test_power_law_and_interpolation(spark):
    df = spark.createDataFrame([("g", 1.0, 2.0), ("g", 2.0, 8.0), ("g", 4.0, 32.0)], "k string, x double, y double")
    r = an.power_law_fit(df, ["k"], "x", "y").first()
    assert abs(r.a - 2) < 1e-9 and abs(r.b - 2) < 1e-9
    kp = spark.createDataFrame([("u", 0.0, 0.0), ("u", 1.0, 10.0), ("u", 2.0, 30.0)], "k string, x double, y double")
    pr = spark.createDataFrame([("u", -1.0), ("u", 0.5), ("u", 3.0)], "k string, x double")
    got = {r.x: r.y for r in an.interpolate(kp, pr, ["k"]).collect()}
    assert got == {-1.0: -10.0, 0.5: 5.0, 3.0: 50.0}


def test_ema_matches_recursion(spark):
    vals = [random.Random(5).uniform(0, 50) for _ in range(70)]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(vals)], "run long, step long, value double")
    got = {r.step: (r.ema_mean, r.ema_std) for r in an.ema_stats(df, ["run"], "step", "value", 0.9).collect()}
    e1 = e2 = bias = 1e-8
    for i, v in enumerate(vals):
        e1 += 0.1 * (v - e1)
        e2 += 0.1 * (v * v - e2)
        bias += 0.1 * (1 - bias)
        m = e1 / bias
        sd = max(e2 / bias - m * m, 0) ** 0.5
        assert abs(got[i][0] - m) < 1e-9 and abs(got[i][1] - sd) < 1e-6


def test_halo_chunks_equal_unsplit_windows(spark):
    rnd = random.Random(11)
    vals = [rnd.uniform(0, 100) for _ in range(300)]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(vals)], "run long, step long, value double")
    small = an.rolling_quantile_clip(df, ["run"], "step", "value", 0.9, window=7, chunk=20)
    big = an.rolling_quantile_clip(df, ["run"], "step", "value", 0.9, window=7, chunk=10_000)
    a = {r.step: (r.q, r.clipped) for r in small.collect()}
    b = {r.step: (r.q, r.clipped) for r in big.collect()}
    assert a == b and len(a) == 300
    e1 = {r.step: r.ema_mean for r in an.ema_stats(df, ["run"], "step", "value", 0.5).collect()}
    assert len(e1) == 300


def test_global_index_orders_nulls_first_and_keeps_null_groups(spark):
    df = spark.createDataFrame([(1, None, 3), (2, None, None), (3, "a", 5), (4, "a", None), (5, "b", 1)], "id long, g string, k long")
    got = {r.id: r.idx for r in global_index(df, ["k", "id"]).collect()}
    assert got == {2: 0, 4: 1, 5: 2, 1: 3, 3: 4}
    got = {r.id: r.idx for r in global_index(df, ["k", "id"], partition_by=["g"]).collect()}
    assert got == {2: 0, 1: 1, 4: 0, 3: 1, 5: 0}
    assert global_index(df.limit(0), ["k", "id"]).count() == 0


def largest_over_mean(spark, df, order, parts=()):
    """Rows of the largest written partition over the mean, and the positions' correctness."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = range_sorted(df, [*parts, *order])
        sizes = [r["n"] for r in rows.groupBy("_task").agg(F.count("*").alias("n")).collect()]
        n = global_index(df, order, partition_by=parts).agg(F.count_distinct("idx"), F.max("idx")).first()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    return max(sizes) * len(sizes) / sum(sizes), n


def test_global_index_spreads_outliers_heavy_values_and_hot_groups(spark):
    outlier = spark.range(8000).select("id", F.when(F.col("id") == 5, 10**15).otherwise(F.col("id") % 97).alias("k"))
    ratio, n = largest_over_mean(spark, outlier, ["k", "id"])
    assert ratio < 3 and tuple(n) == (8000, 7999)
    one = spark.range(8000).select("id", F.lit(7).alias("k"))
    ratio, n = largest_over_mean(spark, one, ["k", "id"])
    assert ratio < 3 and tuple(n) == (8000, 7999)
    hapax = spark.range(8000).select(F.lit(-1).alias("neg"), F.concat(F.lit(" the"), F.col("id").cast("string")).alias("token"))
    ratio, n = largest_over_mean(spark, hapax, ["neg", "token"])
    assert ratio < 3 and tuple(n) == (8000, 7999)
    hot = spark.range(8000).select("id", F.when(F.col("id") % 10 < 9, 1).otherwise(F.col("id")).alias("g"))
    ratio, n = largest_over_mean(spark, hot, ["id"], ["g"])
    assert ratio < 3 and n[1] == 7199


def test_self_consistency_with_missing_runs(spark):
    rows = [(0, 1, "x", "x"), (1, 1, "x", "x"), (1, 2, "y", "y"), (4, 3, "z", "w")]
    df = spark.createDataFrame(rows, "run long, task_id long, pred string, gold string")
    assert [tuple(r) for r in ev.self_consistency(df).orderBy("k").collect()] == [(1, 3, 2, 2 / 3), (2, 3, 2, 2 / 3)]


def test_ema_keeps_old_rows_of_any_magnitude(spark):
    """No horizon: a huge first value still shows after hundreds of rows, over several fold levels."""
    vals = [1e20] + [0.0] * 499 + [float(k % 7) for k in range(4500)]
    rows = [("a", i, v) for i, v in enumerate(vals)] + [(None, i, 2.0) for i in range(3)]
    df = spark.createDataFrame(rows, "run string, step long, value double")
    got = {(r.run, r.step): r.ema_mean for r in an.ema_stats(df, ["run"], "step", "value", 0.9).collect()}
    e = bias = 1e-8
    for i, v in enumerate(vals):
        e = 0.9 * e + (1 - 0.9) * v
        bias = 0.9 * bias + (1 - 0.9)
        assert abs(got[("a", i)] - e / bias) <= 1e-9 * abs(e / bias) + 1e-30, i
    assert len(got) == len(rows) and abs(got[(None, 2)] - 2.0) < 1e-6


def test_interpolation_of_single_and_repeated_keypoints(spark):
    kp = spark.createDataFrame([("one", 1.0, 5.0), ("two", 1.0, 5.0), ("two", 1.0, 6.0), ("two", 2.0, 8.0), (None, 0.0, 1.0)], "k string, x double, y double")
    pr = spark.createDataFrame([("one", 0.0), ("one", 9.0), ("two", 0.0), ("two", 1.5), (None, 4.0), ("none", 1.0)], "k string, x double")
    got = {(r.k, r.x): r.y for r in an.interpolate(kp, pr, ["k"]).collect()}
    assert got == {("one", 0.0): 5.0, ("one", 9.0): 5.0, ("two", 0.0): 5.0, ("two", 1.5): 7.0, (None, 4.0): 1.0}


def test_unfit_groups_are_null_not_errors(spark):
    df = spark.createDataFrame([("g", 10.0, 2.0), ("g", 20.0, 1.0), ("h", 1.0, 3.0), ("h", 2.0, 1.0), ("h", 4.0, 2.0)], "k string, p double, l double")
    got = {r.k: r.opt_loss for r in an.isoflop_optimum(df, ["k"], "p", "l").collect()}
    assert got["g"] is None and got["h"] is not None
    flat = spark.createDataFrame([("g", 3.0, 2.0), ("g", 3.0, 1.0)], "k string, x double, y double")
    assert an.power_law_plus_constant_fit(flat, ["k"], "x", "y", grid=10).count() <= 1


def test_too_long_source_stops_the_job(spark):
    import pytest

    from sagerow.plans.tasks import strict_test_rows

    df = spark.createDataFrame([(1, [1, 2]), (2, [1, 2, 3])], "task_id long, src_ids array<int>")
    assert strict_test_rows(df, 4).count() == 2 and len(strict_test_rows(df, 4).collect()) == 2
    with pytest.raises(Exception, match="too short for task 2"):
        strict_test_rows(df, 3).collect()


def test_dedup_keeps_null_keys_and_hashes(spark):
    rows = [(0, None, "a" * 20), (1, None, "b" * 20), (2, "q" * 20, "c" * 20), (2, "q" * 20, "c" * 20), (3, "q" * 20, "d" * 20)]
    df = spark.createDataFrame(rows, "seq long, question string, answer string")
    assert sorted((r.seq, r.question) for r in cu.dedup_first_wins(df).collect()) == [(0, None), (2, "q" * 20)]


def test_model_set_up_once_per_task(spark):
    import pandas as pd

    def setup():
        state = {"calls": 0}

        def call(prompts: pd.Series) -> pd.Series:
            state["calls"] += 1
            return prompts + str(state["calls"])

        return call

    df = spark.createDataFrame([("a",), ("b",)], "p string").coalesce(1)
    assert [r.t for r in cu.run_model(df, None, "p", "t", setup=setup).collect()] == ["a1", "b1"]


def test_scratch_folder_must_be_shared_on_a_cluster(spark, monkeypatch):
    import pytest

    from sagerow import session

    class Context:
        master = "spark://host:7077"
        applicationId = "app"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext = Context()
        conf = Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_root(Session())


def grid_fit(x, y, grid):
    """y0 + a x^b by trying every y0 of the grid with plain numpy."""
    best = None
    for k in range(grid):
        y0 = min(y) * k / max(1, grid - 1)
        if min(v - y0 for v in y) <= 0:
            continue
        lx, ly = np.log(x), np.log(np.array(y) - y0)
        b = ((lx - lx.mean()) * (ly - ly.mean())).sum() / ((lx - lx.mean()) ** 2).sum()
        a = np.exp(ly.mean() - b * lx.mean())
        mse = float(np.mean((np.array(y) - (a * np.array(x) ** b + y0)) ** 2))
        if best is None or mse < best[-1]:
            best = (a, b, y0, mse)
    return best


def test_grid_fit_in_slices_of_points(spark, monkeypatch):
    monkeypatch.setattr(an, "GRID_POINTS", 7)  # many slices, merged over several levels
    monkeypatch.setattr(an, "GRID_MERGE", 3)
    rng = np.random.default_rng(1)
    rows = [("hot", float(x), float(5 + 300 * x**-0.4 + rng.normal(0, 0.5))) for x in rng.uniform(1, 500, 300)]
    rows += rows[:50] + [(None, float(x), float(2 + 3 * x**0.5)) for x in range(1, 12)]
    rows += [("one x", 3.0, 4.0), ("one x", 3.0, 5.0), ("null", None, 1.0), ("null", 2.0, None)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    got = {r["k"]: r for r in an.power_law_plus_constant_fit(df, ["k"], "x", "y", grid=101).collect()}
    assert set(got) == {"hot", None}
    for k in got:
        want = grid_fit(*zip(*[(r[1], r[2]) for r in rows if r[0] == k]), 101)
        assert np.allclose([got[k][c] for c in ("a", "b", "y0", "mse")], want, rtol=1e-7)
    assert an.power_law_plus_constant_fit(df.limit(0), ["k"], "x", "y", grid=11).collect() == []


@pytest.mark.parametrize("window,fill", [(1, None), (5, None), (5, 100.0), (40, None), (40, -1.0)])
def test_window_quantiles_against_sorting(window, fill):
    rng = random.Random(window)
    values = [None if rng.random() < 0.1 else float(rng.randrange(12)) for _ in range(200)]
    starts = [max(0, k - window) for k in range(len(values))]
    for q in (0.0, 0.3, 0.95, 1.0):
        got = an.window_quantiles(values, starts, q, fill, window)
        for k, g in enumerate(got):
            held = [v for v in values[starts[k] : k] if v is not None]
            held += [fill] * (window - len(held)) if fill is not None else []
            assert (g is None) == (not held) and (not held or abs(g - np.quantile(held, q)) < 1e-9)


def test_filter_holds_its_keys_and_few_others(spark, monkeypatch):
    monkeypatch.setattr(pf, "REGION_KEYS", 5_000)  # several regions
    keys = spark.range(20_000).select(F.xxhash64("id"))
    bitmaps = pf.build_filter(keys.unionByName(keys))
    assert bitmaps.shape == (4, 1 << 17)
    hashed = spark.range(60_000).select("id", F.xxhash64("id").alias("h"))
    held = [r["id"] for r in hashed.where(pf.may_hold(bitmaps, F.col("h"), hashed)).collect()]
    assert set(range(20_000)) <= set(held) and len(held) - 20_000 < 0.001 * 40_000
    monkeypatch.setattr(pf, "FILTER_BYTES", 10_000)
    assert pf.build_filter(keys) is None


@pytest.mark.parametrize("bound", [64 << 20, 0])
def test_not_seen_with_and_without_the_filter(spark, monkeypatch, bound):
    monkeypatch.setattr(pf, "FILTER_BYTES", bound)
    new = spark.createDataFrame([(k, f"q{k % 40}" if k % 7 else None) for k in range(100)], "seq long, question string")
    seen = spark.createDataFrame([(f"q{k}",) for k in range(20, 500)] * 2 + [(None,)], "question string")
    got = sorted((r.seq, r.question) for r in cu.not_seen(new, seen).collect())
    want = [(k, f"q{k % 40}" if k % 7 else None) for k in range(100)]
    assert got == [w for w in want if w[1] is None or int(w[1][1:]) < 20]
    assert cu.not_seen(new.limit(0), seen).collect() == []


def test_metric_state_holds_open_buckets_only(spark):
    every, state, parts = 5, spark.createDataFrame([], STATE), []
    rows = [(run, step, "loss", float(run + step)) for run in (1, 2) for step in range(43) if (run, step) != (2, 9)]
    drops = [[r for r in rows if lo <= r[1] < lo + 9] for lo in range(0, 45, 9)]
    drops[3].append((1, 2, "loss", 100.0))  # late: its bucket has closed
    drops = [spark.createDataFrame(d, METRIC_SCHEMA) for d in drops]
    for batch in drops:
        closed, state = fold_batch(state, batch, every)
        parts += [(r["run_id"], r["bucket"], r["s"] / r["n"], r["n"]) for r in closed.collect()]
        state = spark.createDataFrame(state.collect(), STATE)
        assert state.where("n is not null").count() <= 2 and state.where("n is null").count() <= 2
    want = []
    for run in (1, 2):
        for bucket in range(0, 10):
            held = [r for r in rows if r[0] == run and (0 if r[1] == 0 else r[1] // every + 1) == bucket]
            if held and (bucket == 0 or max(r[1] for r in held) % every == every - 1):
                want.append((run, bucket, sum(r[3] for r in held) / len(held), len(held)))
    assert sorted(parts) == sorted(want) and (2, 2) not in {p[:2] for p in parts}
    one, _ = fold_batch(state.limit(0), spark.createDataFrame(rows, METRIC_SCHEMA), every)
    assert sorted((r["run_id"], r["bucket"], r["s"] / r["n"], r["n"]) for r in one.collect()) == sorted(want)


def test_interpolate_across_partition_borders(spark):
    """One hot key over many sorted partitions, keys with one or no keypoint, ties and NULLs, against brute force."""
    rng = np.random.default_rng(11)
    kps = [("hot", float(x), float(rng.integers(0, 50))) for x in rng.integers(0, 40, 30)]
    kps += [("few", 5.0, 1.0), ("one", 3.0, 7.0), (None, 0.0, 1.0), (None, 2.0, 5.0), ("two", 1.0, 1.0), ("two", 1.0, 4.0)]
    prs = [("hot", float(x) / 4) for x in rng.integers(-200, 400, 400)] + [("few", float(x)) for x in range(60)]
    prs += [("one", -1.0), ("one", 9.0), (None, 1.0), (None, 7.0), ("none", 1.0), ("two", 1.0), ("two", 3.0), ("two", 0.0)]
    want = []
    for k, x in prs:
        own = sorted((a, b) for key, a, b in kps if key == k)
        if own:
            left = sum(a <= x for a, _ in own) - 1
            i = min(max(left, 0), max(len(own) - 2, 0))
            (x0, y0), (x1, y1) = own[i], own[min(i + 1, len(own) - 1)]
            want.append((k, x, y0 + ((x - x0) * (y1 - y0) / (x1 - x0) if x1 != x0 else 0.0)))
    kp, pr = spark.createDataFrame(kps, "k string, x double, y double"), spark.createDataFrame(prs, "k string, x double")
    for coalesce in ("false", "true"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
        try:
            got = [tuple(r) for r in an.interpolate(kp, pr, ["k"]).collect()]
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert len(got) == len(want)
        for g, t in zip(sorted(got, key=repr), sorted(want, key=repr)):
            assert g[:2] == t[:2] and g[2] == pytest.approx(t[2])
    assert an.interpolate(kp.limit(0), pr, ["k"]).collect() == []
