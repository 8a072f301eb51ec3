"""Steps that keep their work, memory and what the driver gets in proportion, against plain restatements."""

import os
import random
import time
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sagerow.config import Tokens
from sagerow.functions import arrays as ar
from sagerow.functions import text as tx
from sagerow.operators import bpe as bp
from sagerow.operators import refine as rf
from sagerow.operators import vocab as vb
from sagerow.plans import fixtures as fx
from sagerow.plans import tasks
from sagerow.session import checkpoint_root, cut_lineage
from sagerow.streaming import curation as sc


def test_bpe_training_sends_levels_not_rows(spark):
    rows = [(k, 3 + (k < 40) * 1000 + (k < 4) * k * 9000) for k in range(5000)]
    pairs = spark.createDataFrame(rows, "pair long, n long")
    levels = bp._count_levels(pairs, 2)
    assert levels[-1] == (3, 4960) and sum(k for _, k in levels) == 5000 and len(levels) < 10
    assert bp._marked_from(levels, 40) == levels[-2][0] and bp._marked_from(levels, 41) == 3
    assert bp._marked_from([(9, 50), (8, bp.MOST_PAIRS)], 60) == 9
    assert bp._marked_from([(9, 5000), (8, 1)], 4096) == 9 and bp._marked_from([(9, bp.MOST_PAIRS + 1)], 4096) is None
    assert bp._marked_from(levels, 0) is None


def test_bpe_encode_and_decode_in_slices(spark, monkeypatch):
    words = {"ab": 5, "abc": 3, " ab": 2}
    m = bp.train_bpe(spark.createDataFrame(list(words.items()), "token string, n long"), 4)
    v = bp.bpe_vocab(spark, m, ("<eos>",))
    texts = ["abc ab é" * 50, "", None, "ab" * 3, "\x00\xad日本 abc"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string").coalesce(1)
    enc = bp.bpe_encode(df, ["k"], F.col("t"), m, v)
    dec = {r.k: r.text for r in bp.bpe_decode(enc, ["k"], "ids", v, ("<eos>",)).collect()}
    assert dec == {k: t or "" for k, t in enumerate(texts)}
    lists = pa.array([[1, 2], None, [3] * 9, [], [4]], pa.list_(pa.int32()))
    monkeypatch.setattr(bp, "SLICE_ITEMS", 4)
    assert [len(x.flatten()) for x in bp._slices(lists)] == [2, 9, 1]
    odd = spark.createDataFrame([(1, [0, 99999, None, 98])], "k long, ids array<int>")
    assert bp.bpe_decode(odd, ["k"], "ids", v, ("<eos>",)).first().text == "<eos>a"


def test_pair_counts_of_all_bytes(spark):
    text = "".join(map(chr, range(0x250))) + "日本 aaa"
    w = bp.word_table(spark.createDataFrame([(text, 2), ("aaa", 3), ("a", 9), ("", 4)], "token string, n long"))
    want, names = Counter(), bp.base_alphabet()
    for t, n in ((text, 2), ("aaa", 3)):
        s = [names[b] for b in t.encode()]
        for pair in zip(s, s[1:]):
            want[pair] += n
    counted = bp.pair_counts(w)
    assert {(r["a"], r["b"]): r["count"] for r in counted.collect()} == want
    assert "ArrayTransform" not in counted._jdf.queryExecution().toString() and "transform(" not in counted._jdf.queryExecution().toString()


@pytest.mark.parametrize("head", [2, 1000])
def test_encode_lists_joins_rare_pieces_only(spark, monkeypatch, head):
    monkeypatch.setattr(vb, "HEAD_IDS", head)
    rnd = random.Random(3)
    words = ["<<", "*", "=", *(str(k) for k in range(60))]
    rows = [(k, [[rnd.choice(words) for _ in range(rnd.randint(0, 6))] for _ in range(rnd.randint(0, 4))]) for k in range(300)] + [(300, None)]
    df = spark.createDataFrame(rows, "k long, texts array<array<string>>")
    vocab = spark.createDataFrame([(w, i + 3) for i, w in enumerate(words)], "token string, id int")
    got = {r.k: r.ids for r in vb.encode_lists(df, "k", "texts", vocab).collect()}
    assert got == {k: [[words.index(w) + 3 for w in t] for t in texts or []] for k, texts in rows}


def test_masks_and_lists_without_lambdas(spark):
    df = spark.createDataFrame([(2, [1, None, 3]), (9, []), (None, None), (-1, [7])], "n int, x array<int>")
    r = df.select(ar.length_mask("n", 3).alias("m"), tx.show_long_array("x").alias("s"), tx.show_array("x").alias("t")).collect()
    assert [x.m for x in r] == [[True, True, False], [True] * 3, [None] * 3, [False] * 3]
    assert [x.s for x in r] == [x.t for x in r] == ["1|3", "", None, "7"]
    assert "lambdafunction" not in df.select(ar.length_mask("n", 3))._jdf.queryExecution().toString()


def test_order_rationales_joins_runs_across_batches(spark, tmp_path):
    rnd = random.Random(5)
    lines = [(rnd.choice([None, 1, 2, 3, 4]), rnd.randint(1, 4), 1, k, rnd.choice([None, 2.0, 3.0]), rnd.choice([1.5, 2.25])) for k in range(60)]
    lines += [(7, 1, 1, 1, None, 1.0)]  # an order without a value
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double"
    spark.createDataFrame(lines, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {r["l_orderkey"]: (r["thoughts"], r["amounts"], r["total"]) for r in fx.order_rationales(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for key in {x[0] for x in lines}:
        own = sorted((x[1:] for x in lines if x[0] == key and x[4] is not None), key=lambda x: x[:3])
        qc = [(int(x[3]), round(x[4] * 100)) for x in own]
        joined = " ".join(f"<<{q}*{c}={q * c}>>" for q, c in qc), " + ".join(str(q * c) for q, c in qc), sum(q * c for q, c in qc)
        want[key] = joined if qc else (None, None, None)
    assert got == want


def test_curate_batch_deduplicates_once(spark, tmp_path, monkeypatch):
    real = sc.dedup_first_wins

    def counted(df, *a):
        out = real(df, *a)
        seen = F.udf(lambda q: rows_made.add(1) or q)
        return out.withColumn("question", seen("question"))

    rows_made = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(sc, "dedup_first_wins", counted)
    schema = "seq long, question string, answer string"
    one = spark.createDataFrame([(k, f"question number {k} of many", "an answer that is long enough") for k in range(20)], schema)
    two = spark.createDataFrame([(k, f"question number {k} of many", "an answer that is long enough") for k in range(10, 30)], schema)
    sc.curate_batch(spark, one, 0, str(tmp_path))
    sc.curate_batch(spark, two, 1, str(tmp_path))
    assert rows_made.value == 40  # each row once a batch
    assert spark.read.parquet(f"{tmp_path}/accepted").count() == 30


def test_refinement_runs_all_passes_in_one_stage(spark, monkeypatch, tmp_path):
    """Rows finish in different passes or never; batches of 3 rows, one write whatever the rounds."""
    tk, n = Tokens(eos_id=0, sep_id=1, pad_id=2), 8
    rnd = random.Random(4)
    rows = [(k, [rnd.randint(3, 9) for _ in range(rnd.randint(0, 3))], rnd.randint(1, 6), None if k % 5 else "x") for k in range(40)]
    df = spark.createDataFrame([(k, s + [1] + [2] * (n - len(s) - 1), at, t) for k, s, at, t in rows], "k long, ids array<int>, at int, t string")

    def model(pdf):  # one id after the SEP a pass, EOS in pass ``at``
        out = []
        for ids, r, at in zip(pdf["ids"], pdf["round"], pdf["at"]):
            ids = [int(x) for x in ids]
            p = ids.index(1)
            out.append([*ids[: p + 1], 10 + r, *([0] if r + 1 == at else []), *ids[p + 1 :]])
        return pd.Series(out, index=pdf.index, dtype=object)

    stages = []
    monkeypatch.setattr(rf, "cut_lineage", lambda df, name, **kw: stages.append(name) or cut_lineage(df, name, **kw))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        out = rf.refine(df, model, 4, n, "ids", tk)
        got = {r.k: (r.ids, r.finished, r.rounds_used, r["at"], r.t) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for k, s, at, t in rows:
        wrote = [10 + r for r in range(min(at, 4))]
        if at <= 4:  # as the model left it
            want[k] = (s + wrote[:-1] + [1] + wrote[-1:] + [0] + [2] * (n - len(s) - at), True, at, at, t)
        else:
            want[k] = (s + wrote + [1] + [2] * (n - len(s) - 5), False, 4, at, t)
    assert got == want
    assert out.columns == ["k", "ids", "at", "t", "finished", "rounds_used"]
    assert stages == ["refine"]
    assert [tuple(r) for r in rf.refine(df.limit(1), model, 0, n, "ids", tk).select("finished", "rounds_used").collect()] == [(False, 0)]


@pytest.mark.parametrize("width", [None, 9])
def test_list_forms_equal_the_column_forms(spark, width):
    tk = Tokens(eos_id=0, sep_id=1, pad_id=2)
    rnd = random.Random(6)
    lists = []
    for _ in range(200):
        x = [rnd.choice([0, 2, 3, 4, 5, None]) for _ in range((width or rnd.randint(1, 12)) - 1)]
        x.insert(rnd.randint(0, x.index(2) if 2 in x else len(x)), 1)
        lists.append(x)
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "k long, x array<int>")
    want = df.orderBy("k").select(ar.shift_sep_to_pad("x", 9, tk)["ids"].alias("s"), F.coalesce(ar.finished("x", tk), F.lit(False)).alias("f")).collect()
    column = pa.array([[7], *lists, [8]], pa.list_(pa.int32())).slice(1, len(lists))
    assert ar.shift_sep_to_pad_lists(column, 9, tk).to_pylist() == [r.s for r in want]
    assert ar.finished_lists(pa.concat_arrays([column, pa.array([None, []], column.type)]), tk).tolist() == [r.f for r in want] + [False, False]
    for x in ([3, 4], [3, 2, 1], []):
        with pytest.raises(ValueError, match="no SEP id"):
            ar.shift_sep_to_pad_lists(pa.array([[1, 2], x], column.type), 9, tk)
    assert not len(ar.shift_sep_to_pad_lists(pa.array([], column.type), 9, tk))


def test_demo_thought_writer_writes_the_next_thought():
    pdf = pd.DataFrame({"round": [0, 1, 2, 5], "ids": [np.array([7, 1, 2, 2])] * 4, "tgt_ids_list": [[[3, 4], [5]]] * 2 + [[[3], [4], []]] + [[[3]]]})
    got = [x.tolist() for x in tasks.demo_thought_writer()(pdf)]
    assert got == [x + [2] * (256 - len(x)) for x in ([7, 1, 3, 4], [7, 1, 5, 0], [7, 1, 0], [7, 1])]
    with pytest.raises(ValueError, match="not in list"):
        tasks.demo_thought_writer()(pdf.assign(ids=[[7, 2]] * 4))


@pytest.mark.parametrize("head, buckets", [(2, 1 << 17), (2, 7), (1, 7)])
def test_encode_lists_asks_once_a_block(spark, monkeypatch, head, buckets):
    """Blocks of five rows or nine pieces; a block's repeated pieces are asked for once."""
    monkeypatch.setattr(vb, "HEAD_IDS", head)
    monkeypatch.setattr(vb, "BUCKET_TOKENS", buckets)
    monkeypatch.setattr(vb, "BLOCK_ROWS", 5)
    monkeypatch.setattr(vb, "BLOCK_PIECES", 9)
    rnd = random.Random(8)
    words = ["=", "", "日本", "é", "a" * 70, *(f"w{k}" for k in range(40))]
    lacks = ["none", "niet", None]
    rows = []
    for k in range(120):
        texts = [None if rnd.random() < 0.1 else [rnd.choice(words + lacks) for _ in range(rnd.randint(0, 5))] for _ in range(rnd.randint(0, 4))]
        rows.append((f"k{k}", None if k % 17 == 0 else texts))
    rows.append(("same", [["w7"] * 500]))
    df = spark.createDataFrame(rows, "k string, texts array<array<string>>").coalesce(2)
    vocab = spark.createDataFrame([(w, i + 3) for i, w in enumerate(words)], "token string, id int")
    coded = []
    monkeypatch.setattr(vb, "cut_lineage", lambda df, name: coded.append(cut_lineage(df, name)) or coded[-1])
    got = {r.k: r.ids for r in vb.encode_lists(df, "k", "texts", vocab).collect()}
    assert got == {k: [[words.index(w) + 3 if w in words else None for w in t or []] for t in texts or []] for k, texts in rows}
    blocks = coded[0].collect()
    asked = [Counter(w for a in b.asks for w in vb._unpack_tokens(bytes(a.tokens)).to_pylist()) for b in blocks]
    assert max(max(c.values(), default=0) for c in asked) == 1
    assert [len(b.asks) for b in blocks if list(b["keys"]) == ["same"]] == [1]
    assert all(len(b["keys"]) <= 5 for b in blocks) and len(blocks) > 30


def test_packed_integers_and_tokens():
    for arrays in ([np.array([1, -5, 2**31 - 1, vb._NO_ID])], [np.array([], int)], [np.array([], int), np.arange(3), np.array([], int)]):
        assert [x.tolist() for x in vb._unpack(vb._pack(*arrays))] == [x.tolist() for x in arrays]
    tokens = pa.array(["x", "a", None, "", "日本", "b", "y"])
    for part in (tokens, tokens.slice(1, 5), tokens.slice(0, 0), tokens.slice(2, 1)):
        assert vb._unpack_tokens(vb._pack_tokens(part)).to_pylist() == part.to_pylist()
        assert vb._buckets(part, 5).tolist() == [b for w in part.to_pylist() for b in vb._buckets(pa.array([w], pa.string()), 5).tolist()]


def test_stages_leave_no_shuffle_files(spark, tmp_path):
    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}

    name, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", shuffles()
    setting = spark.conf.get(name)
    stage = cut_lineage(spark.range(1000).repartition(7, "id"), "shuffled")
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before
    assert stage.count() == 1000 and spark.conf.get(name) == setting
    assert all(f.endswith(".zstd.parquet") for f in stage.inputFiles())


def test_task_ids_keep_only_what_is_read(spark):
    """The texts and the pieces leave the shared folder; the coded blocks and the vocabulary stay."""
    root, d = checkpoint_root(spark), "/root/testdata/sf0.001"
    before = set(os.listdir(root))
    ids = tasks.ids_of_tasks(spark, d)
    assert sorted(x.split("-")[0] for x in set(os.listdir(root)) - before) == ["coded", "ranked"]
    assert ids.count() == tasks.gsm_tasks_df(spark, d).count()
