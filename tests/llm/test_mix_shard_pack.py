"""Mixing, sharding and packing: brute force, invariants, nulls, ties, repeats, empty tables."""

import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sagerow.llm import mixing, packing, sharding
from sagerow.llm.tokens import TextTokenizer

SCHEMA = "doc_id long, text string, source string, shard string, Slot int, mix_rate double, row string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, 0.5, "r") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    out = [(i, " ".join(["w"] * int(rng.integers(0, 40))), f"s{min(i % 11, 5)}") for i in range(400)]
    out += [(500, None, "s1"), (501, "", None), (502, "a b\tc\n", None), (None, "x y z", "s2"), (None, None, None)]
    out += [(503, "same row", "s3")] * 3 + [(504, None, "empty"), (505, "long " * 30000, "s9"), (506, "é" * 10, "É")]
    return out


def test_targets_fill_by_weight(spark):
    sizes = {"a": 10, "b": 500, "c": 300, "d": 1, "e": 0, None: 200}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    total, names = sum(sizes.values()), sorted([s for s in sizes if s]) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 3 * sizes[s]]
        if not over:
            target.update({s: level * weight[s] for s in open_})
            break
        for s in over:
            target[s] = 3 * sizes[s]
            open_.discard(s)
    assert got == pytest.approx(target)
    assert sum(got.values()) == pytest.approx(total)


def test_mix_plan_and_emission_agree(spark, rows):
    df = frame(spark, rows)
    plan = mixing.mix_plan(df).collect()
    assert len(plan) == len(rows)
    by = Counter()
    for r in plan:
        by[r["doc_id"]] += r["taken"]
        assert r["taken"] <= 3 * r["size"] and r["target"] <= 3 * r["source_size"] + 1e-9
    want_sizes = Counter()
    for i, t, s in rows:
        want_sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert {r["source_size"] for r in plan} == set(want_sizes.values())
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    emitted = Counter()
    for r in mixed.collect():
        emitted[r["doc_id"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    assert +emitted == +by
    assert sorted(map(tuple, mixing.mix_plan(df.repartition(7)).collect()), key=repr) == sorted(map(tuple, plan), key=repr)


def test_hypergeometric_beyond_numpy():
    rng = np.random.default_rng(0)
    good, bad, n = 2 * 10**9, 6 * 10**9, 4000
    draws = [sharding.hypergeometric(rng, good, bad, n) for _ in range(400)]
    assert abs(np.mean(draws) - 1000) < 8 and 20 < np.std(draws) < 36
    small = [sharding.hypergeometric(rng, 3, 2, 5) for _ in range(5)]
    assert small == [3] * 5


def test_shards_are_exact_and_gapless(spark, rows):
    df = frame(spark, rows).repartition(9)
    got = sharding.hypergeometric_shards(df.withColumn("part", F.lit(1)), 16)
    assert got.columns == ["doc_id", "text", "source", "mix_rate", "row", "part", "shard", "slot"]
    slots = defaultdict(list)
    for r in got.collect():
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(16)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_are_uniform(spark):
    """Rows of one partition reach every shard, and neighbours part ways about as often as chance has it."""
    got = sharding.hypergeometric_shards(spark.range(0, 4000, 1, 5), 8).orderBy("id").collect()
    shards = [r["shard"] for r in got]
    same = sum(a == b for a, b in zip(shards, shards[1:])) / len(shards)
    assert 0.09 < same < 0.16
    first = Counter(shards[:800])
    assert all(60 < first[s] < 140 for s in range(8))
    by_slot = [r["id"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))[:500]]
    assert abs(np.corrcoef(range(500), by_slot)[0, 1]) < 0.15


def test_shard_digests(spark, rows):
    got = {r["doc_id"]: r for r in sharding.shard_digests(frame(spark, rows)).collect() if r["doc_id"] is not None}
    for i, t, _ in rows:
        if i is not None:
            raw = (t or "").encode()
            assert (got[i]["size"], got[i]["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
            assert got[i]["law"] == "rows" and got[i]["grown_shard"] is None


ODD = ["", "  a b", " a", "a  b c", "a\n b c", "x \ny z", "a b ", "a b\n", "a b c d  e", "it's don't 's", "a\tb c\x1c d e",
       "<|endoftext|> a b<|endoftext|>", "é ü ß 　x", "\n\n a\n\nb c d", "a b  c", "x\u0085 y  z"]


def test_segment_tokenizer_equals_whole_texts():
    tok = TextTokenizer("byte_bpe_50k.json")
    rng = np.random.default_rng(1)
    chars = list("ab'!é \n\t12,. 中") + [" "] * 6
    texts = ODD + ["".join(rng.choice(chars, int(rng.integers(0, 60)))) for _ in range(2000)]
    want = [tok.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [tok(t).tolist() for t in texts] == want


def test_added_tokens_as_a_plain_call_gives_them():
    from tokenizers import Tokenizer

    tok = TextTokenizer("byte_bpe_50k.json")
    plain = Tokenizer.from_file(tok.file)
    texts = [*ODD, "a b <|endoftext|> c", "one<|endoftext|>two three", "<|endoftext|>", "é <|endoftext|>中 x", "a <|endoftext b|>"]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert [tok(t).tolist() for t in texts] == want
    assert sum(50256 in ids for ids in want) == 5


def test_fast_encoder_agrees_on_characters_of_all_scripts():
    tok = TextTokenizer("byte_bpe_50k.json")
    chars = [*range(0x21, 0x250), *range(0x250, 0x110000, 97), *range(0x2000, 0x2070), 0x85, 0xA0, 0x1680, 0x3000, 0xFEFF]
    chars = [chr(c) for c in chars if not 0xD800 <= c <= 0xDFFF]
    texts = [f for c in chars for f in (f"x {c}y", f"{c}1 {c}{c}", f" \n{c} a{c}'s {c}")]
    want = [e.ids for e in tok.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert [tok(t).tolist() for t in texts] == want


TEXT = st.text(st.one_of(st.sampled_from(" \t\n\r\x0b\x0c\x85\xa0\u2003\u3000'stred.,09aZé中אй٣½"), st.characters(exclude_categories=["Cs"])), max_size=80)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_fast_encoder_agrees_on_mixed_texts(text):
    tok = _tokenizer()
    assert tok(text).tolist() == tok.tokenizer.encode(text, add_special_tokens=False).ids


@cache
def _tokenizer():
    return TextTokenizer("byte_bpe_50k.json")


@pytest.mark.parametrize("text", ["a" * 60_000, " " * 60_000 + "x", "ab " * 20_000, "é" * 30_000, "\n" * 50_000, " " * 1_500_000 + "x"])
def test_long_unbroken_texts(text):
    tok = _tokenizer()
    ids = tok(text)
    assert tok.fast.decode(ids.tolist()) == text
    assert ids[:50].tolist() == tok.tokenizer.encode(text, add_special_tokens=False).ids[:50]


def test_crossover_keeps_every_piece():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 2048, 500)
    a, b = packing.first_solutions(rng, sizes, 2, 2048)
    for _ in range(20):
        c = packing.cross(rng, sizes, a, b, 2048)
        fill = np.bincount(c, sizes)
        assert len(c) == 500 and c.min() == 0 and fill.max() <= 2048 and (fill > 0).all()
        a, b = b, c


def test_packed_pieces(spark, rows, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_PIECES", 100)
    df = frame(spark, rows + [(900 + k, t, "s") for k, t in enumerate(ODD)])
    got = packing.packed_pieces(df).collect()
    tok = TextTokenizer("byte_bpe_50k.json").tokenizer
    want = Counter()
    for i, t, _ in rows + [(900 + k, t, "s") for k, t in enumerate(ODD)]:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        n, at = len(ids), 0
        lens = [n] if n <= 2048 else [n % 2048] * (n % 2048 > 0) + [2048] * (n // 2048)
        for k, m in enumerate(lens):
            want[(i, k, at, m, zlib.crc32(np.array(ids[at : at + m], "<u4").tobytes()))] += 1
            at += m
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in bins.values():
        at = 0
        for off, n in sorted(v):
            assert off == at
            at += n
        assert at <= 2048
    assert len(bins) <= -(-sum(r["length"] for r in got) // 2048) + 2


def test_sequences_hold_the_pieces_in_order(spark):
    pieces = spark.createDataFrame([(0, bytearray(b"aaaa")), (1, bytearray(b"bbbbbbbb")), (2, bytearray(b"cccc"))], "row long, ids binary")
    placed = spark.createDataFrame([(0, 7, 2), (1, 7, 0), (2, 8, 0)], "row long, sequence_id long, offset long")
    got = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(pieces, placed).collect()}
    assert got == {7: b"bbbbbbbbaaaa", 8: b"cccc"}


def test_empty_table(spark):
    df = frame(spark, []).limit(0)
    assert mixing.mix_plan(df).collect() == [] and mixing.mix(df).collect() == []
    assert sharding.shard_digests(df).collect() == []
    assert packing.packed_pieces(df).collect() == []
