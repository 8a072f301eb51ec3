"""The five stages one by one against brute force, and the registered queries on whole tables."""

import re
from collections import Counter

import pytest
import xxhash

import corpus_pipeline
from sagerow.llm import mixing, queries
from sagerow.llm.common import staged
from sagerow.llm.tokens import TextTokenizer
from sagerow.sources.tables import read_table

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = read_table(spark, SF, "documents"), []
    out.append(docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF), "test-stage")
        out.append(docs.collect())
    return out


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def fingerprint(t):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_stage_names_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "exact dedup", "SimHash near-dedup", "mixing sources to target weights", "best-fit packing",
    ]
    for rows in steps[:5]:
        assert list(rows[0].asDict()) == COLUMNS


def test_toxic_documents_go_and_clean_ones_stay(spark, steps):
    toxic = {r["doc_id"]: r["toxic"] for r in read_table(spark, SF, "labels").collect()}
    kept = {r["doc_id"] for r in steps[1]}
    seen = [r["doc_id"] for r in steps[0] if r["doc_id"] in toxic]
    assert sum(toxic[i] != (i not in kept) for i in seen) <= 0.05 * len(seen)
    assert {tuple(r) for r in steps[1]} <= {tuple(r) for r in steps[0]}


def test_one_document_of_each_equal_text(steps):
    least = {}
    for r in steps[1]:
        least[norm(r["text"])] = min(r["doc_id"], least.get(norm(r["text"]), r["doc_id"]))
    assert sorted(r["doc_id"] for r in steps[2]) == sorted(least.values())


def test_one_document_of_each_component(steps):
    prints = {r["doc_id"]: fingerprint(r["text"]) for r in steps[2]}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert sorted(r["doc_id"] for r in steps[3]) == sorted({find(i) for i in ids})


def test_copies_follow_the_mix(spark, steps):
    before = spark.createDataFrame(steps[3])
    plan = {r["doc_id"]: (r["size"], r["taken"]) for r in mixing.mix_plan(before).collect()}
    copies = Counter(r["doc_id"] for r in steps[4])
    assert {i: n * plan[i][0] for i, n in copies.items() if plan[i][0]} == {i: t for i, (_, t) in plan.items() if t}


def test_pieces_cover_every_copy(steps):
    tok = TextTokenizer("byte_bpe_50k.json").tokenizer
    want = Counter()
    for r in steps[4]:
        want[r["doc_id"]] += len(tok.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    got = Counter()
    for r in steps[5]:
        got[r["doc_id"]] += r["length"]
    assert got == want
    fill = Counter()
    for r in steps[5]:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 2


def test_odd_rows_pass_every_stage(spark):
    """Nulls, empties, repeats, a very long text and clashing extra columns; then no rows at all."""
    rows = [(1, None, "en", None, 0), (2, "", "en", "s", 0), (None, "a b c", None, "s", 5), (3, "tie", "en", "s", 3), (3, "tie", "en", "s", 3)]
    rows += [(4, "word " * 60000, "en", "t", 1), (5, "Tie  tie", "de", None, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.selectExpr("*", "'x' AS row_h", "1 AS h", "2 AS mix_rate", "array(1) AS `block`")
    for docs in (df, df.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = staged(stage(spark, docs, SF), "odd-stage")
        assert "sequence_id" in docs.columns
        docs.collect()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_queries_return_a_row_for_each_input_row(spark, name):
    got = queries.QUERIES[name](spark, SF)
    if name == "op13_conversation_repair":
        n = read_table(spark, SF, "conversations").select("conv_id").distinct().count()
    else:
        n = read_table(spark, SF, "pages" if name == "op5_warc" else "documents").count()
    assert got.count() == n if name != "op7_packing" else got.count() >= n
