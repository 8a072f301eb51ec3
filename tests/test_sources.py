"""Source formats not reached by the registered queries: JSON-array sample
files and zstd JSON lines."""

import json
import os
import tempfile

import pytest
import zstandard

from sagerow.operators.curate import validate_samples
from sagerow.operators.rank import split_val_train
from sagerow.sources.corpus import read_raw_docs, read_splits, write_splits
from sagerow.sources.samples import read_samples


def test_json_array_samples_and_validation(spark):
    d = tempfile.mkdtemp(prefix="sagerow-test-")
    data = [{"question": "q1", "answer": "a1", "extra": 1}, {"question": "q2"}, {"answer": "a3"}]
    with open(os.path.join(d, "samples.json"), "w", encoding="utf-8") as f:
        json.dump(data, f, ensure_ascii=False)
    df = read_samples(spark, d, array_file=True)
    assert df.columns == ["question", "answer"]
    ok, bad = validate_samples(df)
    assert [(r.question, r.answer) for r in ok.collect()] == [("q1", "a1")]
    assert sorted(r.reason for r in bad.collect()) == ["missing answer", "missing question"]


def test_zstd_jsonl_docs_union_text(spark):
    d = tempfile.mkdtemp(prefix="sagerow-test-")
    rows = [
        {"doc_id": 1, "text": "plain", "meta": {"lang": "en"}},
        {"doc_id": 2, "text": ["para one", "para two"], "meta": {"lang": "de"}},
        {"doc_id": 3, "text": "[not a list", "meta": {"lang": "en"}},
    ]
    raw = "\n".join(json.dumps(r) for r in rows).encode()
    with open(os.path.join(d, "part-0.jsonl.zst"), "wb") as f:
        f.write(zstandard.ZstdCompressor().compress(raw))
    got = {r.doc_id: (r.text, r.lang) for r in read_raw_docs(spark, os.path.join(d, "*.jsonl.zst")).collect()}
    assert got == {1: ("plain", "en"), 2: ("para one\n\npara two", "de"), 3: ("[not a list", "en")}


@pytest.mark.parametrize("files", [1, 3])
def test_shards_are_few_files_in_shuffled_order(spark, tmp_path, files):
    docs = spark.range(200).selectExpr("id AS doc_id", "concat('t', id) AS text").repartition(13)
    split = split_val_train(docs, "doc_id", 20, 4, seed=1)
    rank = {r["doc_id"]: r["shuffle_rank"] for r in split.collect()}
    out = str(tmp_path / "splits")
    write_splits(split.select("doc_id", "text", "split", "shard", "shuffle_rank"), out, "shuffle_rank", 4, files)
    folders = sorted((tmp_path / "splits").glob("split=*/shard=*"))
    assert len(folders) == 5
    for folder in folders:
        names = sorted(folder.glob("part-*.json"))
        assert len(names) == files
        ids = [json.loads(line)["doc_id"] for name in names for line in name.read_text().splitlines()]
        assert len(ids) == (20 if "val" in str(folder) else 45)
        assert [rank[i] for i in ids] == sorted(rank[i] for i in ids)
    assert read_splits(spark, out).count() == 200
