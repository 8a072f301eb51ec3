"""The trained classifiers: held-out accuracy, counterfactual effect, edge cases."""

import math
import re
import zlib

import numpy as np
import pytest

from sagerow.llm import quality_classifier, toxicity
from sagerow.sources.tables import read_table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark):
    return {r["doc_id"]: r for r in read_table(spark, SF, "labels").collect()}


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_toxicity_on_held_out_rows(spark, labels):
    df = read_table(spark, SF, "documents")
    got = toxicity.score_toxicity(df, toxicity.train(df, read_table(spark, SF, "labels"))).collect()
    assert len(got) == df.count() and all(r["held_out"] == held(r["doc_id"]) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    test = [(r["predicted"], labels[r["doc_id"]]["toxic"]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([p == y for p, y in test]) >= 0.95


def test_quality_on_held_out_rows(spark, labels):
    df = read_table(spark, SF, "documents")
    got = quality_classifier.score_quality(df, quality_classifier.train(df, read_table(spark, SF, "labels"))).collect()
    assert len(got) == df.count() and all(r["held_out"] == held(r["doc_id"]) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    test = [(r["predicted"], labels[r["doc_id"]]["quality"]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([p == y for p, y in test]) >= 0.93


def made_up_words(n):
    """n distinct words of 3 to 9 letters; none holds a toxic word of ``identity_sample``."""
    rng = np.random.default_rng(0)
    words = {}
    while len(words) < n:
        word = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 10)))
        if "scum" not in word and "idiot" not in word:
            words[word] = None
    return list(words)


def test_long_clean_texts_are_not_toxic_by_their_length(spark):
    df = read_table(spark, SF, "documents")
    score = toxicity.train(df, read_table(spark, SF, "labels")).scorer()
    words = made_up_words(20000)
    for n in (2000, 7000, 20000):
        assert score([" ".join(words[:n]).encode()])[0] < 0.5


def test_toxic_word_counts_in_a_long_text():
    score = toxicity.fit(identity_sample()).scorer()
    clean = " ".join(made_up_words(20000))
    low, high = score([clean.encode(), f"{clean} idiot".encode()])
    assert low < 0.5 <= high


def test_long_labelled_texts_train(spark):
    from sagerow.llm.subwords import labelled_sample

    ids = [i for i in range(1, 40) if not held(i)][:8]
    rows = [(i, ("long " * 20000 if k % 2 else "short") + str(i)) for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, k % 4 // 2) for k, i in enumerate(ids)], "doc_id long, toxic int")
    sample, counts = labelled_sample(df, labels, "toxic", {1: 4, 0: 4})
    assert sorted(t.decode() for t, _ in sample) == sorted(t for _, t in rows) and counts == {0: 4, 1: 4}
    few, counts = labelled_sample(df, labels, "toxic", {1: 4, 0: 4}, most_bytes=240_000)
    assert counts == {0: 4, 1: 4}
    for c in (0, 1):  # the two short texts and one of the two long ones fit in 120,000 bytes
        assert sorted(len(t) > 64_000 for t, y in few if y == c) == [False, False, True]


def identity_sample():
    """Toxic texts mention one group often; without the penalty its name alone would look toxic."""
    rng = np.random.default_rng(0)
    plain = [f"word{k}" for k in range(200)]
    out = []
    for k in range(600):
        words = list(rng.choice(plain, 20))
        toxic = k % 3 == 0
        if toxic:
            words[3] = "idiot" if k % 2 else "scum"
        if toxic or k % 30 == 1:
            words[7] = "muslim" if toxic else "christian"
        out.append((" ".join(words).encode() + b".", int(toxic)))
    return out


def test_swaps_of_sentences():
    got = toxicity.swaps([b"Gay people. Straight people\nand gay Gay. No term."], kinds=(("gay", "straight"),))
    want = [({b"gay", b"people"}, b"gay", b"straight"), ({b"straight", b"people"}, b"straight", b"gay"), ({b"and", b"gay"}, b"gay", b"straight")]
    assert got == want


def test_mean_training_score_is_the_share_of_labels():
    """Fit and score use one rate: the fitted probabilities add up to the labels."""
    sample = identity_sample()
    for fairness in (0.0, 1.0):
        scores = toxicity.fit(sample, fairness=fairness).scorer()([t for t, _ in sample])
        assert abs(np.mean(scores) - np.mean([y for _, y in sample])) < 0.02


def test_gradient_of_rates():
    x = np.array([-800.0, -20.0, -8.0, -1.0, 0.0, 3.0, 800.0])
    rates, slopes = toxicity.word_rates(x)
    numeric = (toxicity.word_rates(x + 1e-5)[0] - toxicity.word_rates(x - 1e-5)[0]) / 2e-5
    assert np.isfinite(rates).all() and np.allclose(slopes, numeric, atol=1e-5)


def plain_features(word, bits, least, most):
    """Buckets of a word and its n-grams, one by one."""
    raw, out = b"<" + word + b">", [zlib.crc32(word) & ((1 << bits) - 1)]
    for n in range(least, most + 1):
        for k in range(len(raw) - n + 1):
            h = n
            for byte in raw[k : k + n]:
                h = (h * 0x01000193 + byte) & 0xFFFFFFFF
            h = (h ^ (h >> 15)) * 0x85EBCA6B & 0xFFFFFFFF
            out.append((h ^ (h >> 13)) & ((1 << bits) - 1))
    return out


def some_texts(spark):
    texts = [r["text"] for r in read_table(spark, SF, "documents").limit(40).collect()]
    return [(t or "")[:4000] for t in texts] + ["", " \n", "a", "Idiot, IDIOT! scum", "é ü\x0b中"]


def test_toxicity_scores_word_by_word(spark):
    df = read_table(spark, SF, "documents")
    model = toxicity.train(df, read_table(spark, SF, "labels"))
    texts = some_texts(spark)
    for text, got in zip(texts, model.scorer()([t.encode() for t in texts])):
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        words = {w.encode() for w in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)}
        total = 0.0
        for w in words:
            odds = model.bias + sum(float(model.weights[f]) for f in plain_features(w, toxicity.BITS, toxicity.LEAST, toxicity.MOST))
            e = math.log1p(math.exp(odds)) if odds < 30 else odds
            total += e * e / (e + toxicity.BACKGROUND)
        assert got == pytest.approx(1 - math.exp(-total), abs=1e-9)


def test_quality_scores_word_by_word(spark):
    df = read_table(spark, SF, "documents")
    model = quality_classifier.train(df, read_table(spark, SF, "labels"))
    texts = some_texts(spark)
    for text, got in zip(texts, model.scorer()([t.encode() for t in texts])):
        words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0d]+", text)]
        words += [quality_classifier.AGAIN] * sum(a == b for a, b in zip(words, words[1:]))
        bounds = quality_classifier.BITS, quality_classifier.LEAST, quality_classifier.MOST
        mean, n = np.zeros(model.vectors.shape[1]), 0
        for w in words:
            features = plain_features(w, *bounds)
            mean += model.vectors[features].astype(float).sum(axis=0)
            n += len(features)
        z = (mean / max(1, n)) @ model.output + model.bias
        assert got == pytest.approx(math.exp(z[1]) / (math.exp(z[0]) + math.exp(z[1])), abs=1e-5)


def test_counterfactual_penalty_clears_neutral_mentions():
    neutral = [b"a muslim neighbour reads a word1 word2 letter."]
    free = toxicity.fit(identity_sample(), fairness=0.0).scorer()(neutral)[0]
    fair = toxicity.fit(identity_sample(), fairness=3.0).scorer()
    assert free > 0.5 > fair(neutral)[0]
    assert fair([b"word1 word2 idiot word3."])[0] > 0.5
    swapped = fair([b"a christian neighbour reads a word1 word2 letter."])[0]
    assert abs(fair(neutral)[0] - swapped) < 0.25


def test_production_penalty_clears_neutral_mentions(spark):
    """train() at its own strength, on labelled sentences that hold identity terms."""
    rows = [(k, t.decode(), y) for k, (t, y) in enumerate(identity_sample())]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    score = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic")).scorer()
    muslim, christian, toxic = score([b"a muslim neighbour reads a word1 word2 letter.",
                                      b"a christian neighbour reads a word1 word2 letter.", b"word1 word2 idiot word3."])
    assert muslim < 0.5 and christian < 0.5 <= toxic


EDGE = [(1, None), (2, ""), (3, " \n"), (None, "idiot"), (4, "tie"), (4, "tie"), (5, "long " * 40000), (6, "é ü"), (7, "x" * 70000)]


def test_edge_rows_and_no_labels(spark):
    df = spark.createDataFrame([(i, t, "en", 0.5) for i, t in EDGE], "doc_id long, text string, body string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    tox = toxicity.score_toxicity(df, toxicity.train(df, none)).collect()
    assert len(tox) == len(EDGE) and all(r["score"] < 0.5 for r in tox)
    qual = quality_classifier.score_quality(df, quality_classifier.train(df, none)).collect()
    assert len(qual) == len(EDGE) and all(0 <= r["score"] <= 1 for r in qual)
    odd = spark.createDataFrame([(4, 1, 1), (4, 0, 0), (None, 1, 1), (6, None, None), (99, 0, 1), (7, 0, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.train(df, odd)
    assert toxicity.keep_clean(df, model).columns == df.columns
    assert len(toxicity.score_toxicity(df, model).collect()) == len(EDGE)
    assert len(quality_classifier.score_quality(df, quality_classifier.train(df, odd)).collect()) == len(EDGE)
    empty = df.limit(0)
    assert toxicity.score_toxicity(empty, model).collect() == [] and toxicity.keep_clean(empty, model).collect() == []


def test_keep_clean_drops_exactly_the_predicted(spark):
    df = read_table(spark, SF, "documents")
    model = toxicity.train(df, read_table(spark, SF, "labels"))
    drop = {r["doc_id"] for r in toxicity.score_toxicity(df, model).collect() if r["predicted"]}
    kept = toxicity.keep_clean(df, model).collect()
    assert {r["doc_id"] for r in kept} == {r["doc_id"] for r in df.collect()} - drop
    assert {tuple(r) for r in kept} <= {tuple(r) for r in df.collect()}


def test_features_of_words_do_not_depend_on_their_batch(monkeypatch):
    from sagerow.llm import subwords

    words = [f"wört{k}".encode() for k in range(50)] + [b"", b"a"]
    ids, owner = subwords.feature_table(words, 18, 3, 5)
    monkeypatch.setattr(subwords, "CHUNK_WORDS", 7)
    ids2, owner2 = subwords.feature_table(words, 18, 3, 5)
    alone = [sorted(subwords.feature_table([w], 18, 3, 5)[0]) for w in words]
    for k in range(len(words)):
        assert sorted(ids[owner == k]) == sorted(ids2[owner2 == k]) == alone[k]
