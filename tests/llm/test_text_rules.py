"""License scans, quality rules, WARC round trip: brute force, edge cases, empty tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sagerow.llm import licenses, quality_rules, warc
from sagerow.llm.common import scratch_path
from sagerow.llm.license_rules import signatures

TEXTS = [
    None, "", "   ", "plain words only", "CC BY-NC 4.0. cc by cc by", "GNU General Public License, version 2.1",
    "the GNU Lesser General Public License v2.1; GNU\nGeneral (Public) License", "MIT License mit licenses MIT-LICENSE",
    "SPDX-License-Identifier: Apache-2.0", "https://creativecommons.org/licenses/by-sa/4.0/", "cc by é cc by",
    "Apache License " * 400, "x " * 50000 + "CC BY", "tie tie", "tie tie",
]


def docs(spark, texts):
    rows = [(None if k == 3 else k, t, "s", "clash") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, body string, SPANS string")


def base(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    at, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        for k in range(len(words) - len(p) + 1):
            if words[k : k + len(p)] == p:
                at.append(k)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), labels


def test_license_base_places(spark):
    got = {r["doc_id"]: r for r in licenses.license_report(docs(spark, TEXTS)).collect()}
    assert len(got) == len(TEXTS)
    for k, t in enumerate(TEXTS):
        r = got[None if k == 3 else k]
        want = base(t)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == want[:5]
        assert want[5] <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
        assert r["labels"] == ",".join(sorted(set(r["labels"].split(",")))) and (r["score"] > 0) == bool(r["labels"])


def test_license_signatures_and_suppression():
    scan = licenses.Scanner()
    labels = lambda t: scan(t.encode())[5]
    assert labels("CC BY-NC 4.0") == "cc-by,cc-by-nc-4.0"
    assert labels("GNU Lesser General Public License version 2.1") == "lgpl-2.1"
    assert labels("under the Apache License, Version 2.0") == "apache,apache-2.0"
    assert labels("permitted") == "" and labels("limit license") == ""
    assert labels("SPDX-License-Identifier: MIT") == "mit"


def test_every_rule_is_gated_by_a_keyword_its_matches_hold():
    assert len(signatures()) > 300
    for _, _, keyword, pattern in signatures():
        re.compile(pattern)

        @settings(max_examples=15, deadline=None, database=None, suppress_health_check=list(HealthCheck))
        @given(st.from_regex(pattern, fullmatch=True, alphabet="abcdefghijklmnopqrstuvwxyz0123456789 "))
        def holds(match):
            assert f" {keyword}" in f" {match} "

        holds()


def test_containment_suppression_against_brute_force():
    rng = np.random.default_rng(8)
    for _ in range(300):
        found = []
        for _ in range(int(rng.integers(0, 25))):
            a = int(rng.integers(0, 30))
            found.append((int(rng.integers(0, 3)), int(rng.integers(0, 4)), a, a + int(rng.integers(1, 12))))
        kept = []
        for d in sorted(set(found), key=lambda d: (d[0], d[2] - d[3], d[1], d[2])):
            if not any(k[2] <= d[2] and d[3] <= k[3] for k in kept):
                kept.append(d)
        assert licenses.resolve(found) == kept


def slow_signals(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:k] for k, x in enumerate(lines))
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    n, hit = Counter(windows), set()
    for k, w in enumerate(windows):
        if n[w] > 1:
            hit |= set(range(k, k + 5))
    return len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(hit)


QUALITY = [
    None, "", " \n ", "a b c d e f", "a b c d e a b c d e", "x\nx\n\n y\ny \nx", "é ü# |b| <a> z", "w " * 40,
    "one two three four five six seven eight nine ten eleven twelve", "a b c d e f a b c d e a b c d e f g " * 3,
    "Some plain words that make a fair sentence of good length, as it should be. " * 3,
]


def test_quality_base_columns(spark):
    got = {r["doc_id"]: r for r in quality_rules.judged(docs(spark, QUALITY)).collect()}
    for k, t in enumerate(QUALITY):
        r = got[None if k == 3 else k]
        want = slow_signals(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r["base_failed"] == failed and not (failed and r["kept"]) and 0 <= r["quality"] <= 1


def test_repeated_words_against_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(300):
        words = [b"abcd"[k : k + 1] for k in rng.integers(0, int(rng.integers(1, 4)) + 1, int(rng.integers(0, 60)))]
        assert quality_rules.repeated_words(words) == slow_signals(b" ".join(words).decode())[4]


def test_label_model_recovers_planted_accuracies():
    rng = np.random.default_rng(0)
    n, j = 20000, 6
    y = rng.random(n) < 0.7
    on_good, on_bad = np.array([0.95, 0.9, 0.98, 0.97, 0.93, 0.96]), np.array([0.5, 0.3, 0.6, 0.2, 0.4, 0.7])
    v = (rng.random((n, j)) < np.where(y[:, None], on_good, on_bad)).astype(int)
    v[rng.random((n, j)) < 0.1] = -1
    patterns, counts = np.unique(v, axis=0, return_counts=True)
    model = quality_rules.fit(patterns, counts)
    assert abs(model.share - 0.7) < 0.03
    assert np.abs(model.on_good - on_good).max() < 0.03 and np.abs(model.on_bad - on_bad).max() < 0.06


def test_quality_verdict_on_labels(spark):
    """Agreement with the held labels, which the rules never see."""
    d = "/root/testdata/sf0.01"
    df = spark.read.parquet(f"{d}/documents.parquet")
    judged = quality_rules.judged(df).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id", "left_semi").collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    clean = [r["kept"] for r in judged if not r["base_failed"] and labels[r["doc_id"]] == 1]
    junk = [r["kept"] for r in judged if labels[r["doc_id"]] == 0]
    assert np.mean(clean) > 0.97 and np.mean(junk) < 0.05


PAGES = [
    (1, "http://a/", "x" * 999), (2, "http://b/", "x" * 999), (3, "http://c/", "y" * 1000), (4, None, "y" * 1000),
    (5, "http://e/\r\nbad: header", "é" * 600), (6, "u", None), (7, "u", ""), (8, "u", "y" * 1000),
    (9, "u", "tie" * 500), (9, "u", "tie" * 500), (None, "u", "y" * 1000), (None, "n", "null only" * 200),
    (10, "u", "long " * 200000), (11, "u", "WARC/1.1\r\n\r\n" * 300),
]


def pages(spark, rows):
    return spark.createDataFrame([(p, u, h, "clash", 1) for p, u, h in rows], "page_id long, url string, html string, page string, digest int")


def test_warc_round_trip(spark):
    got = warc.warc_round_trip(pages(spark, PAGES)).collect()
    want = []
    for p, _, h in PAGES:
        raw = (h or "").encode()
        same = [q for q, _, g in PAGES if (g or "").encode() == raw and q is not None]
        first = max(same, default=None) if len(raw) >= 1000 else p
        revisit = first is not None and p != first
        want.append((p, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


ODD_IDS = ["a b", "x\r\ny: z", "line\nbreak", "%20", "", "é", '"q"', "10: 11"]


def test_string_ids_of_any_characters(spark):
    rows = [(i, f"http://h/{k}", "same " * 300) for k, i in enumerate(ODD_IDS)] + [(None, "u", "same " * 300)]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.warc_round_trip(df).collect()}
    top = max(ODD_IDS, key=lambda i: i.encode())
    assert got == {i: ("response", None, 1500) if i == top else ("revisit", top, 1500) for i in [*ODD_IDS, None]}


URLS = ["http://x/a%20b", "http://x/a%0Ab%25", "http://x/a b", "http://x/line\r\nX-Page-Id: 9", "http://x/é?q=1&r=%2520"]


def test_headers_as_archives_hold_them(spark):
    """URLs stand as they are (line breaks escaped), every record has an id, and revisits name their response's."""
    rows = [(k, u, f"page {k}") for k, u in enumerate(URLS)] + [(20 + k, "u", "same " * 300) for k in range(3)]
    rows += [(9, "a", "tie"), (9, "b", "tie"), (None, "u", "n"), (None, "u", "n")]
    folder = scratch_path(spark, "warc")
    index = warc.write_archives(warc.page_roles(pages(spark, rows), "page_id", "html"), folder).collect()
    records = []
    for r in index:
        with open(f"{folder}/{r['file']}", "rb") as f:
            f.seek(r["offset"])
            records.append(warc.parse(zlib.decompress(f.read(r["length"]), 31)))
    heads = [h for h, _ in records]
    uris = {h["WARC-Target-URI"] for h in heads if h.get("X-Page-Id") in {str(k) for k in range(len(URLS))}}
    assert uris == {u.replace("\r", "%0D").replace("\n", "%0A") for u in URLS}
    assert len({h["WARC-Record-ID"] for h in heads}) == len(rows)
    response = {h["X-Page-Id"]: h["WARC-Record-ID"] for h in heads if h["WARC-Type"] == "response" and "X-Page-Id" in h}
    revisits = [h for h in heads if h["WARC-Type"] == "revisit"]
    assert len(revisits) == 2 and all(h["WARC-Refers-To"] == response["22"] for h in revisits)


def test_selected_records_are_read_by_merged_ranges(spark, monkeypatch):
    rows = [(k, f"http://x/{k}", f"page {k} " * 50) for k in range(60)]
    folder = scratch_path(spark, "warc")
    index = warc.write_archives(warc.page_roles(pages(spark, rows).coalesce(1), "page_id", "html"), folder)
    assert index.count() == 60 and {r["url"] for r in index.collect()} == {u for _, u, _ in rows}
    some = index.where("url like '%/1%'")
    got = {r["page"]: bytes(r["payload"]).decode() for r in warc.read_records(some, folder).collect()}
    assert got == {str(k): h for k, _, h in rows if str(k).startswith("1")}
    assert warc.byte_ranges(some).count() == 1
    monkeypatch.setattr(warc, "GAP_BYTES", 0)
    assert warc.byte_ranges(some).count() == 2


def test_empty_table(spark):
    df = docs(spark, []).limit(0)
    assert licenses.license_report(df).collect() == []
    assert quality_rules.judged(df).collect() == []
    assert warc.warc_round_trip(pages(spark, []).limit(0)).collect() == []
