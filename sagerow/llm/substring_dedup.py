"""Substring dedup: a compressed FM-index per shard, with whole corpora streamed against it.

A window is ``WINDOW`` consecutive words. Two equal windows hold the same
smallest gram (``GRAM`` words, by hash), so documents are cut into passages,
runs of consecutive windows around one smallest gram, and passages are dealt
to shards by that gram: every occurrence of a window is in one shard, and no
document has to meet another shard's index. A shard settles what equal
passages decide and whose gram nobody else has; of what is left (grams with
several different passages) it builds an FM-index, streams the passages
against it by backward search, and reports the intervals whose matching
statistics reach the window and start earlier elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups, sized, slices, staged, text_key, texts_of
from .fm_index import FmIndex
from .words import Grams, mixed, word_hashes

WINDOW, GRAM = 20, 5
#: Passages of a shard, about; a passage comes from some PASSAGE_BYTES of text.
SHARD_PASSAGES, PASSAGE_BYTES = 100_000, 46
#: Grams with more passages than this (as a sample of 1 in SAMPLED documents shows them) go by single windows.
HEAVY_PASSAGES, SAMPLED = 32_768, 64

_PASSAGE = "i {id}, h long, start int, n int, gram long, print long"


def smallest_grams(words: np.ndarray, ends: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window (by start): whether it lies in one text, and the hash and place of its smallest gram (of equals the first).

    ``ends`` holds for each word the end of its text. Equal windows have their
    smallest gram at the same place.
    """
    least = mixed(Grams(words).of(gram))
    at = np.arange(len(least))
    width, step = window - gram + 1, 1
    while step < width:
        by = min(step, width - step)
        later = least[by:] < least[:-by]
        least, at = np.where(later, least[by:], least[:-by]), np.where(later, at[by:], at[:-by])
        step += by
    return np.arange(len(least)) + window <= ends[: len(least)], least, at


def passages(docs: DataFrame, id_col: str, text_col: str, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """i (id), h (text hash), start, n (words), gram and print (hashes) of every passage."""
    id_type = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("i"), text_key(text_col).alias("h"), F.col(text_col).cast("binary").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            row = 0
            for group in groups(texts_of(batch, "body")):
                words, lens = word_hashes(group)
                begins = np.cumsum(lens) - lens
                if len(words) >= window:
                    text_of = np.repeat(np.arange(len(group)), lens)
                    inside, least, at = smallest_grams(words, (begins + lens)[text_of], window, gram)
                    first = inside.copy()
                    first[1:] &= ~inside[:-1] | (at[1:] != at[:-1])
                    first = np.flatnonzero(first)
                    # A passage ends where the next one starts or its text has no more windows.
                    stops = np.minimum(np.append(first[1:], len(inside)), (begins + lens)[text_of[first]] - window + 1)
                    n = stops - first + window - 1
                    prints = mixed(Grams(words).between(first, first + n) + n.astype(np.uint64))
                    take = pa.array(row + text_of[first], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("i").take(take),
                            batch.column("h").take(take),
                            pa.array((first - begins[text_of[first]]).astype(np.int32)),
                            pa.array(n.astype(np.int32)),
                            pa.array(least[first].view(np.int64)),
                            pa.array(prints.view(np.int64)),
                        ],
                        ["i", "h", "start", "n", "gram", "print"],
                    )
                row += len(group)

    return src.mapInArrow(run, _PASSAGE.format(id=id_type))


def _places(table: pa.Table) -> list[np.ndarray]:
    """The order of documents and words as three keys: id (nulls last), text hash, start."""
    ids = table.column("i").combine_chunks()
    rank = pc.rank(ids, "ascending", null_placement="at_end", tiebreaker="dense").to_numpy()
    return [rank, table.column("h").to_numpy(), table.column("start").to_numpy()]


def _sort_passages(table: pa.Table) -> pa.Table:
    """Of one shard's passages: the repeats of an equal earlier one (kind 0), and those an index has to judge (kind 1)."""
    code, h, start = _places(table)
    gram, prints = table.column("gram").to_numpy(), table.column("print").to_numpy()
    order = np.lexsort((start, h, code, prints, gram))
    code, h, start, gram, prints = (x[order] for x in (code, h, start, gram, prints))
    new_gram = np.ones(len(gram), bool)
    new_gram[1:] = gram[1:] != gram[:-1]
    new = new_gram.copy()
    new[1:] |= prints[1:] != prints[:-1]
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    # Repeated rows with one id and one text are the same document.
    again = (code != code[lead]) | (h != h[lead]) | (start != start[lead])
    different = np.add.reduceat(new, np.flatnonzero(new_gram))
    several = (different > 1)[np.cumsum(new_gram) - 1]
    keep = np.flatnonzero(again | (new & several))
    out = table.take(pa.array(order[keep])).select(["shard", "i", "h", "start", "n"])
    return out.append_column("kind", pa.array((~again[keep]).astype(np.int32)))


def _search_shard(table: pa.Table, window: int) -> pa.Table:
    """The intervals (i, h, start, n) of one shard's passages that the index finds earlier."""
    code, h, start = _places(table)
    order = np.lexsort((start, h, code))
    code, h, start = code[order], h[order], start[order]
    once = np.ones(len(order), bool)
    once[1:] = (code[1:] != code[:-1]) | (h[1:] != h[:-1]) | (start[1:] != start[:-1])
    order, start = order[once], start[once]
    table = table.take(pa.array(order))
    hashes, lens = word_hashes(texts_of(table.select(["body"]).combine_chunks().to_batches()[0], "body"))
    symbols = np.unique(hashes, return_inverse=True)[1] + 1
    begins = np.cumsum(lens + 1) - lens - 1  # a 0 after each passage
    text = np.zeros(int((lens + 1).sum()), np.int32)
    text[np.arange(len(symbols)) + np.repeat(np.arange(len(lens)), lens)] = symbols
    at, first = FmIndex(text, window).matches(text, begins, lens)
    at = np.sort(at[first < at])
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1] + 1  # passages are apart by a word at least, windows by more
    lead = np.flatnonzero(new)
    n = np.diff(np.append(lead, len(at))) + window - 1
    of = np.searchsorted(begins, at[lead], "right") - 1
    out = table.take(pa.array(of)).select(["i", "h"])
    out = out.append_column("start", pa.array((start[of] + at[lead] - begins[of]).astype(np.int32)))
    return out.append_column("n", pa.array(n.astype(np.int32)))


def _packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """i, h, size and the text compressed: what joins on (i, h) carry."""
    id_type = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("i"), text_key(text_col).alias("h"), F.col(text_col).cast("binary").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in slices(batches):
            texts = texts_of(batch, "body")
            size = pa.array(map(len, texts), pa.int64())
            small = pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("h"), size, small], ["i", "h", "size", "small"])

    return src.mapInArrow(run, f"i {id_type}, h long, size long, small binary")


def _unpacked(batch: pa.RecordBatch) -> Iterator[bytes]:
    codec = pa.Codec("zstd")
    for size, small in zip(batch.column("size").to_pylist(), batch.column("small").to_pylist()):
        yield codec.decompress(small, size, asbytes=True) if size else b""


def _with_lists(packed: DataFrame, rows: DataFrame, how: str, *cols: str) -> DataFrame:
    """The packed documents joined to the list of their (i, h) rows' ``cols`` (a document's own: bounded by its words)."""
    lists = rows.groupBy(F.col("i").alias("j"), F.col("h").alias("g")).agg(F.collect_list(F.struct(*cols)).alias("list"))
    return packed.join(lists, (packed["h"] == lists["g"]) & packed["i"].eqNullSafe(lists["j"]), how).drop("j", "g")


def _windows(packed: DataFrame, heavy: DataFrame, window: int) -> DataFrame:
    """The passages' rows cut into single windows, each with its own print."""
    listed = _with_lists(packed, heavy, "inner", "start", "n", "gram")
    id_type = packed.schema["i"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            for row, (text, parts) in enumerate(zip(_unpacked(batch), batch.column("list"))):
                start, n, gram = (parts.values.field(c).to_numpy() for c in ("start", "n", "gram"))
                count = n - window + 1
                first = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())
                prints = mixed(Grams(word_hashes([text])[0]).between(first, first + window))
                take = pa.array(np.full(len(first), row))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("i").take(take),
                        batch.column("h").take(take),
                        pa.array(first.astype(np.int32)),
                        pa.array(np.full(len(first), window, np.int32)),
                        pa.array(np.repeat(gram, count)),
                        pa.array(prints.view(np.int64)),
                    ],
                    ["i", "h", "start", "n", "gram", "print"],
                )

    return listed.mapInArrow(run, _PASSAGE.format(id=id_type))


def repeated_intervals(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM
) -> DataFrame:
    """i, h, start and n: stretches of words whose windows all start earlier too (staged; they may overlap).

    Earlier is a smaller id (nulls last), of one id a smaller text hash, of
    one text a smaller start; rows that share id and text are one document.
    Together the stretches cover exactly the words of repeated windows.
    Words are compared by 64-bit hashes. Passages whose gram is very frequent
    are taken window by window instead, counted before they are shuffled.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    out_type = f"i {id_type}, h long, start int, n int"
    sample = docs.where(F.pmod(F.xxhash64(F.col(id_col), text_key(text_col)), F.lit(SAMPLED)) == 0)
    seen = passages(sample, id_col, text_col, window, gram).groupBy("gram").agg(F.count("*").alias("c"))
    heavy = staged(seen.where(F.col("c") * SAMPLED > HEAVY_PASSAGES).select("gram"), "substring-heavy")
    n_heavy = heavy.count()
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    shards = max(1, -(-size // (PASSAGE_BYTES * SHARD_PASSAGES)))

    cut = passages(docs, id_col, text_col, window, gram)
    packed = _packed(docs, id_col, text_col)
    found = []
    if n_heavy:
        one = staged(_windows(packed, cut.join(sized(heavy), "gram", "left_semi"), window), "substring-windows")
        cut = cut.join(sized(heavy), "gram", "left_anti")
        place = F.struct(F.col("i").isNull().alias("last"), "i", "h", "start")
        firsts = one.groupBy("gram", "print").agg(F.min(place).alias("lead"), F.count("*").alias("c")).where("c > 1").drop("c")
        joined = one.join(sized(staged(firsts, "substring-firsts")), ["gram", "print"])
        found.append(joined.where(~F.expr("struct(i is null, i, h, start) <=> lead")).select("i", "h", "start", "n"))

    dealt = cut.withColumn("shard", F.pmod("gram", F.lit(shards)))
    sorted_type = f"shard long, {out_type}, kind int"
    judged = staged(dealt.groupBy("shard").applyInArrow(_sort_passages, sorted_type), "substring-judged")
    found.append(judged.where("kind = 0").select("i", "h", "start", "n"))

    wanted = _with_lists(packed, judged.where("kind = 1"), "inner", "shard", "start", "n")

    def passages_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            at, shard, start, body = [], [], [], []
            for row, (text, parts) in enumerate(zip(_unpacked(batch), batch.column("list").to_pylist())):
                words = text.split()
                for p in parts:
                    at.append(row)
                    shard.append(p["shard"])
                    start.append(p["start"])
                    body.append(b" ".join(words[p["start"] : p["start"] + p["n"]]))
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard, pa.int64()), batch.column("i").take(take), batch.column("h").take(take),
                 pa.array(start, pa.int32()), pa.array(body, pa.binary())],
                ["shard", "i", "h", "start", "body"],
            )

    texts = wanted.mapInArrow(passages_of, f"shard long, i {id_type}, h long, start int, body binary")
    searched = texts.groupBy("shard").applyInArrow(lambda t: _search_shard(t, window), out_type)
    found.append(staged(searched, "substring-searched"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM
) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by a space, as UTF-8) of every row.

    Null, empty and short texts lose nothing; a null id comes after all
    others; rows that share id and text get equal results; texts are taken
    whole at any length; an empty table gives an empty one; other columns are
    not read.
    """
    intervals = repeated_intervals(docs, id_col, text_col, window, gram)
    joined = _with_lists(_packed(docs, id_col, text_col), intervals, "left", "start", "n")
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            total, gone, kept = [], [], []
            for text, parts in zip(_unpacked(batch), batch.column("list")):
                words = text.split()
                total.append(len(words))
                if parts.is_valid and len(parts):
                    edges = np.zeros(len(words) + 1, np.int64)
                    start, n = (parts.values.field(c).to_numpy() for c in ("start", "n"))
                    np.add.at(edges, start, 1)
                    np.add.at(edges, start + n, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("i"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    return joined.mapInArrow(run, f"doc_id {id_type}, n_words long, n_removed long, kept binary")


def kept_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row (see ``without_repeats``)."""
    return without_repeats(docs, id_col, text_col).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


ORACLE = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), starts AS (
  SELECT doc_id, words, unnest(range(0, len(words) - 19)) AS s FROM w WHERE len(words) >= 20
), windows AS (
  SELECT doc_id, s, array_to_string(words[s + 1 : s + 20], ' ') AS v FROM starts
), repeats AS (
  SELECT doc_id, s FROM windows
  QUALIFY row_number() OVER (PARTITION BY v ORDER BY doc_id, s) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM repeats
), lists AS (
  SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id
), kept AS (
  SELECT w.doc_id, len(words) AS n_words, coalesce(len(ps), 0) AS n_removed,
         CASE WHEN ps IS NULL THEN words
              ELSE list_transform(list_sort(list_filter(range(0, len(words)), lambda p: NOT list_contains(ps, p))), lambda p: words[p + 1])
         END AS k
  FROM w LEFT JOIN lists ON w.doc_id = lists.doc_id
)
SELECT doc_id, n_words, n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""
