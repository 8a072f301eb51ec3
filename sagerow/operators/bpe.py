"""Byte-level BPE: symbols, pair counts, training, encode/decode
(AGG-12, TOK-4, TOK-5, TOK-6, TOK-7, UDF-6).

Training works on the table of distinct pieces with their corpus counts
(TOK-3), which stays distributed. A round learns many merges at once and
exactly: with all pairs that occur at least t times marked, words fall apart
into segments linked by marked pairs. A pair that merges can form later never
occurs more often than the old pair at the border it spans, so every merge of
a count of t or more happens inside a segment, and the distinct segments with
their summed counts give the same merges, in the same order, as the corpus.
They are few; t is set so that their counted bytes stay under a bound, the
driver learns from them, and the words are rewritten segment by segment.

Encoding and decoding work on each text in place: merges and vocabulary are
bounded by the vocabulary size and broadcast once, pieces that recur in a
batch are encoded once, and nothing is shuffled.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import byte_level_pieces
from ..session import cut_lineage, drop_stage


# ---- byte ↔ printable-symbol mapping (by rule) ------------------------------------------
# Bytes 33-126, 161-172 and 174-255 stand for themselves; the other 68
# bytes take code points 256, 257, ... in byte order.

def _mapped_bytes() -> tuple[str, str]:
    """The bytes that don't stand for themselves, as Latin-1 characters, and their symbols."""
    moved = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
    return "".join(map(chr, moved)), "".join(chr(256 + k) for k in range(len(moved)))


def byte_symbols(piece: Column) -> Column:
    """A piece as its byte-level symbols (one printable char per UTF-8 byte)."""
    latin = F.decode(F.encode(piece, "UTF-8"), "ISO-8859-1")
    return F.regexp_extract_all(F.translate(latin, *_mapped_bytes()), F.lit("(?s)."), 0)


# ---- training ------------------------------------------------------------------------------

SYM_SEP = "\u0001"  # never a byte-level symbol (control bytes map to 256+)


def word_table(words: DataFrame, word: str = "token", count: str = "n") -> DataFrame:
    """(w, n): distinct words as symbols with SYM_SEP before, between and after them, with counts."""
    w = F.concat(F.lit(SYM_SEP), F.array_join(byte_symbols(F.col(word)), SYM_SEP), F.lit(SYM_SEP))
    return words.groupBy(w.alias("w")).agg(F.sum(count).alias("n"))


def pair_counts(words: DataFrame) -> DataFrame:
    """Adjacent-pair counts weighted by word frequency (AGG-12), summed in each batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = pc.utf8_slice_codeunits(batch.column("w"), 1, -1)
            parts = pc.split_pattern(w, SYM_SEP)
            sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
            coded = parts.flatten().dictionary_encode()
            at = coded.indices.to_numpy().astype(np.int64)
            word_of = np.repeat(np.arange(len(sizes)), sizes)
            inside, pairs = _neighbours(at, word_of)
            pairs, group = np.unique(pairs[inside], return_inverse=True)
            sums = np.zeros(len(pairs), np.int64)
            np.add.at(sums, group, batch.column("n").to_numpy()[word_of[1:][inside]])
            names = [coded.dictionary.take(pa.array(x)) for x in (pairs >> 32, pairs & 0xFFFFFFFF)]
            yield pa.RecordBatch.from_arrays([*names, pa.array(sums)], ["a", "b", "n"])

    some = words.where("w IS NOT NULL AND n IS NOT NULL").select(F.col("w").cast("string"), F.col("n").cast("long"))
    return some.mapInArrow(run, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("count"))


MERGE_SCHEMA = "rank int, a string, b string, count bigint"
#: Pairs a round marks at most (ties aside), pairs of one level the driver sees, and bytes of distinct segments it learns from.
ROUND_PAIRS, MOST_PAIRS, SEGMENT_BYTES = 4096, 100_000, 4_000_000


def _symbols(batch: pa.RecordBatch) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A batch's words end to end: their bytes, their symbols, and the word each symbol is in."""
    words = batch.column("w").to_pylist()
    raw = b"".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words)) // 4
    return raw, np.frombuffer(raw, "<i4").astype(np.int64), np.repeat(np.arange(len(words)), lens)


def _neighbours(symbols: np.ndarray, word_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which neighbours share a word, and every pair of neighbours as one number."""
    return word_of[1:] == word_of[:-1], symbols[:-1] << 32 | symbols[1:]


def _cuts(symbols: np.ndarray, word_of: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """Where segments begin: at every symbol that no marked pair (sorted) links to the one before it in its word."""
    inside, pairs = _neighbours(symbols, word_of)
    at = np.minimum(np.searchsorted(marked, pairs), len(marked) - 1)
    return np.flatnonzero(np.concatenate(([True], ~(inside & (marked[at] == pairs)))))


def _word_ids(words: DataFrame) -> DataFrame:
    """(w, n): distinct words of two bytes or more as little-endian 32-bit symbols, at first their bytes."""
    counted = words.groupBy(F.encode("token", "UTF-8").alias("w")).agg(F.sum("n").alias("n")).where("length(w) > 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = [np.frombuffer(w, np.uint8).astype("<i4").tobytes() for w in batch.column("w").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(wide, pa.binary()), batch.column("n")], ["w", "n"])

    return counted.mapInArrow(run, "w binary, n long")


def _pair_table(words: DataFrame) -> DataFrame:
    """(pair, n) of the word table, summed in each batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, symbols, word_of = _symbols(batch)
            inside, pairs = _neighbours(symbols, word_of)
            pairs, at = np.unique(pairs[inside], return_inverse=True)
            sums = np.zeros(len(pairs), np.int64)
            np.add.at(sums, at, batch.column("n").to_numpy()[word_of[1:][inside]])
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(sums)], ["pair", "n"])

    return words.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _count_levels(pairs: DataFrame, least: int) -> list[tuple[int, int]]:
    """(lowest count, pairs) of each level of counts, the highest first.

    A level is a count's eight leading bits, so counts below 256 have a level
    each and there are at most 128 an octave, whatever the number of pairs."""
    low_bits = "greatest(length(bin(n)) - 8, 0)"
    level = F.expr(f"shiftleft(shiftright(n, {low_bits}), {low_bits})").alias("level")
    rows = pairs.where(F.col("n") >= least).groupBy(level).agg(F.count(F.lit(1)).alias("k")).collect()
    return sorted(((r["level"], r["k"]) for r in rows), reverse=True)


def _marked_from(levels: list[tuple[int, int]], take: int) -> int | None:
    """From which count on a round marks pairs: the highest levels that hold
    ``take`` pairs together, as far as the driver can see them; None if it can't see the first."""
    floor, held = None, 0
    for low, k in levels:
        held += k
        if held > MOST_PAIRS:
            break
        floor = low
        if held >= take:
            break
    return floor if take else None


def _segments(words: DataFrame, marked: list[int]) -> DataFrame:
    """(s, n): distinct segments of two symbols or more, with their counts in the corpus."""
    shared = words.sparkSession.sparkContext.broadcast(np.array(sorted(marked), np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, symbols, word_of = _symbols(batch)
            if not len(symbols):
                continue
            cuts = _cuts(symbols, word_of, shared.value)
            ends = np.append(cuts[1:], len(symbols))
            some = ends - cuts > 1
            cuts, ends = cuts[some], ends[some]
            found = [raw[4 * a : 4 * b] for a, b in zip(cuts.tolist(), ends.tolist())]
            n = batch.column("n").to_numpy()[word_of[cuts]]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(n)], ["s", "n"])

    return words.mapInArrow(run, "s binary, n long").groupBy("s").agg(F.sum("n").alias("n"))


def _rewritten(words: DataFrame, marked: list[int], merged: dict[bytes, bytes]) -> DataFrame:
    """The word table after a round: its segments replaced, words of one symbol left out."""
    shared = words.sparkSession.sparkContext.broadcast((np.array(sorted(marked), np.int64), merged))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, symbols, word_of = _symbols(batch)
            if not len(symbols):
                continue
            pairs, of = shared.value
            cuts = _cuts(symbols, word_of, pairs)
            bounds = (4 * np.append(cuts, len(symbols))).tolist()
            parts = [of.get(p, p) for p in (raw[a:b] for a, b in zip(bounds, bounds[1:]))]
            starts = np.flatnonzero(np.concatenate(([True], word_of[1:] != word_of[:-1])))
            first = np.searchsorted(cuts, starts).tolist()
            new = [b"".join(parts[a:b]) for a, b in zip(first, [*first[1:], len(parts)])]
            out = pa.RecordBatch.from_arrays([pa.array(new, pa.binary()), batch.column("n")], ["w", "n"])
            yield out.filter(pa.array([len(w) > 4 for w in new], pa.bool_()))

    return words.mapInArrow(run, "w binary, n long")


def _best_pair(pairs: DataFrame, names: list[str]) -> int:
    """Of the most frequent pairs, any number of them, the first by name."""
    spark = pairs.sparkSession
    most = pairs.agg(F.max("n")).first()[0]
    named = F.broadcast(spark.createDataFrame(list(enumerate(names)), "id long, name string"))
    left = named.select(F.col("id").alias("x"), F.col("name").alias("a"))
    right = named.select(F.col("id").alias("y"), F.col("name").alias("b"))
    halves = pairs.where(F.col("n") == most).select("pair", F.shiftright("pair", 32).alias("x"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("y"))
    return halves.join(left, "x").join(right, "y").orderBy("a", "b").select("pair").first()[0]


def train_bpe(words: DataFrame, merges: int, least: int = 1) -> DataFrame:
    """Learn up to ``merges`` merges from a (token, n) frequency table (TOK-4): (rank, a, b, count).

    Best pair per merge: highest count, then (a, b) ascending; it ends early
    once no pair occurs ``least`` times. A round rewrites the word table in
    the shared checkpoint folder and deletes the copy before it. The driver
    sees how many pairs each level of counts has, the pairs a round marks and
    its distinct segments, all bounded (``MOST_PAIRS``, ``SEGMENT_BYTES``,
    counted before they are fetched); where even the pairs of the highest
    level alone give more, the round takes the one best pair, whose segments
    are that pair or runs of one symbol.
    """
    spark = words.sparkSession
    parts = spark.sparkContext.defaultParallelism * 2
    names = base_alphabet()
    learned: list[tuple[int, str, str, int]] = []
    stage = cut_lineage(_word_ids(words), "bpe-words", parts)
    take = ROUND_PAIRS
    while len(learned) < merges:
        pairs = cut_lineage(_pair_table(stage), "bpe-pairs")
        levels = _count_levels(pairs, least)
        if not levels:
            drop_stage(pairs)
            break
        while True:
            floor = _marked_from(levels, take)
            most = merges - len(learned)
            if floor is None:
                marked, most, floor = [_best_pair(pairs, names)], 1, least
            else:
                marked = pairs.where(F.col("n") >= floor).select("pair").toArrow()["pair"].to_pylist()
            segments = cut_lineage(_segments(stage, marked), "bpe-segments")
            if most == 1 or (segments.agg(F.sum(F.length("s"))).first()[0] or 0) <= SEGMENT_BYTES:
                break
            drop_stage(segments)
            take = take // 4 if floor < levels[0][0] else 0
        table = segments.toArrow()
        drop_stage(segments)
        drop_stage(pairs)
        before = table["s"].to_pylist()
        found, after = learn_merges(before, table["n"].to_pylist(), names, most, floor)
        learned += [(len(learned) + k, *m) for k, m in enumerate(found)]
        take = min(ROUND_PAIRS, max(4, 2 * take))
        if len(learned) < merges:
            merged = {a: b for a, b in zip(before, after) if a != b}
            new = cut_lineage(_rewritten(stage, marked, merged), "bpe-words")
            drop_stage(stage)
            stage = new
    drop_stage(stage)
    return spark.createDataFrame(learned, MERGE_SCHEMA)


def train_bpe_vocab(words: DataFrame, size: int, specials: int = 1, least: int = 2) -> DataFrame:
    """The merges of a vocabulary of ``size`` entries: specials, 256 bytes and one symbol a merge (TOK-4)."""
    return train_bpe(words, size - specials - 256, least)


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys, a stable order of the rows by key and where each key starts in it."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return ranked[starts], order, starts


def learn_merges(
    words: list[bytes], counts: list[int], names: list[str], merges: int, least: int = 1
) -> tuple[list[tuple[str, str, int]], list[bytes]]:
    """(a, b, count) of the first ``merges`` merges, and the words after them; new symbols' names are added to ``names``.

    Symbols (little-endian 32-bit) stand in one array, linked to their
    neighbours in the word. A merge takes the best pair from a heap (stale
    entries go back with their present count), replaces it where it stands
    and corrects the counts of the pairs beside those places.
    """
    sym = np.frombuffer(b"".join(words), "<i4").astype(np.int32)
    lens = np.fromiter(map(len, words), np.int64, len(words)) // 4
    n = np.repeat(np.array(counts, np.int64), lens)
    after = np.arange(1, len(sym) + 1, dtype=np.int32)
    before = after - 2
    ends = np.cumsum(lens)
    after[ends - 1] = -1
    before[ends - lens] = -1
    total: dict[int, int] = {}
    places: dict[int, list[np.ndarray]] = {}
    heap: list[tuple[int, str, str, int]] = []

    def change(left: np.ndarray, sign: int) -> None:
        """Count the pairs that begin at ``left`` in (+1) or out (-1)."""
        keys, order, starts = _grouped(sym[left].astype(np.int64) << 32 | sym[after[left]])
        if not len(keys):
            return
        sums = np.add.reduceat(n[left[order]], starts).tolist()
        spans = [*starts.tolist(), len(order)]
        at = left[order]
        for k, key in enumerate(keys.tolist()):
            total[key] = now = total.get(key, 0) + sign * sums[k]
            if sign > 0:
                # A copy: a view would keep the round's whole array.
                places.setdefault(key, []).append(at[spans[k] : spans[k + 1]].copy())
                if now >= least:
                    heapq.heappush(heap, (-now, names[key >> 32], names[key & 0xFFFFFFFF], key))
            elif now == 0:
                del total[key]
                places.pop(key, None)

    change(np.flatnonzero(after >= 0).astype(np.int32), 1)
    learned: list[tuple[str, str, int]] = []
    while heap and len(learned) < merges:
        count, a, b, key = heapq.heappop(heap)
        now = total.get(key, 0)
        if now != -count:
            if least <= now < -count:
                heapq.heappush(heap, (-now, a, b, key))
            continue
        if now < least:
            break
        learned.append((a, b, now))
        names.append(a + b)
        x, y = key >> 32, key & 0xFFFFFFFF
        left = np.unique(np.concatenate(places[key]))
        left = left[(sym[left] == x) & (after[left] >= 0)]
        left = left[sym[after[left]] == y]
        if x == y:  # of a run of overlapping places every other one, from the left
            first = np.r_[True, after[left[:-1]] != left[1:]]
            run = np.arange(len(left))
            left = left[(run - np.maximum.accumulate(np.where(first, run, 0))) % 2 == 0]
        right = after[left]
        far = after[right]
        near = before[left]
        change(np.unique(np.concatenate([near[near >= 0], left, right[far >= 0]])), -1)
        sym[left], sym[right] = len(names) - 1, -1
        after[left] = far
        before[far[far >= 0]] = left[far >= 0]
        near = before[left]
        change(np.unique(np.concatenate([near[near >= 0], left[far >= 0]])), 1)
    kept = sym >= 0
    sizes = np.add.reduceat(kept, ends - lens) if len(lens) else lens
    raw, stops = sym[kept].astype("<i4").tobytes(), (4 * np.cumsum(sizes)).tolist()
    return learned, [raw[a:b] for a, b in zip([0, *stops], stops)]


# ---- vocabulary, encode, decode -----------------------------------------------------------

def base_alphabet() -> list[str]:
    """The 256 byte symbols in byte order."""
    out = []
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        elif b <= 32:
            out.append(chr(b + 256))
        elif b <= 160:
            out.append(chr(b + 162))
        else:
            out.append(chr(323))
    return out


def bpe_vocab(spark: SparkSession, merges: DataFrame, specials: tuple[str, ...]) -> DataFrame:
    """(token, id): specials, then the 256 byte symbols, then merges in rank order."""
    base = [(t, i) for i, t in enumerate(specials)]
    base += [(s, len(specials) + i) for i, s in enumerate(base_alphabet())]
    first = len(base)
    b = spark.createDataFrame(base, "token string, id int")
    m = merges.select(F.concat("a", "b").alias("token"), (F.col("rank") + first).cast("int").alias("id"))
    return b.unionByName(m)


def merge_word(symbols: list[int], ranks: dict[int, tuple[int, int]]) -> list[int]:
    """A word's symbols after all merges, lowest rank first, each from the left: n log n.

    Symbols are linked; a heap holds the ranked pairs by (rank, place), and a
    pair whose symbols have changed since is passed over. ``ranks`` gives a
    pair's rank and new symbol.
    """
    n = len(symbols)
    sym, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r[0], i) for i in range(n - 1) if (r := ranks.get(sym[i] << 32 | sym[i + 1]))]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if sym[i] < 0 or j >= n:
            continue
        found = ranks.get(sym[i] << 32 | sym[j])
        if found is None or found[0] != rank:
            continue
        sym[i], sym[j] = found[1], -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if r := ranks.get(sym[i] << 32 | sym[k]):
                heapq.heappush(heap, (r[0], i))
        if (h := before[i]) >= 0 and (r := ranks.get(sym[h] << 32 | sym[i])):
            heapq.heappush(heap, (r[0], h))
    return [x for x in sym if x >= 0]


#: Encoded pieces a worker remembers, of at most so many bytes each.
CACHE_PIECES, CACHE_PIECE_BYTES = 200_000, 64


#: List items that a worker looks at together (one row's at least).
SLICE_ITEMS = 500_000


def _slices(column: pa.ListArray) -> Iterator[pa.ListArray]:
    """A list column in slices of rows with few items, so that a batch of long rows takes little memory."""
    ends = np.cumsum(pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start, held = 0, 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(ends, held + SLICE_ITEMS, "right")))
        yield column.slice(start, stop - start)
        start, held = stop, int(ends[stop - 1])


def _lists_of(rows: pa.ListArray, at: np.ndarray, parts: list[np.ndarray], kind: type) -> pa.ListArray:
    """For each row its items' parts end to end; ``at`` has each item's place in ``parts``."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = np.concatenate([*parts, np.zeros(0, kind)]).astype(kind, copy=False)
    starts, lens = (np.cumsum(sizes) - sizes)[at], sizes[at]
    ends = np.concatenate(([0], np.cumsum(lens)))
    values = flat[np.repeat(starts - ends[:-1], lens) + np.arange(ends[-1])]
    items = np.cumsum(pc.list_value_length(rows).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    offsets = ends[np.concatenate(([0], items))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def bpe_encode(
    df: DataFrame,
    keys: list[str],
    text: Column,
    merges: DataFrame,
    vocab: DataFrame,
    pieces: Callable[[Column], Column] = byte_level_pieces,
    out: str = "ids",
) -> DataFrame:
    """Text → BPE ids per row (TOK-5); ``pieces`` may chain digit isolation (TOK-6).

    The merges and the vocabulary, bounded by its size, are broadcast once;
    each row is encoded where it is, a piece that recurs once a batch. NULL
    texts give no ids."""
    ids = {r["token"]: r["id"] for r in vocab.collect()}
    learned = merges.orderBy("rank").select("a", "b").collect()
    ranks = {ids[r["a"]] << 32 | ids[r["b"]]: (k + 1, ids[r["a"] + r["b"]]) for k, r in enumerate(learned)}
    shared = df.sparkSession.sparkContext.broadcast(([ids[c] for c in base_alphabet()], ranks))
    known: dict[str, np.ndarray] = {}

    def encoded(piece: str) -> np.ndarray:
        if (got := known.get(piece)) is None:
            base, ranks = shared.value
            raw = piece.encode()
            got = np.array(merge_word([base[b] for b in raw], ranks), np.int32)
            if len(raw) <= CACHE_PIECE_BYTES:
                if len(known) >= CACHE_PIECES:
                    known.clear()
                known[piece] = got
        return got

    def some_rows(rows: pa.ListArray) -> pa.ListArray:
        """Each different piece is a Python value once; the rows' ids are put together as arrays."""
        coded = rows.flatten().dictionary_encode()
        found = [encoded(p) for p in coded.dictionary.to_pylist()]
        return _lists_of(rows, coded.indices.to_numpy(), found, np.int32)

    def run(column: pa.Array) -> pa.Array:
        done = [some_rows(x) for x in _slices(column)]
        return pa.concat_arrays(done) if done else pa.array([], pa.list_(pa.int32()))

    encode = F.arrow_udf(run, T.ArrayType(T.IntegerType()))
    return df.select(*keys, encode(pieces(text)).alias(out))


def bpe_decode(
    df: DataFrame, keys: list[str], ids: str, vocab: DataFrame, specials: tuple[str, ...] = (), out: str = "text"
) -> DataFrame:
    """Ids → text; special tokens are kept as their strings (TOK-7). Ids without a token are left out.

    The vocabulary's byte strings are broadcast; rows are decoded where they are."""
    byte_of = {c: b for b, c in enumerate(base_alphabet())}
    tokens = sorted((r["id"], r["token"]) for r in vocab.collect())
    raw = [t.encode() if t in specials else bytes(byte_of[c] for c in t) for _, t in tokens]
    shared = df.sparkSession.sparkContext.broadcast((np.array([i for i, _ in tokens], np.int64), raw))

    def some_rows(rows: pa.ListArray) -> pa.Array:
        known, raw = shared.value
        values = rows.flatten()
        asked = values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
        at[(known[at] != asked) | values.is_null().to_numpy(zero_copy_only=False)] = len(raw)
        used, at = np.unique(at, return_inverse=True)
        parts = [np.frombuffer(raw[k] if k < len(raw) else b"", np.uint8) for k in used.tolist()]
        texts = _lists_of(rows, at, parts, np.uint8)
        data, ends = texts.values.to_numpy().tobytes(), texts.offsets.to_pylist()
        return pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])], pa.string())

    def run(column: pa.Array) -> pa.Array:
        done = [some_rows(x) for x in _slices(column)]
        return pa.concat_arrays(done) if done else pa.array([], pa.string())

    return df.select(*keys, F.arrow_udf(run, T.StringType())(F.col(ids)).alias(out))
