"""Word/piece vocabularies and table encoding (TOK-3, TOK-5, TOK-7, TOK-8, JOI-7).

Texts are split into pieces by a pre-tokeniser expression, pieces are
counted with a partial+final hash aggregate (hot pieces are absorbed by the
map-side combine), ids are dense ranks by (count desc, piece), and encoding
is an equi-join of exploded pieces against the vocabulary followed by an
in-order regroup per text. Where rows are lists of texts under one key
(``encode_lists``), the vocabulary's first ids, its most frequent pieces, are
broadcast (a bounded number) and set where the rows are; the other pieces
are joined by buckets, each block of rows asking once for a piece, and lists
of pieces and ids cross the network and the disk packed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import byte_level_pieces
from ..session import cut_lineage
from .rank import global_index


Pieces = Callable[[Column], Column]


def piece_counts(df: DataFrame, text_cols: Sequence[str], pieces: Pieces = byte_level_pieces) -> DataFrame:
    """Frequency of every piece over the given text columns (TOK-3)."""
    exploded = None
    for c in text_cols:
        e = df.select(F.explode(pieces(F.col(c))).alias("token"))
        exploded = e if exploded is None else exploded.unionByName(e)
    return exploded.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def vocab_from_counts(counts: DataFrame, first_id: int = 3) -> DataFrame:
    """Dense ids in (count desc, token asc) order starting at ``first_id`` (TOK-8)."""
    neg = counts.withColumn("_neg", -F.col("n"))
    ranked = global_index(neg, ["_neg", "token"], out="_r")
    return ranked.select("token", (F.col("_r") + first_id).cast("int").alias("id"), "n")


def _vocab_side(vocab: DataFrame) -> DataFrame:
    # No unconditional broadcast hint: a vocabulary grows with the corpus.
    # AQE measures the built vocabulary at run time and turns the join into
    # a broadcast only below spark.sql.adaptive.autoBroadcastJoinThreshold;
    # above it the join stays a shuffle join, with skew splitting for hot pieces.
    return vocab.select("token", "id")


def encode(
    df: DataFrame,
    keys: Sequence[str],
    text: str | Column,
    vocab: DataFrame,
    pieces: Pieces = byte_level_pieces,
    out: str = "ids",
    unk_id: int | None = None,
) -> DataFrame:
    """Text → ids for every row of ``df`` identified by ``keys`` (TOK-5, JOI-7).

    Each text is regrouped alone, so a group is one text, kept whole."""
    t = F.col(text) if isinstance(text, str) else text
    # posexplode_outer keeps texts without pieces (one NULL position)
    ex = df.select(*keys, F.posexplode_outer(pieces(t)).alias("pos", "token"))
    joined = ex.join(_vocab_side(vocab), "token", "left")
    idcol = F.coalesce(F.col("id"), F.lit(unk_id)) if unk_id is not None else F.col("id")
    regrouped = joined.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", idcol.alias("id")))).alias("_p"))
    kept = F.filter("_p", lambda s: s["pos"].isNotNull())
    return regrouped.select(*keys, F.transform(kept, lambda s: s["id"]).alias(out))


def decode(df: DataFrame, keys: Sequence[str], ids: str, vocab: DataFrame, out: str = "text") -> DataFrame:
    """Ids → text by ordered concatenation of pieces; special ids kept (TOK-7)."""
    ex = df.select(*keys, F.posexplode(F.col(ids)).alias("pos", "id"))
    joined = ex.join(_vocab_side(vocab), "id", "left")
    return joined.groupBy(*keys).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda s: s["token"]), ""
        ).alias(out)
    )


#: Ids of the vocabulary that are set by broadcast, and the longest such piece in characters.
HEAD_IDS, HEAD_CHARS = 1 << 16, 64
#: Rows and pieces of a block (a longer row is a block of its own), and the mean of a bucket's part of the vocabulary.
BLOCK_ROWS, BLOCK_PIECES, BUCKET_TOKENS = 1 << 12, 1 << 18, 1 << 17
_WEIGHTS = np.random.default_rng(11).integers(1, 1 << 63, 1 << 12, np.uint64) | np.uint64(1)
_NO_ID = np.iinfo(np.int32).min


def _sizes(lists: pa.ListArray) -> np.ndarray:
    return pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), values)


def _zipped(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unzipped(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of 32-bit integers, their bytes by place, compressed."""
    whole = np.concatenate([[len(arrays)], [len(x) for x in arrays], *arrays]).astype("<i4")
    return _zipped(whole.view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(data: bytes) -> list[np.ndarray]:
    whole = np.frombuffer(_unzipped(data), np.uint8).reshape(4, -1).T.copy().view("<i4").ravel()
    return np.split(whole[1 + whole[0] :], np.cumsum(whole[1 : whole[0]]))


def _text(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The tokens' offsets and bytes; a NULL has none."""
    tokens = pa.concat_arrays([tokens.fill_null("")])
    offsets = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset : tokens.offset + len(tokens) + 1] if len(tokens) else np.zeros(1, np.int32)
    data = tokens.buffers()[2]
    return offsets - offsets[0], np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]


def _pack_tokens(tokens: pa.Array) -> bytes:
    offsets, data = _text(tokens)
    sizes = np.where(tokens.is_null().to_numpy(zero_copy_only=False), -1, np.diff(offsets))
    sizes = _pack(sizes)
    return len(sizes).to_bytes(8, "little") + sizes + _zipped(data.tobytes())


def _unpack_tokens(data: bytes) -> pa.Array:
    cut = 8 + int.from_bytes(data[:8], "little")
    (sizes,) = _unpack(data[8:cut])
    offsets = np.concatenate(([0], np.cumsum(np.maximum(sizes, 0, dtype=np.int64))))
    valid = np.packbits(sizes >= 0, bitorder="little")
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [pa.py_buffer(valid), pa.py_buffer(offsets), pa.py_buffer(_unzipped(data[cut:]))])


def _buckets(tokens: pa.Array, n: int) -> np.ndarray:
    """A bucket below ``n`` for every token, by its bytes alone."""
    offsets, data = _text(tokens)
    sizes = np.diff(offsets)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], sizes)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _WEIGHTS[place % len(_WEIGHTS)], out=sums[1:])
    mixed = (sums[offsets[1:]] - sums[offsets[:-1]]) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def _dealt(tokens: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, Iterator[tuple[int, np.ndarray]]]:
    """Every token's bucket, the tokens' order by bucket, and the parts of that order with their buckets."""
    bucket = _buckets(tokens, n)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    return bucket, order, ((int(bucket[part[0]]), part) for part in np.split(order, cuts) if len(part))


def encode_lists(df: DataFrame, key: str, lists: str, vocab: DataFrame, first_id: int = 3) -> DataFrame:
    """(key, ids): lists of texts' pieces (``array<array<string>>``) as lists of ids, under a unique ``key``.

    Pieces among the first ``HEAD_IDS`` ids are set in place. A block of rows
    asks for each of its other pieces once, in one packed list a bucket of
    pieces; every bucket holds its part of the vocabulary and answers with
    packed ids, which go back to the block. NULL lists are empty; a piece
    that the vocabulary lacks has a NULL id."""
    spark = df.sparkSession
    last = first_id + HEAD_IDS
    short = (F.length("token") <= HEAD_CHARS) & (F.col("id") < last)
    head = vocab.where(short).select("token", "id").toArrow().combine_chunks()  # at most HEAD_IDS rows
    shared = spark.sparkContext.broadcast((head["token"].to_pylist(), head["id"].to_numpy()))
    kind = dict(df.dtypes)[key]
    rest = vocab.where(~short).select("token", "id")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = max(parts, -(-rest.count() // BUCKET_TOKENS))

    def block(number: int, keys: pa.Array, texts: pa.ListArray, tokens: pa.Array, ids: pa.Array) -> pa.RecordBatch:
        pieces = texts.flatten()
        flat = pieces.flatten()
        found = ids.take(pc.index_in(flat, value_set=tokens, skip_nulls=True))
        missing = found.is_null()
        own = flat.filter(missing).dictionary_encode(null_encoding="encode")
        bucket, _, asked = _dealt(own.dictionary, n_buckets)
        steps = np.diff(own.indices.to_numpy(), prepend=0)  # mostly ones
        data = _pack(_sizes(texts), _sizes(pieces), found.fill_null(_NO_ID).to_numpy(), steps, bucket)
        asks = [{"bucket": k, "tokens": _pack_tokens(own.dictionary.take(pa.array(part)))} for k, part in asked]
        columns = [pa.array([number], pa.int64()), _lists(np.array([len(keys)]), keys), pa.array([data], pa.binary())]
        kinds = pa.list_(pa.struct([("bucket", pa.int32()), ("tokens", pa.binary())]))
        return pa.RecordBatch.from_arrays([*columns, pa.array([asks], kinds)], ["block", "keys", "data", "asks"])

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, ids = shared.value
        tokens, ids = pa.array(tokens, pa.string()), pa.array(ids, pa.int32())
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column(1)
            in_row = _sizes(texts)
            ends = np.concatenate(([0], np.cumsum(_sizes(texts.flatten()))))[np.cumsum(in_row)]  # pieces up to each row
            at = 0
            while at < len(batch):
                most = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_PIECES, "right"))
                to = max(at + 1, min(at + BLOCK_ROWS, most))
                rows = batch.slice(at, to - at)
                yield block(number, rows.column(0), rows.column(1), tokens, ids)
                at, number = to, number + 1

    schema = f"block bigint, keys array<{kind}>, data binary, asks array<struct<bucket: int, tokens: binary>>"
    coded = cut_lineage(df.select(F.col(key).alias("key"), lists).mapInArrow(known, schema), "coded-pieces")

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, ids = batch.column(0), batch.column(1).to_numpy()
            made = [(k, -1, _pack_tokens(tokens.take(pa.array(part))), _pack(ids[part])) for k, part in _dealt(tokens, n_buckets)[2]]
            if made:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*made), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["bucket", "block", "tokens", "data"]
                )

    tail = rest.mapInArrow(dealt, "bucket int, block bigint, tokens binary, data binary")
    asks = coded.select("block", F.inline("asks")).select("bucket", "block", "tokens", F.lit(None).cast("binary").alias("data"))
    met = tail.unionByName(asks).repartition(parts, "bucket").sortWithinPartitions("bucket", "block")

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tokens, ids = -1, [], []  # the bucket, and its part of the vocabulary so far
        for batch in batches:
            bucket, blocks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for rows in np.split(np.arange(len(bucket)), np.flatnonzero(np.diff(bucket)) + 1):
                if not len(rows):
                    continue
                if bucket[rows[0]] != at:
                    at, tokens, ids = bucket[rows[0]], [], []
                own = rows[blocks[rows] < 0]
                tokens += [_unpack_tokens(batch.column(2)[i].as_py()) for i in own.tolist()]
                ids += [_unpack(batch.column(3)[i].as_py())[0] for i in own.tolist()]
                asking = rows[blocks[rows] >= 0]
                if not len(asking):
                    continue
                asked = [_unpack_tokens(batch.column(2)[i].as_py()) for i in asking.tolist()]
                every = pa.array(np.concatenate([np.empty(0, np.int32), *ids]), pa.int32())
                known = pa.concat_arrays([pa.array([], pa.large_string()), *tokens])
                got = every.take(pc.index_in(pa.concat_arrays(asked), value_set=known, skip_nulls=True)).fill_null(_NO_ID).to_numpy()
                data = [_pack(x) for x in np.split(got, np.cumsum([len(x) for x in asked])[:-1])]
                columns = [batch.column(1).take(pa.array(asking)), batch.column(0).take(pa.array(asking)), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["block", "bucket", "data"])

    back = met.mapInArrow(answered, "block bigint, bucket int, data binary")
    back = back.withColumn("keys", F.lit(None).cast(f"array<{kind}>"))
    rows = coded.select("block", F.lit(-1).alias("bucket"), "keys", "data")
    placed = rows.unionByName(back).repartition(parts, "block").sortWithinPartitions("block", "bucket")

    def filled(keys: pa.Array, data: bytes, answers: list[bytes]) -> pa.RecordBatch:
        in_row, in_text, ids, steps, bucket = _unpack(data)
        own = np.empty(len(bucket), np.int32)
        own[np.argsort(bucket, kind="stable")] = np.concatenate([np.empty(0, np.int32), *[_unpack(x)[0] for x in answers]])
        ids = ids.copy()
        ids[ids == _NO_ID] = own[np.cumsum(steps)]
        texts = _lists(in_row, _lists(in_text, pa.array(ids, pa.int32(), mask=ids == _NO_ID)))
        return pa.RecordBatch.from_arrays([keys, texts], [key, "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, answers = None, []  # the last block of a batch, whose answers may go on in the next
        for batch in batches:
            bucket, keys, data = batch.column(1).to_numpy(), batch.column(2), batch.column(3)
            for i in range(len(batch)):
                if bucket[i] >= 0:
                    answers.append(data[i].as_py())
                    continue
                if held:
                    yield filled(*held, answers)
                held, answers = (keys[i].values, data[i].as_py()), []
        if held:
            yield filled(*held, answers)

    return placed.mapInArrow(run, f"{key} {kind}, ids array<array<int>>")
