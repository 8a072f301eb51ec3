"""Best-fit packing by a grouping genetic algorithm.

Token pieces go into sequences of at most ``CAPACITY`` tokens. Pieces are
dealt into blocks of a few thousand by hash, and each block is evolved on
several islands: a crossover injects whole well-filled bins of one solution
into another, removes the bins that hold duplicates, and best-fits the
displaced pieces by falling size. After each epoch an island's elite
migrates to its neighbour; the best solution of a block's islands stands.
The bins that a block leaves badly filled are pooled and packed once more.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import groups, slices, staged, texts_of
from .tokens import TextTokenizer

CAPACITY = 2048
VOCABULARY = "byte_bpe_50k.json"
BLOCK_PIECES = 4096
ISLANDS, EPOCHS, POPULATION, CHILDREN = 3, 2, 4, 6
#: Bins filled less than this share after the first pass are packed again with those of other blocks.
POOR = 0.98


def token_pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    vocabulary: str = VOCABULARY,
    checksums: bool = False,
) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) of every piece of every row.

    With ``checksums``, ids_crc32 in place of ids. A document is its ids and
    then id 0; null and empty texts are that id alone. Documents over
    ``capacity`` are cut into pieces of that many tokens, the first taking
    the remainder.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("body"))
    last, kind = ("ids_crc32", pa.int64()) if checksums else ("ids", pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = TextTokenizer(vocabulary), np.zeros(1, "<u4")
        for batch in slices(batches):
            row = 0
            for group in groups(texts_of(batch, "body")):
                at, piece, start, length, out = [], [], [], [], []
                for text in group:
                    ids = np.concatenate((tokenizer(text.decode("utf-8", "replace")), end))
                    n = len(ids)
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        at.append(row)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        out.append(crc32(ids[a:b]) if checksums else ids[a:b].tobytes())
                    row += 1
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(at, pa.int64())),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(out, kind),
                    ],
                    ["doc_id", "piece", "start", "length", last],
                )

    return src.mapInArrow(run, f"doc_id {id_type}, piece int, start long, length long, {last} {'long' if checksums else 'binary'}")


class Bins:
    """Open bins by what is left in them; a bit mask finds the tightest fit at once."""

    def __init__(self, left: np.ndarray, capacity: int):
        self.capacity, self.mask, self.by = capacity, 0, {}
        for k, r in enumerate(left.tolist()):
            self._put(k, r)
        self.n = len(left)

    def _put(self, k: int, r: int) -> None:
        if r:
            self.by.setdefault(r, []).append(k)
            self.mask |= 1 << r

    def place(self, size: int) -> int:
        """The fullest bin that takes ``size``, or a new one."""
        fits = self.mask >> size
        if not fits:
            k, r = self.n, self.capacity
            self.n += 1
        else:
            r = (fits & -fits).bit_length() - 1 + size
            ks = self.by[r]
            k = ks.pop()
            if not ks:
                self.mask &= ~(1 << r)
        self._put(k, r - size)
        return k


def best_fit(sizes: np.ndarray, items: np.ndarray, assigned: np.ndarray, fill: np.ndarray, capacity: int) -> np.ndarray:
    """Place ``items`` (indices, in this order) into bins filled so far, in place; compact bin numbers come back."""
    bins = Bins(capacity - fill, capacity)
    assigned[items] = [bins.place(s) for s in sizes[items].tolist()]
    return np.unique(assigned, return_inverse=True)[1]


def fitness(sizes: np.ndarray, assigned: np.ndarray, capacity: int) -> tuple[int, float]:
    """Smaller is better: the number of bins, then minus the mean square fill."""
    fill = np.bincount(assigned, sizes) / capacity
    return len(fill), -float(np.square(fill).mean())


def cross(rng, sizes, giver, taker, capacity) -> np.ndarray:
    """A child of two solutions: some of the giver's best-filled bins whole, the taker's others, the rest best-fitted."""
    fill = np.bincount(giver, sizes)
    full = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    chosen = rng.choice(full, max(1, len(full) // 3), replace=False)
    moved = np.isin(giver, chosen)
    broken = np.zeros(taker.max() + 1, bool)
    broken[taker[moved]] = True  # these bins hold duplicates of what is injected
    # A mutation: the taker's emptiest bins are opened as well.
    left = np.bincount(taker, sizes)
    broken[np.argsort(left, kind="stable")[: max(1, len(left) // 50)]] = True
    displaced = np.flatnonzero(broken[taker] & ~moved)
    child = np.where(moved, giver, taker + len(fill))
    child[displaced] = -1
    kept, numbers = np.unique(child[child >= 0], return_inverse=True)
    child[child >= 0] = numbers
    filled = np.bincount(child[child >= 0], sizes[child >= 0], len(kept)).astype(np.int64)
    order = displaced[np.lexsort((rng.random(len(displaced)), -sizes[displaced]))]
    return best_fit(sizes, order, child, filled, capacity)


def first_solutions(rng, sizes: np.ndarray, n: int, capacity: int) -> list[np.ndarray]:
    """Best fit by falling size, and by sizes blurred more and more."""
    out = []
    for k in range(n):
        order = np.argsort(-sizes * (1 + 0.15 * k * rng.random(len(sizes))), kind="stable")
        out.append(best_fit(sizes, order, np.full(len(sizes), -1), np.zeros(0, np.int64), capacity))
    return out


def evolve(rng, sizes: np.ndarray, population: list[np.ndarray], children: int, capacity: int) -> list[np.ndarray]:
    """One epoch: each child replaces the worst solution if it is better. Best first."""
    ranked = sorted(((fitness(sizes, p, capacity), k, p) for k, p in enumerate(population)), key=lambda x: x[:2])
    least = -(-int(sizes.sum()) // capacity)
    for k in range(children):
        if len(ranked) < 2 or ranked[0][0][0] <= least:
            break
        a, b = rng.choice(len(ranked), 2, replace=False)
        child = cross(rng, sizes, ranked[a][2], ranked[b][2], capacity)
        found = (fitness(sizes, child, capacity), len(population) + k, child)
        if found[0] < ranked[-1][0]:
            ranked = sorted([*ranked[:-1], found], key=lambda x: x[:2])
    return [p for *_, p in ranked]


def _evolve_blocks(items: DataFrame, capacity: int, seed: int) -> DataFrame:
    """(block, row, bin) of staged (block, row, length): the islands' epochs, then each block's best solution."""
    spread = items.select("block", "row", "length", F.explode(F.array(*[F.lit(k) for k in range(ISLANDS)])).alias("island"))
    state = "block long, island int, place int, solution binary"

    def step(epoch: int):
        def run(rows: pd.DataFrame, elites: pd.DataFrame) -> pd.DataFrame:
            if rows.empty:
                return pd.DataFrame({"block": [], "island": [], "place": [], "solution": []})
            rows = rows.sort_values("row")
            block, island = int(rows["block"].iloc[0]), int(rows["island"].iloc[0])
            sizes = rows["length"].to_numpy()
            rng = np.random.default_rng([seed, epoch, block, island])
            if elites.empty:
                population = first_solutions(rng, sizes, POPULATION, capacity)
            else:
                elites = elites.sort_values(["origin", "place"])
                population = [np.frombuffer(s, "<u4").astype(np.int64) for s in elites["solution"]]
            best = evolve(rng, sizes, population, CHILDREN, capacity)[:POPULATION]
            return pd.DataFrame(
                {"block": block, "island": island, "place": range(len(best)), "solution": [p.astype("<u4").tobytes() for p in best]}
            )

        return run

    population = items.sparkSession.createDataFrame([], f"{state}, origin int")
    for epoch in range(EPOCHS):
        grown = spread.groupBy("block", "island").cogroup(population.groupBy("block", "island"))
        grown = staged(grown.applyInPandas(step(epoch), state), "pack-islands")
        migrants = grown.where("place = 0").select(
            "block", ((F.col("island") + 1) % ISLANDS).alias("island"), "place", "solution", F.col("island").alias("origin")
        )
        population = grown.withColumn("origin", F.col("island")).unionByName(migrants)

    def settle(rows: pd.DataFrame, elites: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row")
        sizes = rows["length"].to_numpy()
        solutions = [np.frombuffer(s, "<u4").astype(np.int64) for s in elites.sort_values("island")["solution"]]
        best = min(solutions, key=lambda p: fitness(sizes, p, capacity))
        return pd.DataFrame({"block": rows["block"], "row": rows["row"], "bin": best})

    elites = grown.where("place = 0")
    return items.groupBy("block").cogroup(elites.groupBy("block")).applyInPandas(settle, "block long, row long, bin long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, seed: int = 11) -> DataFrame:
    """Staged ``pieces`` (with row and length) plus sequence_id and offset.

    Full pieces are sequences of their own. No sequence exceeds
    ``capacity``; offsets are gapless from 0 in each sequence. Pieces longer
    than ``capacity`` raise.
    """
    rows = pieces.select("row", "length")
    small = rows.where(F.col("length") < capacity)

    def blocked(items: DataFrame, salt: int) -> DataFrame:
        n = max(1, -(-items.count() // BLOCK_PIECES))
        return items.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + salt), "row"), F.lit(n)))

    first = staged(blocked(small, 0), "pack-items")
    packed = staged(_evolve_blocks(first, capacity, seed), "pack-first").join(first.select("row", "length"), "row")
    fills = packed.groupBy("block", "bin").agg(F.sum("length").alias("fill"))
    poor = fills.where(F.col("fill") < POOR * capacity).select("block", "bin")
    again = staged(packed.join(poor, ["block", "bin"]).select("row", "length"), "pack-again")
    second = staged(blocked(again, 1), "pack-items")
    repacked = _evolve_blocks(second, capacity, seed + 1).select("row", ((F.col("block") * 2 + 1) * (1 << 20) + F.col("bin")).alias("s"))
    settled = packed.join(poor, ["block", "bin"], "left_anti").select(
        "row", (F.col("block") * 2 * (1 << 20) + F.col("bin")).alias("s")
    )
    placed = staged(settled.unionByName(repacked), "pack-placed")
    full = rows.where(F.col("length") >= capacity).select("row", (-1 - F.col("row")).alias("s"))
    joined = pieces.join(placed.unionByName(full), "row")
    before = Window.partitionBy("s").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    fits = F.assert_true(F.col("length") <= capacity, F.lit("a piece is longer than a sequence"))
    return joined.select(
        *pieces.columns,
        F.col("s").alias("sequence_id"),
        F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"),
        fits.alias("checked"),
    ).drop("checked")


def packed_pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece.

    Rows repeated with the same id are packed one by one; null ids pass
    through; a text of any length is tokenized whole and once, and only its
    pieces' lengths and checksums are kept for packing; an empty table gives
    an empty one; other columns are not read.
    """
    pieces = token_pieces(docs, id_col, text_col, capacity, vocabulary, checksums=True)
    narrow = staged(pieces.select(F.monotonically_increasing_id().alias("row"), "*"), "pack-pieces")
    return pack(narrow, capacity).drop("row")


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves.

    ``pieces`` has row and ids, ``placed`` row, sequence_id and offset; a
    sequence's pieces (at most ``capacity`` of them) are joined in offset order.
    """
    parts = pieces.select("row", "ids").join(placed.select("row", "sequence_id", "offset"), "row")
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(ordered, F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    return parts.groupBy("sequence_id").agg(joined.alias("ids"))
