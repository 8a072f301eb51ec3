"""SimHash near-dedup: segment-popcount embedding with an exact check.

A 64-bit fingerprint is cut into 32 segments of two bits, and each segment's
popcount (0, 1 or 2) is one coordinate. Bits that differ change a coordinate
by at most one each, so the Manhattan distance of two embeddings is a lower
bound of the Hamming distance. Within ``2 r`` bits one half of the 32
coordinates is within ``r``; with r = 2 the grid points at distance one or
less of either half-embedding then share a grid cell. The range join is an
equi-join on those cells; pairs in a cell are verified on the real bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, over_texts, staged, text_key, without_rows

WORDS = 4
MAX_BITS = 4
#: Cells up to this many fingerprints are paired by a join, larger ones in blocks.
SMALL_CELL = 32
BLOCK = 1024

_PAIR = 0x55555555
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACE = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: bytes, n_words: int = WORDS) -> int:
    """The signed 64-bit SimHash of the text's word shingles (repeats included)."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= n_words:
        value = digest(line, 42)
        return value - (1 << 64) if value >> 63 else value
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - n_words + 1].tolist()
    stops = ends[n_words - 1 :].tolist()
    hashes = np.array([digest(line[a:b], 42) for a, b in zip(starts, stops)], np.uint64)
    octets = hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
    table = np.bincount((octets + _PLACE).ravel(), minlength=2048).reshape(8, 256)
    ones = (table @ _BITS).ravel() * 2 > len(hashes)
    return int(np.packbits(ones, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = WORDS) -> DataFrame:
    """doc_id and fp (long) of every row."""
    return over_texts(
        docs, id_col, text_col, "fp long", lambda: lambda texts: [[fingerprint(t, n_words) for t in texts]]
    )


def _half(fp: Column, upper: bool) -> Column:
    """Sixteen two-bit popcounts of one half of the fingerprint, packed into 32 bits."""
    x = F.shiftrightunsigned(fp, 32) if upper else fp.bitwiseAND(F.lit(0xFFFFFFFF))
    return x.bitwiseAND(F.lit(_PAIR)) + F.shiftright(x, 1).bitwiseAND(F.lit(_PAIR))


def _cells(v: Column, upper: bool) -> Column:
    """The packed grid points at Manhattan distance one or less, the half marked above the 32 bits."""
    units = F.array(*[F.lit(1 << (2 * i)) for i in range(16)])
    part = lambda u: (v / u).cast("long") % 4
    up = F.transform(F.filter(units, lambda u: part(u) < 2), lambda u: v + u)
    down = F.transform(F.filter(units, lambda u: part(u) > 0), lambda u: v - u)
    return F.transform(F.concat(F.array(v), up, down), lambda c: c + F.lit(int(upper) << 33))


def near_links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) that join all fingerprints within ``max_bits`` of one another, directly or by a chain.

    ``distinct`` has one row per fingerprint ``fp``. Every pair within
    ``max_bits`` (at most 4) is connected by the result; small cells give
    their pairs, large ones a spanning forest per pair of blocks, so a
    dense group never writes out all its pairs.
    """
    if max_bits > 4:
        raise ValueError("the half-embeddings' grid covers up to 4 differing bits")
    sides = []
    for up in (False, True):
        half = distinct.select("fp", _half(F.col("fp"), up).alias("half"))
        cells = half.select("fp", (F.col("half") + F.lit(int(up) << 33)).alias("v"), _cells(F.col("half"), up).alias("cells"))
        sides.append(cells.select("fp", "v", F.explode("cells").alias("cell")))
    spread = sides[0].unionByName(sides[1])
    crowded = staged(spread.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > SMALL_CELL), "crowded-cells")
    few = spread.join(crowded, "cell", "left_anti")
    a, b = few.alias("a"), few.alias("b")
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits
    own = (F.col("a.v") != F.col("b.v")) | (F.col("a.v") == F.col("a.cell"))  # equal halves meet once, not in each cell
    pairs = a.join(b, (F.col("a.cell") == F.col("b.cell")) & (F.col("a.fp") < F.col("b.fp")) & own & near).select(
        F.col("a.fp").alias("a"), F.col("b.fp").alias("b")
    )

    blocks = F.ceil(F.col("n") / BLOCK)
    block = F.pmod(F.xxhash64("fp"), blocks)
    many = (
        spread.join(crowded, "cell")
        .select("cell", "fp", block.alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("y"))
        .select("cell", "fp", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"))
    )

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        fps = pdf["fp"].to_numpy().view(np.uint64)
        left, tree = np.arange(len(fps)), []
        while len(left):
            todo, left = [left[0]], left[1:]
            while todo and len(left):
                at = todo.pop()
                close = np.bitwise_count(fps[left] ^ fps[at]) <= max_bits
                found = left[close]
                tree += [(at, k) for k in found]
                todo += found.tolist()
                left = left[~close]
        own = fps.view(np.int64)
        ends = np.array(tree, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": own[ends].min(1), "b": own[ends].max(1)})

    trees = many.groupBy("cell", "lo", "hi").applyInPandas(forest, "a long, b long")
    return pairs.unionByName(trees).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that a link (a, b) touches; root is the component's smallest node.

    Alternating stars: every node's neighbours are hung on its smallest
    one, first from the larger side, then from the smaller, until nothing
    moves. Each round is written to the shared folder.
    """
    marks = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")]
    now = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b"), "links")
    mark = now.agg(*marks).first()
    while mark["n"]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = staged(down.withColumnRenamed("m", "b").unionByName(small).distinct(), "links")
        new = after.agg(*marks).first()
        drop_staged(now)
        now, same, mark = after, new == mark, new
        if same:
            break
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_classes(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, rep) for every distinct fingerprint of staged rows (fp, r): rep is its component's smallest ``r``."""
    groups = staged(fps.groupBy("fp").agg(F.min("r").alias("r")), "fingerprint-groups")
    roots = staged(components(near_links(groups.select("fp"), max_bits)), "fingerprint-roots")
    linked = groups.join(roots, groups["fp"] == roots["node"]).select("fp", "r", "root")
    reps = linked.groupBy("root").agg(F.min("r").alias("rep"))
    moved = linked.join(reps, "root").select("fp", "rep")
    alone = groups.join(roots, groups["fp"] == roots["node"], "left_anti").select("fp", F.col("r").alias("rep"))
    return staged(moved.unionByName(alone), "fingerprint-classes")


def _rows(docs: DataFrame, id_col: str, text_col: str, n_words: int) -> DataFrame:
    """Staged (i, h, fp, r) of every row; r orders the rows by id (nulls last), then by text hash."""
    key = docs.select(F.struct(F.col(id_col).alias("i"), text_key(text_col).alias("h")).alias("k"), F.col(text_col).alias("t"))
    rows = fingerprints(key, "k", "t", n_words).select("doc_id.i", "doc_id.h", "fp")
    return staged(rows.withColumn("r", F.struct(F.col("i").isNull().alias("absent"), "i", "h")), "fingerprints")


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = WORDS, max_bits: int = MAX_BITS
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Null and empty texts have fingerprint zero and link like any other.
    component_id is null only where no document of the component has an id.
    Repeated rows share a component; other columns are not read.
    """
    rows = _rows(docs, id_col, text_col, n_words)
    joined = rows.join(near_classes(rows, max_bits), "fp")
    return joined.select(
        F.col("i").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("rep.i").alias("component_id"),
    )


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = WORDS, max_bits: int = MAX_BITS
) -> DataFrame:
    """``docs`` with one row of each component (the smallest id, nulls last), columns unchanged."""
    rows = _rows(docs, id_col, text_col, n_words)
    joined = rows.join(near_classes(rows, max_bits), "fp")
    per_row = joined.groupBy("i", "h", (F.col("r") == F.col("rep")).alias("stays")).agg(F.count("*").alias("n"))
    per_row = staged(per_row.where("not stays or n > 1"), "near-members")
    return without_rows(
        docs, per_row.where("not stays").select("i", "h"), per_row.where("stays").select("i", "h"), id_col, text_col
    )
