"""Mixing sources to target weights, in DataFrame expressions throughout.

Tokens are summed per source, the targets follow from the weights, and a
source's repetition rate is target over size. A document is emitted
floor(rate) times, plus once more with the fraction's probability, decided
by a hash of its id and text, so reruns and retried tasks agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, staged, unit_hash

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix"


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target, rate) from rows (source, size), staged.

    Sources weigh ``weights`` in turn by code point, null last. Targets share
    all sizes by weight; none exceeds ``most`` times its source, and the
    excess goes to the others by weight. Ordered by the share at which they
    fill up, each source as the first unfilled one gives a level (what is
    left over the weight that is left); the true level is the largest.
    The windows run over one row per source. A source without words has
    target and rate 0.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turns = F.array(*[F.lit(w) for w in weights])
    weighed = per.withColumn("weight", F.element_at(turns, place % len(weights) + 1)).withColumn("place", place)
    cap = F.col("source_size") * most
    order = Window.orderBy(cap.cast("double") / F.col("weight"), "place")
    filled = F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ((F.sum("source_size").over(everything) - filled).cast("double") / left).alias("level")
    levels = weighed.select("*", level).withColumn("level", F.max("level").over(everything))
    target = F.least(cap.cast("double"), F.col("level") * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0))
    return staged(levels.select("source", "source_size", target.alias("target"), rate.alias("rate")), "mix-sources")


def copies(rate: Column, draw: Column) -> Column:
    """floor(rate), and one more where the draw from [0, 1) falls below the fraction."""
    return F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of every row.

    Texts are read once. Null texts have size 0; a null source is a source
    of its own; rows repeated with the same id and text share their draw;
    a null id draws by its text. Other columns are not read.
    """
    rows = staged(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            unit_hash(SEED, F.col(id_col), F.col(text_col)).alias("draw"),
        ),
        "mix-rows",
    )
    sources = source_targets(rows)
    joined = rows.join(sources, rows["source"].eqNullSafe(sources["source"]))
    taken = F.col("size") * copies(F.col("rate"), F.col("draw"))
    return joined.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with each row emitted as often as the mix takes it, columns unchanged."""
    sources = source_targets(docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")))
    key, rate, copy = fresh(docs, "mix_source", "mix_rate", "mix_copy")
    rates = sources.select(F.col("source").alias(key), F.col("rate").alias(rate))
    joined = docs.join(rates, docs[source_col].eqNullSafe(rates[key]))
    n = copies(F.col(rate), unit_hash(SEED, F.col(id_col), F.col(text_col)))
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(1), n.cast("int")))).select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )


ORACLE = r"""
WITH s AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, 'null')) AS h
  FROM documents
), p AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM s GROUP BY source
), w AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM p
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (
               ORDER BY (3 * source_size)::DOUBLE / weight, place
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (ORDER BY (3 * source_size)::DOUBLE / weight, place
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), t AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, max(level) OVER () * weight) AS target FROM l
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t
)
SELECT s.doc_id, s.size, r.source_size, r.target,
       (s.size * (floor(r.rate) + CASE WHEN ('0x' || substr(s.h, 1, 13))::BIGINT / 4503599627370496.0::DOUBLE
                                            < r.rate - floor(r.rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM s JOIN r ON s.source IS NOT DISTINCT FROM r.source
"""
