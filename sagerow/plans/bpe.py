"""Byte-level BPE queries over ``documents`` (AGG-12, TOK-4..7, UDF-6)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EOS_TOKEN
from ..functions import text as tx
from ..operators import bpe as bp
from ..operators import vocab as vb
from ..sources.tables import read_table
from .registry import query, unstated
from .tasks import sql_pieces

#: Merges of the queries whose SQL unrolls one CTE a merge.
N_MERGES = 50
#: Entries of the published vocabulary, for the ``bpe_full_`` queries.
VOCABULARY = 32_768
SPECIALS = (EOS_TOKEN,)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", F.col("text").alias("t"))


_TRAINED: dict[tuple, list] = {}


def _learned(spark: SparkSession, d: str, merges: int, least: int) -> DataFrame:
    """The merges of a table, learned once per application and state of its files, for all queries over it."""
    docs = _docs(spark, d)
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    files = [path(f) for f in sorted(docs.inputFiles())]
    states = [p.getFileSystem(conf).getFileStatus(p) for p in files]
    key = (spark.sparkContext.applicationId, merges, *((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in states))
    if key not in _TRAINED:
        _TRAINED[key] = bp.train_bpe(vb.piece_counts(docs, ["t"]), merges, least).collect()
    return spark.createDataFrame(_TRAINED[key], bp.MERGE_SCHEMA)


def _merges(spark: SparkSession, d: str) -> DataFrame:
    return _learned(spark, d, N_MERGES, 1)


def _digit_then_bytes(text: Column) -> Column:
    """Digit isolation first, then byte-level pieces inside every chunk."""
    return F.flatten(F.transform(tx.digit_chunks(text), tx.byte_level_pieces))


BYTE_MAP_SQL = (
    "CASE WHEN (b BETWEEN 33 AND 126) OR (b BETWEEN 161 AND 172) OR (b BETWEEN 174 AND 255) THEN b "
    "WHEN b <= 32 THEN b + 256 WHEN b <= 160 THEN b + 162 ELSE 323 END"
)


@query(
    "bpe_pair_counts",
    "AGG-12 TOK-2",
    f"""
WITH p AS (SELECT unnest({sql_pieces('text')}) AS piece FROM documents),
s AS (SELECT list_transform(list_transform(regexp_extract_all(hex(encode(piece)), '..'), lambda h: CAST('0x' || h AS INTEGER)),
                            lambda b: chr({BYTE_MAP_SQL})) AS syms FROM p),
pr AS (SELECT syms[i] AS a, syms[i + 1] AS b FROM (SELECT syms, unnest(range(1, len(syms))) AS i FROM s WHERE len(syms) >= 2))
SELECT a, b, CAST(count(*) AS BIGINT) AS count FROM pr GROUP BY a, b""",
)
def bpe_pair_counts(spark: SparkSession, d: str) -> DataFrame:
    """First-round pair counts: over distinct pieces weighted by frequency."""
    w = bp.word_table(vb.piece_counts(_docs(spark, d), ["t"]))
    return bp.pair_counts(w).select("a", "b", F.col("count").cast("bigint"))


# Symbols of a word stand between marks, chr(1); merging two is one plain replacement.
def _wrap_sql(piece: str) -> str:
    return (
        f"array_to_string(list_transform(list_transform(regexp_extract_all(hex(encode({piece})), '..'), "
        f"lambda h: CAST('0x' || h AS INTEGER)), lambda b: chr(1) || chr({BYTE_MAP_SQL}) || chr(1)), '')"
    )


def _train_sql() -> str:
    """The merges unrolled: per round the best pair, then the words with it merged."""
    ctes = [
        f"words AS (SELECT token, count(*) AS n FROM (SELECT unnest({sql_pieces('text')}) AS token FROM documents) GROUP BY token)",
        f"w0 AS MATERIALIZED (SELECT {_wrap_sql('token')} AS w, n FROM words)",
    ]
    for i in range(1, N_MERGES + 1):
        ctes.append(
            f"p{i} AS MATERIALIZED (SELECT s[i] AS a, s[i + 1] AS b, CAST(sum(n) AS BIGINT) AS c "
            f"FROM (SELECT s, n, unnest(range(1, len(s))) AS i FROM "
            f"(SELECT string_split(substr(w, 2, length(w) - 2), chr(1) || chr(1)) AS s, n FROM w{i - 1})) "
            f"GROUP BY 1, 2 ORDER BY c DESC, a, b LIMIT 1)"
        )
        pair, merged = "chr(1) || a || chr(1) || chr(1) || b || chr(1)", "chr(1) || a || b || chr(1)"
        ctes.append(f"w{i} AS MATERIALIZED (SELECT replace(w, {pair}, {merged}) AS w, n FROM w{i - 1}, p{i})")
    union = " UNION ALL ".join(f"SELECT {i - 1} AS rank, a, b, c FROM p{i}" for i in range(1, N_MERGES + 1))
    ctes.append(f"merges AS MATERIALIZED ({union})")
    return "WITH " + ",\n".join(ctes)


def _encode_sql(pieces: str) -> str:
    """Every piece through all merges in rank order, then ids by rule: EOS 0, bytes 1 to 256, merges after them."""
    rule = "chr(1) || a || chr(1) || chr(1) || b || chr(1) || chr(2) || chr(1) || a || b || chr(1)"
    return f"""{_train_sql()},
rules AS (SELECT list({rule} ORDER BY rank) AS r FROM merges),
ids AS (SELECT a || b AS sym, rank + 257 AS id FROM merges
        UNION ALL SELECT chr({BYTE_MAP_SQL}), CAST(b AS INTEGER) + 1 FROM (SELECT CAST(b AS INTEGER) AS b FROM range(256) t(b))),
occ AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS pos FROM (SELECT doc_id, {pieces} AS p FROM documents)),
merged AS (SELECT piece, list_reduce(list_prepend({_wrap_sql('piece')}, r),
             lambda acc, m: replace(acc, split_part(m, chr(2), 1), split_part(m, chr(2), 2))) AS w
           FROM (SELECT DISTINCT piece FROM occ), rules),
syms AS (SELECT piece, unnest(s) AS sym, generate_subscripts(s, 1) AS i
         FROM (SELECT piece, string_split(substr(w, 2, length(w) - 2), chr(1) || chr(1)) AS s FROM merged)),
enc AS (SELECT piece, list(id ORDER BY i) AS pid FROM syms JOIN ids USING (sym) GROUP BY piece),
docs AS (SELECT doc_id, flatten(list(pid ORDER BY pos)) AS x FROM occ JOIN enc USING (piece) GROUP BY doc_id)"""


@query("bpe_merges", "TOK-4 AGG-12", _train_sql() + "\nSELECT CAST(rank AS INTEGER) AS rank, a, b, c AS count FROM merges")
def bpe_merges(spark: SparkSession, d: str) -> DataFrame:
    """Merges learned from the documents: each round the most frequent pair of all."""
    return _merges(spark, d)


@query(
    "bpe_encode_documents",
    "TOK-5 UDF-6 JOI-7",
    _encode_sql(sql_pieces("text")) + "\nSELECT doc_id, CAST(len(x) AS INTEGER) AS n_ids, array_to_string(x, '|') AS ids FROM docs",
)
def bpe_encode_documents(spark: SparkSession, d: str) -> DataFrame:
    m = _merges(spark, d)
    v = bp.bpe_vocab(spark, m, SPECIALS)
    e = bp.bpe_encode(_docs(spark, d), ["doc_id"], F.col("t"), m, v)
    return e.select("doc_id", F.size("ids").alias("n_ids"), tx.show_array("ids").alias("ids"))


DIGIT_PIECES_SQL = (
    "flatten(list_transform(regexp_extract_all(text, '\\p{N}|[^\\p{N}]+'), lambda y: " + sql_pieces("y") + "))"
)


@query(
    "bpe_digit_encode",
    "TOK-6 TOK-1 TOK-5",
    _encode_sql(DIGIT_PIECES_SQL) + "\nSELECT doc_id, CAST(len(x) AS INTEGER) AS n_ids FROM docs",
)
def bpe_digit_encode(spark: SparkSession, d: str) -> DataFrame:
    m = _merges(spark, d)
    v = bp.bpe_vocab(spark, m, SPECIALS)
    e = bp.bpe_encode(_docs(spark, d), ["doc_id"], F.col("t"), m, v, pieces=_digit_then_bytes)
    return e.select("doc_id", F.size("ids").alias("n_ids"))


def _same_texts(docs: DataFrame, back: DataFrame) -> DataFrame:
    """Whether each document's text came back; the join carries the texts' SHA-256, not the texts."""
    of = docs.select("doc_id", F.unhex(F.sha2(F.col("t"), 256)).alias("a"))
    got = back.select("doc_id", F.unhex(F.sha2(F.col("text"), 256)).alias("b"))
    return of.join(got, "doc_id", "left").select("doc_id", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("roundtrip_ok"))


@query("bpe_roundtrip", "TOK-7 TOK-5", "SELECT doc_id, true AS roundtrip_ok FROM documents")
def bpe_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """decode(encode(text)) equals the text for every document."""
    m = _merges(spark, d)
    v = bp.bpe_vocab(spark, m, SPECIALS)
    docs = _docs(spark, d)
    e = bp.bpe_encode(docs, ["doc_id"], F.col("t"), m, v)
    back = bp.bpe_decode(e, ["doc_id"], "ids", v, SPECIALS)
    return _same_texts(docs, back)


# ---- the whole vocabulary: no SQL unrolls that many merges --------------------------------

def _full_merges(spark: SparkSession, d: str) -> DataFrame:
    return _learned(spark, d, VOCABULARY - len(SPECIALS) - 256, 2)


def _full_encode(spark: SparkSession, d: str, pieces: Callable[[Column], Column] = tx.byte_level_pieces) -> DataFrame:
    m = _full_merges(spark, d)
    return bp.bpe_encode(_docs(spark, d), ["doc_id"], F.col("t"), m, bp.bpe_vocab(spark, m, SPECIALS), pieces=pieces)


@unstated("bpe_full_merges")
def bpe_full_merges(spark: SparkSession, d: str) -> DataFrame:
    """The merges of the published vocabulary size (fewer once no pair occurs twice)."""
    return _full_merges(spark, d)


@unstated("bpe_full_encode_documents")
def bpe_full_encode_documents(spark: SparkSession, d: str) -> DataFrame:
    return _full_encode(spark, d).select("doc_id", F.size("ids").alias("n_ids"), tx.show_array("ids").alias("ids"))


@unstated("bpe_full_digit_encode")
def bpe_full_digit_encode(spark: SparkSession, d: str) -> DataFrame:
    return _full_encode(spark, d, _digit_then_bytes).select("doc_id", F.size("ids").alias("n_ids"))


@unstated("bpe_full_roundtrip")
def bpe_full_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """decode(encode(text)) equals the text for every document, at the whole vocabulary."""
    v = bp.bpe_vocab(spark, _full_merges(spark, d), SPECIALS)
    back = bp.bpe_decode(_full_encode(spark, d), ["doc_id"], "ids", v, SPECIALS)
    return _same_texts(_docs(spark, d), back)
