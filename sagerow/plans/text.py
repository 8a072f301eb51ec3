"""Text queries (P5 text side): normaliser, word tokeniser, pre-tokenisers,
piece frequencies, unigram model and corpus NLL, vector normalisation."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import moses as mo
from ..functions import text as tx
from ..functions.prefixes import prefixes_for
from ..functions.scaling import l2_normalize
from ..operators import vocab as vb
from ..session import checkpoint_root, cut_lineage
from ..sources import prefixes as sp
from ..sources.tables import read_table
from .registry import query
from .tasks import sql_pieces

ALPHA_SMOOTHING = 1.0


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _steps(e: str, rules: list[tuple[str, str]]) -> str:
    for pattern, replacement in rules:
        e = f"regexp_replace({e}, {_q(pattern)}, {_q(replacement)}, 'g')"
    return e


# ---- fixed values: the oracle's own statement of the published punctuation rules, in order ----
SPACING_SQL = [
    ("\r", ""), ("[(]", " ("), ("[)]", ") "), (" {1,}", " "), ("[)] ([.!:?;,])", r")\1"), ("[(] ", "("), (" [)]", ")"),
    (r"(\p{Nd}) %", r"\1%"), (" :", ":"), (" ;", ";"),
]
UNICODE_SQL = [
    (r"[\x{2018}\x{2019}]", "'"), (r"[\x{2013}\x{2014}]", "--"), (r"\x{2026}", "... "), (r" \x{2605} ", " "),
    (r"[\x{201C}\x{201D}\x{201E}\x{2033}]", '"'),
]
_E = r"\x{E2}\x{20AC}"  # a curly mark's first two bytes, read as characters
_A = r"\x{C2}"
GARBLED_SQL = [
    (_E + r"[\x{17E}\x{153}\x{9D}]", '"'), (_E + r"\x{201C}", "-"), (_E + r"\x{201D}", " - "), (" {1,}", " "),
    (_A + r"\x{B4}", "'"), (rf"([A-Za-z]){_E}\x{{2DC}}([A-Za-z])", r"\1'\2"), (rf"([A-Za-z]){_E}\x{{2122}}([A-Za-z])", r"\1'\2"),
    (_E + r"[\x{2DC}\x{161}\x{2122}]", '"'), ("''", '"'), (_E + r"\x{A6}", "..."),
    (rf"{_A} {_A}\x{{AB}}{_A} ", ' "'), (rf"{_A}\x{{AB}}{_A} ", '"'), (rf"{_A}\x{{AB}}", '"'),
    (rf"{_A} {_A}\x{{BB}}{_A} ", '" '), (rf"{_A} {_A}\x{{BB}}", '"'), (rf"{_A}\x{{BB}}", '"'),
    (rf"{_A} %", "%"), (rf"n{_A}\x{{BA}}{_A} ", "n\u00c2\u00ba "), (rf"{_A} :", ":"), (rf"{_A} {_A}\x{{BA}}C", " \u00c2\u00baC"),
    (rf"{_A} cm", " cm"), (rf"{_A} [?]", "?"), (rf"{_A} !", "!"), (rf"{_A} ;", ";"), (rf",{_A} ", ", "), (" {1,}", " "),
]
# ---- end of fixed values ----


def _normalize_sql(x: str, lang: str) -> str:
    e = _steps("nfc_normalize(" + _steps(x, SPACING_SQL + UNICODE_SQL) + ")", GARBLED_SQL)
    quoted = (
        f"CASE {lang} WHEN 'en' THEN regexp_replace({e}, '\"([.,]+)', '\\1\"', 'g') WHEN 'cs' THEN {e} WHEN 'cz' THEN {e} "
        f"ELSE regexp_replace(replace({e}, ',\"', '\",'), '([.]+)\"(\\s*[^<])', '\"\\1\\2', 'g') END"
    )
    group = f"'({chr(92)}p{{Nd}}){chr(92)}x{{C2}} ({chr(92)}p{{Nd}})'"
    comma = f"CASE WHEN {lang} IN ('de', 'es', 'cz', 'cs', 'fr') THEN ',' ELSE '.' END"
    return f"regexp_replace({quoted}, {group}, '\\1' || {comma} || '\\2', 'g')"


#: Line put before document i (by i modulo their number) so that the data reach every rule.
MARKED_LINES = [
    "He said \u201cyes\u201d, (he did ) and ( \u2018no\u2019 ) . \u2014 5 % \u2013 x : y ; z\u2026 ok \u2605 fine (a) ! \u2033",
    "\u201eZitat\u201c, 3 %; \"Wort,\" und \"Satz.\" Mehr, \"Ende.\" <b> 12\u00c2 345 und 1\u00c2 2\u00c2 3",
    "\u00e2\u20ac\u017eone\u00e2\u20ac\u0153 two \u00e2\u20ac\u009d a\u00e2\u20ac\u2122b c\u00e2\u20ac\u02dcD \u00e2\u20ac\u2122 \u00e2\u20ac\u0161 \u00e2\u20ac\u00a6 \u00c2\u00b4",
    "\u00c2 \u00c2\u00ab\u00c2 un\u00c2 \u00c2\u00bb\u00c2 deux \u00c2\u00abtrois\u00c2\u00bb n\u00c2\u00ba\u00c2 7 5\u00c2 cm 3\u00c2 % quoi\u00c2 ? oui\u00c2 ! a\u00c2 ; b,\u00c2 c 9\u00c2 \u00c2\u00baC d\u00c2 : e",
    "''double'' `tick` it's John's 1990's d'accord l'eau '90 rock'n'roll 5's x' 'y 3'4",
    "U.S. Mr. Smith No. 5 No. x Nos. 7 etc. z.B. heute vs. them v. x. End. a.b. Dr. Who I. Krieg usw. und Art. 3 pp. 9 12. Mai",
    "a,b 3,500 4,x x,4 ,, 1, 2 ... .... x..y A...B .5 end.. u. Z. last.",
    "\"word\", \"word.\" next. e\u0301 n\u0303 \u2460 \u00b2 <tag> a&b c|d #e $5 ~f",
    "<p>a markup line, it's \u201cleft\u201d.</p>",
]


def marked_documents(spark: SparkSession, d: str) -> DataFrame:
    """``documents`` whose texts begin with one of ``MARKED_LINES``."""
    docs = read_table(spark, d, "documents").select("doc_id", "text", "lang")
    lines = F.array(*[F.lit(x) for x in MARKED_LINES])
    head = F.element_at(lines, (F.pmod("doc_id", F.lit(len(MARKED_LINES))) + 1).cast("int"))
    return docs.select("doc_id", F.concat(head, F.lit("\n"), "text").alias("text"), "lang")


MARKED_SQL = (
    "marked AS (SELECT doc_id, lang, [" + ", ".join(_q(x) for x in MARKED_LINES) + "]"
    f"[doc_id % {len(MARKED_LINES)} + 1] || chr(10) || text AS text FROM documents)"
)


def _normalized(docs: DataFrame) -> DataFrame:
    n = mo.normalize_punctuation(docs, "text", "lang", "normalized")
    return n.select("doc_id", "normalized", mo.has_garbled_bom("text").alias("has_bom"))


@query(
    "normalize_documents",
    "SCA-12 UDF-5 FIL-13",
    f"""
SELECT doc_id, {_normalize_sql('text', 'lang')} AS normalized, contains(text, chr(239) || chr(187) || chr(191)) AS has_bom
FROM documents""",
)
def normalize_documents(spark: SparkSession, d: str) -> DataFrame:
    return _normalized(read_table(spark, d, "documents").select("doc_id", "text", "lang"))


@query(
    "normalize_marked_documents",
    "SCA-12 UDF-5",
    f"""
WITH {MARKED_SQL}
SELECT doc_id, {_normalize_sql('text', 'lang')} AS normalized, contains(text, chr(239) || chr(187) || chr(191)) AS has_bom
FROM marked""",
)
def normalize_marked_documents(spark: SparkSession, d: str) -> DataFrame:
    """The normaliser on texts that hold every mark its rules are about."""
    return _normalized(marked_documents(spark, d))


def _prefix_sql(kind: int) -> str:
    def lst(lg: str) -> str:
        words = prefixes_for(lg, kind)
        return "[" + ", ".join(_q(w) for w in words) + "]::VARCHAR[]" if words else "[]::VARCHAR[]"

    return f"(CASE WHEN lang = 'de' THEN {lst('de')} WHEN lang = 'el' THEN {lst('el')} ELSE {lst('en')} END)"


def _prepare_sql(x: str) -> str:
    """A line up to the word rules: spaces round marks, dot runs, commas, quotes and contractions."""
    letter, number = r"\p{L}\p{Nl}", r"\p{N}"
    t = f"regexp_replace(' ' || {x} || ' ', {_q(rf'([^{letter}{chr(92)}p{{Nd}}{chr(92)}s.{chr(39)}`,-])')}, ' \\1 ', 'g')"
    mark = "chr(57344)"
    t = (
        f"array_to_string(list_transform(regexp_extract_all({t}, '\\.\\.+|[^.]+|\\.'), "
        f"lambda p: CASE WHEN regexp_full_match(p, '\\.\\.+') THEN ' ' || replace(p, '.', {mark}) || ' ' ELSE p END), '')"
    )
    t = _steps(t, [(rf"([^{number}]),([^{number}])", r"\1 , \2"), (rf"([{number}]),([^{number}])", r"\1 , \2"), (rf"([^{number}]),([{number}])", r"\1 , \2")])
    t = f"replace(replace({t}, '`', ''''), '''''', ' \" ')"
    apart, joined = r"\1 ' \2", [rf"([^{letter}])'([^{letter}])", rf"([{letter}])'([^{letter}])", rf"([{letter}])'([{letter}])"]
    english = [(joined[0], apart), (rf"([^{letter}{number}])'([{letter}])", apart), (joined[1], apart), (joined[2], r"\1 '\2"), (rf"([{number}])'(s)", r"\1 '\2")]
    french = [(joined[0], apart), (rf"([^{letter}])'([{letter}])", apart), (joined[1], apart), (joined[2], r"\1' \2")]
    return f"(CASE WHEN lang = 'en' THEN {_steps(t, english)} WHEN lang IN ('fr', 'it') THEN {_steps(t, french)} ELSE replace({t}, '''', ' '' ') END)"


def _tokenize_sql(table: str, with_: str = "") -> str:
    return f"""
WITH {with_}lines AS (
  SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS ln, generate_subscripts(string_split(text, chr(10)), 1) AS li
  FROM {table}),
prep AS (
  SELECT doc_id, lang, li, ln, (regexp_full_match(ln, '<.+>') OR regexp_full_match(ln, '\\s*')) AS pass,
         {_prepare_sql('ln')} AS t
  FROM lines),
words AS (
  SELECT doc_id, lang, li, unnest(string_split_regex(t, '\\s')) AS w, generate_subscripts(string_split_regex(t, '\\s'), 1) AS wi
  FROM prep WHERE NOT pass),
wn AS (SELECT *, lead(w) OVER (PARTITION BY doc_id, li ORDER BY wi) AS nxt,
              CASE WHEN regexp_full_match(w, '\\S+\\.') THEN substr(w, 1, length(w) - 1) END AS pre FROM words),
wr AS (
  SELECT doc_id, li, string_agg(
    CASE WHEN pre IS NOT NULL
          AND NOT ((contains(pre, '.') AND regexp_matches(pre, '[\\p{{L}}\\p{{Nl}}]'))
                   OR list_contains({_prefix_sql(1)}, pre)
                   OR coalesce(regexp_matches(nxt, '^\\p{{Ll}}'), false))
          AND NOT (list_contains({_prefix_sql(2)}, pre) AND coalesce(regexp_matches(nxt, '^[0-9]+'), false))
         THEN pre || ' .' ELSE w END, ' ' ORDER BY wi) AS t8
  FROM wn GROUP BY doc_id, li),
toks AS (
  SELECT p.doc_id, p.li,
         CASE WHEN pass THEN ln
              ELSE replace(regexp_replace(regexp_replace(t8, ' +', ' ', 'g'), '^ | $', '', 'g'), chr(57344), '.') END AS out
  FROM prep p LEFT JOIN wr USING (doc_id, li))
SELECT doc_id, string_agg(out, chr(10) ORDER BY li) AS tokens FROM toks GROUP BY doc_id"""


@query("tokenize_documents", "SCA-13 FIL-11 WIN-6 JOI-8", _tokenize_sql("documents"))
def tokenize_documents(spark: SparkSession, d: str) -> DataFrame:
    """Moses-style tokens per line of every document, language rules by ``lang``."""
    docs = read_table(spark, d, "documents").select("doc_id", "text", "lang")
    return docs.select("doc_id", mo.tokenize_words("text", "lang").alias("tokens"))


@query("tokenize_marked_documents", "SCA-13 WIN-6 JOI-8", _tokenize_sql("marked", MARKED_SQL + ",\n"))
def tokenize_marked_documents(spark: SparkSession, d: str) -> DataFrame:
    """The tokeniser on texts with quotes, contractions, dot runs and abbreviations."""
    return marked_documents(spark, d).select("doc_id", mo.tokenize_words("text", "lang").alias("tokens"))


@query(
    "period_words",
    "SRC-8 JOI-8",
    f"""
WITH {MARKED_SQL},
w AS (SELECT lang, unnest(string_split_regex(text, '[ \n]')) AS word FROM marked),
p AS (SELECT lang, substr(word, 1, length(word) - 1) AS prefix FROM w WHERE length(word) > 1 AND word[-1] = '.')
SELECT lang, prefix, CASE WHEN list_contains({_prefix_sql(1)}, prefix) THEN 1 WHEN list_contains({_prefix_sql(2)}, prefix) THEN 2 ELSE 0 END AS kind,
       CAST(count(*) AS BIGINT) AS n
FROM p GROUP BY ALL""",
)
def period_words(spark: SparkSession, d: str) -> DataFrame:
    """Words before a period, counted, with their kind from prefix files
    written to the shared folder and read back (languages without a file
    take the English one)."""
    folder = f"{checkpoint_root(spark).rstrip('/')}/prefixes-{uuid.uuid4().hex}"
    for lang in ("en", "de"):
        rows = [("# a comment", 1), ("", 1), *[(w, k) for k in (1, 2) for w in prefixes_for(lang, k)]]
        sp.write_prefixes(spark.createDataFrame(rows, "prefix string, kind int"), folder, lang)
    words = marked_documents(spark, d).select("lang", F.explode(F.split("text", "[ \n]")).alias("word"))
    stems = words.filter((F.length("word") > 1) & F.col("word").endswith(".")).select(
        "lang", F.expr("substring(word, 1, length(word) - 1)").alias("prefix")
    )
    counts = stems.groupBy("lang", "prefix").agg(F.count(F.lit(1)).alias("n"))
    tables = [sp.read_prefixes(spark, folder, lang) for lang in ("en", "de", "fr", "es")]
    known = functools.reduce(DataFrame.unionByName, tables)  # a few hundred fixed rows
    j = counts.join(known, ["lang", "prefix"], "left")
    return j.select("lang", "prefix", F.coalesce("kind", F.lit(0)).alias("kind"), F.col("n").cast("bigint"))


@query(
    "page_markup_lines",
    "FIL-11",
    """
WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS ln FROM pages)
SELECT page_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE regexp_full_match(ln, '<.+>')) AS BIGINT) AS n_markup,
       CAST(count(*) FILTER (WHERE regexp_full_match(ln, '\\s*')) AS BIGINT) AS n_blank
FROM l GROUP BY page_id""",
)
def page_markup_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of raw pages that the tokeniser passes through untouched."""
    p = read_table(spark, d, "pages").select("page_id", F.explode(F.split("html", "\n", -1)).alias("ln"))
    return p.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count(F.when(F.col("ln").rlike("^<.+>$"), 1)).alias("n_markup"),
        F.count(F.when(F.col("ln").rlike(r"^\s*$"), 1)).alias("n_blank"),
    )


@query(
    "digit_chunks",
    "TOK-1 TOK-6",
    """
SELECT doc_id, CAST(len(c) AS INTEGER) AS n_chunks, array_to_string(c, '|') AS chunks
FROM (SELECT doc_id, regexp_extract_all(text, '\\p{N}|[^\\p{N}]+') AS c FROM documents)""",
)
def digit_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Digit isolation over whole documents."""
    docs = read_table(spark, d, "documents").select("doc_id", tx.digit_chunks("text").alias("c"))
    return docs.select("doc_id", F.size("c").cast("int").alias("n_chunks"), F.array_join("c", "|").alias("chunks"))


@query(
    "byte_level_pieces",
    "TOK-2",
    f"""
SELECT doc_id, CAST(len(p) AS INTEGER) AS n_pieces, array_to_string(p, '|') AS pieces
FROM (SELECT doc_id, {sql_pieces('text')} AS p FROM documents)""",
)
def byte_level_pieces(spark: SparkSession, d: str) -> DataFrame:
    """GPT-2 byte-level pre-tokenisation of whole documents as they are."""
    docs = read_table(spark, d, "documents").select("doc_id", tx.byte_level_pieces("text").alias("p"))
    return docs.select("doc_id", F.size("p").cast("int").alias("n_pieces"), F.array_join("p", "|").alias("pieces"))


PIECES_SQL = f"""
doc_pieces AS (SELECT doc_id, source, unnest({sql_pieces('text')}) AS token FROM documents),
freq AS (SELECT token, count(*) AS n FROM doc_pieces GROUP BY token)"""


@query("piece_frequencies", "TOK-3", "WITH " + PIECES_SQL + "\nSELECT token, CAST(n AS BIGINT) AS n FROM freq")
def piece_frequencies(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").select("text")
    return vb.piece_counts(docs, ["text"]).select("token", F.col("n").cast("bigint"))


def unigram(spark: SparkSession, d: str) -> DataFrame:
    """Add-α unigram model over pieces of ``documents`` (AGG-10): one
    aggregate for the counts; the totals N and V are two numbers. Columns
    token, n, logp and logp_unk (an unseen piece's)."""
    docs = read_table(spark, d, "documents").select("text")
    counts = vb.piece_counts(docs, ["text"])
    # totals as a scalar subquery: planned with the main query, no driver trip
    denom = counts.select((F.sum("n") + ALPHA_SMOOTHING * (F.count(F.lit(1)) + 1)).cast("double")).scalar()
    return counts.select(
        "token", "n",
        F.log((F.col("n") + ALPHA_SMOOTHING) / denom).alias("logp"),
        F.log(F.lit(ALPHA_SMOOTHING) / denom).alias("logp_unk"),
    )


UNIGRAM_SQL = PIECES_SQL + """,
tot AS (SELECT sum(n) AS total_n, count(*) AS vocab_v FROM freq),
model AS (SELECT token, n, ln((n + 1.0) / (total_n + 1.0 * (vocab_v + 1))) AS logp,
                 ln(1.0 / (total_n + 1.0 * (vocab_v + 1))) AS logp_unk FROM freq, tot)"""


@query(
    "unigram_model",
    "AGG-10 TOK-3",
    "WITH " + UNIGRAM_SQL + "\nSELECT token, CAST(n AS BIGINT) AS n, round(logp, 6) AS logp FROM model",
)
def unigram_model(spark: SparkSession, d: str) -> DataFrame:
    return unigram(spark, d).select("token", F.col("n").cast("bigint"), F.round("logp", 6).alias("logp"))


@query(
    "corpus_nll",
    "AGG-11 AGG-10 TOK-1 TOK-2",
    "WITH "
    + UNIGRAM_SQL
    + f""",
unk AS (SELECT max(logp_unk) AS lu FROM model),
texts AS (SELECT 'documents' AS dataset, source AS part, text FROM documents
          UNION ALL SELECT 'benchmark', 'benchmark', text FROM benchmark),
toks AS (SELECT dataset, part, unnest({sql_pieces('text')}) AS token FROM texts),
refs AS (SELECT dataset, part, sum(len(regexp_extract_all(text, '\\p{{N}}|[^\\p{{N}}]+'))) AS n_ref FROM texts GROUP BY 1, 2),
nll AS (SELECT dataset, part, sum(-coalesce(m.logp, unk.lu)) AS s, count(*) AS n_model
        FROM toks LEFT JOIN model m USING (token), unk GROUP BY 1, 2)
SELECT dataset, part, CAST(n_model AS BIGINT) AS n_model_tokens, CAST(n_ref AS BIGINT) AS n_ref_tokens,
       round(s / n_model, 6) AS nll_per_model_token, round(s / n_ref, 6) AS nll_per_ref_token
FROM nll JOIN refs USING (dataset, part)""",
)
def corpus_nll(spark: SparkSession, d: str) -> DataFrame:
    """NLL of each source under the unigram model, divided by the model's
    token count and by a second tokeniser's count (digit chunks).

    One pass over the texts: counts per (dataset, part, token), with the
    digit chunks counted under a NULL token, feed the model (documents
    only), the scoring join and the second token count."""
    docs = read_table(spark, d, "documents").select(F.lit("documents").alias("dataset"), F.col("source").alias("part"), "text")
    bench = read_table(spark, d, "benchmark").select(F.lit("benchmark").alias("dataset"), F.lit("benchmark").alias("part"), "text")
    texts = docs.unionByName(bench)
    chunks = F.size(tx.digit_chunks("text")).cast("bigint")
    pieces = F.transform(tx.byte_level_pieces("text"), lambda p: F.struct(p.alias("token"), F.lit(1).cast("bigint").alias("w")))
    refs_entry = F.array(F.struct(F.lit(None).cast("string").alias("token"), chunks.alias("w")))
    toks = texts.select("dataset", "part", F.explode(F.concat(pieces, refs_entry)).alias("e"))
    # written once: the model, its totals, the scoring join and the second count all read it
    both = cut_lineage(toks.groupBy("dataset", "part", "e.token").agg(F.sum("e.w").alias("n")), "piece-counts",
                       spark.sparkContext.defaultParallelism)
    c = both.filter(F.col("token").isNotNull())
    model_counts = c.filter(F.col("dataset") == "documents").groupBy("token").agg(F.sum("n").alias("n"))
    denom = model_counts.select((F.sum("n") + ALPHA_SMOOTHING * (F.count(F.lit(1)) + 1)).cast("double")).scalar()
    model = model_counts.select("token", F.log((F.col("n") + ALPHA_SMOOTHING) / denom).alias("logp"))
    lu = F.log(F.lit(ALPHA_SMOOTHING) / denom)
    scored = c.join(model, "token", "left")
    nll = scored.groupBy("dataset", "part").agg(
        F.sum(-F.coalesce(F.col("logp"), lu) * F.col("n")).alias("s"), F.sum("n").alias("n_model")
    )
    refs = both.filter(F.col("token").isNull()).select("dataset", "part", F.col("n").alias("n_ref"))
    j = nll.join(refs, ["dataset", "part"])
    return j.select(
        "dataset",
        "part",
        F.col("n_model").cast("bigint").alias("n_model_tokens"),
        F.col("n_ref").cast("bigint").alias("n_ref_tokens"),
        F.round(F.col("s") / F.col("n_model"), 6).alias("nll_per_model_token"),
        F.round(F.col("s") / F.col("n_ref"), 6).alias("nll_per_ref_token"),
    )


@query(
    "vector_normalize",
    "SCA-23",
    """
WITH n AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v,
                  sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS norm
           FROM embeddings),
u AS (SELECT vec_id, label, list_transform(v, lambda x: x / (norm + 1e-8)) AS w FROM n)
SELECT vec_id, label, round(sqrt(list_sum(list_transform(w, lambda x: x * x))), 6) AS unit_norm,
       round(w[1], 6) AS first_component, CAST(len(w) AS INTEGER) AS dim
FROM u""",
)
def vector_normalize(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "embeddings").select("vec_id", "label", l2_normalize("embedding").alias("w"))
    return e.select(
        "vec_id",
        "label",
        F.round(F.sqrt(F.aggregate("w", F.lit(0.0), lambda a, x: a + x * x)), 6).alias("unit_norm"),
        F.round(F.get("w", 0), 6).alias("first_component"),
        F.size("w").cast("int").alias("dim"),
    )
