"""Punctuation normaliser (SCA-12) and Moses-style word tokeniser (SCA-13).

Both are ordered rule tables. Each rule is a regex rewrite applied to the
whole string with non-overlapping left-to-right matches (``s///g``
semantics, which Java's ``replaceAll`` shares), so the table folds into a
chain of ``regexp_replace`` expressions.

Unicode normalisation (NFC) has no Spark built-in: it is one Arrow pandas
UDF, and only rows with non-ASCII text send a value through it.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import let

# ---- fixed values: normaliser rules, in order ------------------------------------
# (pattern, replacement)
NORMALIZE_BEFORE_NFC = [
    ("\r", ""),
    (r"\(", " ("),
    (r"\)", ") "),
    (" +", " "),
    (r"\) ([.!:?;,])", ")$1"),
    (r"\( ", "("),
    (r" \)", ")"),
    (r"(\p{Nd}) %", "$1%"),
    (" :", ":"),
    (" ;", ";"),
    ("’", "'"),
    ("‘", "'"),
    ("—", "--"),
    ("–", "--"),
    ("…", "... "),
    (" ★ ", " "),
    ("„", '"'),
    ("″", '"'),
    ("“", '"'),
    ("”", '"'),
]
NORMALIZE_AFTER_NFC = [
    ("â€ž", '"'),
    ("â€œ", '"'),
    ("â€\u009d", '"'),
    ("â€“", "-"),
    ("â€”", " - "),
    (" +", " "),
    ("Â´", "'"),
    ("(?i)([a-z])â€˜([a-z])", "$1'$2"),
    ("(?i)([a-z])â€™([a-z])", "$1'$2"),
    ("â€˜", '"'),
    ("â€š", '"'),
    ("â€™", '"'),
    ("''", '"'),
    ("Â´Â´", '"'),
    ("â€¦", "..."),
    ("Â Â«Â ", ' "'),
    ("Â«Â ", '"'),
    ("Â«", '"'),
    ("Â Â»Â ", '" '),
    ("Â Â»", '"'),
    ("Â»", '"'),
    ("Â %", "%"),
    ("nÂºÂ ", "nÂº "),
    ("Â :", ":"),
    ("Â ÂºC", " ÂºC"),
    ("Â cm", " cm"),
    (r"Â \?", "?"),
    ("Â !", "!"),
    ("Â ;", ";"),
    (",Â ", ", "),
    (" +", " "),
]
QUOTE_RULES_EN = [(r'"([,.]+)', '$1"')]
QUOTE_RULES_OTHER = [(',"', '",'), (r'(\.+)"(\s*[^<])', '"$1$2')]
QUOTE_NONE_LANGS = ("cs", "cz")
COMMA_DIGIT_LANGS = ("de", "es", "cz", "cs", "fr")
DIGIT_GROUP = r"(\p{Nd})Â (\p{Nd})"
BOM_GARBLED = "ï»¿"
# ---- end of fixed values ----------------------------------------------------------


_META = set("\\^$.|?*+()[]{}")


def _chain(c: Column, rules) -> Column:
    for pat, rep in rules:
        if not (set(pat) & _META) and "$" not in rep:
            c = F.replace(c, F.lit(pat), F.lit(rep))  # literal rule: no regex engine
        else:
            c = F.regexp_replace(c, ("(?U)" + pat) if "\\s" in pat else pat, rep)
    return c


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode NFC (UDF-5). NULL in, NULL out."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@functools.lru_cache(maxsize=1)
def nfc_trigger_class() -> str:
    """Regex class of the characters whose presence can make NFC change a
    text, derived from the Unicode tables by rule: non-zero combining class,
    characters not stable under NFC on their own, characters that can be the
    second part of a canonical composition (or start with one after
    decomposition), and the Hangul vowel/trailing jamo. A text with none of
    them is already NFC."""
    second = set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))
    decomposable = []
    for cp in range(sys.maxunicode + 1):
        d = unicodedata.decomposition(chr(cp))
        if d and not d.startswith("<"):
            parts = d.split()
            decomposable.append(cp)
            if len(parts) == 2:
                second.add(int(parts[1], 16))
    cps = set(second)
    for cp in range(sys.maxunicode + 1):
        ch = chr(cp)
        if unicodedata.combining(ch) or unicodedata.normalize("NFC", ch) != ch:
            cps.add(cp)
    for cp in decomposable:
        if ord(unicodedata.normalize("NFD", chr(cp))[0]) in second:
            cps.add(cp)
    ranges, start, prev = [], None, None
    for cp in sorted(cps):
        if start is None:
            start = prev = cp
        elif cp == prev + 1:
            prev = cp
        else:
            ranges.append((start, prev))
            start = prev = cp
    ranges.append((start, prev))
    body = "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)
    return f"[{body}]"


NFC_SAFE_BELOW = 0x300  # every trigger character is at or above U+0300 (checked in tests)


def normalize_punctuation(df, text: str, lang: str, out: str = "normalized"):
    """Ordered punctuation rewrite with language branches (SCA-12).

    Rows with a character at or above U+0300 form a branch of their own and
    pass the NFC UDF; text of ASCII, Latin-1 and Latin Extended letters is
    already NFC and never leaves the JVM. (A one-range test: a class of
    every trigger character is exact too but costs far more per character.)"""
    ascii_rules = [r for r in NORMALIZE_BEFORE_NFC if all(ord(ch) < 128 for ch in r[0])]
    wide_rules = NORMALIZE_BEFORE_NFC[len(ascii_rules):]
    assert NORMALIZE_BEFORE_NFC[: len(ascii_rules)] == ascii_rules  # ASCII rules come first
    # the other rules before NFC match only characters from U+2013 on
    assert all(ord(ch) >= NFC_SAFE_BELOW for r in wide_rules for ch in r[0] if ch != " ")
    far = F.coalesce(F.col(text).rlike(f"[^\\x00-\\x{{{NFC_SAFE_BELOW - 1:X}}}]"), F.lit(False))
    near_rows = df.filter(~far).withColumn("_nfc", _chain(F.col(text), ascii_rules))
    far_rows = df.filter(far).withColumn("_nfc", nfc(_chain(F.col(text), ascii_rules + wide_rules)))
    both = near_rows.unionByName(far_rows)
    return both.withColumn(out, _normalize_after(F.col("_nfc"), F.col(lang))).drop("_nfc")


def _normalize_after(t: Column, lg: Column) -> Column:
    # Every after-NFC rule except the space squeezes and '' needs â or Â in
    # the text, and none of the three creates one: texts without them take
    # the short chain, in the same order.
    plain = [r for r in NORMALIZE_AFTER_NFC if r[0] in (" +", "''")]
    hit = t.contains("â") | t.contains("Â")
    t = F.when(hit, _chain(t, NORMALIZE_AFTER_NFC)).otherwise(_chain(t, plain))
    t = (
        F.when(lg == "en", _chain(t, QUOTE_RULES_EN))
        .when(lg.isin(*QUOTE_NONE_LANGS), t)
        .otherwise(_chain(t, QUOTE_RULES_OTHER))
    )
    return F.when(lg.isin(*COMMA_DIGIT_LANGS), F.regexp_replace(t, DIGIT_GROUP, "$1,$2")).otherwise(
        F.regexp_replace(t, DIGIT_GROUP, "$1.$2")
    )


def has_garbled_bom(text: Column | str) -> Column:
    """Lines carrying the byte-order mark in its garbled form (FIL-13)."""
    t = F.col(text) if isinstance(text, str) else text
    return F.contains(t, F.lit(BOM_GARBLED))


# ---- word tokeniser -----------------------------------------------------------------

ALPHA = r"\p{IsAlphabetic}"
ALNUM = r"\p{IsAlphabetic}\p{Nd}"
DOT_MARK = "\ue000"  # stands in for the dots of a dot run while words are examined

# ---- fixed values: contraction and comma rules, in order -------------------------
CONTRACTIONS = {
    "en": [
        (rf"([^{ALPHA}])'([^{ALPHA}])", "$1 ' $2"),
        (rf"([^{ALPHA}\p{{N}}])'([{ALPHA}])", "$1 ' $2"),
        (rf"([{ALPHA}])'([^{ALPHA}])", "$1 ' $2"),
        (rf"([{ALPHA}])'([{ALPHA}])", "$1 '$2"),
        (r"(\p{N})'(s)", "$1 '$2"),
    ],
    "fr": [
        (rf"([^{ALPHA}])'([^{ALPHA}])", "$1 ' $2"),
        (rf"([^{ALPHA}])'([{ALPHA}])", "$1 ' $2"),
        (rf"([{ALPHA}])'([^{ALPHA}])", "$1 ' $2"),
        (rf"([{ALPHA}])'([{ALPHA}])", "$1' $2"),
    ],
    "other": [("'", " ' ")],
}
COMMA_RULES = [
    (r"([^\p{N}]),([^\p{N}])", "$1 , $2"),
    (r"(\p{N}),([^\p{N}])", "$1 , $2"),
    (r"([^\p{N}]),(\p{N})", "$1 , $2"),
]
# ---- end of fixed values ------------------------------------------------------------


def _guard(t: Column, trigger: str, rules_fn) -> Column:
    """``rules_fn(t)`` on values containing ``trigger``, else ``t``; ``t`` is
    bound once (expressions inside lambdas are not shared)."""
    return let(t, lambda v: F.when(v.contains(trigger), rules_fn(v)).otherwise(v))


def _prepare(line: Column, lang: Column) -> Column:
    # Each rule group runs only on lines holding the character its patterns
    # need; other lines are unchanged by it, so the result is the same.
    t = F.concat(F.lit(" "), line, F.lit(" "))
    t = F.regexp_replace(t, rf"(?U)([^{ALNUM}\s.'`,\-])", " $1 ")
    # dot runs: mark their dots, then isolate the run
    t = _guard(t, "..", lambda v: F.regexp_replace(F.regexp_replace(v, r"\.(?=\.)|(?<=\.)\.", DOT_MARK), f"({DOT_MARK}+)", " $1 "))
    t = _guard(t, ",", lambda v: _chain(v, COMMA_RULES))
    t = F.replace(F.replace(t, F.lit("`"), F.lit("'")), F.lit("''"), F.lit(' " '))

    def contract(v: Column) -> Column:
        return (
            F.when(lang == "en", _chain(v, CONTRACTIONS["en"]))
            .when(lang.isin("fr", "it"), _chain(v, CONTRACTIONS["fr"]))
            .otherwise(_chain(v, CONTRACTIONS["other"]))
        )

    return _guard(t, "'", contract)


_W = r"\p{IsWhite_Space}"
_NW = r"\P{IsWhite_Space}"


def _period_regex(lang: str) -> str:
    """One regex for the sentence-final period rule of ``lang``'s prefix
    lists: a whitespace-delimited word ``pre.`` is split into ``pre .``
    unless pre has an inner dot and a letter, pre is a kind-1 prefix, the
    next word starts lowercase, or pre is a kind-2 prefix and the next word
    starts with a digit. Lookarounds read the original line, as the
    word-by-word rule does."""
    import re as _re

    from .prefixes import prefixes_for

    def alts(kind: int) -> str:
        words = sorted(prefixes_for(lang, kind), key=len, reverse=True)
        return "|".join(_re.escape(w) for w in words)

    end = f"(?:{_W}|$)"
    keep_inner = f"(?=(?:{_NW})*{ALPHA})(?=(?:{_NW})*\\.(?:{_NW})*\\.{end})"
    # cheap test first: only words ending in a period go on to the prefix checks
    parts = [f"(?<!{_NW})", f"(?=(?:{_NW})*\\.{end})", f"(?!{keep_inner})"]
    k1, k2 = alts(1), alts(2)
    if k1:
        parts.append(f"(?!(?:{k1})\\.{end})")
    if k2:
        parts.append(f"(?!(?:{k2})\\.{_W}[0-9])")
    parts.append(f"((?:{_NW})+)\\.(?={end})(?!{_W}\\p{{IsLowercase}})")
    return "".join(parts)


_PERIOD = {lg: _period_regex(lg) for lg in ("en", "de", "el")}


def _tokenize_line(line: Column, lang: Column) -> Column:
    t = _prepare(line, lang)
    t = (
        F.when(lang == "de", F.regexp_replace(t, _PERIOD["de"], "$1 ."))
        .when(lang == "el", F.regexp_replace(t, _PERIOD["el"], "$1 ."))
        .otherwise(F.regexp_replace(t, _PERIOD["en"], "$1 ."))
    )
    # words were split on single whitespace characters and re-joined by spaces
    t = F.trim(F.regexp_replace(F.regexp_replace(t, _W, " "), " +", " "))
    return F.translate(t, DOT_MARK, ".")


def tokenize_words(text: Column | str, lang: Column | str) -> Column:
    """Tokenise every line; markup lines ``<...>`` and blank lines pass
    through unchanged; lines are joined back with newlines (SCA-13, FIL-11,
    WIN-6, JOI-8)."""
    t = F.col(text) if isinstance(text, str) else text
    lg = F.col(lang) if isinstance(lang, str) else lang
    lines = F.split(t, "\n", -1)
    passthrough = lambda ln: ln.rlike("^<.+>$") | ln.rlike(r"(?U)^\s*$")
    return F.array_join(
        F.transform(lines, lambda ln: F.when(passthrough(ln), ln).otherwise(_tokenize_line(ln, lg))), "\n"
    )
