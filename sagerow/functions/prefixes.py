"""Non-breaking prefixes for the word tokeniser (SRC-8).

A word ending in a period keeps the period attached when its stem is a
kind-1 prefix, or a kind-2 (numeric-only) prefix followed by a number.
Languages without a list fall back to English.
"""

from __future__ import annotations

import string

def _roman(n: int) -> str:
    out = ""
    for value, sym in ((10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        while n >= value:
            out += sym
            n -= value
    return out


# ---- fixed values: abbreviation lists ---------------------------------------------
EN_ABBREVIATIONS = [
    "Adj",
    "Adm",
    "Adv",
    "Asst",
    "Bart",
    "Bldg",
    "Brig",
    "Bros",
    "Capt",
    "Cmdr",
    "Col",
    "Comdr",
    "Con",
    "Corp",
    "Cpl",
    "DR",
    "Dr",
    "Drs",
    "Ens",
    "Gen",
    "Gov",
    "Hon",
    "Hr",
    "Hosp",
    "Insp",
    "Lt",
    "MM",
    "MR",
    "MRS",
    "MS",
    "Maj",
    "Messrs",
    "Mlle",
    "Mme",
    "Mr",
    "Mrs",
    "Ms",
    "Msgr",
    "Op",
    "Ord",
    "Pfc",
    "Ph",
    "Prof",
    "Pvt",
    "Rep",
    "Reps",
    "Res",
    "Rev",
    "Rt",
    "Sen",
    "Sens",
    "Sfc",
    "Sgt",
    "Sr",
    "St",
    "Supt",
    "Surg",
    "v",
    "vs",
    "i.e",
    "rev",
    "e.g",
    "Nos",
    "Nr",
]
EN_NUMERIC_ONLY = [
    "No",
    "Art",
    "pp",
]
DE_ABBREVIATIONS = [
    "Adj",
    "Adm",
    "Adv",
    "Asst",
    "Bart",
    "Bldg",
    "Brig",
    "Bros",
    "Capt",
    "Cmdr",
    "Col",
    "Comdr",
    "Con",
    "Corp",
    "Cpl",
    "DR",
    "Dr",
    "Ens",
    "Gen",
    "Gov",
    "Hon",
    "Hosp",
    "Insp",
    "Lt",
    "MM",
    "MR",
    "MRS",
    "MS",
    "Maj",
    "Messrs",
    "Mlle",
    "Mme",
    "Mr",
    "Mrs",
    "Ms",
    "Msgr",
    "Op",
    "Ord",
    "Pfc",
    "Ph",
    "Prof",
    "Pvt",
    "Rep",
    "Reps",
    "Res",
    "Rev",
    "Rt",
    "Sen",
    "Sens",
    "Sfc",
    "Sgt",
    "Sr",
    "St",
    "Supt",
    "Surg",
    "Mio",
    "Mrd",
    "bzw",
    "vs",
    "usw",
    "d.h",
    "z.B",
    "u.a",
    "etc",
    "MwSt",
    "ggf",
    "d.J",
    "D.h",
    "m.E",
    "vgl",
    "I.F",
    "z.T",
    "sogen",
    "ff",
    "u.E",
    "g.U",
    "g.g.A",
    "c.-à-d",
    "Buchst",
    "u.s.w",
    "sog",
    "u.ä",
    "Std",
    "evtl",
    "Zt",
    "Chr",
    "u.U",
    "o.ä",
    "Ltd",
    "b.A",
    "z.Zt",
    "spp",
    "sen",
    "SA",
    "k.o",
    "jun",
    "i.H.v",
    "dgl",
    "dergl",
    "Co",
    "zzt",
    "usf",
    "s.p.a",
    "Dkr",
    "bzgl",
    "BSE",
    "No",
    "Nos",
    "Art",
    "Nr",
    "pp",
    "ca",
    "Ca",
]
EL_ABBREVIATIONS = [
    "κ",
]
# ---- end of fixed values ----------------------------------------------------------


def _build() -> dict[str, dict[str, int]]:
    en = {c: 1 for c in string.ascii_uppercase}
    en.update({w: 1 for w in EN_ABBREVIATIONS})
    en.update({w: 2 for w in EN_NUMERIC_ONLY})
    # German: single letters, Roman numerals 1-20 in both cases, numbers 1-99, abbreviations
    de = {c: 1 for c in string.ascii_letters}
    de.update({_roman(n): 1 for n in range(1, 21)})
    de.update({_roman(n).lower(): 1 for n in range(1, 21)})
    de.update({w: 1 for w in DE_ABBREVIATIONS})
    de.update({str(n): 1 for n in range(1, 100)})
    el = {w: 1 for w in EL_ABBREVIATIONS}
    return {"en": en, "de": de, "el": el}


PREFIXES = _build()


def prefixes_for(lang: str, kind: int) -> list[str]:
    table = PREFIXES.get(lang, PREFIXES["en"])
    return sorted(w for w, k in table.items() if k == kind)
