"""Accent folding and transliteration.

Latin letters are folded by one ``translate`` over a table that is derived from Unicode's decompositions, so ordinary text never leaves the JVM. Text in other scripts
takes Arrow kernels: folding by decomposition, transliteration by the letters' Unicode names.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LATIN = range(0xC0, 0x250)
#: Latin letters that have no decomposition, with their usual spelling.
SPELT = {"ß": "ss", "æ": "ae", "Æ": "ae", "œ": "oe", "Œ": "oe", "ø": "o", "Ø": "o", "đ": "d", "Đ": "d", "ł": "l", "Ł": "l", "þ": "th", "Þ": "th", "ð": "d", "Ð": "d", "ı": "i"}


def fold_text(text: str, marks_only: bool = False) -> str:
    """NFKD without combining characters (``marks_only``: without category Mn)."""
    drop = (lambda c: unicodedata.category(c) == "Mn") if marks_only else unicodedata.combining
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not drop(c))


@cache
def _latin() -> tuple[str, str]:
    pairs = [(chr(cp), f) for cp in LATIN if len(f := fold_text(chr(cp))) == 1 and f != chr(cp)]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(c: Column) -> Column:
    """Latin letters without accents; other characters stay."""
    a, b = _latin()
    return F.when(F.length(c) == F.octet_length(c), c).otherwise(F.translate(c, a, b))


@F.pandas_udf(T.StringType())
def fold_any(s: pd.Series) -> pd.Series:
    """Any script: NFKD without combining characters."""
    return s.map(lambda t: t if t is None or t.isascii() else fold_text(t))


@F.pandas_udf(T.StringType())
def strip_marks(s: pd.Series) -> pd.Series:
    """Any script: NFKD without nonspacing marks (drops vowel signs of Indic scripts too)."""
    return s.map(lambda t: t if t is None or t.isascii() else fold_text(t, marks_only=True))


def transliterate(c: Column) -> Column:
    """Latin text as lower-case ASCII letters; other scripts' characters stay (see ``transliterate_any``)."""
    out = fold(c)
    for letter, spelt in SPELT.items():
        out = F.replace(out, F.lit(letter), F.lit(spelt))
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.lower(out))


_CYRILLIC = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюяёіїєґ", "a b v g d e zh z i i k l m n o p r s t u f kh ts ch sh shch \" y ' e iu ia io i yi ie g".split(), strict=True))
_GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a b g d e z e th i k l m n x o p r s s t u ph kh ps o".split(), strict=True))
#: Letters whose Unicode names do not spell them.
_NAMED = _CYRILLIC | _GREEK


@cache
def _letter(c: str) -> str:
    """ASCII for one character, from its Unicode name where it has no decomposition to ASCII."""
    if c.isascii():
        return c
    if c in SPELT:
        return SPELT[c]
    plain = fold_text(c)
    if plain.isascii():
        return plain
    if spelt := _NAMED.get(c.lower()) or _NAMED.get(plain.lower()):
        return spelt
    name = unicodedata.name(c, "")
    if "VOWEL SIGN" in name:
        return name.split("VOWEL SIGN ")[1].split()[-1].lower()
    if "VIRAMA" in name or "NUKTA" in name:
        return ""
    if "ANUSVARA" in name or "CANDRABINDU" in name:
        return "n"
    if "VISARGA" in name:
        return "h"
    if unicodedata.decimal(c, None) is not None:
        return str(unicodedata.decimal(c))
    for kind in (" LETTER ", " SYLLABLE "):
        if kind in name:
            own = name.split(kind)[1].split(" WITH ")[0].split()[-1].lower()
            # Indic consonants carry an inherent vowel that the letters around them spell out.
            return own[:-1] if len(own) > 1 and own.endswith("a") and name.split()[0] in _INDIC else own
    return " " if c.isspace() or unicodedata.category(c)[0] == "P" else ""


_INDIC = {"DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM", "SINHALA"}


def transliterate_text(text: str) -> str:
    return "".join(map(_letter, unicodedata.normalize("NFC", text))).lower()


@F.pandas_udf(T.StringType())
def transliterate_any(s: pd.Series) -> pd.Series:
    """Any script as lower-case ASCII."""
    return s.map(lambda t: t if t is None else transliterate_text(t))


#: Letters, marks and digits that ``fold`` and ``transliterate`` leave alone.
_OTHER = r"[\p{L}\p{M}\p{N}&&[^\x00-\x7F\u00C0-\u024F]]"


def _by_script(c: Column, native, kernel) -> Column:
    """``native(c)`` for Latin text; only values with other scripts reach the Arrow kernel."""
    other = c.rlike(_OTHER)
    return F.when(other, kernel(F.when(other, c))).otherwise(native(c))


def fold_script(c: Column) -> Column:
    return _by_script(c, fold, fold_any)


def transliterate_script(c: Column) -> Column:
    return _by_script(c, transliterate, transliterate_any)


def strip_script(c: Column) -> Column:
    return _by_script(c, fold, strip_marks)
