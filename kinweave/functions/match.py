"""The matching normaliser."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave import values as V
from kinweave.functions.block import let, squeeze
from kinweave.functions.clean import lookup
from kinweave.functions.fold import strip_script

NUMBER = r"(?<![\p{L}\p{N}_])\p{Nd}+(?![\p{L}\p{N}_])"
_EDGE = r"(?![\p{L}\p{N}_])"


@F.pandas_udf(T.StringType())
def compose(s: pd.Series) -> pd.Series:
    """NFC; the identity on precomposed text, so it is only needed where marks stand alone."""
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def _composed(c: Column) -> Column:
    """NFC where a mark stands alone; all other text is composed already or not composable."""
    marked = c.rlike(r"\p{M}")
    return F.when(marked, compose(F.when(marked, c))).otherwise(c)


def match_name(name: Column) -> Column:
    """Lower case without URLs, punctuation, one legal suffix (as a string, without regard to words) and one honorific."""
    text = F.lower(_composed(F.coalesce(name, F.lit(""))))
    text = F.replace(F.replace(text, F.lit("&"), F.lit(" and ")), F.lit("+"), F.lit(" and "))
    text = F.regexp_replace(text, V.MATCH_URL.replace(r"\b", _EDGE), "")
    text = F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", " ")
    return _strip_affixes(text)


def _strip_affixes(text: Column) -> Column:
    def suffix(t: Column) -> Column:
        cut = None
        for word in V.MATCH_SUFFIXES:
            then = F.substr(t["end"], F.lit(1), F.length(t["end"]) - len(word))
            cut = F.when(t["end"].endswith(word), then) if cut is None else cut.when(t["end"].endswith(word), then)
        return cut.otherwise(t["text"])

    def prefix(start: Column) -> Column:
        cut = None
        for word in V.MATCH_PREFIXES:
            then = F.substr(start, F.lit(len(word) + 1))
            cut = F.when(start.startswith(word), then) if cut is None else cut.when(start.startswith(word), then)
        return squeeze(cut.otherwise(start))

    # Bound once each: reused as plain expressions they would be copied into every branch.
    ended = let(text, lambda t: F.struct(t.alias("text"), F.regexp_replace(t, r"\s+$", "").alias("end")))
    return let(F.regexp_replace(let(ended, suffix), r"^\s+", ""), prefix)


def match_name_ascii(normalised: Column) -> Column:
    """A normalised name without accents and all that is not ASCII."""
    return squeeze(F.regexp_replace(strip_script(normalised), r"[^a-z0-9\s]", ""))


def match_address(addr: Column) -> Column:
    text = F.replace(F.lower(_composed(F.coalesce(addr, F.lit("")))), F.lit("&"), F.lit(" and "))
    return squeeze(F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", " "))


def expand_address(addr: Column, country: Column) -> Column:
    land = F.lower(F.coalesce(country, F.lit("")))

    def one(t: Column) -> Column:
        key = F.regexp_replace(F.lower(t), r"\.+$", "")
        street = F.when(land.isin("us", "france", ""), lookup(V.MATCH_STREETS, key))
        return F.coalesce(street, F.when(land.isin("india", ""), lookup(V.MATCH_INDIA, key)), t)

    return F.array_join(F.transform(tokens(addr, lower=False), one), " ")


def numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0)))


def postal_code(addr: Column, country: Column) -> Column:
    addr, land = F.coalesce(addr, F.lit("")), F.lower(F.coalesce(country, F.lit("")))
    before = r"(?<![\p{L}\p{N}_])"
    five, six = F.regexp_extract(addr, rf"{before}(\p{{Nd}}{{5}}){_EDGE}", 1), F.regexp_extract(addr, rf"{before}(\p{{Nd}}{{6}}){_EDGE}", 1)
    return F.when(land.isin("us", "france"), five).when(land == "india", six).when(five != "", five).otherwise(six)


def tokens(text: Column, lower: bool = True) -> Column:
    return F.filter(F.split(F.lower(text) if lower else text, r"\s+"), lambda t: t != "")
