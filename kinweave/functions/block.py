"""The blocking normaliser and its tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinweave import values as V
from kinweave.functions.fold import fold_script, transliterate_script


def let(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), then), 0)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _plain(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", " "))


def norm(c: Column, folded=fold_script) -> Column:
    """Folded, lower-case words with single spaces."""
    return _plain(folded(F.coalesce(c, F.lit(""))))


def translit_norm(c: Column, spelt=transliterate_script) -> Column:
    return norm(spelt(F.coalesce(c, F.lit(""))))


def _kept(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda t: (F.length(t) >= V.MIN_TOKEN) & ~t.isin(V.NAME_STOPS) & ~t.rlike(r"^\p{Nd}+$"))


def name_tokens(name: Column, folded=fold_script, spelt=transliterate_script) -> Column:
    """Words of a name that can identify it, repeats kept; a differing transliteration adds its words, then each counts once."""
    def both(t: Column) -> Column:
        own, other = t["own"], t["other"]
        return F.when((other != "") & (other != own), F.array_distinct(F.concat(_kept(own), _kept(other)))).otherwise(_kept(own))

    return let(F.struct(norm(name, folded).alias("own"), translit_norm(name, spelt).alias("other")), both)


def prefixes(tokens: Column, length: int = V.PREFIX_LENGTH) -> Column:
    """The first characters of tokens that are long enough, repeats kept."""
    return F.transform(F.filter(tokens, lambda t: F.length(t) >= length), lambda t: F.substring(t, 1, length))


def addr_tokens(addr: Column) -> Column:
    return F.filter(F.split(norm(addr), " "), lambda t: (F.length(t) >= V.MIN_TOKEN) & ~t.isin(V.ADDR_STOPS))


def numeric_tokens(addr: Column) -> Column:
    return F.filter(F.split(norm(addr), " "), lambda t: (F.length(t) >= 2) & t.rlike(r"\p{Nd}"))


def grams_of(text: Column, n: int = 3) -> Column:
    """Character n-grams of normalised text without its spaces; a shorter text is its own gram."""
    def cut(chars: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(chars) - n)), lambda i: F.concat_ws("", *[F.get(chars, i + k) for k in range(n)]))
        return F.when(F.get(chars, 0) == "", F.array().cast("array<string>")).otherwise(grams)

    return let(F.split(F.replace(text, F.lit(" "), F.lit("")), ""), cut)


def char_grams(text: Column, n: int = 3) -> Column:
    return grams_of(norm(text), n)


def name_grams(name: Column) -> Column:
    """Distinct 3-grams of a name and of its transliteration where that differs."""
    none = F.array().cast("array<string>")
    both = lambda t: F.array_distinct(F.concat(grams_of(t["own"]), F.when(t["other"] != t["own"], grams_of(t["other"])).otherwise(none)))
    return let(F.struct(norm(name).alias("own"), translit_norm(name).alias("other")), both)


def source_of(entity_id: Column) -> Column:
    return F.substring(entity_id, 1, 2)


def counted(tokens: Column) -> Column:
    """array<struct<token, tf>> of a bag of tokens, without a shuffle."""
    return F.transform(F.array_distinct(tokens), lambda t: F.struct(t.alias("token"), F.size(F.filter(tokens, lambda x: x == t)).cast("bigint").alias("tf")))
