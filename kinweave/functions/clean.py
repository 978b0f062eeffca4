"""The cleaner: raw names and addresses to comparable parts. All Catalyst expressions; text is transliterated first, so it is lower-case ASCII."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinweave import values as V
from kinweave.functions.block import let, squeeze
from kinweave.functions.fold import transliterate_script


def bound(value: Column, *steps) -> Column:
    """The steps one after the other. Each value is bound once, so that Catalyst has nothing to copy into every place that uses it."""
    for step in steps:
        value = let(value, step)
    return value


def lookup(table: dict[str, str], key: Column) -> Column:
    """The table's value for ``key``, else null."""
    return F.element_at(F.map_from_arrays(F.array(*map(F.lit, table)), F.array(*map(F.lit, table.values()))), key)


def _any_of(words, c: Column) -> Column:
    return c.isin(list(words))


def null_to_empty(c: Column, literals=V.NULLS) -> Column:
    return F.when(c.isNull() | c.isin(literals), F.lit("")).otherwise(c)


def safe_str(c: Column) -> Column:
    return F.when(c.isNull() | F.lower(F.trim(c)).isin(V.NULLS_FOLDED), F.lit("")).otherwise(F.trim(c))


def strip_nulls(c: Column) -> Column:
    return F.regexp_replace(c, V.NULL_WORD, "")


def strip_urls(c: Column) -> Column:
    return F.regexp_replace(c, V.URL, "")


def strip_phones(c: Column) -> Column:
    return F.regexp_replace(c, V.PHONE, "")


def strip_brackets(c: Column) -> Column:
    return F.translate(c, V.BRACKETS, "")


def strip_pipe(c: Column) -> Column:
    return F.regexp_replace(c, r"(?d)\|.*$", "")


def conjunctions(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit(" and ")), F.lit("+"), F.lit(" and "))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def _tail_run(flags: Column) -> Column:
    """How many of the last values are true."""
    stop = F.array_position(F.reverse(flags), False)
    return F.when(stop == 0, F.size(flags)).otherwise(stop - 1).cast("int")


def _head_run(flags: Column) -> Column:
    stop = F.array_position(flags, False)
    return F.when(stop == 0, F.size(flags)).otherwise(stop - 1).cast("int")


def _drop_last(a: Column, n: Column) -> Column:
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - n, F.lit(0)))


def legal_parts(tokens: Column) -> Column:
    """struct<core, suffix> of a name's tokens: core as an array; as suffix a tail phrase, the tail's suffixes (canonical, in order), then suffixes at the head."""
    none = F.array().cast("array<string>")

    def phrase(t: Column) -> Column:
        last = F.array_join(F.slice(t, F.greatest(F.size(t) - 1, F.lit(1)), F.lit(2)), " ")
        return F.struct(t.alias("all"), F.when(F.size(t) >= 2, lookup(V.LEGAL_PHRASES, last)).alias("phrase"))

    def first(s: Column) -> Column:
        found = s["phrase"].isNotNull()
        return F.struct(F.when(found, _drop_last(s["all"], F.lit(2))).otherwise(s["all"]).alias("first"), F.when(found, F.array(s["phrase"])).otherwise(none).alias("known"))

    def run(s: Column) -> Column:
        return F.struct(s["first"].alias("first"), s["known"].alias("known"), _tail_run(F.transform(s["first"], lambda t: _any_of(V.LEGAL_SUFFIXES, t))).alias("run"))

    def tail(s: Column) -> Column:
        popped = F.transform(F.slice(s["first"], F.greatest(F.size(s["first"]) - s["run"] + 1, F.lit(1)), s["run"]), lambda t: lookup(V.LEGAL_SUFFIXES, t))
        # From the right each new canonical goes to the front, so of repeats the rightmost stands.
        return F.struct(F.concat(F.array_except(F.reverse(F.array_distinct(F.reverse(popped))), s["known"]), s["known"]).alias("tail"), _drop_last(s["first"], s["run"]).alias("rest"))

    def lead(s: Column) -> Column:
        n = F.least(_head_run(F.transform(s["rest"], lambda t: _any_of(V.LEGAL_PREFIXES, t))), F.greatest(F.size(s["rest"]) - 1, F.lit(0)))
        return F.struct(s["tail"].alias("tail"), s["rest"].alias("rest"), n.alias("lead"))

    def parts(s: Column) -> Column:
        heads = F.array_distinct(F.transform(F.slice(s["rest"], F.lit(1), s["lead"]), lambda t: F.coalesce(lookup(V.LEGAL_SUFFIXES, t), t)))
        core = F.slice(s["rest"], s["lead"] + 1, F.greatest(F.size(s["rest"]) - s["lead"], F.lit(0)))
        return F.struct(core.alias("core"), F.array_join(F.concat(s["tail"], F.array_except(heads, s["tail"])), " ").alias("suffix"))

    return bound(tokens, phrase, first, run, tail, lead, parts)


def name_text(latin: Column) -> Column:
    """A transliterated name after all cleaning, before it is taken apart."""
    text = conjunctions(strip_brackets(strip_phones(strip_urls(strip_pipe(latin)))))
    return squeeze(F.regexp_replace(F.regexp_replace(text, V.HYPHEN_SUFFIX, " "), r"[^\w\s\-\.]", " "))


def with_clean_name(df, raw: str, spelt=transliterate_script):
    """``df`` with name_original, name_clean, name_translit, name_core, legal_suffix."""
    own = F.coalesce(F.col(raw), F.lit(""))
    df = df.withColumn("_trim", F.regexp_replace(own, r"^\s+|\s+$", "")).withColumn("name_translit", spelt(F.col("_trim")))

    def without_fillers(s: Column) -> Column:
        fill = _head_run(F.transform(s["tokens"], lambda t: _any_of(V.NAME_FILLERS, t)))
        return F.struct(s["text"].alias("text"), F.slice(s["tokens"], fill + 1, F.size(s["tokens"]) + 1).alias("tokens"))

    parts = bound(
        name_text(F.col("name_translit")), lambda t: F.struct(t.alias("text"), words(t).alias("tokens")), without_fillers,
        lambda s: F.struct(F.when(F.size(s["tokens"]) > 0, F.array_join(s["tokens"], " ")).otherwise(s["text"]).alias("clean"), legal_parts(s["tokens"]).alias("legal")),
    )
    df = df.withColumn("_name", parts)
    made = {
        "name_original": F.when(F.col("_trim") == "", own).otherwise(F.col("_trim")), "name_clean": F.col("_name.clean"),
        "name_core": F.regexp_replace(F.array_join("_name.legal.core", " "), r"^[\-\.\s]+|[\-\.\s]+$", ""), "legal_suffix": F.col("_name.legal.suffix"),
    }
    return df.withColumns(made).drop("_trim", "_name")


def expand_streets(c: Column) -> Column:
    def one(t: Column) -> Column:
        full = lookup(V.STREETS, F.lower(F.regexp_replace(t, ",+$", "")))
        return F.coalesce(F.concat(full, F.when(t.endswith(","), F.lit(",")).otherwise(F.lit(""))), t)

    return F.array_join(F.transform(words(c), one), " ")


def state_of(part: Column, country: Column) -> Column:
    """The canonical state or region of one part of an address, else null."""
    key, out = F.lower(F.trim(part)), F.lit(None).cast("string")
    for name, names in V.STATES.items():
        out = F.when(country == name, lookup(names, key)).otherwise(out)
    return out


def postal_split(text: Column, country: Column) -> Column:
    """struct<rest, code>: the text without its postal code, and the code. A number that opens the text is a house number where a code follows."""

    def without(pattern: str, prefix: bool) -> Column:
        at, hit = F.regexp_instr(text, F.lit(pattern)), F.regexp_extract(text, pattern, 0)
        middle = F.concat(F.regexp_extract(text, pattern, 1), F.lit(", ")) if prefix else F.lit("")
        return F.concat(F.substr(text, F.lit(1), at - 1), middle, F.substr(text, at + F.length(hit)))

    rules = [("india", V.PIN_INDIA_LATER, 1), ("india", V.PIN_INDIA, 1), ("us", V.ZIP_US, 2), ("france", V.POSTAL_FRANCE_LATER, 2), ("france", V.POSTAL_FRANCE, 2)]
    out = F.struct(text.alias("rest"), F.lit("").alias("code"))
    for land, pattern, group in reversed(rules):
        code = F.regexp_extract(text, pattern, group)
        valid = (code != "") & ~code.startswith("0") if land == "india" else code != ""
        out = F.when((country == land) & valid, F.struct(without(pattern, group == 2).alias("rest"), code.alias("code"))).otherwise(out)
    return out


def address_text(latin: Column) -> Column:
    """A transliterated address after all cleaning, before it is taken apart."""
    text = strip_brackets(strip_urls(strip_nulls(latin)))
    text = conjunctions(F.regexp_replace(F.regexp_replace(text, V.LANDMARK, ""), V.HOUSE, ""))
    return squeeze(expand_streets(F.regexp_replace(text, r"[^\w\s,\.\-/#]", " ")))


def address_parts(latin: Column, country: Column) -> Column:
    """struct<clean, city, state, code> of a transliterated address."""

    def cut(s: Column) -> Column:
        parts = lambda rest: F.filter(F.transform(F.split(rest, ","), lambda p: F.trim(p)), lambda p: p != "")
        return let(postal_split(s["text"], s["land"]), lambda p: F.struct(parts(p["rest"]).alias("parts"), p["code"].alias("code"), s["land"].alias("land")))

    def states(s: Column) -> Column:
        return F.struct(s["parts"].alias("parts"), s["code"].alias("code"), F.transform(s["parts"], lambda p: state_of(p, s["land"])).alias("states"))

    def place(s: Column) -> Column:
        first = F.array_position(F.transform(s["states"], lambda x: x.isNotNull()), True).cast("int")
        at = F.when(F.get(s["states"], F.size(s["states"]) - 1).isNotNull(), F.size(s["states"])).otherwise(first)
        return F.struct(s["parts"].alias("parts"), s["code"].alias("code"), s["states"].alias("states"), at.alias("at"))

    def apart(s: Column) -> Column:
        found = s["at"] > 0
        left = F.when(found, F.concat(F.slice(s["parts"], F.lit(1), s["at"] - 1), F.slice(s["parts"], s["at"] + 1, F.size(s["parts"])))).otherwise(s["parts"])
        return F.struct(left.alias("left"), s["code"].alias("code"), F.when(found, F.get(s["states"], s["at"] - 1)).otherwise(F.lit("")).alias("state"))

    def trimmed(s: Column) -> Column:
        same = F.when(s["state"] != "", _tail_run(F.transform(s["left"], lambda p: F.lower(p) == s["state"]))).otherwise(F.lit(0))
        return F.struct(_drop_last(s["left"], same).alias("left"), s["code"].alias("code"), s["state"].alias("state"))

    def unnumbered(s: Column) -> Column:
        left = _drop_last(s["left"], _tail_run(F.transform(s["left"], lambda p: p.rlike(r"^\d+$"))))
        return let(left, lambda a: F.struct(a.alias("left"), F.get(a, F.size(a) - 1).alias("city"), s["code"].alias("code"), s["state"].alias("state")))

    def finished(s: Column) -> Column:
        named = F.length(s["city"]) > 1
        kept = F.when(named, _drop_last(s["left"], F.lit(1))).otherwise(s["left"])
        tidy = F.regexp_replace(squeeze(F.array_join(kept, ", ")), r"^[,.\s]+|[,.\s]+$", "")
        return F.struct(tidy.alias("clean"), F.when(named, s["city"]).otherwise(F.lit("")).alias("city"), s["state"].alias("state"), s["code"].alias("code"))

    return bound(F.struct(address_text(latin).alias("text"), country.alias("land")), cut, states, place, apart, trimmed, unnumbered, finished)


def with_clean_address(df, raw: str, country: str, spelt=transliterate_script):
    """``df`` with addr_original, addr_clean, addr_translit, addr_city, addr_state, addr_postal_code."""
    own = F.coalesce(F.col(raw), F.lit(""))
    land = F.lower(F.trim(F.coalesce(F.col(country), F.lit(""))))
    trimmed = F.regexp_replace(own, r"^\s+|\s+$", "")
    df = df.withColumn("_own", trimmed).withColumn("addr_translit", spelt(F.col("_own")))
    df = df.withColumn("_addr", address_parts(F.col("addr_translit"), land))
    made = {"addr_original": F.when(F.col("_own") == "", own).otherwise(F.col("_own")), "addr_clean": F.col("_addr.clean"), "addr_city": F.col("_addr.city"), "addr_state": F.col("_addr.state"), "addr_postal_code": F.col("_addr.code")}
    return df.withColumns(made).drop("_own", "_addr")


CLEAN = "entity_id country business_name business_address name_original name_clean name_translit name_core legal_suffix addr_original addr_clean addr_translit addr_city addr_state addr_postal_code".split()


def preprocess(raw, spelt=transliterate_script):
    """Raw records (entity_id, business_name, business_address, country) to the 15 clean columns. Narrow: no shuffle."""
    text = ["business_name", "business_address"]
    df = raw.select("entity_id", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in text], F.coalesce("country", F.lit("")).alias("_raw"))
    df = with_clean_name(df, "business_name", spelt)
    df = with_clean_address(df, "business_address", "_raw", spelt)
    return df.select("entity_id", F.lower(F.trim("_raw")).alias("country"), *text, *CLEAN[4:])


def blocking_keys(clean):
    """entity_id, country, postal_code, city_state, name_first_token of clean records."""
    first = F.split(F.when(F.col("name_core") != "", F.col("name_core")).otherwise(F.col("name_clean")), " ")[0]
    both = (F.col("addr_city") != "") & (F.col("addr_state") != "")
    return clean.select("entity_id", "country", F.col("addr_postal_code").alias("postal_code"), F.when(both, F.concat_ws("_", "addr_city", "addr_state")).otherwise(F.lit("")).alias("city_state"), first.alias("name_first_token"))
