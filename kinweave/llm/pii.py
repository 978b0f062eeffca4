"""Personal data by candidate gradient boosting, in DataFrame functions alone.

Generators with high recall propose spans, which may overlap: the four base kinds, chains of digits with blanks (``number``) and without (``group``), and addresses that are spelt out (``contact``).
Base spans that pass their checks stay. Every other proposal is described by its format and the context on both sides, scored by boosted trees and
passes if its calibrated probability reaches its kind's threshold. Where proposals that pass overlap, the most probable one wins (then the first, then the kinds' order); base spans win over all.

The trees are fitted on ``sentences(TRAINING)``, a bounded set of labelled sentences, and calibrated on ``sentences(HELD)``, whose words and formats are others; in both many a proposal stands
without any word that the features know, and some stand after a misleading one. The features come from the same DataFrame code as everywhere; the trees run as one SQL expression. Nothing is shuffled.

Defined cases: a null text is empty and has no spans; repeated rows give equal results; texts and proposals of any length are scanned to the end; columns of the input named ``base`` or ``spans`` are replaced, all
others kept; an empty table gives no rows.
"""

from __future__ import annotations

import random
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.boosting import Boosted, threshold
from kinweave.llm.spans import found, listed, located, redact, tagged

#: Base patterns. Possessive repeats and look-behinds change no match; they keep long runs linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Proposals of high recall, of any length.
NUMBER = r"[+(]?[0-9][0-9 ()./-]{5,}[0-9]"
GROUP = r"[0-9]++(?:[-./][0-9]++)++|[0-9]{7,}+"
CONTACT = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)|\{at\}) ?[A-Za-z0-9-]++(?: ?(?:\.|\[dot\]|\(dot\)|\{dot\}) ?[A-Za-z0-9-]*[A-Za-z]{2})++"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

KINDS = ["email", "ip", "card", "phone", "number", "group", "contact"]
BEFORE, AFTER = 28, 16
#: Fixed words of the context features.
CALLS = r"(?i)\b(?:call|phone|tel|mobile|cell|fax|whatsapp|dial|text me|ring)\b"
OWNS = r"(?i)\b(?:ssn|social security|passport|card|visa|account|iban|licen[cs]e|national id|tax id)\b"
OTHER = r"(?i)(?:\b(?:version|order|isbn|issn|page|vol|figure|table|section|invoice|ticket|part|serial|build|year|pp|total|sum|row|id)\b|[#$€£v=]\s*$)"

UNITS = r"(?i)^\s*(?:%|€|\$|(?:kg|km|cm|mm|gb|mb|ms|eur|usd|euros?|dollars?|units?|pieces?|items?|copies|pages?|points|people|rows|bytes|times|years?)\b)"
INSIDE = r"[A-Za-z0-9_]"

FEATURES = ["digits", "size", "blanks", "seps", "groups", "plus", "paren", "dots", "slash", "lead", "last", "luhn", "calls", "owns", "other", "units", "inside", "quoted", "isdate", "spelt", "contact"]
PRECISION = 0.97


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    back = F.reverse(digits)
    value = lambda i: F.substr(back, i, F.lit(1)).cast("int")
    twice = lambda i: F.when(i % 2 == 0, F.when(value(i) > 4, 2 * value(i) - 9).otherwise(2 * value(i))).otherwise(value(i))
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + twice(i)) % 10 == 0


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _proposals(docs: DataFrame) -> DataFrame:
    """Adds the base spans (``c_<kind>``, checked) and the other proposals (``c_number``, ``c_contact``)."""
    text = F.col("body")
    digit = F.col("has_digit")
    ways = {
        "email": (EMAIL, F.contains(text, F.lit("@"))), "ip": (IP, digit & text.rlike(r"[0-9]\.[0-9]")), "card": (CARD, digit), "phone": (PHONE, digit & F.contains(text, F.lit("+"))),
        "number": (NUMBER, digit), "group": (GROUP, digit), "contact": (CONTACT, F.contains(text, F.lit("at)")) | F.contains(text, F.lit("at]")) | F.contains(text, F.lit("at}"))),
    }
    docs = docs.withColumn("has_digit", text.rlike("[0-9]"))
    parts = {}
    for kind, (pattern, guard) in ways.items():
        parts[f"m_{kind}"], parts[f"g_{kind}"] = found(text, pattern, guard)
    docs = docs.withColumns(parts)
    docs = docs.withColumns({f"c_{k}": located(F.col(f"m_{k}"), F.col(f"g_{k}")) for k in ways})
    count = lambda h: F.length(_digits(h))
    checks = {
        "ip": lambda s: s["hit"].rlike(rf"^{PART}(?:\.{PART}){{3}}$"),
        "card": lambda s: F.length(s["hit"]).between(12, 38) & count(s["hit"]).between(12, 19) & luhn(_digits(s["hit"])),
        "phone": lambda s: count(s["hit"]).between(9, 15),
    }
    docs = docs.withColumns({f"c_{k}": F.filter(f"c_{k}", check) for k, check in checks.items()})
    base = F.concat(*[tagged(F.col(f"c_{k}"), k, r) for r, k in enumerate(KINDS[:4])])
    docs = docs.withColumn("base", F.array_sort(base)).drop(*parts, "has_digit")
    # Base spans are certain: what overlaps one has lost already.
    free = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return docs.withColumns({f"c_{k}": F.filter(f"c_{k}", free) for k in KINDS[4:]})


def _features(s: Column, text: Column, contact: bool) -> Column:
    hit, digits = s["hit"], _digits(s["hit"])
    before = F.substr(text, F.greatest(s["start"] - BEFORE + 1, F.lit(1)).cast("int"), F.least(s["start"], F.lit(BEFORE)).cast("int"))
    after = F.substr(text, (s["end"] + 1).cast("int"), F.lit(AFTER))
    flag = lambda c: c.cast("double")
    count = lambda sign: F.length(hit) - F.length(F.replace(hit, F.lit(sign), F.lit("")))
    made = {
        "digits": F.length(digits), "size": F.length(hit), "blanks": count(" "), "seps": F.length(F.regexp_replace(hit, "[0-9]", "")), "groups": F.size(F.split(hit, "[^0-9]+")),
        "plus": flag(F.startswith(hit, F.lit("+"))), "paren": flag(F.contains(hit, F.lit("("))), "dots": count("."),
        "slash": flag(F.contains(hit, F.lit("/"))), "lead": F.length(F.regexp_extract(hit, "[0-9]+", 0)), "last": F.length(F.regexp_extract(hit, "[0-9]+$", 0)),
        "luhn": flag(F.length(digits).between(12, 19) & luhn(digits)), "calls": flag(before.rlike(CALLS)), "owns": flag(before.rlike(OWNS)), "other": flag(before.rlike(OTHER)),
        "units": flag(after.rlike(UNITS)), "inside": flag(before.rlike(INSIDE + "$") | after.rlike("^" + INSIDE)), "quoted": flag(before.rlike("[\"'=/&?:#-]$")),
        "isdate": flag(hit.rlike(r"^(?:(?:19|20)[0-9]{2}[-./ ][01]?[0-9][-./ ][0-3]?[0-9]|[0-3]?[0-9][-./ ][0-3]?[0-9][-./ ](?:19|20)[0-9]{2})")), "spelt": flag(hit.rlike(r"[\[({]dot[\])}]|\.[A-Za-z]")), "contact": F.lit(float(contact)),
    }
    return F.struct(s["start"].alias("start"), s["end"].alias("end"), *[v.cast("double").alias(k) for k, v in made.items()])


def _described(docs: DataFrame) -> DataFrame:
    docs = _proposals(docs)
    of = lambda contact: lambda s: _features(s, F.col("body"), contact)
    return docs.withColumns({f"f_{k}": F.transform(f"c_{k}", of(k == "contact")) for k in KINDS[4:]})


#: Words of the two sets of sentences, none in both: leads to personal numbers (half of them known to the features), leads to others, fillers.
TRAINING = {
    "calling": ["call me at", "phone:", "my mobile is", "text me on", "reach me under", "my number:", "answering machine", "at home"], "owning": ["my ssn is", "passport", "account", "her papers say", "holder", "member no"],
    "others": ["version", "order", "page", "ticket", "total", "=", "lot", "score", "article", "in"], "units": ["units", "km", "points", "miles", "steps", "eggs"],
    "words": "the of and house water along green under market every later story which found small river".split(), "hosts": ["mail", "example", "office"], "ends": ["com", "org"],
}
HELD = {
    "calling": ["dial", "tel", "fax", "ring us on", "contact us:", "you get me with", "after six", "hotline"], "owning": ["visa card", "tax id", "national id", "document", "registered as", "policy holder"],
    "others": ["isbn", "invoice", "serial", "build", "$", "#", "batch", "figure", "model", "since"], "units": ["pages", "kg", "rows", "degrees", "metres", "votes"],
    "words": "for with from night paper bridge large again over winter letter since field north people early".split(), "hosts": ["post", "firm", "home"], "ends": ["net", "info"],
}


def sentences(words: dict[str, list[str]], n: int = 2400, seed: int = 11) -> list[tuple[int, str]]:
    """Labelled sentences (1: personal) with one proposal each: formats that are personal with or without a lead, formats that depend on it, and formats that never are."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    any_of = lambda key: rng.choice(words[key])
    two = lambda: f"{rng.randint(1, 28):02d}"
    clear = [lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"({d(4)}) {d(3)} {d(3)}", lambda: f"0{d(2)} {d(4)} {d(4)}", lambda: f"0{d(3)} {d(3)} {d(3)}"]
    unclear = [lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"{d(3)} {d(3)} {d(4)}", lambda: d(10), lambda: d(9), lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: f"{d(4)} {d(4)} {d(4)} {d(4)}", lambda: d(16), lambda: f"{d(2)} {d(2)} {d(2)} {d(2)} {d(2)}"]
    never = [
        lambda: f"{rng.randint(1900, 2030)}-{two()}-{two()}", lambda: f"{two()}/{two()}/{rng.randint(1900, 2030)}", lambda: f"{rng.randint(1, 9)}.{d(2)}.{d(4)}", lambda: f"{rng.randint(1000, 2030)} - {rng.randint(1000, 2030)}",
        lambda: f"{d(2)}.{d(3)}.{d(3)}", lambda: d(7), lambda: d(rng.randint(17, 24)), lambda: f"{d(3)}-{d(1)}-{d(5)}-{d(3)}-{d(1)}", lambda: f"{d(3)} {d(3)} {d(3)} {d(3)} {d(3)} {d(3)}",
    ]
    hidden = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 4))) + d(rng.randint(7, 12)) + rng.choice("abcdef")
    rows = []
    for _ in range(n):
        lead, tail = " ".join(any_of("words") for _ in range(4)), " ".join(any_of("words") for _ in range(3))
        way = rng.random()
        if way < 0.12:
            label, text = 1, rng.choice(clear)()
        elif way < 0.34:
            label, text = 1, f"{any_of('calling')} {rng.choice(clear + unclear[:4])()}"
        elif way < 0.46:
            label, text = 1, f"{any_of('owning')} {rng.choice(unclear[4:8])()}"
        elif way < 0.56:
            at, dot = rng.choice([(" [at] ", " [dot] "), ("(at)", "(dot)"), ("[at]", "."), (" {at} ", " {dot} ")])
            own = rng.choice([any_of("words"), f"{any_of('words')}.{any_of('words')}", f"{any_of('words')}{d(2)}", rng.choice("abcdefgh")])
            label, text = 1, f"{own}{at}{rng.choice([any_of('hosts'), any_of('words')[:2]])}{dot}{any_of('ends')}"
        elif way < 0.59:
            at = rng.choice(["[at]", "(at)"])
            label, text = 0, f"{any_of('words')} {at} {any_of('words')}. {any_of('words')}"
        elif way < 0.72:
            label, text = 0, f"{any_of('others')} {rng.choice(never + unclear)()}"
        elif way < 0.78:
            label, text = 0, f"{rng.choice(never + unclear[3:5])()} {any_of('units')}"
        elif way < 0.84:
            label, text = 0, f"{any_of('calling')} {rng.choice(never[:5])()}"
        elif way < 0.92:
            label, text = 0, hidden()
        else:
            label, text = 0, rng.choice(never)()
        rows.append((label, f"{lead} {text} {tail}"))
    return rows


@cache
def _fitted(rows: tuple, held: tuple) -> tuple[str, dict[str, float]]:
    table = lambda r: (np.array([x[1:] for x in r], float), np.array([x[0] for x in r], float))
    (x, y), (u, v) = table(rows), table(held)
    model = Boosted().fit(x, y).calibrate(u, v)
    p, contact = model.predict(u), u[:, FEATURES.index("contact")] > 0
    limits = {k: threshold(p[m], v[m], PRECISION) for k, m in (("number", ~contact), ("contact", contact))}
    return model.sql([f"c.{f}" for f in FEATURES]), limits | {"group": limits["number"]}


_MODELS: dict[str, tuple[str, dict[str, float]]] = {}


def fitted(spark: SparkSession) -> tuple[str, dict[str, float]]:
    """The trees as SQL over a proposal ``c`` and the thresholds by kind."""
    if "default" not in _MODELS:
        rows = [(0, y, t) for y, t in sentences(TRAINING)] + [(1, y, t) for y, t in sentences(HELD, seed=12)]
        docs = spark.createDataFrame(rows, "held int, y int, body string").coalesce(1)
        # A sentence's label is that of its longest proposal; what is only a part of it teaches nothing.
        own = F.array_sort(F.concat(*[F.transform(f"f_{k}", lambda f: F.struct((f["start"] - f["end"]).alias("size"), f.alias("f"))) for k in KINDS[4:]]))
        seen = _described(docs).select("held", "y", F.get(own, 0)["f"].alias("f")).where("f is not null").select("held", "y", *[f"f.{k}" for k in FEATURES])
        found = sorted(tuple(r) for r in seen.collect())
        _MODELS["default"] = _fitted(*[tuple(r[1:] for r in found if r[0] == k) for k in (0, 1)])
    return _MODELS["default"]


def find_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with column ``body`` (text, not null); adds ``base`` and ``spans``: sorted arrays of struct<start, rank, end, kind>."""
    sql, limits = fitted(docs.sparkSession)
    own = [c for c in docs.columns if c not in ("base", "spans")]
    docs = _described(docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col("body")))
    scored = {}
    for rank, kind in enumerate(KINDS[4:], 4):
        passed = F.expr(f"filter(transform(f_{kind}, c -> struct(c.start AS start, {rank} AS rank, c.end AS end, '{kind}' AS kind, {sql} AS p)), c -> c.p >= {limits[kind]}D)")
        scored[f"s_{kind}"] = F.when(F.size(f"f_{kind}") > 0, passed)
    docs = docs.withColumns(scored)
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,p:double>>")
    docs = docs.withColumn("passed", F.concat(*[F.coalesce(F.col(k), none) for k in scored]))
    better = lambda a, b: (a["p"] > b["p"]) | ((a["p"] == b["p"]) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["rank"] < b["rank"]))))
    beaten = lambda s: F.exists("passed", lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]) & better(o, s))
    won = F.transform(F.filter("passed", lambda s: ~beaten(s)), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return docs.select(*[F.col("row")[c].alias(c) for c in own], "base", F.array_sort(F.concat("base", won)).alias("spans"))


def redact_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with all spans in ``text`` replaced by their kinds; null texts stay null."""
    columns = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"))
    done = find_pii(held)
    new = F.when(F.col("doc")[text].isNotNull(), redact(F.col("body"), F.col("spans")))
    return done.select(*[(new if c == text else F.col("doc")[c]).alias(c) for c in columns])


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    done = find_pii(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return done.select("doc_id", *[count(k) for k in KINDS[:4]], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
