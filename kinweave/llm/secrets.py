"""Secrets by a battery of randomness tests, in DataFrame functions alone.

Base spans (assignments, access keys, long hexadecimal runs) always count. Other long tokens are proposals: each gets the smallest encoding that holds
its characters (``ENCODINGS``); a token that fits none, as with signs of both base64 variants, is not random. Against "drawn evenly from that alphabet" run a chi-squared test of the symbols' counts, a runs test about the
alphabet's middle and a lag-one serial correlation test. Tokens are short, so the chi-squared statistic (a count of equal pairs of symbols) is compared with a gamma
distribution that has its exact first three moments, and counts are taken at the middle of their step; the battery's p-value is that of the least of the three. Even draws give even p-values, language gives p-values near 0.

Which p-value is high enough follows from all proposals of the corpus, by bands of length: in each band the share of even draws is estimated from
the upper half of the p-values (Storey), and the threshold is the lowest bin above which the estimated share of false discoveries is at most ``FDR``. A band's counts are joined by ``WEIGHT`` tokens spread as in all
bands, and all bands by ``PRIOR`` tokens, half even draws, half language: the same rule at every size, in which a band's own tokens gain weight as they grow in number. Only bands x bins counts come to the driver.

Defined cases: null texts are empty; repeated rows give equal results (and each counts in its band); a p-value equal to the threshold passes; very long texts and tokens are read to their end; a corpus without proposals has base spans only;
columns of the input named ``base`` or ``spans`` are replaced, all others kept; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import save
from kinweave.llm.spans import found, let, listed, located, tagged

ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_PARTS = r"""(?i)^(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run that is too short fails wherever it is entered, so the least lengths can stand in the patterns.
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
#: Proposals: runs of token characters.
LONG = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"

KINDS = ["assign", "access", "hex", "random"]
#: Encodings from the smallest, with their alphabets.
ENCODINGS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
BANDS = [24, 32, 48, 64, 128]  # upper ends, exclusive; longer ones are the last band
BINS, FDR, WEIGHT, PRIOR = 20, 0.05, 40, 40


def _below(z: Column) -> Column:
    """The normal distribution's share below ``z``, by a logistic form that is right to 2e-4."""
    a = F.greatest(F.least(z, F.lit(12.0)), F.lit(-12.0))
    return 1 / (1 + F.exp(-(1.5976 * a + 0.07056 * a * a * a)))


def _two_sided(lower: Column) -> Column:
    return 2 * F.least(lower, 1 - lower)


def _alphabet(token: Column) -> Column:
    """The smallest alphabet that holds the token, null if there is none."""
    return F.coalesce(*[F.when(token.rlike(f"^[{a.replace('-', '')}{'-' if '-' in a else ''}]+$"), F.lit(a)) for a in ENCODINGS.values()])


def battery(token: Column) -> Column:
    """The battery's p-value of a token of 4 characters or more: near 0 where it is not drawn evenly from its encoding's alphabet, 0 where it has none."""
    start = F.lit(0.0)

    def placed(s: Column) -> Column:
        places = F.transform(F.split(s["token"], ""), lambda c: F.instr(s["alphabet"], c).cast("double"))
        squares = F.aggregate(F.transform(F.split(s["alphabet"], ""), lambda c: (F.length(s["token"]) - F.length(F.replace(s["token"], c, F.lit("")))).cast("double")), start, lambda a, o: a + o * o)
        return let(F.struct(places.alias("places"), squares.alias("squares"), F.length(s["token"]).cast("double").alias("n"), F.length(s["alphabet"]).cast("double").alias("k")), summed)

    def summed(s: Column) -> Column:
        high = F.transform(s["places"], lambda p: (p > s["k"] / 2).cast("int"))
        middle = F.aggregate(s["places"], start, lambda a, p: a + p) / s["n"]
        return let(F.struct(s["n"].alias("n"), s["k"].alias("k"), s["places"].alias("places"), s["squares"].alias("squares"), high.alias("high"), middle.alias("middle"), F.aggregate(high, start, lambda a, h: a + h).alias("ones")), measured)

    def measured(t: Column) -> Column:
        n, p = t["n"], 1 / t["k"]
        pairs = F.sequence(F.lit(1), n.cast("int") - 1)
        # Equal pairs of symbols: mean, deviation and skewness of their number, all exact.
        many, unlike = n * (n - 1) / 2, p * (1 - p)
        third = many * unlike * (1 - 2 * p) + n * (n - 1) * (n - 2) * p * unlike
        turns = F.aggregate(pairs, F.lit(1.0), lambda a, i: a + (F.get(t["high"], i) != F.get(t["high"], i - 1)).cast("double"))
        power = F.aggregate(t["places"], start, lambda a, x: a + (x - t["middle"]) * (x - t["middle"]))
        lagged = F.aggregate(pairs, start, lambda a, i: a + (F.get(t["places"], i) - t["middle"]) * (F.get(t["places"], i - 1) - t["middle"]))
        both = 2 * t["ones"] * (n - t["ones"])
        made = {"n": n, "equal": (t["squares"] - n) / 2, "mean": many * p, "deviation": F.sqrt(many * unlike), "skew": third / F.pow(many * unlike, F.lit(1.5)), "turns": turns, "both": both, "power": power, "lagged": lagged}
        return let(F.struct(*[v.alias(k) for k, v in made.items()]), tested)

    def tested(t: Column) -> Column:
        n = t["n"]

        def gamma(count: Column) -> Column:
            # Wilson and Hilferty's cube root of a gamma variate with this skewness.
            cube = F.cbrt(F.greatest(1 + (count - t["mean"]) / t["deviation"] * t["skew"] / 2, F.lit(0.0)))
            return _below((cube - 1 + t["skew"] * t["skew"] / 36) * 6 / t["skew"])

        chi = (gamma(t["equal"] + 0.5) + gamma(t["equal"] - 0.5)) / 2
        spread = F.sqrt(F.greatest(t["both"] * (t["both"] - n) / (n * n * (n - 1)), F.lit(1e-9)))
        runs = lambda r: _below((r - 1 - t["both"] / n) / spread)
        turned = F.when(t["both"] > 0, (runs(t["turns"] + 0.5) + runs(t["turns"] - 0.5)) / 2).otherwise(F.lit(0.0))
        serial = F.when(t["power"] > 0, _below((t["lagged"] / t["power"] + 1 / n) * n * F.sqrt(n - 1) / (n - 2))).otherwise(F.lit(0.0))
        return let(F.least(_two_sided(chi), _two_sided(turned), _two_sided(serial)), lambda least: 1 - (1 - least) * (1 - least) * (1 - least))

    return let(F.struct(token.alias("token"), _alphabet(token).alias("alphabet")), lambda s: F.when(s["alphabet"].isNull(), F.lit(0.0)).otherwise(placed(s)))


def _band(size: Column) -> Column:
    out = F.lit(len(BANDS))
    for k in reversed(range(len(BANDS))):
        out = F.when(size < BANDS[k], F.lit(k)).otherwise(out)
    return out


def describe(docs: DataFrame) -> DataFrame:
    """``docs`` (any columns and ``body``): ``row`` with all columns but the text, ``base`` spans and ``rest``, the other proposals with band and p-value."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("body", "base", "spans")]
    docs, text = docs.select(F.struct(F.lit(1).alias("_"), *others).alias("row"), F.col("body")), F.col("body")
    ways = {
        "assign": (ASSIGN, text.rlike("[:=]")), "access": (ACCESS, F.contains(text, F.lit("AKIA"))),
        "hex": (HEX, text.rlike("[0-9a-f]{24}")), "random": (LONG, text.rlike("[A-Za-z0-9+/_-]{20}")),
    }
    parts = {}
    for kind, (pattern, guard) in ways.items():
        parts[f"m_{kind}"], parts[f"g_{kind}"] = found(text, pattern, guard)
    docs = docs.withColumns(parts)
    docs = docs.withColumns({f"c_{k}": located(F.col(f"m_{k}"), F.col(f"g_{k}")) for k in ways})
    docs = docs.withColumn("c_assign", F.filter("c_assign", lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN_PARTS, 1)) >= 6))
    docs = docs.withColumn("base", F.array_sort(F.concat(*[tagged(F.col(f"c_{k}"), k, r) for r, k in enumerate(KINDS[:3])])))
    free = F.filter("c_random", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    docs = docs.withColumn("c_random", free)
    rest = F.transform("c_random", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), _band(F.length(s["hit"])).alias("band"), battery(F.rtrim(s["hit"], F.lit("="))).alias("p")))
    return docs.select("row", "base", rest.alias("rest"))


def limits_of(counts: list[list[int]]) -> list[float]:
    """The least p-value of a discovery in each band, from the proposals by band and bin."""
    every = [sum(c[k] for c in counts) + PRIOR / 2 / BINS + (PRIOR / 2 if k == 0 else 0) for k in range(BINS)]
    limits = []
    for own in counts:
        spread = [own[k] + WEIGHT * every[k] / sum(every) for k in range(BINS)]
        even = min(2 * sum(spread[BINS // 2 :]), sum(spread))
        false = lambda k: 1 - min(1.0, even * (1 - k / BINS) / sum(spread[k:]))  # noqa: B023, E731
        limits.append(next((k / BINS for k in range(1, BINS) if false(k) <= FDR), 1.01))
    return limits


def thresholds(described: DataFrame) -> list[float]:
    rows = described.select(F.explode("rest").alias("r")).groupBy(F.col("r.band").alias("band"), F.least(F.floor(F.col("r.p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).count().collect()
    found = {(r[0], r[1]): r[2] for r in rows}
    return limits_of([[found.get((b, k), 0) for k in range(BINS)] for b in range(len(BANDS) + 1)])


def find_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` (any columns and ``body``, not null) with ``base`` and all ``spans`` in place of the text."""
    described = save(describe(docs))
    limits = F.array(*map(F.lit, thresholds(described)))
    more = tagged(F.filter("rest", lambda s: s["p"] >= F.get(limits, s["band"])), KINDS[3], 3)
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("body", "base", "spans")]
    return described.select(*kept, "base", F.array_sort(F.concat("base", more)).alias("spans"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    done = find_secrets(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return done.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
