"""Matches of a regular expression with their places, by DataFrame functions alone.

Spark gives the matches and, by splitting at them, the gaps between; the running sum of both lengths is each match's place in code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP = 512


def let(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once; a plain reuse of an expression within a lambda is worked out at every element."""
    return F.get(F.transform(F.array(value), then), 0)


def running_sums(values: Column) -> Column:
    """The sums of an array's first 1, 2, ... values. Blocks of ``STEP`` keep the array copies short."""
    def sums(a: Column, first: Column) -> Column:
        return F.aggregate(a, F.struct(first.alias("s"), F.array().cast("array<bigint>").alias("out")), lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.array_append(acc["out"], acc["s"] + x).alias("out")))["out"]

    zero = F.lit(0).cast("bigint")
    total = lambda a: F.aggregate(a, zero, lambda s, x: s + x)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / STEP).cast("int")), lambda b: F.slice(values, b * STEP + 1, F.lit(STEP)))
    firsts = sums(F.transform(blocks, total), zero)
    long = F.flatten(F.zip_with(blocks, firsts, lambda b, upto: sums(b, upto - total(b))))
    return F.when(F.size(values) <= STEP, sums(values, zero)).otherwise(long)


def found(text: Column, pattern: str, guard: Column) -> tuple[Column, Column]:
    """The matches and the gaps around them, both empty where ``guard`` says that there can be none."""
    none = F.array().cast("array<string>")
    return F.when(guard, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none), F.when(guard, F.split(text, pattern, -1)).otherwise(none)


def located(matches: Column, gaps: Column) -> Column:
    """array<struct<start, end, hit>> of the matches; ends are exclusive, in code points."""
    lengths = F.transform(matches, lambda m, k: (F.length(F.get(gaps, k)) + F.length(m)).cast("bigint"))
    placed = F.zip_with(matches, let(lengths, running_sums), lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("hit")))
    return F.when(F.size(matches) > 0, placed).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,hit:string>>"))


def tagged(spans: Column, kind: str, rank: int) -> Column:
    """The spans as struct<start, rank, end, kind>, which sort by start and then by the kinds' order."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each run of overlapping spans (sorted) replaced by ``<KIND>`` of its first span."""
    merged = F.aggregate(
        spans,
        F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>"),
        lambda acc, s: F.when(
            F.coalesce(F.get(acc, F.size(acc) - 1)["end"] > s["start"], F.lit(False)),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.get(acc, F.size(acc) - 1)["start"].alias("start"), F.greatest(F.get(acc, F.size(acc) - 1)["end"], s["end"]).alias("end"), F.get(acc, F.size(acc) - 1)["kind"].alias("kind")))),
        ).otherwise(F.array_append(acc, F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))),
    )
    def fill(merged: Column) -> Column:
        before = lambda k: F.coalesce(F.get(merged, k - 1)["end"], F.lit(0).cast("bigint"))
        piece = lambda a, b: F.substr(text, (a + 1).cast("int"), (b - a).cast("int"))
        body = F.array_join(F.transform(merged, lambda s, k: F.concat(piece(before(k), s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))), "")
        return F.concat(body, piece(F.element_at(merged, -1)["end"], F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(let(merged, fill))
