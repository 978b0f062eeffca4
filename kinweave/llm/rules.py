"""Quality rules by document and by host.

Counts are taken from every whole text; each rule's failures are summed by host; a host's failure rates are shrunk towards an empirical
beta prior (moments over the hosts, less what drawing a host's few documents adds to the variance), and hosts whose shrunk rate of some rule exceeds its limit are turned down with all their documents.

Defined cases: a null or empty text has no words and fails as too short; documents without a host get no host verdict; repeated rows count each; a rate equal to its limit passes; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import arrow, lean, save, slices, small

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30

#: Host rules: failing documents by SQL over the counts, and the shrunk rate above which a host is turned down.
HOST_RULES = {
    "short": ("n_words < 20", 0.5),
    "repeats": ("100 * n_repeat_words > 30 * n_words", 0.5),
    "symbols": ("n_symbols > n_words", 0.6),
    "dup_lines": ("n_dup_lines > 0 and 2 * n_dup_lines > n_lines", 0.6),
}

_COUNTS = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), *((k, pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"))])
_COUNTS_DDL = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
_CONTINUATION = bytes(range(0x80, 0xC0))
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(64)], np.uint64)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in windows of ``window`` words that occur twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(window):
        key += h[k : k + n] * _FACTORS[k]
    key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    twin = np.zeros(n, bool)
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twin[1:] |= same
    twin[:-1] |= same
    at = order[twin]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def counts(raw: bytes) -> tuple[int, int, int, int, int, int]:
    words = raw.split()
    joined = b"".join(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words), len(joined.translate(None, _CONTINUATION)), len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)), repeated_words(words), len(lines),
    )


def document_counts(docs: DataFrame) -> DataFrame:
    """``docs``: doc_id, host, text."""

    def run(batches):
        def each():
            for ids, hosts, texts in slices(batches, 64):
                for d, h, t in zip(ids, hosts, texts, strict=True):
                    yield d, h, *counts(t or b"")

        return arrow(each(), _COUNTS)

    return lean(docs).select(F.col("doc_id").cast("long"), F.col("host").cast("string"), F.col("text").cast("string").cast("binary")).mapInArrow(run, _COUNTS_DDL)


def host_verdicts(counted: DataFrame, rules: dict[str, tuple[str, float]] = HOST_RULES) -> DataFrame:
    """One row per host: documents, each rule's shrunk failure rate, and ``host_ok``. ``counted``: a saved table."""
    hosts = save(counted.where("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.expr(f"cast({sql} as long)")).alias(f"f_{k}") for k, (sql, _) in rules.items()]))
    # Moments over all hosts: a few sums come to the driver, whatever the number of hosts.
    sums = hosts.agg(F.count(F.lit(1)).alias("hosts"), *[x for k in rules for x in (F.avg(F.col(f"f_{k}") / F.col("n")).alias(f"m_{k}"), F.var_pop(F.col(f"f_{k}") / F.col("n")).alias(f"v_{k}"))], F.avg(1 / F.col("n")).alias("each")).first()
    rates = {}
    for k in rules:
        mean = min(max(sums[f"m_{k}"] or 0.0, 1e-4), 1 - 1e-4)
        # The rates' variance is that of the hosts' own rates and what drawing n documents adds: e = 1/n on average, v = p (1 - p) e + v' (1 - e).
        each, even = sums["each"] or 1.0, mean * (1 - mean)
        between = max(((sums[f"v_{k}"] or 0.0) - even * each) / max(1 - each, 1e-9), even * 1e-6)
        weight = max(even / between - 1, 0.0)
        rates[f"rate_{k}"] = (F.col(f"f_{k}") + mean * weight) / (F.col("n") + weight)
    judged = hosts.withColumns(rates)
    ok = F.lit(True)
    for k, (_, limit) in rules.items():
        ok = ok & (F.col(f"rate_{k}") <= limit)
    return judged.select("host", F.col("n").alias("host_docs"), *rates, ok.alias("host_ok"))


def apply_rules(docs: DataFrame) -> DataFrame:
    """Counts, ``base_failed``, the host's figures and ``kept`` for every document (doc_id, host, text)."""
    counted = save(document_counts(docs))
    verdicts = small(save(host_verdicts(counted)))
    judged = counted.join(verdicts, "host", "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & F.coalesce("host_ok", F.lit(True)))


def op3_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("source").alias("host"), "text")
    return apply_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    fails = ", ".join(f"CAST(({sql}) AS INT) AS x_{k}" for k, (sql, _) in HOST_RULES.items())
    sums = ", ".join(f"sum(x_{k}) AS f_{k}" for k in HOST_RULES)
    means = ", ".join(f"least(greatest(avg(f_{k} / n), 1e-4), 1 - 1e-4) AS m_{k}, var_pop(f_{k} / n) AS v_{k}" for k in HOST_RULES) + ", avg(1 / n) AS e"
    weights = ", ".join(f"m_{k}, greatest(m_{k} * (1 - m_{k}) / greatest((v_{k} - m_{k} * (1 - m_{k}) * e) / greatest(1 - e, 1e-9), m_{k} * (1 - m_{k}) * 1e-6) - 1, 0.0) AS w_{k}" for k in HOST_RULES)
    ok = " AND ".join(f"(f_{k} + m_{k} * w_{k}) / (n + w_{k}) <= {limit}" for k, (_, limit) in HOST_RULES.items())
    return rf"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(len(w) - 7)) AS pos, unnest(list_transform(range(len(w) - 7), lambda i: array_to_string(w[i + 1 : i + 8], ' '))) AS g FROM d WHERE len(w) >= 9),
twice AS (SELECT doc_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS k FROM win) WHERE k > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS reps FROM (SELECT doc_id, unnest(range(pos, pos + 8)) AS p FROM twice) GROUP BY doc_id),
lin AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS dups FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (SELECT d.doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
  coalesce(dups, 0) AS n_dup_lines, coalesce(reps, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lin USING (doc_id)),
h AS (SELECT host, count(*) AS n, {sums} FROM (SELECT host, {fails} FROM c WHERE host IS NOT NULL) GROUP BY host),
v AS (SELECT host, {ok} AS host_ok FROM h, (SELECT {weights} FROM (SELECT {means} FROM h)))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND coalesce(host_ok, true) AS kept FROM c LEFT JOIN v USING (host)
"""


OP3_SQL = _sql()
