"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions alone.

Items become windows of ``WINDOW`` words (shorter items one window), windows become shingles of ``SHINGLE`` words. Documents are read once: of their shingles only those that
the benchmark has are kept, with their places. Shingles are ordered by rarity in the corpus; to hold a whole window a document must hold
its rarest shingle, so that one (a prefix of length one) is joined. Positional and length bounds fix where the window would have to begin and whether it fits,
and the shingles that tile the window are then looked up at their exact places, by 64-bit hashes. The few documents that pass are cut into words once more, and each claimed window is compared with them word by word.

The benchmark's shingles are broadcast up to ``HASH_ROWS``; beyond that the join with the corpus' shingles is shuffled.

Defined cases: null and empty texts have no words; items without words are skipped; equal windows of several items count for each of them; repeated rows of a document get equal results; documents
that share an id but not the text are kept apart; of equally rare shingles the one with the least hash, then place, is the prefix; an empty benchmark hits nothing; an empty table gives no rows;
other columns than doc_id, item_id and text, whatever their names, are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.llm.common import save, small
from kinweave.llm.spans import let

WINDOW, SHINGLE = 10, 5
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Stands for "the document itself" among the shingles' hashes.
SELF = 0
#: Distinct shingles of the benchmark that are still broadcast, as single longs (some 64 bytes each in a hash table, 64 MB at most).
HASH_ROWS = 1_000_000


def words(text: Column) -> Column:
    """Words of letters, digits and non-ASCII characters, with A-Z in lower case."""
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    cut = F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS, -1), "")
    return F.transform(cut, lambda w: F.when(F.length(w) == F.octet_length(w), F.lower(w)).otherwise(F.translate(w, upper, lower)))


def _keyed(docs: DataFrame) -> DataFrame:
    """did, th, text: the id (null as the least long) and a hash of the text tell documents apart."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("did"), F.xxhash64("text").alias("th"), F.col("text").alias("text"))


def _hashes(tokens: Column, k: int) -> Column:
    """Hashes of the k-word shingles, in order."""
    made = F.transform(F.sequence(F.lit(1), F.size(tokens) - k + 1), lambda i: F.xxhash64(F.slice(tokens, i, F.lit(k))))
    return F.when(F.size(tokens) >= k, made).otherwise(F.array().cast("array<bigint>"))


def item_windows(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Distinct windows with their shingles (window, size, k, at, h), and which items have them (window, item_id); both saved."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).withColumn("n", F.size("w")).where("n > 0")
    size = F.least("n", F.lit(window))
    cut = items.select("item_id", size.alias("size"), F.explode(F.transform(F.sequence(F.lit(1), F.col("n") - size + 1), lambda i: F.slice("w", i, size))).alias("w"))
    cut = save(cut.withColumn("window", F.array_join("w", " ")))
    owners = cut.select("window", "item_id").distinct()
    one = cut.select("window", "size", "w").dropDuplicates(["window"])
    k = F.least("size", F.lit(shingle))
    tokens = one.withColumn("k", k).select("window", "size", "k", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("size") - F.col("k") + 1), lambda i: F.xxhash64(F.slice("w", i, F.col("k"))))).alias("at", "h"))
    return save(tokens), save(owners)


def shingle_hits(docs: DataFrame, tokens: DataFrame) -> DataFrame:
    """The documents' shingles that the benchmark has (did, th, n_words, k, at, h) and a row with k = 0 for each document itself. One pass, whatever lengths the items' shingles have."""
    sizes = sorted((r[0] for r in tokens.select("k").distinct().collect()), reverse=True)
    worded = _keyed(docs).select("did", "th", words(F.col("text")).alias("w"))
    lists = F.concat(F.array(F.lit(SELF).cast("bigint")), *[_hashes(F.col("w"), k) for k in sizes])
    rows = worded.select("did", "th", F.size("w").alias("n_words"), F.posexplode(lists).alias("pos", "h"))
    wanted = tokens.select("h").union(docs.sparkSession.range(1).select(F.lit(SELF).cast("bigint").alias("h"))).distinct()
    found = rows.join(small(save(wanted), HASH_ROWS), "h", "left_semi")
    # The lists follow each other, so a place tells the length of its shingle.
    k, at, before = F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(1)
    for size in sizes:
        upto = before + F.greatest(F.col("n_words") - size + 1, F.lit(0))
        k, at, before = F.coalesce(k, F.when(F.col("pos") < upto, size)), F.coalesce(at, F.when(F.col("pos") < upto, F.col("pos") - before)), upto
    none = F.col("pos") == 0
    found = found.select("did", "th", "n_words", F.when(none, 0).otherwise(k).alias("k"), F.when(none, -1).otherwise(at).alias("at"), "h")
    return save(found)


def occurrences(hits: DataFrame, tokens: DataFrame) -> DataFrame:
    """Where whole windows lie in documents: did, th, begin, size, window."""
    inside = hits.where("k > 0")
    rarity = inside.groupBy("k", "h").agg(F.count(F.lit(1)).alias("df"))
    ordered = Window.partitionBy("window").orderBy("df", "h", "at")
    prefix = save(tokens.join(rarity, ["k", "h"]).withColumn("r", F.row_number().over(ordered)).where("r = 1").select("k", "h", "window", "size", F.col("at").alias("offset")))
    maybe = inside.join(small(prefix), ["k", "h"]).select("did", "th", "n_words", "k", "window", "size", (F.col("at") - F.col("offset")).alias("begin"))
    maybe = maybe.where("begin >= 0 and begin + size <= n_words").select("did", "th", "k", "window", "size", "begin").distinct()
    # The window's tiles: every k-th shingle and the last one.
    tiles = save(tokens.where("at % k = 0 or at = size - k").groupBy("window").agg(F.collect_list(F.struct("at", "h")).alias("tiles"), F.count(F.lit(1)).alias("n_tiles")))
    spread = maybe.join(small(tiles), "window").select("did", "th", "k", "window", "size", "begin", "n_tiles", F.explode("tiles").alias("t"))
    spread = spread.select("did", "th", "k", "window", "size", "begin", "n_tiles", (F.col("begin") + F.col("t.at")).alias("at"), F.col("t.h").alias("h"))
    there = spread.join(inside.select("did", "th", "k", "at", "h").distinct(), ["did", "th", "k", "at", "h"], "left_semi")
    return there.groupBy("did", "th", "window", "size", "begin", "n_tiles").agg(F.count(F.lit(1)).alias("n")).where("n = n_tiles").select("did", "th", "begin", "size", "window")


def verified(docs: DataFrame, there: DataFrame) -> DataFrame:
    """The ``occurrences`` (saved) whose words really are the window's: the documents they lie in are cut into words once more. Saved."""
    by_document = there.groupBy("did", "th").agg(F.collect_set(F.struct("begin", "size", "window")).alias("claims"))
    # Only the documents' keys are broadcast, if they are few; the claims, of any size, meet the few documents in a shuffle.
    keys = small(save(there.select("did", "th").distinct()))
    held = _keyed(docs).join(keys, ["did", "th"], "left_semi").join(by_document, ["did", "th"])
    # The words are bound once; as a column they would be copied into the lambda and cut anew for every claim.
    true = let(words(F.col("text")), lambda w: F.filter("claims", lambda c: F.array_join(F.slice(w, c["begin"] + 1, c["size"]), " ") == c["window"]))
    return save(held.select("did", "th", F.explode(true).alias("c")).select("did", "th", "c.begin", "c.size", "c.window").distinct())


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) against ``benchmark`` (item_id, text): did, th, n_words, n_hit, n_items, item_ids for every document row."""
    tokens, owners = item_windows(benchmark)
    hits = shingle_hits(docs, tokens)
    there = verified(docs, save(occurrences(hits, tokens)))
    order = Window.partitionBy("did", "th").orderBy("begin", "end")
    spans = there.select("did", "th", "begin", (F.col("begin") + F.col("size")).alias("end")).distinct()
    upto = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = spans.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest("begin", upto))).groupBy("did", "th").agg(F.sum("new").cast("long").alias("n_hit"))
    items = there.select("did", "th", "window").distinct().join(small(owners), "window").groupBy("did", "th").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    found = covered.join(items, ["did", "th"])
    every = hits.where("k = 0").select("did", "th", F.col("n_words").cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    return every.join(found, ["did", "th"], "left").select("did", "th", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"))


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
    return done.select(F.when(F.col("did") > -(1 << 63), F.col("did")).alias("doc_id"), "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
bs AS (SELECT item_id, w, least(len(w), 10) AS size FROM b WHERE len(w) > 0),
bw AS (SELECT item_id, size, unnest(list_transform(range(len(w) - size + 1), lambda i: array_to_string(w[i + 1 : i + size], ' '))) AS win FROM bs),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, unnest(range(len(w) - size + 1)) AS pos, unnest(list_transform(range(len(w) - size + 1), lambda i: array_to_string(w[i + 1 : i + size], ' '))) AS win FROM d, sizes WHERE len(w) >= size),
occ AS (SELECT DISTINCT doc_id, pos, dw.size AS size, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS p FROM (SELECT DISTINCT doc_id, pos, size FROM occ)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
