"""Repeated passages by compressed FM-indexes over content shards.

Every window of ``WINDOW`` words belongs to the least of its ``ANCHOR``-word shingles' hashes; consecutive windows with the same least hash make a segment. Equal
windows have equal anchors, so only segments whose anchor occurs again can hold repeats, and the shard of an anchor sees all occurrences
of its windows. Equal segments (by anchor and a hash of their words) are merged before their words are fetched, with the earliest place of each. Anchors whose segments hold more than
a quarter of ``SHARD_WORDS`` go to no shard: their windows are grouped by a 128-bit hash of their own words, so that shards stay bounded whatever the anchors are.

A shard's text is indexed as an FM-index: its suffixes are sorted once by prefix doubling, and what stays is the Burrows-Wheeler transform over groups of ``STEP`` words (the group that stands
``STEP`` places before each suffix) as a bit-packed wavelet matrix with popcount ranks, and every ``RATE``-th suffix' place. The shard's segments then stream past the index in blocks of ``LANES`` windows:
each window is searched backward, a group at a time, while its interval holds more than one suffix. The words matched are the window's matching statistic; where it reaches ``WINDOW``, the
interval's places are read off by walking back to sampled ones, and all but the earliest are reported.

Defined cases: null and empty texts have no words and keep nothing; documents are ordered by id (null first), then by a hash of the text; rows that repeat an id and its text are one document and are cut alike; an
empty table gives no rows; other columns than doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import BROADCAST_ROWS, arrow, discard, lean, save, slices

WINDOW, ANCHOR, STEP = 20, 8, 4
SEGMENT_WINDOWS = 32
SHARD_WORDS = 200_000
RATE, LANES = 4, 65_536

_FACTORS = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(ANCHOR)]
_BASE = 0xD6E8FEB86659FD93
_ANCHORS = pa.schema([("anchor", pa.int64()), ("key", pa.int64()), ("did", pa.int64()), ("th", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("times", pa.int32())])
_WINDOWS = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("did", pa.int64()), ("th", pa.int64()), ("at", pa.int32()), ("anchor", pa.int64()), ("key", pa.int64()), ("k", pa.int32())])
_SEGMENTS = pa.schema([("anchor", pa.int64()), ("key", pa.int64()), ("did", pa.int64()), ("th", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("words", pa.binary())])
_DONE = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _signed(x: int) -> int:
    return x - (x >> 63 << 64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def segments(words: list[bytes]) -> tuple[np.ndarray, ...]:
    """A document's segments: anchors, hashes of their words, first windows, numbers of windows, and 2 where a segment may repeat a window of its own, else 1."""
    n = len(words) - WINDOW + 1
    if n < 1:
        return (np.empty(0, np.int64),) * 5
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    m = len(words) - ANCHOR + 1
    grams = least = _mix(sum(h[k : k + m] * _FACTORS[k] for k in range(ANCHOR)))
    width, span = 1, WINDOW - ANCHOR + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: n], least[span - width : span - width + n])
    new = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    size = np.diff(np.r_[new, n])
    # A window can only come again in its segment where the anchor stands twice in some window or the segment outruns one anchor.
    stands = np.zeros(n, np.uint8)
    for k in range(span):
        stands += grams[k : k + n] == least
    times = 1 + (np.logical_or.reduceat(stands > 1, new) | (size > span))
    if size.max() > SEGMENT_WINDOWS:
        parts = -(-size // SEGMENT_WINDOWS)
        first = np.repeat(np.cumsum(parts) - parts, parts)
        shift = (np.arange(parts.sum()) - first) * SEGMENT_WINDOWS
        times = np.repeat(times, parts)
        new, size = np.repeat(new, parts) + shift, np.minimum(np.repeat(size, parts) - shift, SEGMENT_WINDOWS)
    # The polynomial hash of each segment's words, from sums over the whole document.
    upto = np.r_[np.uint64(0), np.cumsum(_mix(h) * _powers(_BASE, len(h)), dtype=np.uint64)]
    key = (upto[new + size + WINDOW - 1] - upto[new]) * _powers(pow(_BASE, -1, 1 << 64), len(h))[new]
    return least[new].view(np.int64), _mix(key + size.astype(np.uint64)).view(np.int64), new, size, times


class WaveletMatrix:
    """Symbols 0..2^levels-1 as bit planes with popcount ranks."""

    def __init__(self, symbols: np.ndarray, levels: int) -> None:
        self.planes, self.counts, self.zeros, self.levels = [], [], [], levels
        n = len(symbols)
        for level in reversed(range(levels)):
            bits = ((symbols >> level) & 1).astype(np.uint8)
            packed = np.packbits(np.r_[bits, np.zeros(-n % 64 + 64, np.uint8)], bitorder="little").view(np.uint64)
            self.planes.append(packed)
            self.counts.append(np.r_[0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]].astype(np.int32))
            ones = bits.astype(bool)
            self.zeros.append(n - int(np.count_nonzero(ones)))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def _ones(self, k: int, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[k][block] + np.bitwise_count(self.planes[k][block] & mask)

    def rank(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often ``symbol`` occurs before ``low`` and before ``high``."""
        both = np.concatenate([np.zeros(len(symbol), np.int64), low, high])
        thrice = np.concatenate([symbol, symbol, symbol])
        for k, level in enumerate(reversed(range(self.levels))):
            ones = self._ones(k, both)
            both = np.where((thrice >> level) & 1, self.zeros[k] + ones, both - ones)
        n = len(symbol)
        return both[n : 2 * n] - both[:n], both[2 * n :] - both[:n]

    def at(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at ``row`` and how often each occurs before its row."""
        symbol, both, n = np.zeros(len(row), np.int64), np.concatenate([np.zeros(len(row), np.int64), row]), len(row)
        for k in range(self.levels):
            own = both[n:]
            bit = (self.planes[k][own >> 6] >> (own & 63).astype(np.uint64)).astype(np.int64) & 1
            ones = self._ones(k, both)
            both = np.where(np.concatenate([bit, bit]), self.zeros[k] + ones, both - ones)
            symbol = symbol << 1 | bit
        return symbol, both[n:] - both[:n]


class FMIndex:
    """Of a text of int32 symbols in which every symbol below ``ends`` occurs once and ends a segment of less than 64 symbols; the last ``STEP`` symbols are such ends too."""

    def __init__(self, text: np.ndarray) -> None:
        n = len(text)
        rank, reach = text.astype(np.int64), 1
        while reach < 64:
            if reach == STEP:
                self.groups = rank.astype(np.int32)
            after = np.zeros(n, np.int64)
            after[: n - reach] = rank[reach:] + 1
            key = rank * (n + len(text) + 2) + after
            order = np.argsort(key)
            ranked = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.r_[False, ranked[1:] != ranked[:-1]])
            reach *= 2
        # The transform: the group STEP places before each suffix, in suffix order; groups are numbered in suffix order too.
        self.first = np.r_[0, np.cumsum(np.bincount(self.groups))].astype(np.int32)
        self.tree = WaveletMatrix(self.groups[order - STEP], max(1, int(self.groups.max()).bit_length()))
        # Of the places in a chain of steps every RATE-th one is kept, and those from which no step leads back.
        marked = (order // STEP % RATE == 0) | (order < STEP)
        self.marked = np.packbits(np.r_[marked.astype(np.uint8), np.zeros(-n % 64 + 64, np.uint8)], bitorder="little").view(np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.marked), dtype=np.int64)[:-1]].astype(np.int32)
        self.sample = order[marked].astype(np.int32)

    def search(self, at: np.ndarray, length: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Suffix intervals of the patterns of ``length`` (a multiple of ``STEP``) at text places ``at``, and how many words of each, from its end, occur twice or more."""
        low, high, matched = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        live = np.arange(len(at))
        for shift in range(length - STEP, -1, -STEP):
            symbol = self.groups[at[live] + shift]
            if shift == length - STEP:
                a, b = self.first[symbol].astype(np.int64), self.first[symbol + 1].astype(np.int64)
            else:
                a, b = self.tree.rank(symbol, low[live], high[live])
                a, b = a + self.first[symbol], b + self.first[symbol]
            low[live], high[live] = a, b
            live = live[b - a > 1]
            matched[live] += STEP
        return low, high, matched

    def locate(self, row: np.ndarray) -> np.ndarray:
        """The text places of suffixes, by steps back to sampled ones."""
        place, row = np.zeros(len(row), np.int64), row.astype(np.int64)
        live, steps = np.arange(len(row)), 0
        while len(live):
            own = row[live]
            bit = own & 63
            here = (self.marked[own >> 6] >> bit.astype(np.uint64) & np.uint64(1)).astype(bool)
            known, r = live[here], own[here]
            mask = (np.uint64(1) << bit[here].astype(np.uint64)) - np.uint64(1)
            place[known] = self.sample[self.before[r >> 6] + np.bitwise_count(self.marked[r >> 6] & mask)] + steps * STEP
            live = live[~here]
            symbol, rank = self.tree.at(row[live])
            row[live] = self.first[symbol] + rank
            steps += 1
        return place


def firsts(texts: list[bytes], counts: np.ndarray, places: np.ndarray) -> list[str]:
    """For each of a shard's distinct segments a digit per window: 1 if the segment's own earliest place is the window's first.

    ``counts``: windows per segment; ``places``: (n, 3) earliest places (id, hash, start).
    """
    words = [t.split(b" ") for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = len(words) + STEP
    number: dict[bytes, int] = {}
    flat = np.fromiter((number.setdefault(w, ends + len(number)) for seg in words for w in seg), np.int32, int(sizes.sum()))
    begins = np.cumsum(sizes + 1) - sizes - 1
    text = np.full(len(flat) + ends, -1, np.int32)
    text[np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))] = flat
    text[text < 0] = np.arange(ends)
    del words, number, flat
    index = FMIndex(text)
    own = np.repeat(np.arange(len(texts), dtype=np.int32), counts)
    offset = (np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
    at = begins[own] + offset
    # Places in corpus order, for every window.
    order = np.lexsort((places[own, 2] + offset, places[own, 1], places[own, 0]))
    prior = np.full(len(text), len(own), np.int32)
    prior[at[order]] = np.arange(len(own))
    result, lows, highs, who = np.ones(len(own), bool), [], [], []
    for block in range(0, len(at), LANES):
        low, high, matched = index.search(at[block : block + LANES])
        repeated = np.flatnonzero(matched >= WINDOW)
        lows.append(low[repeated]), highs.append(high[repeated]), who.append(repeated + block)
    low, high, repeated = np.concatenate(lows), np.concatenate(highs), np.concatenate(who)
    if len(repeated):
        low, which, back = np.unique(low, return_index=True, return_inverse=True)
        size = high[which] - low
        first = np.cumsum(size) - size
        rows = np.repeat(low - first, size) + np.arange(int(size.sum()))
        found = np.concatenate([prior[index.locate(rows[k : k + LANES])] for k in range(0, len(rows), LANES)])
        result[repeated] = prior[at[repeated]] == np.minimum.reduceat(found, first)[back]
    flags = (result.astype(np.uint8) + ord("0")).tobytes().decode()
    upto = np.cumsum(counts)
    return [flags[a:b] for a, b in zip((upto - counts).tolist(), upto.tolist(), strict=True)]


def _document(df: DataFrame) -> DataFrame:
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long"))
    return df.select(did.alias("did"), F.xxhash64("text").alias("th"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("raw"))


def anchors(docs: DataFrame) -> DataFrame:
    def run(batches):
        for dids, ths, raws in slices(batches, 256):
            parts = [segments(r.split()) for r in raws]
            n = [len(p[0]) for p in parts]
            anchor, key, start, size, times = (np.concatenate([p[k] for p in parts]) for k in range(5))
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(key), pa.array(np.repeat(np.array(dids, np.int64), n)), pa.array(np.repeat(np.array(ths, np.int64), n)), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(times.astype(np.int32))], schema=_ANCHORS)

    return lean(docs).mapInArrow(run, "anchor long, key long, did long, th long, start int, n int, times int")


def repeated_segments(docs: DataFrame) -> DataFrame:
    """anchor, key, did, th, start, n of the segments whose anchor occurs twice or more; saved."""
    found = save(anchors(docs))
    again = found.groupBy("anchor").agg(F.sum("times").alias("times")).where("times > 1").select("anchor")
    repeated = save(found.drop("times").join(again, "anchor", "left_semi"))
    discard(found)
    return repeated


def distinct_segments(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """Each distinct segment at its earliest place, with its words: anchor, key, did, th, start, n, words; saved. A document that is stored twice gives its segments twice."""
    earliest = repeated.groupBy("anchor", "key").agg(F.min(F.struct("did", "th", "start", "n")).alias("p"))
    chosen = earliest.groupBy("p.did", "p.th").agg(F.collect_list(F.struct("p.start", "p.n", "anchor", "key")).alias("parts"))

    def run(batches):
        def each():
            last = None
            for dids, ths, raws, parts in slices(batches, 64):
                for did, th, raw, own in zip(dids, ths, raws, parts, strict=True):
                    if last != (did, th):
                        words, last = raw.split(), (did, th)
                        for p in own:
                            yield p["anchor"], p["key"], did, th, p["start"], p["n"], b" ".join(words[p["start"] : p["start"] + p["n"] + WINDOW - 1])

        return arrow(each(), _SEGMENTS, width=lambda r: len(r[-1]))

    return save(docs.join(chosen, ["did", "th"]).mapInArrow(run, "anchor long, key long, did long, th long, start int, n int, words binary"))


def hot_anchors(distinct: DataFrame) -> DataFrame:
    """anchor of those whose distinct segments hold too many words for one shard; of W words in all, fewer than 4 W / SHARD_WORDS."""
    return distinct.groupBy("anchor").agg(F.sum(F.col("n") + WINDOW).alias("n")).where(F.col("n") > SHARD_WORDS // 4).select("anchor")


def window_firsts(hot: DataFrame) -> DataFrame:
    """What ``firsts`` finds, for segments of any number, by grouping windows in place of an index: anchor, key, did, th, start, own."""
    hot = save(hot.dropDuplicates(["anchor", "key"]))

    def run(batches):
        def each():
            for anchors_, keys, dids, ths, starts, ns, texts in slices(batches, 64):
                for anchor, key, did, th, start, n, text in zip(anchors_, keys, dids, ths, starts, ns, texts, strict=True):
                    words = text.split(b" ")
                    for k in range(n):
                        w = xxhash.xxh3_128_intdigest(b" ".join(words[k : k + WINDOW]))
                        yield _signed(w >> 64), _signed(w & (1 << 64) - 1), did, th, start + k, anchor, key, k

        return arrow(each(), _WINDOWS)

    windows = lean(hot.select("anchor", "key", "did", "th", "start", "n", "words")).mapInArrow(run, "w1 long, w2 long, did long, th long, at int, anchor long, key long, k int")
    earliest = windows.groupBy("w1", "w2").agg(F.min(F.struct("did", "th", "at", "anchor", "key", "k")).alias("f"))
    own = earliest.groupBy("f.anchor", "f.key").agg(F.collect_list("f.k").alias("own"))
    flags = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.when(F.array_contains("own", k), "1").otherwise("0"))
    return hot.drop("words").join(own, ["anchor", "key"], "left").select("anchor", "key", "did", "th", "start", F.array_join(flags, "").alias("own"))


def cut(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """``docs`` (doc_id, text) without the words that an earlier window covers: doc_id, n_words, n_removed, kept_sha256, kept."""
    docs = _document(docs)
    repeated = repeated_segments(docs)
    distinct = distinct_segments(docs, repeated)
    total = distinct.agg(F.sum(F.col("n") + WINDOW).alias("n")).first()["n"] or 0
    shards = max(1, -(-total // SHARD_WORDS))

    def shard(t: pa.Table) -> pa.Table:
        seen = np.stack([t.column(c).to_numpy() for c in ("anchor", "key")], 1)
        t = t.take(pa.array(np.sort(np.unique(seen, axis=0, return_index=True)[1])))
        places = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("did", "th", "start")], 1)
        flags = firsts(t.column("words").to_pylist(), t.column("n").to_numpy().astype(np.int64), places)
        return t.select(["anchor", "key", "did", "th", "start"]).append_column("own", pa.array(flags, pa.string()))

    hot = save(hot_anchors(distinct))
    n_hot = hot.count()
    hot = F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot
    cold = distinct.join(hot, "anchor", "left_anti") if n_hot else distinct
    judged = cold.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).groupBy("shard").applyInArrow(shard, "anchor long, key long, did long, th long, start int, own string")
    if n_hot:
        judged = judged.unionByName(window_firsts(distinct.join(hot, "anchor", "left_semi")))
    verdicts = save(judged.select("anchor", "key", F.struct("did", "th", "start").alias("place"), "own"))
    discard(distinct)
    seen = repeated.join(verdicts, ["anchor", "key"])
    seen = seen.select("did", "th", "start", "n", F.when(F.struct("did", "th", "start") == F.col("place"), F.col("own")).alias("own"))
    by_document = save(seen.groupBy("did", "th").agg(F.collect_set(F.struct("start", "n", "own")).alias("parts")))
    discard(repeated)
    discard(verdicts)

    def finish(batches):
        def each():
            for dids, raws, parts in slices(batches, 64):
                for did, raw, own in zip(dids, raws, parts, strict=True):
                    words = raw.split()
                    gone = np.zeros(len(words) + 1, np.int64)
                    for p in own or ():
                        a, n = p["start"], p["n"]
                        if p["own"] is None:
                            gone[a] += 1
                            gone[a + n + WINDOW - 1] -= 1
                        else:
                            for k in np.flatnonzero(np.frombuffer(p["own"].encode(), np.uint8) == ord("0")).tolist():
                                gone[a + k] += 1
                                gone[a + k + WINDOW] -= 1
                    covered = np.cumsum(gone[:-1]) > 0
                    kept = b" ".join(words if not covered.any() else [w for w, c in zip(words, covered.tolist(), strict=True) if not c])
                    yield None if did == -(1 << 63) else did, len(words), int(covered.sum()), hashlib.sha256(kept).hexdigest(), kept if keep_text else None

        return arrow(each(), _DONE, width=lambda r: len(r[-1] or b""))

    done = docs.join(by_document, ["did", "th"], "left").select("did", "raw", "parts")
    return done.mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary")


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return cut(docs, keep_text=False).drop("kept")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(len(w) - 19)) AS pos, unnest(list_transform(range(len(w) - 19), lambda i: array_to_string(w[i + 1 : i + 20], ' '))) AS t FROM d WHERE len(w) >= 20),
again AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY t ORDER BY doc_id, pos) AS r FROM win) WHERE r > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(pos, pos + 20)) AS p FROM again) GROUP BY doc_id),
words AS (SELECT doc_id, unnest(range(len(w))) AS p, unnest(w) AS word FROM d),
gonep AS (SELECT doc_id, unnest(ps) AS p FROM gone),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gonep USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
