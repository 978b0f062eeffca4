"""SimHash near-duplicates by segment-popcount embedding.

A 64-bit fingerprint is cut into segments of two bits; the vector of the segments' bit counts is its embedding, and the Manhattan distance of
two vectors is a lower bound of their Hamming distance. The segments are dealt to ``blocks`` blocks. Vectors within Manhattan distance d agree in
all but d blocks at most, so such pairs share a grid cell (the counts of some ``blocks - d`` blocks). Within a cell pairs are
compared by total count, by Manhattan distance and then exactly; a cell gives a spanning forest of its links, never all its pairs. Cells over ``CELL``
fingerprints are dealt out as pairs of sub-blocks, so no task holds more than two of them.

``keep_one`` takes one text of each component under the exact links of ``jaccard``: sets of five-word shingles with a similarity of 0.8 or more.

Links join to components by alternating large-star and small-star rounds over distinct fingerprints.

Defined cases: a text without words (or null) has fingerprint zero, linked like any other; fewer words than a shingle make one shingle; repeated rows and equal texts share a
fingerprint and a component, whose id is the smallest non-null doc_id (null if none has one); an empty table gives no rows; other columns than doc_id and text, whatever their names, are not read
(``keep_one`` returns them as they are).
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations
from math import comb, prod

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import arrow, lean, save, slices

SHINGLE, DISTANCE, SEED = 4, 4, 42
SEGMENT_BITS, BLOCKS = 2, 7
CELL = 8192
NEAR_SHINGLE, SIMILARITY = 5, 0.8
#: Bits of one word for links of fingerprints of several words.
REACH = 6

def _signed(x: int) -> int:
    return x - (x >> 63 << 64)


_LOWER = bytes(range(256)).lower()
_PRINTS = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("fp", pa.int64())])
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_hashes(raw: bytes, shingle: int, seed: int) -> np.ndarray:
    """The shingles' hashes, repeats included."""
    words = raw.translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    n = len(words) - shingle + 1
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n < 2:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = ends[:n] - np.fromiter(map(len, words[:n]), np.int64, n) - 1
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The word whose bits are set where over half of the hashes have them; zero without hashes."""
    ones, raw = np.zeros(64, np.int64), hashes.astype(">u8")
    for at in range(0, len(raw), 4096):
        ones += np.unpackbits(raw[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(raw)).tobytes(), "big")


def fingerprint(raw: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned SimHash of a text: a bit is set where over half of the shingles' hashes have it."""
    return majority(shingle_hashes(raw, shingle, seed))


def node_of(words: np.ndarray) -> int:
    """One signed long for a fingerprint of one word or more."""
    return int(words.view(np.int64)[0]) if len(words) == 1 else _signed(xxhash.xxh64_intdigest(words.tobytes()))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, row, fp (the 64 bits as a signed long) of ``docs`` (doc_id, row, text); ``row`` is passed on as it is."""

    def run(batches):
        def each():
            for ids, rows, texts in slices(batches, 64):
                for d, r, t in zip(ids, rows, texts, strict=True):
                    yield d, r, _signed(fingerprint(t or b""))

        return arrow(each(), _PRINTS)

    return lean(docs).select(F.col("doc_id").cast("long"), F.col("row").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, "doc_id long, row long, fp long")


def embed(fp: np.ndarray, bits: int = SEGMENT_BITS) -> np.ndarray:
    """Bit counts of the 64 / bits segments, as uint8."""
    shifts = np.arange(0, 64, bits, dtype=np.uint64)
    return np.bitwise_count((fp[:, None] >> shifts) & np.uint64((1 << bits) - 1))


def cells(fp: np.ndarray, distance: int = DISTANCE, blocks: int = BLOCKS, bits: int = SEGMENT_BITS) -> np.ndarray:
    """The grid cells of each fingerprint: one 64-bit key for each choice of ``blocks - distance`` blocks."""
    vectors = embed(fp, bits).astype(np.uint64)
    of = np.arange(vectors.shape[1]) * blocks // vectors.shape[1]
    code = [np.zeros(len(fp), np.uint64) for _ in range(blocks)]
    for segment, block in enumerate(of):
        code[block] = code[block] * np.uint64(bits + 1) + vectors[:, segment]
    radix = [(bits + 1) ** int((of == b).sum()) for b in range(blocks)]
    span, keys = prod(sorted(radix)[distance:]), []
    for k, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        key = np.zeros(len(fp), np.uint64)
        for b in chosen:
            key = key * np.uint64(radix[b]) + code[b]
        keys.append(key + np.uint64(k * span))
    return np.stack(keys, 1)


class Forest:
    """Union-find over places 0..n-1."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


Accept = Callable[[np.ndarray, np.ndarray], np.ndarray]


def links(fp: np.ndarray, distance: int = DISTANCE, rows: int = 256, accept: Accept | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among fingerprints, as places; ``accept`` tells which pairs of places may link."""
    total = np.bitwise_count(fp)
    order = np.argsort(total, kind="stable")
    fp, total = fp[order], total[order]
    vectors = embed(fp, 8 if distance <= DISTANCE else 4)  # coarser segments: a bound too, and quicker
    high = np.searchsorted(total, total + distance, "right")
    forest, found = Forest(len(fp)), []
    for at in range(0, len(fp), rows):
        end = min(at + rows, len(fp))
        far = int(high[end - 1])
        # Manhattan distance first, then the exact distance of what it lets through.
        near = np.zeros((end - at, far - at), np.uint8)
        for s in range(vectors.shape[1]):
            a, b = vectors[at:end, s, None], vectors[None, at:far, s]
            near += np.maximum(a, b) - np.minimum(a, b)
        x, y = np.nonzero(near <= distance)
        keep = y > x
        x, y = x[keep] + at, y[keep] + at
        exact = np.bitwise_count(fp[x] ^ fp[y]) <= distance
        x, y = order[x[exact]], order[y[exact]]
        if accept:
            good = accept(x, y)
            x, y = x[good], y[good]
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            if forest.join(i, j):
                found.append((i, j))
    return found


def _close(keys: np.ndarray, fp: np.ndarray, distance: int, accept: Accept | None = None, most: int = 24):
    """Links, as places, within runs of equal keys (all sorted by key)."""
    edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    size = np.diff(edge)
    # Runs of a few: all at once, by the distance of their places; the bound first here too.
    few, vectors = np.repeat(size, size), embed(fp, 8)
    for shift in range(1, min(most, int(size.max(initial=1)))):
        same = (keys[shift:] == keys[:-shift]) & (few[shift:] <= most)
        i = np.flatnonzero(same)
        if not len(i):
            continue
        a, b = vectors[i], vectors[i + shift]
        i = i[(np.maximum(a, b) - np.minimum(a, b)).sum(1) <= distance]
        i = i[np.bitwise_count(fp[i] ^ fp[i + shift]) <= distance]
        i = i[accept(i, i + shift)] if accept else i
        yield from zip(i.tolist(), (i + shift).tolist(), strict=True)
    for k in np.flatnonzero(size > most):
        low, high = int(edge[k]), int(edge[k + 1])
        for i, j in links(fp[low:high], distance, accept=accept and (lambda x, y: accept(x + low, y + low))):  # noqa: B023
            yield low + i, low + j


def blocks_for(n: int, distance: int = DISTANCE) -> int:
    """How many blocks keep cells small for ``n`` distinct fingerprints: the least cost of copies made and pairs compared, were the bits even.

    A segment of two bits tells 1.415 bits (a share of 3/8 of all pairs agree); comparing a pair costs about a hundredth of making a copy.
    Two blocks at least make a cell: the counts of a single one are too common.
    """
    def cost(blocks: int) -> float:
        kept = blocks - distance
        agree = (3 / 8) ** (64 / SEGMENT_BITS * kept / blocks)
        return comb(blocks, distance) * (n + 0.01 * n * n * agree / 2)

    return min(range(max(BLOCKS, distance + 2), distance + 13), key=cost)


def near_links(prints: DataFrame, distance: int = DISTANCE, blocks: int | None = None, cell: int = CELL, limit: int | None = None) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (``prints``: a long for each of their words; saved) of which some word differs in at most ``distance`` bits, and all words together in at most ``limit``.

    The ends are the words themselves where fingerprints have one, else ``node_of`` them. The cells' copies are made anew where they are needed: that costs less than writing and reading them.
    """
    blocks, names = blocks or blocks_for(prints.count(), distance), prints.columns
    width, parts = comb(blocks, distance), len(names)
    schema = pa.schema([(c, pa.int64()) for c in ("cell", *names)])

    def stacked(b: pa.RecordBatch, at: int) -> np.ndarray:
        return np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(at, at + parts)], 1).view(np.uint64)

    def spread(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                own = stacked(b.slice(at, 4096), 0)
                for k in range(parts):
                    # At most 3^32 vectors and some thousand choices of blocks: far below 2^63.
                    keys = cells(own[:, k], distance, blocks) * np.uint64(parts) + np.uint64(k)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), *(pa.array(np.repeat(own[:, j].view(np.int64), width)) for j in range(parts))], schema=schema)

    placed = prints.mapInArrow(spread, ", ".join(f"{f.name} long" for f in schema))
    counted = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    hot = save(counted.where(F.col("n") > cell))

    def judged(part: np.ndarray, keys: np.ndarray, words: np.ndarray):
        def accept(i, j):
            return np.bitwise_count(words[i] ^ words[j]).sum(1) <= limit

        for i, j in _close(keys, words[np.arange(len(words)), part], distance, accept if limit is not None else None):
            yield node_of(words[i]), node_of(words[j])

    def close(batches):
        # Rows come sorted by key; a key's last rows wait for the next batch.
        def each():
            key, cell_of, words = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, parts), np.uint64)
            for b in batches:
                key = np.concatenate([key, b.column(0).to_numpy(zero_copy_only=False)])
                cell_of = np.concatenate([cell_of, b.column(1).to_numpy(zero_copy_only=False)])
                words = np.concatenate([words, stacked(b, 2)])
                cut = int(np.searchsorted(key, key[-1], "left")) if len(key) else 0
                if cut:
                    yield from judged(cell_of[:cut], key[:cut], words[:cut])
                    key, cell_of, words = key[cut:], cell_of[cut:], words[cut:]
            if len(key):
                yield from judged(cell_of, key, words)

        return arrow(each(), _EDGES)

    def closed(rows: DataFrame, key: str) -> DataFrame:
        return rows.repartition(key).sortWithinPartitions(key).select(key, F.pmod("cell", F.lit(parts)).cast("long").alias("part"), *names).mapInArrow(close, "a long, b long")

    n_hot = hot.count()
    if not n_hot:
        return closed(placed, "cell").distinct()
    # Hot cells: sub-blocks of about half a cell's size, each pair of sub-blocks by itself.
    hot = F.broadcast(hot) if n_hot <= 100_000 else hot
    plain = closed(placed.join(hot.select("cell"), "cell", "left_anti"), "cell")
    dealt = placed.join(hot, "cell").withColumn("k", F.ceil(F.col("n") * 2 / cell).cast("long")).withColumn("own", F.pmod(F.xxhash64(*names), F.col("k")))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))).withColumn("pair", F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")))
    return plain.union(closed(pairs.select("pair", "cell", *names), "pair")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the component's smallest node) for every node of ``edges`` (a, b), by large-star and small-star rounds up to their fixed point.

    The number of rounds grows with the logarithm of the longest chain; a round that changes nothing ends them.
    """
    e = save(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    before, now = None, ()
    while now != before:
        # Large star: each node's larger neighbours move to its smallest neighbour.
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        # Small star: each node and its smaller neighbours move to the smallest of them.
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        moved = large.join(least, "b")
        e = save(moved.select(F.col("m").alias("a"), F.col("a").alias("b")).where("a <> b").union(least.select(F.col("m").alias("a"), "b")).distinct())
        before, now = now, tuple(e.agg(F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    return e.select(F.col("b").alias("node"), F.col("a").alias("root"))


def rooted(prints: DataFrame, distance: int = DISTANCE, words: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """``prints`` (any columns and fp, with the fingerprint's ``words`` where they are several; saved) with ``root``, equal for all rows of a component."""
    distinct = save(prints.select("fp", *(words or [])).distinct())
    roots = save(components(near_links(distinct.select(*(words or ["fp"])), distance, limit=limit)))
    named = save(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")))
    return prints.join(named, "fp")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp, component_id for every row of ``docs`` (doc_id, text)."""
    own = rooted(save(fingerprints(docs.select("doc_id", F.lit(None).cast("long").alias("row"), "text"))), distance)
    # The smallest id by fingerprint first, so that a component of many copies meets as one row each.
    lows = own.groupBy("fp", "root").agg(F.min("doc_id").alias("low")).groupBy("root").agg(F.min("low").alias("component_id"))
    return own.join(lows, "root").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = NEAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each component of ``docs`` (doc_id, text and any others) under links between all texts whose sets of shingles reach the similarity: the least by doc_id (null last) and a hash of the whole row. Rows that repeat an id but not the text are judged apart."""
    from kinweave.llm import jaccard

    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.struct(*columns).alias("doc"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("did"), F.xxhash64(*columns).alias("row"), F.col("text").alias("text"))
    own = jaccard.rooted(keyed.select("did", "row", "text"), shingle, similarity)
    first = F.min(F.struct((F.col("did") == -(1 << 63)).alias("none"), "did", "row"))
    chosen = own.groupBy("fp", "root").agg(first.alias("m")).groupBy("root").agg(F.min("m").alias("m")).select("m.did", "m.row")
    # Equal rows share id and hash: one of them stays. The join has dealt them to one place already.
    kept = keyed.drop("text").join(chosen, ["did", "row"], "left_semi").dropDuplicates(["did", "row"])
    return kept.select(*[F.col("doc")[c].alias(c) for c in docs.columns])


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
