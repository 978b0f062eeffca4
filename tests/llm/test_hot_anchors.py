import hashlib
import random

import pytest
from pyspark.sql import functions as F

from kinweave.llm import substrings


@pytest.fixture
def small_shards(monkeypatch):
    monkeypatch.setattr(substrings, "SHARD_WORDS", 2_000)


def documents():
    """One line of 12 words that 150 documents have between words of their own, and some windows that come again."""
    rng, line = random.Random(1), " ".join(f"line{k}" for k in range(12))
    own = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(15)) for _ in range(150)]
    return {k: f"{own[k]} {line} {own[k - 1] if k % 7 else own[3]}" for k in range(150)} | {200: f"{own[5]} {line} tail", 201: f"head {own[9]} {line} {own[8]}"}


def test_hot_anchor_goes_by_windows(spark, small_shards):
    docs = documents()
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    docs_ = substrings._document(frame)
    distinct = substrings.distinct_segments(docs_, substrings.repeated_segments(docs_))
    hot = {r.anchor for r in substrings.hot_anchors(distinct).collect()}
    words = {r.anchor: r.n for r in distinct.groupBy("anchor").agg(F.sum(F.col("n") + 20).alias("n")).collect()}
    assert hot == {a for a, n in words.items() if n > 500} and hot
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.cut(frame).collect()}
    assert got == brute_cut(docs) and sum(v[1] for v in got.values()) > 0


def brute_cut(docs):
    seen, out = set(), {}
    for i in sorted(docs):
        w, gone = docs[i].split(), set()
        for p in range(len(w) - 19):
            t = tuple(w[p : p + 20])
            gone |= set(range(p, p + 20)) if t in seen else set()
            seen.add(t)
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out
