"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are cut into windows of ``WINDOW`` bytes; two gated recurrent layers read each window in either direction, every byte position gets language probabilities, and the
means over a document's letter positions are its probabilities. The network is trained here, in numpy, by backpropagation through time.

Training takes a bounded sample: per language (``MOST_LANGUAGES`` at most) the ``SAMPLE`` documents that come first by a hash of id and text, and of each at most ``SAMPLE_CHARS`` characters.
Labels, sources and ids are no inputs of a prediction.

Defined cases: null texts and texts without a letter are ``und`` with score 0; without labelled documents there is no model and everything is ``und``; documents with a null label are only predicted;
null ids are never trained on; repeated rows get the same result; equal probabilities go to the label that sorts first; very long texts are read to their end, a few megabytes at a time;
more than ``MOST_LANGUAGES`` labels are an error; other columns are not read, and ``detect_rows`` returns them as they are under whatever names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.common import arrow, lean, slices

WINDOW, HIDDEN, BATCH, STEPS, RATE = 64, 8, 128, 600, 0.01
SAMPLE, SAMPLE_CHARS = 500, 600
#: Labels that training accepts; more of them are an error, for each brings ``SAMPLE`` texts to the driver.
MOST_LANGUAGES = 400
#: A document in which no language has half of the letters' probability is in none of them.
SURE = 0.5
LANES, SLICE_BYTES = 2048, 2 << 20
PAD = 256

_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(np.int64)
_LETTER = np.array([chr(b).isalpha() or b >= 0x80 if b < 0x80 else True for b in range(256)] + [False])
_ASCII_LETTERS = bytes(b for b in range(128) if chr(b).isalpha())
_FOUND = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


@dataclass
class Model:
    """``table``: the bytes' inputs to the three gates, bias included, by direction (2, 3H, 257); ``gates`` (2, 3H, H); ``out`` (C, 2H) and ``bias`` (C, 1)."""

    languages: list[str]
    table: np.ndarray
    gates: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @property
    def weights(self) -> list[np.ndarray]:
        return [self.table, self.gates, self.out, self.bias]


def start(languages: list[str], hidden: int = HIDDEN, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    return Model(languages, draw(2, 3 * hidden, PAD + 1, scale=0.3), draw(2, 3 * hidden, hidden, scale=hidden**-0.5), draw(len(languages), 2 * hidden, scale=0.3), np.zeros((len(languages), 1), np.float32))


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(-2, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(-2, keepdims=True)
    return x


def _read(model: Model, x: np.ndarray, way: int, tape: list | None = None) -> np.ndarray:
    """States (T, H, B) after each byte of ``x`` (T, B) in direction ``way``; padding resets the state. ``tape`` gets what backpropagation needs."""
    steps, lanes = x.shape
    n_h = model.gates.shape[2]
    table, gates = model.table[way], model.gates[way]
    states, h = np.empty((steps, n_h, lanes), np.float32), np.zeros((n_h, lanes), np.float32)
    real = (x != PAD).astype(np.float32) if (x == PAD).any() else None
    g = np.empty((3 * n_h, lanes), np.float32)
    for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
        np.take(table, x[t], axis=1, out=g, mode="clip")
        u = gates @ h
        zr = g[: 2 * n_h]
        zr += u[: 2 * n_h]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        n = g[2 * n_h :]
        n += zr[n_h:] * u[2 * n_h :]
        np.tanh(n, out=n)
        new = np.subtract(n, h, out=states[t])
        new *= zr[:n_h]
        new += h
        if real is not None:
            new *= real[t]
        if tape is not None:
            tape.append((t, g.copy(), u[2 * n_h :].copy(), h))
        h = new
    return states


def label(model: Model, x: np.ndarray) -> np.ndarray:
    """Language probabilities (T, C, B) of every position."""
    n_h = model.gates.shape[2]
    logits = model.out[:, :n_h] @ _read(model, x, 0)
    logits += model.out[:, n_h:] @ _read(model, x, 1)
    logits += model.bias
    return _softmax(logits)


def _gradients(model: Model, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross-entropy over letter positions; backpropagation through time in both directions."""
    n_h = model.gates.shape[2]
    tapes: list[list] = [[], []]
    states = [_read(model, x, way, tapes[way]) for way in (0, 1)]
    d = _softmax(sum(model.out[:, way * n_h : (way + 1) * n_h] @ states[way] for way in (0, 1)) + model.bias)
    lanes = np.arange(x.shape[1])
    d[:, y, lanes] -= 1
    weight = _LETTER[x].astype(np.float32)
    d *= (weight / max(weight.sum(), 1))[:, None, :]
    d_table, d_gates, d_out = np.zeros_like(model.table), np.zeros_like(model.gates), np.zeros_like(model.out)
    real = (x != PAD).astype(np.float32)
    for way in (0, 1):
        part = slice(way * n_h, (way + 1) * n_h)
        d_out[:, part] = np.einsum("tcb,thb->ch", d, states[way], optimize=True)
        into = model.out[:, part].T @ d
        carry, d_in = np.zeros_like(states[way][0]), np.empty((*x.shape[:1], 3 * n_h, x.shape[1]), np.float32)
        for t, g, un, before in reversed(tapes[way]):
            z, r, n = g[:n_h], g[n_h : 2 * n_h], g[2 * n_h :]
            dh = (carry + into[t]) * real[t]
            own = d_in[t]
            own[2 * n_h :] = dh * z * (1 - n * n)
            own[:n_h] = dh * (n - before) * z * (1 - z)
            own[n_h : 2 * n_h] = own[2 * n_h :] * un * r * (1 - r)
            du = own.copy()
            du[2 * n_h :] *= r
            d_gates[way] += du @ before.T
            carry = dh * (1 - z) + model.gates[way].T @ du
        flat, order = d_in.transpose(1, 0, 2).reshape(3 * n_h, -1), x.reshape(-1)
        for row in range(3 * n_h):
            d_table[way, row] = np.bincount(order, flat[row], PAD + 1)
    return [d_table, d_gates, d_out, d.sum((0, 2))[:, None]]


def windows(raw: bytes, window: int = WINDOW) -> np.ndarray:
    """The text's windows as columns (window, n), lower-cased in ASCII, the last one padded."""
    n = -(-len(raw) // window)
    out = np.full(n * window, PAD, np.int64)
    out[: len(raw)] = _LOWER[np.frombuffer(raw, np.uint8)]
    return out.reshape(n, window).T


def fit(samples: list[tuple[str, bytes]], steps: int = STEPS, seed: int = 7) -> Model | None:
    """A model from labelled texts, by Adam over windows drawn evenly from the languages."""
    languages = sorted({lang for lang, raw in samples if raw})
    if not languages:
        return None
    model, rng = start(languages, seed=seed), np.random.default_rng(seed)
    pools = [np.concatenate([windows(raw) for lang, raw in samples if lang == own and raw], 1) for own in languages]
    first, second = [np.zeros_like(w) for w in model.weights], [np.zeros_like(w) for w in model.weights]
    for step in range(1, steps + 1):
        y = rng.integers(0, len(languages), BATCH)
        x = np.stack([pools[k][:, rng.integers(pools[k].shape[1])] for k in y], 1)
        rate = RATE * min(1.0, 2 * (1 - (step - 1) / steps))
        for w, g, m, v in zip(model.weights, _gradients(model, x, y), first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def has_letter(raw: bytes) -> bool:
    return len(raw.translate(None, _ASCII_LETTERS)) < len(raw) or not raw.isascii() and any(map(str.isalpha, raw.decode("utf-8", "replace")))


def predict(model: Model | None, texts: list[bytes | None]) -> list[tuple[str, float]]:
    """(language, score) of each text."""
    if model is None:
        return [("und", 0.0)] * len(texts)
    sums, letters = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts))
    held, owners, size = [], [], 0

    def flush() -> None:
        x, own = np.concatenate(held, 1), np.concatenate(owners)
        full = (x != PAD).sum(0)
        order = np.argsort(-full, kind="stable")
        for at in range(0, len(order), LANES):
            lanes = order[at : at + LANES]
            part = x[: full[lanes[0]], lanes]
            p = label(model, part)
            w = _LETTER[part].astype(np.float32)
            pooled = np.einsum("tcb,tb->cb", p, w)
            for c in range(len(model.languages)):
                sums[:, c] += np.bincount(own[lanes], pooled[c], len(texts))
            letters[:] += np.bincount(own[lanes], w.sum(0), len(texts))

    for k, raw in enumerate(texts):
        if not raw or not has_letter(raw):
            continue
        for at in range(0, len(raw), SLICE_BYTES):
            held.append(windows(raw[at : at + SLICE_BYTES]))
            owners.append(np.full(held[-1].shape[1], k))
            size += held[-1].size
            if size >= SLICE_BYTES:
                flush()
                held.clear(), owners.clear()
                size = 0
    if held:
        flush()
    best = sums.argmax(1)
    return [(model.languages[b], float(min(1.0, s[b] / n))) if n else ("und", 0.0) for b, s, n in zip(best, sums, letters, strict=True)]


def sample(docs: DataFrame, per_language: int = SAMPLE, chars: int = SAMPLE_CHARS) -> list[tuple[str, bytes]]:
    """At most ``per_language`` labelled texts of each language (doc_id, text, lang), each at most ``chars`` characters from a place drawn by hash."""
    draw = F.xxhash64(F.lit("sample"), "doc_id", "text")
    labelled = docs.where("lang is not null and doc_id is not null")
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    found = [(r.lang, r.n) for r in sizes.limit(MOST_LANGUAGES + 1).collect()]
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} different labels: clean the language column, or train on fewer of them")
    if not found:
        return []
    # A hash prefix thins large languages to some four times the sample, so that the ranks below see a few thousand rows of each.
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, 4 * per_language / n))) for lang, n in found])
    rows = labelled.where((F.pmod(draw, F.lit(1 << 20)) < share * (1 << 20)) & F.col("text").isNotNull()).withColumn("draw", draw)
    rows = rows.select("lang", "draw", "doc_id", F.substr("text", (1 + F.pmod(draw, F.greatest(F.length("text") - chars, F.lit(1)))).cast("int"), F.lit(chars)).alias("part"))
    kept = rows.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id", "part"))).where(F.col("k") <= per_language)
    return [(lang, part.encode()) for lang, _, part in sorted(kept.select("lang", "k", "part").collect())]


def train(docs: DataFrame) -> Model | None:
    return fit(sample(docs))


def detect(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score of every row of ``docs`` (doc_id, text)."""

    def run(batches):
        def each():
            for ids, texts in slices(batches, 512):
                yield from ((d, *found) for d, found in zip(ids, predict(model, texts), strict=True))

        return arrow(each(), _FOUND)

    return lean(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def detect_rows(docs: DataFrame, model: Model | None, lang: str, score: str) -> DataFrame:
    """All columns of ``docs`` (with ``text``) and the prediction in columns ``lang`` and ``score``."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                found = predict(model, part.column(at).cast(pa.binary()).to_pylist())
                langs, scores = pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, langs, scores], names=[*part.schema.names, lang, score])

    schema = T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    return lean(docs).mapInArrow(run, schema)


def held_out(doc_id="doc_id"):
    """Whether the id's checksum leaves 2 by 4; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out()))
    return detect(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
