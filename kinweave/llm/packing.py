"""Concatenate and cut: all documents' tokens in one line, cut into fixed windows.

Pass one tokenizes and writes each document's ids with its place within its partition; the partitions' totals (one number per task,
the only thing the driver gathers) are summed up to global offsets; pass two cuts documents at window borders. What is left after the last full
window is cut at powers of two, largest first, so the last sequences carry no padding either.

Tokenizing goes word by word through a bounded cache. That is exact for tokenizers whose pre-tokenizer never joins characters on both sides of ASCII white space
and drops it (``word_bpe_49k``); for others pass ``by_word=False``.

Defined cases: null and empty texts are one piece of the end id; repeated rows and ids are packed as often as they occur; a very long text is tokenized word by word; an empty table gives no rows;
other columns than doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import arrow, lean, save, slices

WINDOW = 2048
END_ID = 1
#: Bytes of words and ids that a worker's cache holds at most, with ENTRY_BYTES for each entry's objects; longer words are never cached.
CACHE_BYTES, ENTRY_BYTES, CACHED_WORD = 96 << 20, 150, 64

_SIMPLE = re.compile(rb"([A-Za-z\x80-\xff]+)([.,:;!?|*#$%&()-]*)")
#: Byte-level tokenizers' printable sign for each byte: the byte itself where it is printable, else the next free code point from 256.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_SIGNS = [chr(b) if b in _SHOWN else chr(256 + b - sum(x < b for x in _SHOWN)) for b in range(256)]

_TOKENS = pa.schema([("part", pa.int32()), ("local_start", pa.int64()), ("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
_TOKENS_DDL = "part int, local_start long, doc_id long, doc_tokens long, ids binary"
_PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("cut_before", pa.bool_()), ("cut_after", pa.bool_()), ("ids", pa.binary()),
])
_PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cut_before boolean, cut_after boolean, ids binary"


class Encoder(dict):
    """Texts (UTF-8) to little-endian ids. As a dictionary it holds words' ids, ``CACHE_BYTES`` at most.

    Words of Latin letters and closing marks, nearly all there are, go to the tokenizer's model directly: letters and marks are
    a pre-token each, as the tokenizer itself would cut them. All others take the tokenizer's whole path.
    """

    def __init__(self, path: str, by_word: bool = True) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.by_word = by_word
        self.held = 0

    def _ids(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def _piece(self, raw: bytes) -> bytes | None:
        """The ids of one pre-token, or None if it isn't known to be one."""
        if raw.isascii():
            text = raw.decode().lower()
        else:
            text = raw.decode("utf-8", "replace")
            low = text.lower()
            if not text.isalpha() or max(text) > "\u024f" or len(low) != len(text):
                return None
            text = "".join(map(_BYTE_SIGNS.__getitem__, low.encode()))
        return self.get(raw) or np.array([t.id for t in self.model.tokenize(text)], self.dtype).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        m = _SIMPLE.fullmatch(word)
        ids = self._piece(m[1]) if m else None
        if ids is None:
            (ids,) = self._ids([word])
        elif m[2]:
            ids += self._piece(m[2])
        if len(word) <= CACHED_WORD:
            self.held += len(word) + len(ids) + ENTRY_BYTES
            if self.held > CACHE_BYTES:
                self.clear()
                self.held = 0
            self[word] = ids
        return ids

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_word:
            return self._ids(texts)
        get = self.__getitem__
        return [b"".join(map(get, t.split())) for t in texts]


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, by_word: bool) -> Encoder:
    """One encoder for all tasks of a Python worker, so that its cache lives on."""
    if (path, by_word) not in _ENCODERS:
        _ENCODERS[path, by_word] = Encoder(path, by_word)
    return _ENCODERS[path, by_word]


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = END_ID, by_word: bool = True) -> DataFrame:
    """``docs``: doc_id, text. Each document's ids (with ``end_id``) and the number of ids before it in its partition."""

    def run(batches):
        from kinweave.llm import packing  # the worker's own module: what it holds outlives this task

        encode = packing.encoder(tokenizer, by_word)
        part, end = TaskContext.get().partitionId(), np.array([end_id], encode.dtype).tobytes()

        def each():
            start = 0
            for ids, texts in slices(batches, 64):
                for doc, tokens in zip(ids, encode([t or b"" for t in texts]), strict=True):
                    tokens += end
                    n = len(tokens) // encode.dtype.itemsize
                    yield part, start, doc, n, tokens
                    start += n

        return arrow(each(), _TOKENS, width=lambda r: len(r[-1]))

    return lean(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, _TOKENS_DDL)


class Windows:
    """Where the windows over ``total`` ids lie: full ones, then powers of two."""

    def __init__(self, total: int, size: int) -> None:
        self.size, self.full = size, total // size * size
        self.tail, at = [], self.full
        for bit in reversed(range(size.bit_length())):
            if total - at >= 1 << bit:
                self.tail.append((at, at + (1 << bit)))
                at += 1 << bit
        if size & (size - 1) and at < total:
            self.tail.append((at, total))

    def at(self, place: int) -> tuple[int, int, int]:
        """The window that holds id number ``place``: its number, begin and end."""
        if place < self.full:
            k = place // self.size
            return k, k * self.size, (k + 1) * self.size
        k = next(i for i, (a, b) in enumerate(self.tail) if place < b)
        return self.full // self.size + k, *self.tail[k]


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, by_word: bool = True, keep_ids: bool = True) -> DataFrame:
    """One row per piece of a document; ``cut_before``/``cut_after`` mark pieces at a cut within the document, ``ids`` are unsigned 32-bit."""
    tokens = save(tokenize(docs, tokenizer, end_id, by_word))
    spark = docs.sparkSession
    totals = sorted(tokens.groupBy("part").agg(F.sum("doc_tokens").alias("n")).collect())
    starts, place = [], 0
    for part, n in totals:
        starts.append((part, place))
        place += n
    windows = Windows(place, window)
    offsets = spark.createDataFrame(starts, "part int, base long")  # a row per task of pass one

    def run(batches):
        def each():
            for cols in slices(batches, 256):
                for base, local, doc, n, raw in zip(*cols, strict=True):
                    ids = np.frombuffer(raw, np.dtype(f"<u{len(raw) // n}")).astype("<u4").tobytes()
                    begin, at = base + local, base + local
                    while at < begin + n:
                        k, low, high = windows.at(at)
                        upto = min(high, begin + n)
                        part = ids[4 * (at - begin) : 4 * (upto - begin)]
                        yield doc, at - begin, upto - at, zlib.crc32(part), n, k, at - low, at > begin, upto < begin + n, part if keep_ids else None
                        at = upto

        return arrow(each(), _PIECES, width=lambda r: len(r[-1] or b""))

    placed = tokens.join(F.broadcast(offsets), "part").select("base", "local_start", "doc_id", "doc_tokens", "ids")
    return placed.mapInArrow(run, _PIECES_DDL)


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, _tokenizer(), keep_ids=False).drop("ids")
