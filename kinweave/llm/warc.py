"""WARC archives: write pages as response, revisit and continuation records; read, reassemble and verify them.

Records whose block is longer than a segment go out as a first record and ``continuation`` records. The
reader takes any WARC/1.x archive, plain or gzipped: it follows Content-Length, so no payload can be mistaken for a
record. Segments are grouped by origin identifier, ordered by segment number, checked for gaps and against the total length,
and then the HTTP block's chunked framing is undone.

Defined cases: a null payload is empty; null page ids are written as an empty field and come back null; rows that repeat
a page id with an equal payload are all responses if that id is the group's largest; a segment that is stored twice
counts once; a group with a missing segment or a wrong total has ``valid`` false and a null payload; an empty table gives an empty archive;
other columns than page_id, url and html, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import arrow, lean, save, scratch, slices, small

SEGMENT_BYTES = 64 << 10
#: Records of an archive at most; with the segments' size that bounds what a reader's task holds (some 256 MB before compression, mostly far less).
ARCHIVE_RECORDS = 4096
CHUNK_BYTES = 16 << 10
DATE = "2024-01-01T00:00:00Z"

_RECORD = pa.schema([("record", pa.binary())])
_PARSED = pa.schema([
    ("record_id", pa.string()), ("kind", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()), ("digest", pa.string()),
    ("refers_to_id", pa.string()), ("origin_id", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary()),
])
_PARSED_DDL = "record_id string, kind string, page_id long, uri string, digest string, refers_to_id string, origin_id string, segment int, total long, block binary"
_WHOLE = pa.schema([
    ("record_id", pa.string()), ("kind", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()), ("refers_to_id", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("valid", pa.bool_()), ("payload", pa.binary()),
])
_WHOLE_DDL = "record_id string, kind string, page_id long, uri string, refers_to_id string, payload_bytes long, payload_digest string, valid boolean, payload binary"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, digest: str, url: str) -> str:
    h = hashlib.md5(f"{page_id}|{digest}|{url}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without its last CRLF, which the file writer puts as the line's end."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n"


def chunked(payload: bytes, chunk: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for at in range(0, len(payload), chunk) if (p := payload[at : at + chunk])]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """The payload in chunked transfer framing, or None if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            n = int(body[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            return None
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        if len(out[-1]) != n or body[end + 2 + n : end + 4 + n] != b"\r\n":
            return None
        at = end + 4 + n


def records(page_id: int | None, url: str | None, payload: bytes, owner: tuple[int, str] | None, segment_bytes: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The page's records. ``owner``: page id and url of the response that a revisit refers to."""
    uri = re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url) if url else "about:blank"
    digest = sha1_base32(payload)
    own = _record_id(page_id, digest, "")
    common = [("WARC-Date", DATE), ("WARC-Target-URI", uri), ("X-Page-Id", "" if page_id is None else page_id), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if owner is not None:
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", _record_id(page_id, digest, "revisit")), *common, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(owner, digest, ""))], b"")
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[at : at + segment_bytes] for at in range(0, len(block), segment_bytes)]
    several = len(parts) > 1
    yield _record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common, ("Content-Type", "application/http;msgtype=response"), ("WARC-Segment-Number", 1 if several else None)], parts[0])
    for k, part in enumerate(parts[1:], 2):
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", _record_id(page_id, digest, str(k))), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", len(block) if k == len(parts) else None)], part)


def write_archive(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, archive_records: int = ARCHIVE_RECORDS, compression: str = "gzip") -> None:
    """Writes ``pages`` (page_id, url, html) as WARC files of at most ``archive_records`` records.

    A gzipped file is one stream, as Spark writes it; for readers that want a member for each record use ``compression="none"``.

    Equal payloads are found by their digest in a table of groups of two or more only, which is broadcast if
    small; else the join is shuffled, and AQE splits a hot digest.
    """
    own = lean(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")).withColumn("sha", F.sha1("payload"))
    again = save(own.groupBy("sha").agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1 and owner is not null").select("sha", "owner"))
    tagged = own.join(small(again), "sha", "left").select("page_id", "url", "payload", F.when(F.col("owner") != F.coalesce("page_id", F.lit(-(1 << 63)).cast("long")), F.col("owner")).alias("owner"))

    def build(batches):
        def each():
            for ids, urls, payloads, owners in slices(batches):
                for p, u, b, o in zip(ids, urls, payloads, owners, strict=True):
                    for r in records(p, u, b, o, segment_bytes):
                        yield (r,)

        return arrow(each(), _RECORD, width=lambda r: len(r[0]))

    written = tagged.mapInArrow(build, "record binary").select(F.col("record").cast("string").alias("value"))
    written.write.option("lineSep", "\r\n").option("compression", compression).option("maxRecordsPerFile", archive_records).text(path)


def parse(stream) -> Iterator[tuple]:
    """Records of an archive, in order, as rows of ``_PARSED``."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip().lower()] = v.strip()
        block = stream.read(int(fields.get("content-length", 0)))
        number, total, page = fields.get("warc-segment-number"), fields.get("warc-segment-total-length"), fields.get("x-page-id")
        yield (
            fields.get("warc-record-id"), fields.get("warc-type"), int(page) if page else None, fields.get("warc-target-uri"), fields.get("warc-payload-digest"),
            fields.get("warc-refers-to"), fields.get("warc-segment-origin-id"), int(number) if number else None, int(total) if total else None, block,
        )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per stored record of the archives in ``path`` (``*.gz`` or plain ``*.warc``/``*.txt``)."""

    def run(batches):
        def each():
            for (contents,) in slices(batches, 1):
                for data in contents:
                    stream = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
                    yield from parse(io.BufferedReader(stream))

        return arrow(each(), _PARSED, width=lambda r: len(r[-1]))

    return spark.read.format("binaryFile").load(path).where("length > 0").select("content").mapInArrow(run, _PARSED_DDL)


def decode(block: bytes) -> bytes | None:
    """The payload of an HTTP response block."""
    head, split, body = block.partition(b"\r\n\r\n")
    if not split:
        return None
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    if fields.get(b"transfer-encoding") == b"chunked":
        body = unchunked(body)
    if body is not None and fields.get(b"content-encoding") == b"gzip":
        body = zlib.decompress(body, 47)
    return body


def reassemble(stored: DataFrame, keep_payload: bool = True) -> DataFrame:
    """Whole records of ``read_records``; only segmented ones are shuffled, by origin."""
    meta = ["record_id", "kind", "page_id", "uri", "digest", "refers_to_id"]
    whole = stored.where("segment is null").select(*meta, F.lit(None).cast("long").alias("total"), F.array(F.struct(F.lit(1).alias("segment"), "block")).alias("parts"))
    first = F.col("kind") != "continuation"
    split = (
        stored.where("segment is not null")
        .groupBy(F.coalesce("origin_id", "record_id").alias("record_id"))
        .agg(*[F.max(F.when(first, F.col(c))).alias(c) for c in meta[1:]], F.max("total").alias("total"), F.collect_list(F.struct("segment", "block")).alias("parts"))
        .select(*meta, "total", "parts")
    )

    def run(batches):
        def each():
            for cols in slices(batches, 16):
                for rid, kind, page, uri, digest, refers, total, parts in zip(*cols, strict=True):
                    if kind == "revisit":
                        yield rid, kind, page, uri, refers, None, digest.removeprefix("sha1:") if digest else None, True, None
                        continue
                    by = {p["segment"]: p["block"] for p in parts}
                    block = b"".join(by[k] for k in sorted(by))
                    entire = sorted(by) == list(range(1, len(by) + 1)) and (len(by) == 1 and total is None or total == len(block))
                    payload = decode(block) if entire else None
                    own = sha1_base32(payload) if payload is not None else None
                    ok = payload is not None and digest in (None, f"sha1:{own}")
                    yield rid, kind, page, uri, refers, len(payload) if ok else None, own if ok else None, ok, payload if ok and keep_payload else None

        return arrow(each(), _WHOLE, width=lambda r: len(r[-1] or b""))

    return whole.union(split).mapInArrow(run, _WHOLE_DDL)


def resolve_revisits(whole: DataFrame) -> DataFrame:
    """Adds ``refers_to`` (page id) and the payload's size to revisit records from the response they refer to. ``whole``: a saved table."""
    origin = whole.where("kind = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("origin_bytes")).dropDuplicates(["refers_to_id"])
    revisits = whole.where("kind = 'revisit'").join(origin, "refers_to_id", "left")
    plain = whole.where("kind = 'response'").withColumns({"refers_to": F.lit(None).cast("long"), "origin_bytes": F.col("payload_bytes")})
    names = ["page_id", F.col("origin_bytes").alias("payload_bytes"), "payload_digest", F.col("kind").alias("record_type"), "refers_to", "valid"]
    return plain.select(names).union(revisits.select(names))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = scratch(spark)
    write_archive(pages, path)
    whole = save(reassemble(read_records(spark, path), keep_payload=False))
    return resolve_revisits(whole).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, upper(sha1(body)) AS hex FROM p),
b AS (SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, hex,
  list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(hex, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT) >> s) & 31) + 1 AS BIGINT), 1)),
    'string_agg', '')), 'string_agg', '') AS payload_digest FROM d),
g AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS owner FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = owner THEN NULL ELSE owner END AS refers_to FROM g
"""
