"""Plumbing shared by the corpus operators: written intermediate tables and bounded Arrow batches."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows below which a table may be broadcast (at some 100 bytes a row at most 20 MB).
BROADCAST_ROWS = 200_000

#: Characters that separate words in ``bytes.split`` and in the contracts: space and \t to \r.
SPACES = b" \t\n\v\f\r"


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only a local session without one, as in tests, gets a temporary folder; on a cluster its absence is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="kinweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/kinweave-{uuid.uuid4().hex}"


#: Arrow batch settings: Spark's default, and what whole texts need so that a few batches in flight stay small.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1024"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


def lean(df: DataFrame) -> DataFrame:
    """``df``, to be read by Python in small Arrow batches; a session that has settings of its own keeps them."""
    conf = df.sparkSession.conf
    for key, (default, own) in BATCHES.items():
        if conf.get(key) == default:
            conf.set(key, own)
    return df


def save(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here, and lost executors cost nothing before it."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a saved table that nothing reads any more, and lets Spark drop the shuffle files of finished jobs."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    release(spark)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished jobs: a second collection finds what the first one's cleaning has let go."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint on a *saved* table if it is small enough; otherwise the table as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def slices(batches: Iterable[pa.RecordBatch], rows: int = 128) -> Iterator[list[list]]:
    """The batches' columns as Python lists of at most ``rows`` values, so that only a little is held as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield [c.to_pylist() for c in part.columns]


def arrow(rows: Iterable[tuple], schema: pa.Schema, every: int = 2048, size: int = 8 << 20, width=None) -> Iterator[pa.RecordBatch]:
    """Tuples as record batches of at most ``every`` rows or about ``size`` bytes by ``width(row)``."""
    held: list[tuple] = []
    held_bytes = 0
    for row in rows:
        held.append(row)
        held_bytes += width(row) if width else 0
        if len(held) >= every or held_bytes >= size:
            yield _batch(held, schema)
            held, held_bytes = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
