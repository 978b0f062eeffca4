"""Sinks: clean tables, id lists, and results that can be resumed."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_clean(clean: DataFrame, path: str) -> None:
    clean.write.mode("overwrite").options(sep="\t", header=True, quote="").csv(path)


def write_lists(lists: DataFrame, path: str) -> None:
    """Two columns, id and comma list; empty lists stay empty fields."""
    lists.write.mode("overwrite").options(sep="\t", header=True, quote="", emptyValue="").csv(path)


def result_lists(queries: DataFrame, matches: DataFrame, order: str = "position") -> DataFrame:
    """One row per query, its matches in ``order``."""
    lists = matches.groupBy("s1_id").agg(F.array_sort(F.collect_list(F.struct(order, "cand_id"))).alias("m"))
    ids = F.array_join(F.transform("m", lambda m: m["cand_id"]), ",")
    return queries.select("s1_id").distinct().join(lists, "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), F.coalesce(ids, F.lit("")).alias("matched_entity_ids"))


def config_key(config: dict) -> str:
    """A folder name for one configuration: other parameters never resume into its results."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]


def remaining(queries: DataFrame, finished: DataFrame) -> DataFrame:
    """Queries that have no result yet."""
    return queries.join(finished.select(F.col("source1_entity_id").alias("entity_id")).distinct(), "entity_id", "left_anti")


def finished_by_country(queries: DataFrame, finished: DataFrame) -> DataFrame:
    done = finished.select(F.col("source1_entity_id").alias("entity_id")).distinct()
    return queries.join(done, "entity_id", "left_semi").groupBy("country").agg(F.count(F.lit(1)).alias("finished"))


def append_results(lists: DataFrame, path: str) -> None:
    """Committed as a whole; an interrupted run leaves no torn rows."""
    lists.write.mode("append").parquet(path)


def shared_path(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``, which driver and executors share. Only a local session without one gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="kinweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/kinweave-{uuid.uuid4().hex}"


#: Rows below which a table of normalised entities (about 1 KB each) is broadcast.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint on a *stored* table if it is small enough; otherwise the table as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def stored(df: DataFrame) -> DataFrame:
    """``df`` through a table in the shared folder, so that later steps neither repeat nor lose it."""
    spark, path = df.sparkSession, shared_path(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
