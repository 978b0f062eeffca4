"""Linkage of queries that arrive as files: the target side is a fixed table, each micro-batch is linked and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinweave.operators import blocking
from kinweave.sources import sinks
from kinweave.sources.sinks import stored

SCHEMA = "entity_id string, name string, addr string, country string"


def query_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def link_stream(queries: DataFrame, targets: DataFrame, out: str, checkpoint: str, profile=blocking.Profile()):
    """Starts a query that writes each batch's candidate lists to its own folder, so a repeated batch overwrites itself: exactly once. The targets' index is written once, before the first batch."""
    known = blocking.index(targets, profile, stored)

    def batch(df: DataFrame, number: int) -> None:
        lists = blocking.candidate_lists(df, blocking.candidates(df, known, profile, stored))
        lists.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def resume(queries: DataFrame, targets: DataFrame, out: str, profile=blocking.Profile()) -> None:
    """Links the queries that have no result in ``out`` for this profile and appends them."""
    spark, path = queries.sparkSession, f"{out}/{sinks.config_key(vars(profile))}"
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm):
        queries = sinks.remaining(queries, spark.read.parquet(path))
    sinks.append_results(blocking.candidate_lists(queries, blocking.candidates(queries, targets, profile, stored)), path)
