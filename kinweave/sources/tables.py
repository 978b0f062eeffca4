"""Scans: raw and clean TSV tables, ground truth, candidate lists, ids, and the test tables' adapter."""

from __future__ import annotations

import json
import os
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave import values as V
from kinweave.functions.clean import CLEAN, null_to_empty, preprocess

RAW = ["entity_id", "business_name", "business_address", "country"]


def _strings(names) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _tsv(spark: SparkSession, path, names) -> DataFrame:
    """One reader for all tables: tabs, a header, no quoting (a stray quote stays a character), malformed bytes replaced."""
    return spark.read.schema(_strings(names)).options(sep="\t", header=True, quote="", escape="", mode="PERMISSIVE", enforceSchema=True).csv(path)


def load_raw(spark: SparkSession, path, last_wins: bool = False) -> DataFrame:
    """Raw records; null literals become empty. ``last_wins``: of records that repeat an id only one stays, the last by content order of the file."""
    df = _tsv(spark, path, RAW)
    if last_wins:
        df = df.withColumn("_at", F.monotonically_increasing_id()).groupBy("entity_id").agg(F.max_by(F.struct(*RAW[1:]), "_at").alias("r")).select("entity_id", "r.*")
    return df.select([null_to_empty(F.col(c)).alias(c) for c in RAW])


def load_matching(spark: SparkSession, path) -> DataFrame:
    return load_raw(spark, path).toDF("entity_id", "name", "addr", "country")


def load_clean(spark: SparkSession, path, columns: list[str] | None = None) -> DataFrame:
    """Clean records, pruned to ``columns``."""
    df = _tsv(spark, path, CLEAN)
    return df.select([null_to_empty(F.col(c), V.NULLS_CLEAN).alias(c) for c in columns or CLEAN])


def load_preprocessed(spark: SparkSession, path) -> DataFrame:
    return preprocess(load_raw(spark, path))


def split_ids(c):
    """A comma list's ids: trimmed, without empty ones, each once."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))


def load_ground_truth(spark: SparkSession, path) -> DataFrame:
    """s1_id, matched (array; empty for singletons), whichever header the file has; rows with a blank id are dropped."""
    df = _tsv(spark, path, ["s1_id", "ids"])
    return df.where(F.trim(F.coalesce("s1_id", F.lit(""))) != "").select(F.trim("s1_id").alias("s1_id"), split_ids(F.col("ids")).alias("matched"))


def load_lists(spark: SparkSession, path) -> DataFrame:
    """s1_id, position, cand_id of a candidate or result file."""
    df = _tsv(spark, path, ["s1_id", "ids"])
    return df.select("s1_id", F.posexplode(F.filter(F.transform(F.split(F.coalesce("ids", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")).alias("position", "cand_id"))


def pairs_of(truth: DataFrame) -> DataFrame:
    return truth.select("s1_id", F.explode("matched").alias("cand_id"))


def needed(records: DataFrame, ids: DataFrame) -> DataFrame:
    """The records with these ids."""
    return records.join(ids.select("entity_id").distinct(), "entity_id", "left_semi")


def known_ids(*tables: DataFrame) -> DataFrame:
    out = tables[0].select("entity_id")
    for t in tables[1:]:
        out = out.union(t.select("entity_id"))
    return out.distinct()


_FILES = {"validate": ["train_source1.tsv", "train_source2.tsv", "train_source3.tsv", "train_ground_truth.tsv"], "generate": ["test_source1.tsv", "test_source2.tsv", "test_source3.tsv"]}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def dataset_dir(spark: SparkSession, path: str | None = None) -> str:
    """The argument, else the environment's DATASET_DIR, else the first of the usual relative places, else ``dataset``."""
    if path:
        return path
    if own := os.environ.get("DATASET_DIR"):
        return own
    for place in ("dataset", "data", "../dataset", "../data", "."):
        if _exists(spark, f"{place}/train") or _exists(spark, f"{place}/test"):
            return place
    return "dataset"


def dataset_paths(spark: SparkSession, root: str, mode: str) -> dict[str, str]:
    """Paths of a mode's tables, in ``root/train`` or ``root/test`` or flat; an error names all that are missing."""
    names = _FILES[mode]
    folder = "train" if mode == "validate" else "test"
    for base in (PurePosixPath(root, folder), PurePosixPath(root, "dataset", folder), PurePosixPath(root)):
        found = {n.split("_", 1)[1].removesuffix(".tsv"): f"{root if str(base) == root else base}/{n}" for n in names}
        if all(_exists(spark, p) for p in found.values()):
            return found
    raise FileNotFoundError("missing: " + ", ".join(p for p in found.values() if not _exists(spark, p)))


def load_config(path: str, spark: SparkSession) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))


#: The test tables' stand-in records: a page's title, and the language in its address.
TITLE = "<title>([^<]*)</title>"
LANG = "^[a-z]+://[^/]+/([a-z][a-z])/"
LANDS = {"en": "US", "fr": "France", "de": "India", "es": "Spain"}


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test tables' stand-in records, from whole pages: dealt to three sources, the title for name, the words of the address with a street and a postal code for address, a country for each language."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    ids = F.concat(F.lit("S"), (F.col("page_id") % 3 + 1).cast("string"), F.lit("-"), F.col("page_id").cast("string"))
    addr = F.concat(F.trim(F.regexp_replace("url", "[^A-Za-z0-9]+", " ")), F.lit(" St. "), (10000 + F.col("page_id") % 97).cast("string"))
    land = F.coalesce(*[F.when(F.regexp_extract("url", LANG, 1) == k, F.lit(v)) for k, v in LANDS.items()], F.lit(""))
    return pages.select(ids.alias("entity_id"), F.regexp_extract("html", TITLE, 1).alias("name"), addr.alias("addr"), land.alias("country"))


def sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Queries (source one) and targets (sources two and three)."""
    df = entities(spark, sf_dir)
    first = F.col("entity_id").startswith("S1-")
    return df.where(first), df.where(~first)
