"""Rules over result lists (source1_entity_id, candidate_entity_ids or matched_entity_ids)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exploded(lists: DataFrame) -> DataFrame:
    """s1_id, cand_id of a table of lists (id, comma list)."""
    a, b = lists.columns[:2]
    ids = F.filter(F.transform(F.split(F.coalesce(F.col(b), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return lists.select(F.col(a).alias("s1_id"), F.explode(ids).alias("cand_id"))


def duplicate_rows(lists: DataFrame) -> DataFrame:
    a = lists.columns[0]
    return lists.groupBy(F.col(a).alias("s1_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def duplicate_ids(lists: DataFrame) -> DataFrame:
    return exploded(lists).groupBy("s1_id", "cand_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def wrong_prefix(lists: DataFrame) -> DataFrame:
    """Ids that are no candidates: of source one (self matches) or of no known source."""
    kind = F.when(F.col("cand_id").startswith("S1-"), "self").when(~F.col("cand_id").rlike("^S[23]-"), "prefix")
    return exploded(lists).withColumn("problem", kind).where("problem is not null")


def unknown_ids(lists: DataFrame, valid: DataFrame) -> DataFrame:
    return exploded(lists).join(valid.select(F.col("entity_id").alias("cand_id")), "cand_id", "left_anti").select("s1_id", "cand_id")


def missing_rows(lists: DataFrame, required: DataFrame) -> DataFrame:
    return required.select(F.col("entity_id").alias("s1_id")).join(lists.select(F.col(lists.columns[0]).alias("s1_id")), "s1_id", "left_anti")


def extra_rows(lists: DataFrame, required: DataFrame) -> DataFrame:
    return lists.select(F.col(lists.columns[0]).alias("s1_id")).join(required.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_anti")


def not_subset(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    return exploded(matches).distinct().join(exploded(candidates), ["s1_id", "cand_id"], "left_anti")


def report(matches: DataFrame, required: DataFrame, candidates: DataFrame | None = None, valid: DataFrame | None = None, examples: int = 5) -> DataFrame:
    """rule, severity, n and the first offenders of each rule that is broken."""
    def rows(df: DataFrame, rule: str, severity: str = "error") -> DataFrame:
        who = F.concat_ws(" ", *[F.col(c) for c in ("s1_id", "cand_id") if c in df.columns])
        return df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), who.alias("who"))

    wrong = wrong_prefix(matches)
    parts = [rows(duplicate_rows(matches), "duplicate row"), rows(duplicate_ids(matches), "duplicate id"), rows(wrong.where("problem = 'self'"), "self match"), rows(wrong.where("problem = 'prefix'"), "wrong prefix"), rows(missing_rows(matches, required), "missing row"), rows(extra_rows(matches, required), "extra row")]
    if valid is not None:
        parts.append(rows(unknown_ids(matches, valid), "unknown id"))
    if candidates is not None:
        parts.append(rows(not_subset(matches, candidates), "not a candidate", "warning"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    # Counts by a plain aggregate. Examples: the first of each hash part, then the first of those, so that no rule's rows meet in one task.
    first = out.select("rule", "severity", "who", F.pmod(F.xxhash64("who"), F.lit(64)).alias("part"))
    for keys in (["rule", "severity", "part"], ["rule", "severity"]):
        first = first.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("who"))).where(F.col("k") <= examples)
    shown = first.groupBy("rule", "severity").agg(F.array_join(F.array_sort(F.collect_list("who")), "; ").alias("examples"))
    return out.groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n")).join(shown, ["rule", "severity"])


def file_problems(spark, path: str, header: list[str]) -> list[str]:
    """What is wrong with a list file before its rows are read: missing, empty, header, rows without a tab, bytes that are no UTF-8."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return [f"missing file: {path}"]
    lines = spark.read.text(path)
    first = lines.first()
    if first is None:
        return [f"empty file: {path}"]
    found = []
    if first[0].split("\t") != header:
        found.append("comma-separated header" if "," in first[0] and "\t" not in first[0] else f"wrong header: {first[0]!r}")
    value = F.col("value")
    counts = lines.agg(F.count_if((F.trim(value) != "") & ~F.contains(value, F.lit("\t"))).alias("bare"), F.count_if(~F.is_valid_utf8(value)).alias("bytes")).first()
    bare = counts["bare"] - (0 if "\t" in first[0] else 1)
    if bare:
        found.append(f"{bare} rows without a tab")
    if counts["bytes"]:
        found.append(f"{counts['bytes']} rows that are not UTF-8")
    return found
