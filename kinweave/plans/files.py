"""Command-line plans over files: cleaning raw tables, validating results."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators import validate
from kinweave.sources import sinks, tables

RESULTS, CANDIDATES = ["source1_entity_id", "matched_entity_ids"], ["source1_entity_id", "candidate_entity_ids"]


def clean_files(spark: SparkSession, pattern: str, out: str) -> None:
    """All raw tables that match ``pattern`` (a Hadoop glob such as ``*_source*.tsv``) to clean tables, one folder per file, in one narrow job each."""
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    for path in sorted(str(s.getPath()) for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or ()):
        name = path.rsplit("/", 1)[1].removesuffix(".tsv")
        sinks.write_clean(tables.load_preprocessed(spark, path), f"{out}/{name}_clean")


def _lists(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{RESULTS[0]} string, ids string").options(sep="\t", header=True, quote="", escape="", mode="PERMISSIVE").csv(path).where(F.trim(F.coalesce(RESULTS[0], F.lit(""))) != "")


def validate_files(spark: SparkSession, results: str, queries: str, candidates: str | None = None, targets: list[str] | None = None) -> tuple[list[str], list[str]]:
    """Errors and warnings of a results file; ids are checked against ``targets`` if these are given."""
    errors = validate.file_problems(spark, results, RESULTS)
    warnings = [] if targets else ["ids are not checked"]
    if any(e.startswith(("missing file", "empty file")) for e in errors):
        return errors, warnings
    pool = None
    if candidates:
        problems = validate.file_problems(spark, candidates, CANDIDATES)
        if any(p.startswith(("missing file", "empty file")) for p in problems):
            warnings += problems
        else:
            errors += problems
            pool = _lists(spark, candidates)
    known = tables.known_ids(*[tables.load_raw(spark, t) for t in targets]) if targets else None
    for r in validate.report(_lists(spark, results), tables.load_raw(spark, queries), pool, known).collect():
        (errors if r.severity == "error" else warnings).append(f"{r.rule}: {r.n} ({r.examples})")
    return errors, warnings


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("results")
    p.add_argument("--queries", required=True)
    p.add_argument("--candidates")
    p.add_argument("--targets", nargs="*")
    a = p.parse_args(argv)
    errors, warnings = validate_files(SparkSession.builder.getOrCreate(), a.results, a.queries, a.candidates, a.targets)
    for kind, lines in (("error", errors), ("warning", warnings)):
        for line in lines:
            print(f"{kind}: {line}")
    return int(bool(errors))


if __name__ == "__main__":
    sys.exit(main())
