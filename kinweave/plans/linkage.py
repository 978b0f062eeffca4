"""The whole linkage: candidates, features, probabilities, threshold, lists, evaluation, validation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions.similarity import normalised, pair_features
from kinweave.operators import blocking, evaluate, model, sampling, validate
from kinweave.sources import sinks, tables
from kinweave.sources.sinks import stored


@dataclass
class Result:
    candidates: DataFrame
    scored: DataFrame
    lists: DataFrame
    evaluation: DataFrame | None
    problems: DataFrame


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` through a table, so that later steps neither repeat nor lose it."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def train(queries: DataFrame, targets: DataFrame, truth: DataFrame, work: str, profile=blocking.Profile()):
    """A matcher from hard negatives: 80 % of the queries train, on thinned negatives; 20 % choose the threshold, on all of their candidates. Returns model, threshold in percent, sweep."""
    pairs = written(blocking.candidates(queries, targets, profile, stored).select("s1_id", "cand_id"), f"{work}/candidates")
    split = sampling.stratified_split(queries, truth, 0.2).select(F.col("entity_id").alias("s1_id"), "validation")
    held, own = split.where("validation").select("s1_id"), split.where("not validation").select("s1_id")
    sides = normalised(queries), normalised(targets)
    rows = sampling.hard_negatives(pairs.join(own, "s1_id", "left_semi"), truth)
    features = written(pair_features(rows.select("s1_id", "cand_id"), *sides).join(rows, ["s1_id", "cand_id"]), f"{work}/features")
    fitted = model.train(features)
    asked = pair_features(pairs.join(held, "s1_id", "left_semi"), *sides)
    scored = written(model.predict(fitted, asked).select("s1_id", "cand_id", "probability"), f"{work}/held")
    sweep = evaluate.threshold_sweep(held, scored, truth.join(held, "s1_id", "left_semi"), [round(100 * t, 1) for t in evaluate.PRODUCTION_GRID])
    return fitted, evaluate.best_threshold(sweep).first()["percent"], sweep


def link(queries: DataFrame, targets: DataFrame, fitted, threshold: float, work: str, profile=blocking.Profile(), truth: DataFrame | None = None) -> Result:
    """Scores all candidates of ``queries``; a result list keeps its candidates' order. ``work`` is a folder that driver and executors share."""
    pairs = written(blocking.candidates(queries, targets, profile, stored), f"{work}/candidates")
    features = pair_features(pairs.select("s1_id", "cand_id"), normalised(queries), normalised(targets))
    scored = written(model.predict(fitted, features), f"{work}/scored")
    matches = model.select(scored, threshold).withColumn("position", blocking.place("cand_id"))
    ids = queries.select(F.col("entity_id").alias("s1_id"))
    lists = sinks.result_lists(ids, matches)
    evaluation = evaluate.macro(evaluate.f05_by_entity(ids, matches, truth)) if truth is not None else None
    candidates = blocking.candidate_lists(queries, pairs)
    return Result(candidates, scored, lists, evaluation, validate.report(lists, queries, candidates))


def run(spark: SparkSession, root: str, work: str, mode: str = "validate", fitted=None, threshold: float = 0.95, profile=blocking.Profile()) -> Result:
    """From a data set's folder; without a model one is trained (``validate`` only)."""
    paths = tables.dataset_paths(spark, root, mode)
    load = lambda k: tables.load_matching(spark, paths[k])
    queries, targets = load("source1"), load("source2").unionByName(load("source3"))
    truth = tables.pairs_of(tables.load_ground_truth(spark, paths["ground_truth"])) if "ground_truth" in paths else None
    if fitted is None:
        if truth is None:
            raise ValueError("a model is needed to score without ground truth")
        fitted, percent, _ = train(queries, targets, truth, work, profile)
        threshold = percent / 100
    return link(queries, targets, fitted, threshold, work, profile, truth)
