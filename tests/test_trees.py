import random

import numpy as np
from pyspark.ml.classification import GBTClassifier

from kinweave import values as V
from kinweave.operators import model, trees


class Alone:
    up = None

    def summed(self, a):
        return a

    told = summed


def table(spark, n, seed=7):
    rng = random.Random(seed)
    rows = [[round(rng.random(), 2) for _ in V.FEATURES] for _ in range(n)]
    return spark.createDataFrame([[*r, int((r[0] + 0.5 * r[3] > 0.8) != (rng.random() < 0.1))] for r in rows], [*V.FEATURES, "label"])


def jobs(spark, f):
    sc = spark.sparkContext
    sc.setJobGroup("trees", "trees")
    found = f()
    sc.setLocalProperty("spark.jobGroup.id", None)
    return found, len(sc.statusTracker().getJobIdsForGroup("trees"))


def test_a_tree_takes_no_job(spark):
    """Storing and loading the model takes some jobs more."""
    df, small = table(spark, 3000).cache(), {"maxDepth": 3, "stepSize": 0.1, "subsamplingRate": 0.85}
    (few, a), (many, b) = (jobs(spark, lambda k=k: model.train(df, small | {"maxIter": k})) for k in (4, 40))
    assert (few.getNumTrees, many.getNumTrees) == (4, 40) and b - a < 36


def test_trees_are_those_of_spark(spark):
    """Without draws and with few values, splits and leaves are the same."""
    own = {"maxIter": 5, "maxDepth": 3, "stepSize": 0.1, "minInstancesPerNode": 5}
    df = table(spark, 4000).selectExpr(*[f"floor({c} * 8) / 8 as {c}" for c in V.FEATURES], "label").cache()
    mine = model.train(df, own)
    n = df.count()
    ratio = (n - (p := df.where("label = 1").count())) / p
    rows = model._vectors(df).selectExpr("features", "double(label) label", f"if(label = 1, {ratio}D, 1D) weight")
    theirs = GBTClassifier(weightCol="weight", seed=42, **own).fit(rows)
    assert mine.treeWeights == theirs.treeWeights
    a, b = (np.array([r.probability for r in model.predict(m, df.orderBy(*V.FEATURES)).collect()]) for m in (mine, theirs))
    assert np.abs(a - b).max() < 1e-4
    assert np.abs(mine.featureImportances.toArray() - theirs.featureImportances.toArray()).max() < 1e-3


def test_partitions_do_not_change_the_model(spark):
    df, own = table(spark, 5000), {"maxIter": 6, "maxDepth": 4, "stepSize": 0.1, "subsamplingRate": 0.85, "featureSubsetStrategy": "0.85"}
    found = [trees.fit(df.repartition(k), V.FEATURES, 2.5, 5000, own, 42, parts).toDebugString for k, parts in ((1, 1), (7, 3), (3, 4))]
    assert len({s.split("\n", 1)[1] for s in found}) == 1


def test_one_label_and_few_rows(spark):
    df = table(spark, 40).selectExpr(*V.FEATURES, "0 as label")
    assert model.predict(model.train(df, {"maxIter": 3, "maxDepth": 2, "stepSize": 0.1}), df).where("probability > 0.5").count() == 0


def test_siblings_by_difference():
    """Every node's count and value are those of the rows that reach it."""
    rng = np.random.default_rng(3)
    bins, label = rng.integers(0, trees.BINS, (4, 500)).astype(np.uint8), rng.integers(0, 2, 500).astype(np.int32)
    (out,) = trees.grown(bins, label, np.arange(500, dtype=np.uint64), Alone(), 2.0, {"maxIter": 1, "maxDepth": 4, "stepSize": 0.1, "minInstancesPerNode": 5}, 1)
    nodes = {k: (f, b, v, n) for _, k, f, b, _, v, _, n in zip(*out)}
    weight, sign = np.where(label == 1, 2.0, 1.0), 2.0 * label - 1

    def check(k, at):
        f, b, v, n = nodes[k]
        assert n == len(at) >= 5 and abs(v - (weight * sign)[at].sum() / weight[at].sum()) < 1e-6
        if f >= 0:
            right = bins[f, at] > b
            check(2 * k, at[~right]), check(2 * k + 1, at[right])

    check(1, np.arange(500))
    assert len(nodes) > 7


def test_features_are_counted_together(monkeypatch):
    """A level passes over its rows once for some features together, not for each of them, and the trees stay those of features counted alone."""
    rng, width, seen = np.random.default_rng(5), 12, []
    sizes = [2, 3, 2, 7, *[trees.BINS] * 8]
    bins, label = np.stack([rng.integers(0, s, 4000) for s in sizes]).astype(np.uint8), rng.integers(0, 2, 4000).astype(np.int32)
    key, own = np.arange(4000, dtype=np.uint64), {"maxIter": 3, "maxDepth": 4, "stepSize": 0.1, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}
    count = np.bincount
    monkeypatch.setattr(np, "bincount", lambda a, *more, **named: seen.append(len(a)) or count(a, *more, **named))
    together = [np.array(t) for t in trees.grown(bins, label, key, Alone(), 2.0, own, 1)]
    assert 0 < sum(seen) < 3 * 4 * 4000 * 2 * width * 0.25
    some = [np.array(t) for t in trees.grown(bins, label, key, Alone(), 2.0, own, 1, sizes)]
    monkeypatch.setattr(trees, "CELLS", trees.BINS)
    alone = [np.array(t) for t in trees.grown(bins, label, key, Alone(), 2.0, own, 1)]
    assert all(np.array_equal(a, b) and np.array_equal(a, c) for a, b, c in zip(together, some, alone, strict=True))
