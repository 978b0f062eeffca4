import random

from kinweave import values as V
from kinweave.operators import model


def test_rounds_and_depth_of_the_method():
    assert (model.PRODUCTION["maxIter"], model.PRODUCTION["maxDepth"]) == (350, 6)
    assert (model.BASELINE["maxIter"], model.BASELINE["maxDepth"], model.PATIENCE) == (600, 8, 50)


def test_early_stopping_waits():
    assert model.best_round([5.0, 4.0, 4.5, 3.0, 3.5, 3.6, 1.0], 2) == 4
    assert model.best_round([5.0, 4.0, 4.5, 3.0, 3.5, 3.6, 1.0], 3) == 7
    assert model.best_round([1.0], 50) == 1


def test_model_ends_at_its_best_round(spark):
    rng = random.Random(7)
    rows = [[rng.random() for _ in V.FEATURES] for _ in range(300)]
    rows = [[*r, int((r[0] > 0.5) != (rng.random() < 0.3))] for r in rows]
    df = spark.createDataFrame(rows, [*V.FEATURES, "label"])
    small = model.BASELINE | {"maxIter": 8, "maxDepth": 3}
    full, held = model.train(df.limit(200), small), spark.createDataFrame(rows[200:], df.schema)
    cut = model.first_rounds(full, 3)
    assert (full.getNumTrees, cut.getNumTrees) == (8, 3) and cut.treeWeights == full.treeWeights[:3]
    assert model.predict(cut, held).count() == 100 and len(cut.featureImportances) == 23
    assert 1 <= model.train(df.limit(200), small, validation=held, patience=1).getNumTrees <= 8
