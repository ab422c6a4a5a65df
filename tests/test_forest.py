"""The forest grown from bins: its cuts against plain loops, its model beside Spark's own fit, the same in any groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.operators import forest, models


def table(spark, n=3000):
    rng = np.random.default_rng(5)
    a, b, c = rng.random(n), rng.normal(size=n), rng.integers(0, 3, n)
    label = np.where(a > 0.6, "x", np.where(b + 0.3 * rng.normal(size=n) > 0.2, "y", "z"))
    rows = [(float(p), float(q), float(r), str(s)) for p, q, r, s in zip(a, b, c, label)]
    return spark.createDataFrame(rows, "a double, b double, c double, Label string")


def fitted(spark, monkeypatch, many, trees=20):
    monkeypatch.setattr(models, "MANY_ROWS", many)
    return models.fit_intrusion(table(spark), ["a", "b", "c"], trees=trees, depth=4)


def test_best_cut_of_a_node():
    rng = np.random.default_rng(2)
    sums = rng.integers(0, 9, (2, 3, 5, 4))
    sums[1] = sums[0, :, rng.permutation(5)].transpose(1, 0, 2)  # both features see the same rows
    used = np.array([[True, True, False], [True, False, True]])
    for node, row in enumerate(forest.best_cuts(sums, used)):
        best = (-1.0,)
        for f in range(2):
            for cut in range(4):
                left, right = sums[f, node, : cut + 1].sum(axis=0), sums[f, node, cut + 1 :].sum(axis=0)
                n, parts = left.sum() + right.sum(), 0
                for side in (left, right):
                    parts += side.sum() / n * (1 - sum((v / side.sum()) ** 2 for v in side)) if side.sum() else 0
                whole = left + right
                gain = 1 - sum((v / n) ** 2 for v in whole) - parts
                if used[f, node] and left.sum() and right.sum() and gain > best[0] + 1e-12:
                    best = (gain, f, cut, *left, *whole)
        assert np.allclose(row, best)


def test_rows_take_part_as_often_as_spark_draws_them():
    often = np.bincount(forest.poisson(0.8), minlength=4) / (1 << 16)
    assert np.allclose(often[:3], [np.exp(-0.8), 0.8 * np.exp(-0.8), 0.32 * np.exp(-0.8)], atol=1e-4)


def test_large_tables_get_a_forest_like_sparks(spark, monkeypatch, tmp_path):
    own, sparks = fitted(spark, monkeypatch, 100), fitted(spark, monkeypatch, 1_000_000)
    stage, other = own.stages[2], sparks.stages[2]
    assert (stage.getNumTrees, stage.numClasses, stage.numFeatures) == (other.getNumTrees, other.numClasses, other.numFeatures) == (20, 4, 3)
    assert max(t.depth for t in stage.trees) == 4
    right = F.avg((F.col("predicted") == F.col("Label")).cast("double"))
    a, b = (models.predictions(m, table(spark)).agg(right).first()[0] for m in (own, sparks))
    assert a > 0.85 and abs(a - b) < 0.03
    assert max(abs(x - y) for x, y in zip(stage.featureImportances.toArray(), other.featureImportances.toArray())) < 0.15
    own.write().overwrite().save(str(tmp_path / "m"))
    again = type(own).load(str(tmp_path / "m"))
    rows = [sorted(map(str, models.predictions(m, table(spark)).collect())) for m in (own, again)]
    assert rows[0] == rows[1]


def test_groups_of_trees_change_nothing(spark, monkeypatch):
    whole = fitted(spark, monkeypatch, 100, trees=4).stages[2].toDebugString
    monkeypatch.setattr(forest, "GROUP_BYTES", 1)
    cut = fitted(spark, monkeypatch, 100, trees=4).stages[2].toDebugString
    assert whole.split("\n")[1:] == cut.split("\n")[1:]


def test_missing_features_are_refused(spark, monkeypatch):
    monkeypatch.setattr(models, "MANY_ROWS", 1)
    rows = spark.createDataFrame([(1.0, "x"), (None, "y")], "a double, Label string")
    with pytest.raises(Exception, match="a feature is missing"):
        models.fit_intrusion(rows, ["a"], trees=2, depth=2)
