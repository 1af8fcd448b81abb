"""Forests on many rows: same kind of model as MLlib's, grown from blocks of bins."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from casetrail.operators import models as M
from casetrail.operators import stats as E
from casetrail.session import cut_lineage


@pytest.fixture(scope="module")
def rows(spark):
    x, z = F.rand(1), F.rand(2)
    flag = (F.col("id") % 3 == 0).cast("int")
    y = ((x + 0.5 * flag + 0.3 * F.rand(3)) > 0.9).cast("int")
    return cut_lineage(spark.range(6000).select("id", x.alias("x"), z.alias("z"), flag.alias("flag"), y.alias("y")))


def test_large_forest_is_grown_from_blocks(spark, rows, monkeypatch, tmp_path):
    names, size = ["x", "z", "flag"], {"numTrees": 20, "maxDepth": 6}
    plain = M.train_model(rows, names, "forest", **size)
    monkeypatch.setattr(M, "bounded", lambda df, max_rows=100_000: False)
    monkeypatch.setattr(M.RandomForestClassifier, "_fit", only_few(M.RandomForestClassifier._fit))
    model = M.train_model(rows, names, "forest", **size)
    trees = model.stages[-1]
    assert (trees.getNumTrees, trees.numClasses, trees.numFeatures) == (20, 2, 3)
    assert max(t.depth for t in trees.trees) == 6
    importance = trees.featureImportances.toArray()
    assert importance[0] > importance[2] > importance[1]
    both = [M.score(m, rows).select("id", "y", "p") for m in (plain, model)]
    areas = [E.auroc(s).first()["auroc"] for s in both]
    assert areas[1] == pytest.approx(areas[0], abs=0.01)
    assert both[0].withColumnRenamed("p", "q").join(both[1], "id").agg(F.corr("p", "q")).first()[0] > 0.98
    M.save_model(model, str(tmp_path / "m"))
    again = M.score(PipelineModel.load(str(tmp_path / "m")), rows, "again").join(both[1], "id")
    assert again.where("again <> p").count() == 0


def only_few(fit):
    def checked(self, dataset):
        assert dataset.count() < 100, "MLlib's passes over all rows and trees"
        return fit(self, dataset)
    return checked


def test_tree_splits_are_the_best_ones(spark, monkeypatch):
    """One tree over all features against the gains of all limits, with as many rows in every leaf as asked for."""
    from casetrail.operators import forest

    # Every row is taken exactly once, so that the sums are known.
    monkeypatch.setattr(forest, "_TIMES", np.array([0] + [2**32] * 12, np.uint64))
    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, (500, 2)).astype(float)
    y = ((x[:, 0] > 6) ^ (rng.random(500) < 0.2)).astype(int)
    df = spark.createDataFrame([(*map(float, a), int(b)) for a, b in zip(x, y)], "a double, b double, y int")
    monkeypatch.setattr(M, "bounded", lambda df, max_rows=100_000: False)
    model = M.train_model(df, ["a", "b"], "forest", weighted=False, numTrees=1, maxDepth=1, minInstancesPerNode=5, featureSubsetStrategy="all")
    gini = lambda v: 1 - v.mean() ** 2 - (1 - v.mean()) ** 2 if len(v) else 0.0
    best = max((gini(y) - (left.mean() * gini(y[left]) + (~left).mean() * gini(y[~left])), f, t) for f in (0, 1) for t in np.arange(0.5, 11) for left in [x[:, f] <= t])
    assert f"feature {best[1]} <= {best[2]}" in model.stages[-1].trees[0].toDebugString
    scored = M.score(model, df)
    assert {round(r["p"], 9) for r in scored.collect()} == {round(float(y[x[:, best[1]] <= best[2]].mean()), 9), round(float(y[x[:, best[1]] > best[2]].mean()), 9)}
