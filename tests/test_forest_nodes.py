"""A forest's single fit notes the nodes of rows from level to level; trees and stated parameters are those of a plain fit."""

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.linalg import Vectors

from cohortlens.operators import models as M


def test_forest_notes_nodes_and_gives_the_same_trees(spark, monkeypatch):
    data = [(i, float((i * 7 % 13 + (i % 3) * 4 > 9) != (i % 11 == 0)), Vectors.dense(i * 7 % 13, i % 3, i * 31 % 17)) for i in range(400)]
    rows = spark.createDataFrame(data, ["id", "label", "features"]).coalesce(2).persist()
    est = M.forest(n_trees=7, max_depth=8)
    plain = est.fit(rows)
    asked = []
    fit = RandomForestClassifier._fit
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda self, df: asked.append((self.getCacheNodeIds(), self.getCheckpointInterval())) or fit(self, df))
    record, model = M.train_eval("forest", est, rows, rows)
    assert asked == [(True, -1)]
    assert model.toDebugString.split("\n")[1:] == plain.toDebugString.split("\n")[1:]
    assert [tuple(r) for r in M.param_table(model).collect()] == [tuple(r) for r in M.param_table(plain).collect()]
    assert record.first()["model"] == "forest" and est.getCacheNodeIds() is False
    rows.unpersist()


def test_other_estimators_are_fitted_as_they_are(spark):
    rows = spark.createDataFrame([(float(i % 2), Vectors.dense(i % 5, i % 2)) for i in range(60)], ["label", "features"])
    _, model = M.train_eval("tree", M.tree(max_depth=2), rows, rows)
    assert model.toDebugString.split("\n")[1:] == M.tree(max_depth=2).fit(rows).toDebugString.split("\n")[1:]


def test_a_forest_of_many_rows_is_fitted_in_parts(spark, monkeypatch):
    data = [(i, float((i * 7 % 13 + (i % 3) * 4 > 9) != (i % 11 == 0)), Vectors.dense(i * 7 % 13, i % 3, i * 31 % 17)) for i in range(400)]
    rows = spark.createDataFrame(data, ["id", "label", "features"]).coalesce(2).persist()
    est = M.forest(n_trees=7, max_depth=8)
    plain = est.fit(rows)
    asked = []
    fit = RandomForestClassifier._fit
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda self, df: asked.append((self.getNumTrees(), self.getFeatureSubsetStrategy())) or fit(self, df))
    monkeypatch.setattr(M, "MOST_NOTED", 1_000)
    model = M.fit_single(est, rows)
    assert asked == [(2, "sqrt"), (2, "sqrt"), (3, "sqrt")]
    assert [tuple(r) for r in M.param_table(model).collect()] == [tuple(r) for r in M.param_table(plain).collect()]
    texts = [t.toDebugString.split("\n", 1)[1] for t in model.trees]
    assert len(set(texts)) == model.getNumTrees == 7  # draws of every tree are its own
    assert abs(model.featureImportances.toArray().sum() - 1) < 1e-9
    votes = model.transform(rows).select("rawPrediction").first()[0]
    assert abs(votes.toArray().sum() - 7) < 1e-9
    rows.unpersist()
