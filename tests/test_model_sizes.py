"""Grids, curves and scores at the reference's own sizes; estimators are recorded, not fitted."""

from pyspark.ml.linalg import Vectors

from cohortlens.operators import models as M
from cohortlens.plans import models as P
from cohortlens.plans.registry import REGISTRY


def test_every_grid_and_curve_is_a_query(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(P, "rounded", lambda x: x)
    monkeypatch.setattr(P, "prepared", lambda *_: (None, None))
    monkeypatch.setattr(P, "everything", lambda *_: None)
    monkeypatch.setattr(M, "grid_search", lambda est, params, *_, **__: None)
    monkeypatch.setattr(M, "grid_results", lambda cv, est, params: (type(est).__name__, params))
    monkeypatch.setattr(M, "boosted_search", lambda est, params, *_, **__: (type(est).__name__, params))
    monkeypatch.setattr(M, "validation_curve", lambda make, depths, *_, **__: [(type(e := make(d)).__name__, e.getMaxDepth()) for d in depths])
    monkeypatch.setattr(M, "cv_accuracy", lambda est, *_, **__: est)
    for name in ("mdl_grid_forest", "mdl_grid_boost", "mdl_grid_surgery_forest", "mdl_grid_surgery_boost", "mdl_val_curve_forest", "mdl_val_curve_boost", "mdl_cv_score", "mdl_cv_score_boost"):
        assert name in REGISTRY
        seen[name] = getattr(P, name)(None, None)
    assert seen["mdl_grid_boost"] == ("GBTClassifier", P.GRIDS["boost"])
    assert seen["mdl_grid_surgery_forest"] == ("RandomForestClassifier", P.SURGERY_GRIDS["forest"])
    assert seen["mdl_grid_surgery_boost"] == ("GBTClassifier", P.SURGERY_GRIDS["boost"])
    assert M.grid_notes(seen["mdl_grid_forest"][1]) == "min_samples_split left out"
    assert seen["mdl_val_curve_forest"] == [("RandomForestClassifier", d) for d in range(1, 21)]
    assert seen["mdl_val_curve_boost"] == [("GBTClassifier", d) for d in range(1, 21)]
    assert seen["mdl_cv_score"].getMaxDepth() == 30 and seen["mdl_cv_score"].getNumTrees() == 100
    assert (seen["mdl_cv_score_boost"].getMaxIter(), seen["mdl_cv_score_boost"].getMaxDepth()) == (100, 6)


def test_the_compared_boosted_model_is_the_best_of_its_grid(spark, monkeypatch):
    data = [(i, float((i * 7 % 13 + (i % 3) * 4 > 9) != (i % 11 == 0)), Vectors.dense(i * 7 % 13, i % 3, i * 31 % 17), i % 5, 1.0) for i in range(200)]
    rows = spark.createDataFrame(data, ["doc_id", "label", "features", "fold", "weight"]).persist()
    monkeypatch.setattr(P, "prepared", lambda *_: (rows, rows))
    small = {"tree": {"maxDepth": [2]}, "forest": {"numTrees": [2], "maxDepth": [2]}, "boost": {"maxIter": [1, 4], "maxDepth": [1, 3], "stepSize": [0.5], "subsamplingRate": [1.0]}}
    monkeypatch.setattr(P, "GRIDS", small)
    found = {r["params"]: r["mean_auc"] for r in M.boosted_search(M.boosted(), small["boost"], rows).collect()}
    best = dict(P._searched(spark, None))["boosted_trees"]
    got = ", ".join(f"{p}={best.getOrDefault(p)}" for p in ("maxDepth", "maxIter", "stepSize", "subsamplingRate"))
    assert len(found) == 4 and found[got] == max(found.values()) > min(found.values())
    rows.unpersist()
