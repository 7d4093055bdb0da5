"""Fits of all folds run side by side; single fits are dealt to several partitions; surgery dummies read finished rows."""

import threading

import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.linalg import Vectors
from pyspark.ml.tuning import CrossValidator

from cohortlens.operators import cohort
from cohortlens.operators import models as M


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, float((i * 7 % 13 + (i % 3) * 4 > 9) != (i % 11 == 0)), Vectors.dense(i * 7 % 13, i % 3, i * 31 % 17), i % 3) for i in range(120)]
    return spark.createDataFrame(data, ["id", "label", "features", "fold"]).coalesce(1).persist()


class Waits(DecisionTreeClassifier):
    meet = threading.Barrier(3, timeout=60)

    def fit(self, dataset, params=None):
        Waits.meet.wait()
        return super().fit(dataset, params)


def test_folds_are_fitted_side_by_side(spark, rows):
    got = M.cv_accuracy(Waits(maxDepth=3), rows, k=3).first()
    assert 0.5 < got["mean_accuracy"] <= 1


def test_grid_search_scores_as_cross_validator_does(spark, rows):
    est, params = M.forest(n_trees=5), {"maxDepth": [1, 2, 4]}
    ev = BinaryClassificationEvaluator(metricName="areaUnderROC", numBins=0)
    want = CrossValidator(estimator=est, estimatorParamMaps=M.grid(est, params), evaluator=ev, foldCol="fold", numFolds=3).fit(rows)
    got = M.grid_search(est, params, rows, k=3)
    assert got.avgMetrics == pytest.approx(want.avgMetrics) and got.stdMetrics == pytest.approx(want.stdMetrics)
    assert got.getEstimatorParamMaps() == want.getEstimatorParamMaps()
    assert got.bestModel.toDebugString.split("\n")[1:] == want.bestModel.toDebugString.split("\n")[1:]


def test_single_fits_read_several_even_partitions(spark):
    n = 3 * M.LEAST_ROWS
    a, b = spark.range(n, numPartitions=2), spark.range(n, numPartitions=7).orderBy("id", ascending=False)
    parts = [M.spread(d, n, "id").rdd.glom().map(lambda p: [r["id"] for r in p]).collect() for d in (a, b)]
    assert parts[0] == parts[1] and len(parts[0]) == 3 and min(map(len, parts[0])) > n / 4
    assert M.spread(a, M.LEAST_ROWS, "id").rdd.getNumPartitions() == 1
    assert M.spread(spark.range(10, numPartitions=4), 100 * M.ROWS_PER_TASK, "id").rdd.getNumPartitions() == 100


def test_surgery_dummies_read_finished_rows(spark, monkeypatch):
    left = spark.createDataFrame([(i, "2020-01-01", ("III", "IV")[i % 2], str(i), "Pulm", ("Never", "Current")[i % 2]) for i in range(8)],
                                 "k int, SurgeryDate string, CancerStage string, Days string, TumorType string, Smoking string")
    right = spark.createDataFrame([(i, "3", "1,5", 50 + i, "Alive", ("F", "M")[i % 2]) for i in range(8)],
                                  "k int, FollowUp string, TumorSize string, Age int, SurvivalStatus string, Gender string")
    read = []
    dummies = M.one_hot
    monkeypatch.setattr(M, "one_hot", lambda df, *a, **b: read.append(df) or dummies(df, *a, **b))
    got = cohort.prepare_surgery(left.join(right, "k"), ["k"])
    assert "Join" not in read[0]._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in got.collect())[1] == (1, 51, 1.0, 3.0, 1.5, 1, 2, 1, 1, 0, 0)
