"""Shorter boosted fits are the first rounds of longer ones; depth limits that no tree reaches share one fit."""

import statistics

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from cohortlens.operators import models as M


@pytest.fixture(scope="module")
def rows(spark):
    data = [(float((i * 7 % 13 + (i % 3) * 4 > 9) != (i % 11 == 0)), Vectors.dense(i * 7 % 13, i % 3, i * 31 % 17), i % 3, 1.0 + i % 2) for i in range(120)]
    return spark.createDataFrame(data, ["label", "features", "fold", "weight"]).persist()


def same(a, b, df):
    p, q = ([tuple(r["probability"].toArray()) for r in m.transform(df).collect()] for m in (a, b))
    return p == q


@pytest.mark.parametrize("subsample", [0.8, 1.0])
def test_first_rounds_are_the_shorter_fit(spark, rows, subsample):
    long = M.boosted(n_trees=6, max_depth=3, step=0.1, subsample=subsample).fit(rows)
    for n in (1, 4, 6, 9):
        short = M.boosted(n_trees=min(n, 6), max_depth=3, step=0.1, subsample=subsample).fit(rows)
        cut = M.first_rounds(long, n)
        assert cut.getNumTrees == min(n, 6) and same(cut, short, rows)


def test_search_scores_every_point_from_the_longest_fits(spark, rows):
    params = {"maxIter": [2, 5], "maxDepth": [2, 3], "stepSize": [0.1]}
    est = M.boosted(weight_col="weight")
    got = {r["params"]: r for r in M.boosted_search(est, params, rows, k=3).collect()}
    assert len(got) == 4
    ev = BinaryClassificationEvaluator(metricName="areaUnderROC", numBins=0)
    aucs = []
    for fold in range(3):
        model = M.boosted(n_trees=2, max_depth=3, step=0.1, weight_col="weight").fit(rows.where(F.col("fold") != fold))
        aucs.append(ev.evaluate(model.transform(rows.where(F.col("fold") == fold))))
    row = got["maxDepth=3, maxIter=2, stepSize=0.1"]
    assert row["mean_auc"] == pytest.approx(statistics.fmean(aucs)) and row["sd_auc"] == pytest.approx(statistics.pstdev(aucs))


def test_limits_beyond_the_deepest_tree_are_fitted_once(spark, rows):
    made = []

    def make(depth):
        made.append(depth)
        return M.tree(max_depth=depth)

    got = M.validation_curve(make, range(1, 25), rows, k=3).orderBy("depth").collect()
    assert len(got) == 24 and made.count(24) == 3 and len(made) < 24 * 3
    for depth in (2, 20, 24):
        valid = []
        for fold in range(3):
            model = M.tree(max_depth=depth).fit(rows.where(F.col("fold") != fold))
            valid.append(model.transform(rows.where(F.col("fold") == fold)).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0])
        assert got[depth - 1]["valid_mean"] == pytest.approx(statistics.fmean(valid))
