"""Fits dealt out as tasks score as Spark ML's own fits do; what they don't cover is left to Spark ML."""

import statistics

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from cohortlens.operators import fits
from cohortlens.operators import models as M


def auc_of(df):
    return BinaryClassificationEvaluator(metricName="areaUnderROC", numBins=0).evaluate(df)


def accuracy_of(df):
    return MulticlassClassificationEvaluator(metricName="accuracy").evaluate(df)


def table(spark, n, partitions=1):
    draw = np.random.default_rng(5)
    x = np.stack([draw.lognormal(8, 1, n).round(), draw.poisson(20, n), draw.beta(1, 9, n) * (draw.random(n) > .3), draw.random(n) < .2], axis=1).astype(float)
    y = (x[:, 0] > 3000) ^ (x[:, 2] > .1) ^ (draw.random(n) < .3)
    rows = [(float(y[i]), Vectors.dense(x[i]), i % 3, 1.0 + 0.5 * float(y[i]), i) for i in range(n)]
    return spark.createDataFrame(rows, ["label", "features", "fold", "weight", "id"]).repartition(partitions).persist()


@pytest.fixture(scope="module")
def rows(spark):
    return table(spark, 900)


def by_spark(estimator, df, fold):
    model = estimator.fit(df.where(F.col("fold") != fold))
    return model, model.transform(df.where(F.col("fold") == fold)), model.transform(df.where(F.col("fold") != fold))


@pytest.mark.parametrize("subsample, weight", [(0.8, None), (1.0, "weight")])
def test_boosted_scores_are_those_of_spark(spark, rows, subsample, weight):
    est = M.boosted(n_trees=6, max_depth=4, step=0.3, subsample=subsample, weight_col=weight)
    auc = fits.scores(rows, [est], [[2, 6]], "auc", "fold", 3)
    hits = fits.scores(rows, [est], [[6]], "accuracy", "fold", 3)
    for fold in range(3):
        model, held, own = by_spark(est, rows, fold)
        assert auc[0][fold][1] == pytest.approx([auc_of(held)], abs=1e-3)  # margins that tie but for rounding
        assert auc[0][fold][0] == pytest.approx([auc_of(M.first_rounds(model, 2).transform(rows.where(F.col("fold") == fold)))], abs=1e-3)  # margins that tie but for rounding
        assert hits[0][fold] == [pytest.approx([accuracy_of(held), accuracy_of(own)])]


def test_thresholds_of_a_sample_and_draws_of_partitions(spark):
    df = table(spark, 36_000, 2)
    for n in (36_000, 18_000):  # a sample of fewer than 0.4 of the rows, and of more
        some = df.where(F.col("id") < n)
        est = M.boosted(n_trees=3, max_depth=3, step=0.1, subsample=0.7)
        got = fits.scores(some, [est], [[3]], "auc", "fold", 3)
        assert got[0][1][0] == pytest.approx([auc_of(by_spark(est, some, 1)[1])], abs=1e-3)  # margins that tie but for rounding
    df.unpersist()


def test_boosted_searches_curves_and_scores_run_no_job_per_round(spark, rows, monkeypatch):
    est = M.boosted(n_trees=3, max_depth=2)
    want = [accuracy_of(by_spark(est, rows, f)[1]) for f in range(3)]

    def refuse(*_):
        raise AssertionError("fitted by Spark ML")

    monkeypatch.setattr(GBTClassifier, "_fit", refuse)
    assert M.boosted_search(M.boosted(), {"maxIter": [2, 3], "maxDepth": [2, 3]}, rows, k=3).count() == 4
    assert M.cv_accuracy(est, rows, k=3).first()["mean_accuracy"] == pytest.approx(statistics.fmean(want))
    curve = M.validation_curve(lambda d: M.boosted(n_trees=3, max_depth=d), [1, 2], rows, k=3).orderBy("depth").collect()
    assert curve[1]["valid_mean"] == pytest.approx(statistics.fmean(want)) and curve[1]["valid_sd"] == pytest.approx(statistics.pstdev(want))


def test_what_needs_more_is_left_to_spark(spark, rows, monkeypatch):
    est = M.boosted(n_trees=2, max_depth=2)
    assert fits.scores(rows, [M.tree(max_depth=2)], [[]], "auc", "fold", 3) is None
    assert fits.scores(rows, [est.copy({est.minInfoGain: 0.1})], [[2]], "auc", "fold", 3) is None
    assert fits.scores(rows.withColumn("label", F.when(F.col("fold") == 1, 0.0).otherwise(F.col("label"))), [est], [[2]], "auc", "fold", 3) is None
    assert fits.scores(rows.withColumn("weight", F.lit(None).cast("double")), [M.boosted(n_trees=2, weight_col="weight")], [[2]], "auc", "fold", 3) is None
    want = M.cv_accuracy(est, rows, k=3).first()
    monkeypatch.setattr(fits, "MOST_VALUES", 100)
    assert fits.scores(rows, [est], [[2]], "auc", "fold", 3) is None
    assert M.cv_accuracy(est, rows, k=3).first()["mean_accuracy"] == pytest.approx(want["mean_accuracy"])


@pytest.mark.parametrize("memory, weight", [(256, "weight"), (1, None)])
def test_forests_of_all_depths_score_as_fits_of_their_own(spark, rows, memory, weight):
    ests = [M.forest(n_trees=40, max_depth=d, weight_col=weight).setMaxMemoryInMB(memory) for d in (3, 7, 12)]
    auc = fits.scores(rows, ests, [[3], [7], [12]], "auc", "fold", 3)
    hits = fits.scores(rows, ests, [[3], [7], [12]], "accuracy", "fold", 3)
    for i, est in enumerate(ests):
        _, held, own = by_spark(est, rows, 1)
        assert auc[i][1] == [pytest.approx([auc_of(held)])]
        assert hits[i][1] == [pytest.approx([accuracy_of(held), accuracy_of(own)])]


def test_forests_draw_by_partition_and_in_groups_of_nodes(spark, monkeypatch):
    df = table(spark, 12_000, 2)
    est = M.forest(n_trees=25, max_depth=14, min_leaf=2).setMaxMemoryInMB(1)
    groups = []
    grown = fits._forest
    x, y, fold = (np.array([r[c].toArray() if c == "features" else r[c] for r in df.collect()]) for c in ("features", "label", "fold"))
    monkeypatch.setattr(fits, "_forest", lambda *a: groups.append(out := grown(*a)) or out)
    spec = fits.specification(est) | {"stages": [14, 6], "metric": "auc"}
    sizes = [len(p) for p in df.rdd.glom().collect()]
    parts = [(0, sizes[0]), (sizes[0], 12_000)]
    with np.errstate(all="ignore"):
        votes = dict(fits.forest_votes(x.T.copy(), y, np.ones(12_000), parts, fold == 1, spec, fits._draws(spark, sizes, 25, 42)))
    assert not groups[0][1] and len(groups) == 2 and set(votes) == {6, 14}  # not all at once: shallower ones are grown again
    got = fits.scores(df, [est], [[14]], "auc", "fold", 3)
    assert got[0][1] == [pytest.approx([auc_of(by_spark(est, df, 1)[1])])]
    assert got[0][1] == [pytest.approx([fits.auc(votes[14][0][1], y[fold == 1])])]
    df.unpersist()


def test_forest_searches_curves_and_scores_hold_no_forest_on_the_driver(spark, rows, monkeypatch):
    want = [accuracy_of(by_spark(M.forest(n_trees=4, max_depth=3), rows, f)[1]) for f in range(3)]

    def refuse(*_):
        raise AssertionError("fitted by Spark ML")

    monkeypatch.setattr(RandomForestClassifier, "_fit", refuse)
    assert M.cv_accuracy(M.forest(n_trees=4, max_depth=3), rows, k=3).first()["mean_accuracy"] == pytest.approx(statistics.fmean(want))
    curve = M.validation_curve(lambda d: M.forest(n_trees=4, max_depth=d), [2, 3], rows, k=3).orderBy("depth").collect()
    assert curve[1]["valid_mean"] == pytest.approx(statistics.fmean(want))
    found = M.grid_search(M.forest(), {"numTrees": [3, 4], "maxDepth": [2, 3]}, rows, k=3, refit=False)
    assert len(found.avgMetrics) == 4 and found.bestModel is None
