"""Encoders with inverse and unseen levels, clamped grids, model records, curves and the four-section findings."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortlens.operators import models as M
from cohortlens.operators.cohort import prepare_surgery
from cohortlens.operators.report import findings


@pytest.fixture(scope="module")
def points(spark):
    rows = [(i, float(i % 17), float(i % 5), float((i % 17 > 8) ^ (i % 5 == 0))) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double").withColumn("fold", (F.col("id") % 5).cast("int"))
    return M.assemble(df.withColumn("w", F.when(F.col("y") == 1, 2.0).otherwise(1.0)), ["a", "b"], "y")


def test_label_codes_decode_and_fit_on_training_rows(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("b",)], "v string")
    codes = M.label_codes(train, "v")
    assert {r["level"]: r["code"] for r in codes.collect()} == {"a": 0, "b": 1, "c": 2}
    rows = spark.createDataFrame([("c",), ("z",), (None,), ("a",)], "v string")
    coded = M.label_encode(rows, "v", "code", fit_on=train)
    assert {(r["v"], r["code"]) for r in coded.collect()} == {("c", 2), ("z", None), (None, None), ("a", 0)}
    back = M.label_decode(coded, codes, "code", "again")
    assert {(r["v"], r["again"]) for r in back.collect()} == {("c", "c"), ("z", None), (None, None), ("a", "a")}


def test_one_hot_vector_has_no_bound_on_levels(spark):
    df = spark.range(3000).select(F.format_string("l%05d", F.col("id") % 1500).alias("v"))
    with pytest.raises(ValueError, match="one_hot_vector"):
        M.one_hot(df, ["v"])
    out = M.one_hot_vector(df.limit(0).unionByName(df), "v", "vec").limit(50).withColumn("x", vector_to_array("vec")).collect()
    for r in out:
        code = int(r["v"][1:])
        assert len(r["x"]) == 1499 and sum(r["x"]) == (code > 0) and (code == 0 or r["x"][code - 1] == 1.0)
    small = spark.createDataFrame([("a",), ("b",), (None,), ("q",)], "v string")
    fitted = M.one_hot_vector(small, "v", "vec", drop_first=False, fit_on=small.where("v <> 'q'")).withColumn("x", vector_to_array("vec"))
    assert {r["v"]: r["x"] for r in fitted.collect()} == {"a": [1.0, 0.0], "b": [0.0, 1.0], None: [0.0, 0.0], "q": [0.0, 0.0]}


def test_missing_features_raise_unless_asked_otherwise(spark):
    df = spark.createDataFrame([(1.0, 0.0), (None, 1.0)], "a double, y double")
    with pytest.raises(Exception, match="(?i)null"):
        M.assemble(df, ["a"], "y").select("features").collect()
    assert M.assemble(df, ["a"], "y", handle_invalid="skip").count() == 1


def test_deep_trees_raise_and_grids_record_what_they_change(points):
    with pytest.raises(ValueError, match="30"):
        M.tree(max_depth=31)
    params = {"maxDepth": [20, 30, 40], "minInstancesPerNode": [1], "min_samples_split": [2, 5]}
    assert len(M.grid(M.tree(), params)) == 2
    assert M.grid_notes(params) == "maxDepth 40 -> 30; min_samples_split left out"
    est = M.tree()
    rows = M.grid_results(M.grid_search(est, {"maxDepth": [1, 2]}, points, k=5), est, params).collect()
    assert len(rows) == 2 and all(r["notes"].startswith("maxDepth 40") for r in rows)


def test_model_record_holds_the_report_and_weights_change_the_fit(spark, points):
    train, test = points.where("fold <> 0"), points.where("fold = 0")
    row, model = M.train_eval("t", M.tree(max_depth=4), train, test)
    r = row.first()
    lines = r["report"].split("\n")
    assert [x.split(" ")[0] for x in lines] == ["0", "1", "accuracy", "macro", "weighted"]
    assert r["tn"] + r["fp"] + r["fn"] + r["tp"] == test.count() and f"{r['accuracy']:.4f}" in lines[2]
    weighted = M.tree(max_depth=1, weight_col="w").fit(train)
    assert weighted.toDebugString != M.tree(max_depth=1).fit(train).toDebugString or weighted.getWeightCol() == "w"
    assert M.boosted(n_trees=2, weight_col="w").getWeightCol() == "w"
    table = M.metric_table(model, ["a", "b"], train, test).collect()
    names = [x["name"] for x in table if x["section"] == "metric"]
    assert names == ["f1_train", "f1_test", "sse", "sst", "r2"]
    assert [x["name"] for x in table if x["section"] == "importance"] and any(x["name"] == "maxDepth" for x in table)


def test_curves_cover_every_depth(points):
    curve = M.validation_curve(lambda d: M.tree(max_depth=d), [1, 3], points).orderBy("depth").collect()
    assert [r["depth"] for r in curve] == [1, 3] and curve[1]["train_mean"] >= curve[0]["train_mean"]
    train, test = points.where("fold <> 0"), points.where("fold = 0")
    depth = M.depth_curve(lambda d: M.tree(max_depth=d), [1, 2, 4], train, test).orderBy("depth").collect()
    one = M.tree(max_depth=2).fit(train)
    hits = one.transform(test).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert depth[1]["test_accuracy"] == pytest.approx(hits)


def test_findings_layout(spark):
    prevalence = spark.createDataFrame([("S", 20.0), ("R", 50.0)], "name string, percent double")
    top = spark.createDataFrame([("R:1", 7, 70.0), ("R:0", 3, 30.0)], "value string, count long, percent double")
    positive = spark.createDataFrame([(3, "R", 2.0), (4, "S", 5.5)], "stage int, treatment string, efficacy_pct double")
    best = spark.createDataFrame([("forest", 0.8)], "model string, auc double")
    imp = spark.createDataFrame([("age", 0.3), ("size", 0.6)], "feature string, importance double")
    params = spark.createDataFrame([("maxDepth", "5"), ("impurity", "gini")], "param string, value string")
    out = findings(prevalence, top, positive, ["stage", "treatment"], ["R", "S"], best, imp, params, 12.5)
    assert [tuple(r) for r in out.orderBy("section", "rank").collect()] == [
        ("1 prevalence", 1, "R", 50.0), ("1 prevalence", 2, "S", 20.0),
        ("2 top combinations", 1, "R:1", 70.0), ("2 top combinations", 2, "R:0", 30.0),
        ("3 positive effects", 1, "4 | S", 5.5), ("3 positive effects", 2, "3 | R", 2.0),
        ("4 best model", 1, "forest", 0.8), ("4 best model", 2, "size", 0.6), ("4 best model", 3, "age", 0.3),
        ("4 best model", 4, "impurity = gini", None), ("4 best model", 5, "maxDepth = 5", None), ("4 best model", 6, "total processing time (s)", 12.5)]


def test_surgery_features(spark):
    rows = [
        (1, "2020-01-01", "III", "12", "Pulmonar", "Current", "10", "3,5", 60, "Deceased", "F"),
        (2, "2020-01-01", "IV", "7", "Mama", "Former", "4.0", "2.25", 50, "Alive", "M"),
        (3, "N/A", "III", "12", "Pulmonar", "Never", "10", "3,5", 60, "Alive", "F"),
        (4, None, "III", "12", "Pulmonar", "Never", "10", "3,5", 60, "Alive", "F"),
        (5, "2020-01-01", "I", "12", "Pulmonar", "Never", "10", "3,5", 60, "Alive", "F"),
        (6, "2020-01-01", "III", "soon", "Pulmonar", "Never", "10", "3,5", 60, "Alive", "F"),
        (7, "2020-01-01", "III", "1", None, "Never", "1", "1", 40, None, "F")]
    df = spark.createDataFrame(rows, "id long, SurgeryDate string, CancerStage string, Days string, TumorType string, Smoking string, "
                                     "FollowUp string, TumorSize string, Age int, SurvivalStatus string, Gender string")
    got = {r["id"]: r.asDict() for r in prepare_surgery(df, ["id"]).collect()}
    assert set(got) == {1, 2, 7}
    assert (got[1]["lung_and_smoked"], got[1]["lung_smoker_weight"], got[1]["tumor_size"], got[1]["outcome"]) == (1, 2, 3.5, 1)
    assert (got[2]["lung_and_smoked"], got[2]["lung_smoker_weight"], got[2]["Gender_M"], got[2]["CancerStage_IV"]) == (0, 0, 1, 1)
    assert (got[7]["Smoking_Former"], got[7]["Smoking_Never"], got[7]["outcome"]) == (0, 1, 0)
