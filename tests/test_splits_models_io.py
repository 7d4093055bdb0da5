"""Splits, folds and weights; Spark ML wrappers; readers and writers (N1)."""

import math
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import models as M
from cohortlens.operators import splits as SP
from cohortlens.sources import io as IO


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.range(1, 1001).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"))


def test_random_split_size(spark, labelled):
    s = SP.random_split(labelled, "id", 0.2)
    assert s.where("is_test = 1").count() == math.ceil(0.2 * 1000)
    again = SP.random_split(labelled, "id", 0.2)
    assert s.where("is_test = 1").select("id").exceptAll(again.where("is_test = 1").select("id")).count() == 0


def test_stratified_split_keeps_class_shares(spark, labelled):
    s = SP.stratified_split(labelled, "id", "y", 0.3)
    got = {r["y"]: r["n"] for r in s.where("is_test = 1").groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert got == {1: math.ceil(0.3 * 333), 0: math.ceil(0.3 * 667)}


def test_folds_disjoint_cover_and_sizes(spark, labelled):
    f = SP.kfold(labelled, "id", 5)
    sizes = sorted(r["n"] for r in f.groupBy("fold").agg(F.count("*").alias("n")).collect())
    assert sizes == [200] * 5 and f.count() == 1000
    first = [r["id"] for r in f.where("fold = 0").orderBy("id").collect()]
    assert first == list(range(1, 201))  # contiguous, unshuffled
    uneven = SP.kfold(labelled.where("id <= 13"), "id", 5)
    assert sorted(r["n"] for r in uneven.groupBy("fold").agg(F.count("*").alias("n")).collect()) == [2, 2, 3, 3, 3]
    strat = SP.kfold(labelled, "id", 5, label="y", order="hash")
    per = strat.groupBy("y", "fold").count().collect()
    assert len(per) == 10 and max(r["count"] for r in per) - min(r["count"] for r in per if r["y"] == 1) <= 68


@pytest.mark.parametrize("blocks", [None, 300])
def test_splits_and_folds_with_text_missing_and_repeated_ids(spark, monkeypatch, blocks):
    from cohortlens.operators import prefix

    monkeypatch.setattr(prefix, "BLOCKS", blocks)
    rows = [(f"id{i:04d}", "a" if i % 3 else None) for i in range(1500)] + [(None, "a")] * 5 + [("id0003", "a")] * 4
    df = spark.createDataFrame(rows, "id string, y string")
    n = len(rows)
    split = SP.random_split(df, "id", 0.2)
    tests = split.where("is_test = 1").count()
    assert split.count() == n and math.ceil(0.2 * n) <= tests <= math.ceil(0.2 * n) + 5
    assert split.groupBy("id").agg(F.count_distinct("is_test").alias("k")).where("k > 1").count() == 0
    strat = SP.stratified_split(df, "id", "y", 0.3)
    assert strat.count() == n
    for y, k in ((None, 500), ("a", n - 500)):
        got = strat.where(F.col("y").eqNullSafe(F.lit(y)) & (F.col("is_test") == 1)).count()
        assert math.ceil(0.3 * k) <= got <= math.ceil(0.3 * k) + 5
    for order in ("id", "hash"):
        folds = {r["fold"]: r["count"] for r in SP.kfold(df, "id", 4, order=order).groupBy("fold").count().collect()}
        assert sum(folds.values()) == n and set(folds) == {0, 1, 2, 3} and max(folds.values()) - min(folds.values()) <= 12
    first = SP.kfold(df, "id", 4).where("fold = 0")
    assert first.where("id IS NULL").count() == 5 and first.agg(F.max("id")).first()[0] < "id0400"
    assert SP.kfold(df.limit(0), "id", 4).count() == 0 and SP.random_split(df.limit(0), "id").count() == 0
    tiny = SP.kfold(spark.range(2), "id", 5).orderBy("id").collect()
    assert [r["fold"] for r in tiny] == [0, 1]


def test_balanced_weights(spark, labelled):
    w = {r["y"]: r["weight"] for r in SP.balanced_weights(labelled, "y").select("y", "weight").distinct().collect()}
    assert w[1] == pytest.approx(1000 / (2 * 333)) and w[0] == pytest.approx(1000 / (2 * 667))


def test_logistic_matches_newton_solution(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(400, 2))
    y = (X @ np.array([1.5, -2.0]) + 0.3 + rng.normal(size=400) > 0).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(X, y)], "a double, b double, y double")
    data = M.assemble(df, ["a", "b"], "y")
    model = M.logistic(C=1.0, n_rows=400, max_iter=200, tol=1e-10).fit(data)
    # scikit-learn objective: 0.5 * |w|^2 + C * sum(logloss), intercept not penalised; Newton iterations
    Xb = np.hstack([X, np.ones((400, 1))])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-Xb @ w))
        g = Xb.T @ (p - y) + np.r_[w[:2], 0.0]
        H = Xb.T @ (Xb * (p * (1 - p))[:, None]) + np.diag([1.0, 1.0, 0.0])
        w -= np.linalg.solve(H, g)
    assert list(model.coefficients.toArray()) == pytest.approx(list(w[:2]), abs=1e-4)
    assert model.intercept == pytest.approx(w[2], abs=1e-4)


def test_tree_models_on_separable_data(spark):
    df = spark.range(600).select("id", (F.col("id") % 2).cast("double").alias("y"))
    df = df.withColumn("x1", F.col("y") * 2 + (F.col("id") % 7) / 10.0).withColumn("x2", (F.col("id") % 5).cast("double"))
    data = M.assemble(df, ["x1", "x2"], "y")
    data = SP.stratified_split(data, "id", "y", 0.3)
    train = SP.kfold(data.where("is_test = 0"), "id", 5, label="y", order="hash").cache()
    test = data.where("is_test = 1").cache()
    for est in (M.tree(3), M.forest(10, 3), M.boosted(10, 2)):
        row, model = M.train_eval("m", est, train, test)
        r = row.first()
        assert r["auc"] > 0.9 and r["tp"] + r["fn"] + r["tn"] + r["fp"] == test.count()
    cv = M.grid_search(M.tree(), {"maxDepth": [1, 40]}, train)
    res = M.grid_results(cv, M.tree()).collect()
    assert len(res) == 2 and any("maxDepth=30" in r["params"] for r in res)  # clamped to Spark's limit
    imp = M.importances(M.forest(10, 3).fit(train), ["x1", "x2"])
    assert M.top_importances(imp, 1).first()["feature"] == "x1"
    assert M.tree_text(M.tree(2).fit(train), ["x1", "x2"]).where(F.col("line").contains("x1")).count() > 0
    vc = M.validation_curve(lambda d: M.tree(d), [1, 2], train)
    assert vc.count() == 2
    assert M.cv_accuracy(M.tree(2), train).first()["mean_accuracy"] > 0.9
    assert M.depth_curve(lambda d: M.tree(d), [1, 2], train, test).count() == 2


def test_logistic_trend_guard(spark):
    one_class = spark.range(10).select(F.col("id").alias("x"), F.lit(1).alias("y"))
    with pytest.raises(ValueError):
        M.logistic_trend(one_class, "x", "y")
    two = spark.range(100).select(F.col("id").alias("x"), (F.col("id") > 50).cast("int").alias("y"))
    pts = M.logistic_trend(two, "x", "y", points=5).orderBy("x").collect()
    assert len(pts) == 5 and pts[0]["p"] < pts[-1]["p"]


def test_encoders(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "t string")
    codes = [r[0] for r in M.label_encode(df, "t", "code").select("code").collect()]
    assert codes == [1, 0, None, 2]
    oh = M.one_hot(df, ["t"]).collect()
    assert [(r["t_b"], r["t_c"]) for r in oh] == [(1, 0), (0, 0), (0, 0), (0, 1)]  # first level 'a' dropped


def test_csv_missing_tokens_and_dispatch(spark):  # N1
    d = tempfile.mkdtemp(prefix="cl-io-", dir="/tmp")
    p = os.path.join(d, "patients.csv")
    with open(p, "w") as f:
        f.write("id,SurgeryDate,Comorbidities\n1,2020-01-01,A\n2,N/A,None\n3,,nan\n")
    df = IO.read_table(spark, p, schema="id int, SurgeryDate string, Comorbidities string")
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "2020-01-01", "A"), (2, None, None), (3, None, None)]
    with pytest.raises(ValueError):
        IO.format_of("data.xlsx")
    out = IO.convert(spark, p, os.path.join(d, "patients.parquet"), schema="id int, SurgeryDate string, Comorbidities string")
    assert IO.read_table(spark, out).count() == 3
    res = IO.filter_and_save(df, "SurgeryDate", ["2020-01-01"], os.path.join(d, "kept.parquet"))
    assert (res["before"], res["after"], res["removed"]) == (3, 2, 1)
    part = IO.write_run(df, os.path.join(d, "runs"), stamp="2025-06-25_19-10-00")
    assert part.endswith("run_ts=2025-06-25_19-10-00") and spark.read.parquet(part).count() == 3


def test_assemble_impute_and_constant_columns(spark):
    from cohortlens.operators.profile import constant_columns

    df = spark.createDataFrame([(1.0, 5.0, 1), (None, 5.0, 0), (3.0, 5.0, 1)], "a double, b double, y int")
    skipped = M.assemble(df, ["a", "b"], "y", handle_invalid="skip")  # the default raises, see test_models_reports
    assert skipped.count() == 2
    filled = M.assemble(df, ["a", "b"], "y", impute="mean").orderBy("y").collect()
    assert [list(r["features"]) for r in filled][0] == [2.0, 5.0]
    assert [r["column"] for r in constant_columns(df, ["a", "b", "y"]).collect()] == ["b"]


def test_run_folders_append_and_formats_round_trip(spark):
    d = tempfile.mkdtemp(prefix="cl-io-", dir="/tmp")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    base = os.path.join(d, "runs")
    first = IO.write_run(df, base, stamp="2025-01-01_00-00-00")
    second = IO.write_run(df.where("id = 1"), base, stamp="2025-01-02_00-00-00")
    assert spark.read.parquet(first).count() == 2 and spark.read.parquet(second).count() == 1
    assert spark.read.parquet(base).select("run_ts").distinct().count() == 2
    for ext in ("json", "orc", "parquet", "csv"):
        p = IO.write_table(df, os.path.join(d, f"t.{ext}"))
        back = IO.read_table(spark, p, schema="id int, v string")
        assert sorted(tuple(r) for r in back.collect()) == [(1, "a"), (2, "b")]


def test_csv_round_trip_of_awkward_fields(spark):
    rows = [(1, 'a "quoted", b'), (2, "two\nlines"), (3, ""), (4, None), (5, "NA"), (6, "comma, only"), (7, 'ends with "'), (8, "back\\slash")]
    df = spark.createDataFrame(rows, "i long, t string")
    path = IO.scratch_path(spark, "awkward") + ".csv"
    IO.write_table(df, path)
    same = IO.read_table(spark, path, na_tokens=None)
    assert sorted((r["i"], r["t"]) for r in same.collect()) == rows and dict(same.dtypes)["i"] == "bigint"
    missing = IO.read_table(spark, path)
    assert {r["i"]: r["t"] for r in missing.collect()} == {**dict(rows), 3: None, 5: None}
    IO.drop_scratch(spark, path)
    with pytest.raises(ValueError):
        IO.drop_scratch(spark, "/tmp/elsewhere")


def test_csv_types_after_missing_tokens(spark, tmp_path):
    (tmp_path / "t.csv").write_text('n,x,b,t,e\n1,2.5,True,"a ""b"", c",\nNA,NaN,false,"line\nbreak",\n3,-1e3,,1d,\n')
    df = IO.read_table(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"n": "bigint", "x": "double", "b": "boolean", "t": "string", "e": "string"}
    assert [tuple(r) for r in df.orderBy(F.asc_nulls_last("n")).collect()] == [
        (1, 2.5, True, 'a "b", c', None), (3, -1000.0, None, "1d", None), (None, None, False, "line\nbreak", None)]
    given = IO.read_table(spark, str(tmp_path / "t.csv"), schema="n int, x double, b boolean, t string, e string")
    assert [r["n"] for r in given.orderBy(F.asc_nulls_last("n")).collect()] == [1, 3, None]


def test_no_local_scratch_folder_off_local_mode():
    from cohortlens.session import ensure_checkpoint_dir

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())
