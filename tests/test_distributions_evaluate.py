"""Quantiles, box, histogram, KDE, correlation, scaling (scale_small), R² (Q7); classification metrics against the
three saved confusion matrices of the reference, ROC with ties (roc_ties) and AUC invariance."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import distributions as D
from cohortlens.operators import evaluate as EV
from cohortlens.operators import prefix


@pytest.fixture(scope="module")
def sample(spark):
    rng = random.Random(17)
    data = [(rng.choice(["a", "b"]), round(rng.gauss(10, 3), 2), rng.random()) for _ in range(1500)]
    data += [("a", 60.0, 0.5), ("b", -30.0, 0.1)]
    return data, spark.createDataFrame(data, "g string, v double, w double")


def test_quantiles_match_numpy(spark, sample, monkeypatch):
    data, df = sample
    probs = [0.1, 0.25, 0.5, 0.9]
    for blocked in (False, True):
        if blocked:
            monkeypatch.setattr(prefix, "BLOCKS", 8)
        got = {r["g"]: [r[f"q{i}"] for i in range(4)] for r in D.quantiles(df, "v", probs, ["g"]).collect()}
        for g in "ab":
            arr = np.array([v for k, v, _ in data if k == g])
            assert got[g] == pytest.approx(list(np.percentile(arr, [p * 100 for p in probs])), abs=1e-9)


def test_box_summary_whiskers(spark, sample):
    data, df = sample
    box = {r["g"]: r for r in D.box_summary(df, "v", ["g"]).collect()}
    for g in "ab":
        arr = np.array([v for k, v, _ in data if k == g])
        q1, q3 = np.percentile(arr, [25, 75])
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        inside = arr[(arr >= lo) & (arr <= hi)]
        r = box[g]
        assert (r["whisker_low"], r["whisker_high"]) == (inside.min(), inside.max())
        assert r["outliers"] == int(((arr < lo) | (arr > hi)).sum())
        assert r["min"] == arr.min() and r["max"] == arr.max() and r["n"] == len(arr)
    whole = D.box_summary(df, "v").first()
    assert whole["n"] == len(data)


def test_histogram_counts(spark, sample):
    data, df = sample
    h = D.histogram(df, ["v", "w"], bins=7).collect()
    for var, idx in (("v", 1), ("w", 2)):
        arr = np.array([row[idx] for row in data])
        counts, _ = np.histogram(arr, bins=7)
        got = [r["count"] for r in sorted((r for r in h if r["variable"] == var), key=lambda r: r["bin"])]
        assert got == list(counts)


def test_kde_matches_formula(spark):
    xs = [1.0, 2.0, 2.0, 3.5, 7.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    out = sorted(D.kde(df, "x", grid_size=20).collect(), key=lambda r: r["point"])
    arr = np.array(xs)
    bw = arr.std(ddof=1) * len(arr) ** (-0.2)
    grid = np.linspace(arr.min() - 3 * bw, arr.max() + 3 * bw, 20)
    dens = [np.exp(-0.5 * ((g - arr) / bw) ** 2).sum() / (len(arr) * bw * math.sqrt(2 * math.pi)) for g in grid]
    assert [r["x"] for r in out] == pytest.approx(list(grid))
    assert [r["density"] for r in out] == pytest.approx(dens, rel=1e-9)


def test_corr_matrix_and_pairwise(spark):
    rng = random.Random(2)
    data = [(rng.random(), rng.random(), rng.random(), rng.random()) for _ in range(200)]
    df = spark.createDataFrame(data, "a double, b double, c double, d double")
    cm = {(r["var1"], r["var2"]): r["corr"] for r in D.corr_matrix(df, ["a", "b", "c", "d"]).collect()}
    m = np.corrcoef(np.array(data).T)
    names = "abcd"
    for i in range(4):
        for j in range(4):
            assert cm[(names[i], names[j])] == pytest.approx(m[i, j], abs=1e-12)
    with pytest.raises(ValueError):
        D.corr_matrix(df, ["a", "b", "c"])
    pg = D.pair_grid(df, ["a", "b", "c"], bins=4)
    assert pg.groupBy("var1", "var2").agg(F.sum("count").alias("n")).where("n != 200").count() == 0


def test_standardize_population_sd(spark):  # scale_small
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    z = [r[0] for r in D.standardize(df, ["x"], suffix="_z").select("x_z").collect()]
    arr = np.array([1.0, 2.0, 3.0, 4.0])
    assert z == pytest.approx(list((arr - arr.mean()) / arr.std(ddof=0)))


def test_regression_errors_zero_sst(spark):  # Q7
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 0.0)], "y double, p double")
    r = D.regression_errors(df, "y", "p").first()
    assert (r["sse"], r["sst"], r["r2"]) == (1.0, 0.0, 0.0)


# The three saved confusion matrices [[TN FP] [FN TP]] and every figure of their saved reports.
CONFUSION_GOLDEN = {
    "tree": ((307, 377, 313, 350), {
        "0": (0.49516129032258066, 0.44883040935672514, 0.4708588957055215, 684.0),
        "1": (0.4814305364511692, 0.5279034690799397, 0.5035971223021583, 663.0),
        "accuracy": 0.48775055679287305,
        "macro avg": (0.48829591338687495, 0.4883669392183324, 0.4872280090038399, 1347.0),
        "weighted avg": (0.48840294598943595, 0.48775055679287305, 0.4869728112464051, 1347.0)}),
    "forest": ((378, 306, 363, 300), {
        "0": (0.5101214574898786, 0.5526315789473685, 0.5305263157894737, 684.0),
        "1": (0.49504950495049505, 0.45248868778280543, 0.4728132387706856, 663.0),
        "accuracy": 0.5033407572383074,
        "macro avg": (0.5025854812201869, 0.502560133365087, 0.5016697772800797, 1347.0),
        "weighted avg": (0.5027029686007833, 0.5033407572383074, 0.5021196564996026, 1347.0)}),
    "boost": ((368, 316, 371, 292), {
        "0": (0.4979702300405954, 0.5380116959064327, 0.517217146872804, 684.0),
        "1": (0.48026315789473684, 0.44042232277526394, 0.45948072383949645, 663.0),
        "accuracy": 0.48997772828507796,
        "macro avg": (0.4891166939676661, 0.48921700934084833, 0.4883489353561502, 1347.0),
        "weighted avg": (0.4892547223696939, 0.48997772828507796, 0.488798996560196, 1347.0)}),
}


def _from_counts(spark, tn, fp, fn, tp):
    i = F.col("id")
    b1, b2, b3 = tn, tn + fp, tn + fp + fn
    label = F.when(i < b2, 0).otherwise(1)
    pred = F.when(i < b1, 0).when(i < b2, 1).when(i < b3, 0).otherwise(1)
    return spark.range(tn + fp + fn + tp).select(label.alias("y"), pred.alias("p"))


@pytest.mark.parametrize("name", sorted(CONFUSION_GOLDEN))
def test_confusion_goldens(spark, name):
    (tn, fp, fn, tp), report = CONFUSION_GOLDEN[name]
    df = _from_counts(spark, tn, fp, fn, tp)
    cm = {(r["actual"], r["predicted"]): r["count"] for r in EV.confusion(df, "y", "p").collect()}
    assert cm == {(0, 0): tn, (0, 1): fp, (1, 0): fn, (1, 1): tp}
    rep = {r["class"]: r for r in EV.classification_report(df, "y", "p").collect()}
    for cls in ("0", "1", "macro avg", "weighted avg"):
        r = rep[cls]
        assert (r["precision"], r["recall"], r["f1"], r["support"]) == pytest.approx(report[cls], abs=1e-15)
    assert rep["accuracy"]["precision"] == pytest.approx(report["accuracy"], abs=1e-15)
    m = EV.binary_metrics(df, "y", "p").first()
    assert m["accuracy"] == pytest.approx(report["accuracy"], abs=1e-15)
    assert m["sensitivity"] == pytest.approx(report["1"][1]) and m["specificity"] == pytest.approx(report["0"][1])
    assert m["f1"] == pytest.approx(report["1"][2])


def test_roc_ties_and_invariance(spark):  # roc_ties
    data = [(0, 0.1), (1, 0.4), (0, 0.4), (1, 0.8), (1, 0.8), (0, 0.2)]
    df = spark.createDataFrame(data, "y int, s double")
    assert EV.roc_auc(df, "y", "s").first()["auc"] == pytest.approx(8.5 / 9)
    t = df.withColumn("s", F.exp("s") * 3 + 1)
    assert EV.roc_auc(t, "y", "s").first()["auc"] == pytest.approx(8.5 / 9)
    pts = sorted((r["fpr"], r["tpr"]) for r in EV.roc_points(df, "y", "s").collect())
    assert pts[0] == (0.0, 0.0) and pts[-1] == (1.0, 1.0)
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(pts, pts[1:]))
    assert area == pytest.approx(8.5 / 9)


def test_auc_blocked_path(spark, monkeypatch):
    rng = random.Random(23)
    data = [(int(rng.random() < 0.4), round(rng.random(), 3)) for _ in range(3000)]
    df = spark.createDataFrame(data, "y int, s double")
    plain = EV.roc_auc(df, "y", "s").first()["auc"]
    monkeypatch.setattr(prefix, "BLOCKS", 16)
    assert EV.roc_auc(df, "y", "s").first()["auc"] == pytest.approx(plain, abs=1e-12)
    pos = [s for y, s in data if y == 1]
    neg = [s for y, s in data if y == 0]
    brute = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert plain == pytest.approx(brute, abs=1e-12)


def test_standardize_fit_scope(spark):  # Q5
    df = spark.createDataFrame([(1.0, 0), (2.0, 0), (3.0, 1), (10.0, 1)], "x double, test int")
    train = df.where("test = 0")
    z = [r[0] for r in D.standardize(df, ["x"], suffix="_z", fit_on=train).orderBy("x").select("x_z").collect()]
    assert z == pytest.approx([-1.0, 1.0, 3.0, 17.0])


def test_kde_truncated_reach_is_exact(spark):
    rng = random.Random(29)
    xs = [round(rng.gauss(0, 1), 3) for _ in range(1500)] + [round(rng.gauss(500, 1), 3) for _ in range(1500)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    bw = 0.5  # narrow kernel: each value reaches only ~16 of the 200 grid points
    out = sorted(D.kde(df, "x", grid_size=200, bandwidth=bw).collect(), key=lambda r: r["point"])
    arr = np.array(xs)
    grid = np.linspace(arr.min() - 3 * bw, arr.max() + 3 * bw, 200)
    dens = [np.exp(-0.5 * ((g - arr) / bw) ** 2).sum() / (len(arr) * bw * math.sqrt(2 * math.pi)) for g in grid]
    assert len(out) == 200
    assert [r["density"] for r in out] == pytest.approx(dens, rel=1e-9, abs=1e-300)
    assert sum(1 for r in out if r["density"] == 0.0) > 100


def test_kde_by_group_matches_per_group_formula(spark):
    rng = random.Random(31)
    data = [("a", round(rng.gauss(0, 1), 3)) for _ in range(300)] + [("b", round(rng.gauss(50, 5), 3)) for _ in range(200)]
    df = spark.createDataFrame(data, "g string, x double")
    out = D.kde_by_group(df, "x", ["g"], grid_size=50).collect()
    for g in "ab":
        arr = np.array([x for k, x in data if k == g])
        bw = arr.std(ddof=1) * len(arr) ** (-0.2)
        grid = np.linspace(arr.min() - 3 * bw, arr.max() + 3 * bw, 50)
        dens = [np.exp(-0.5 * ((p - arr) / bw) ** 2).sum() / (len(arr) * bw * math.sqrt(2 * math.pi)) for p in grid]
        got = sorted((r for r in out if r["g"] == g), key=lambda r: r["point"])
        assert [r["x"] for r in got] == pytest.approx(list(grid))
        assert [r["density"] for r in got] == pytest.approx(dens, rel=1e-9)


def test_auc_beyond_the_range_of_bigint_products_and_without_labels(spark, monkeypatch):
    counts = spark.createDataFrame([(0.9, 3_000_000_000, 1_000_000_000), (0.1, 1_000_000_000, 3_000_000_000)], "score double, pos long, neg long")
    table = prefix.running_totals(counts, "score", {"cum_pos": "pos", "cum_neg": "neg"}, ascending=False, with_totals=True)
    monkeypatch.setattr(EV, "_score_table", lambda *a: table)
    assert EV.roc_auc(counts, "pos", "score").first()["auc"] == pytest.approx(0.75)
    monkeypatch.undo()
    df = spark.createDataFrame([(1, 0.9), (0, 0.2), (None, 0.95), (None, 0.1), (1, None)], "y int, s double")
    r = EV.roc_auc(df, "y", "s").first()
    assert (r["auc"], r["positives"], r["negatives"]) == (1.0, 1, 1)


def test_correlation_with_constant_and_missing_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0, None), (2.0, 4.5, 5.0, 1.0), (3.0, 6.0, 5.0, 2.0)], "a double, b double, c double, d double")
    got = {(r["var1"], r["var2"]): r["corr"] for r in D.corr_matrix(df, ["a", "b", "c", "d"]).collect()}
    assert got["c", "c"] is None and got["a", "c"] is None and got["a", "a"] == 1.0
    assert got["a", "b"] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4.5, 6])[0, 1]) and got["a", "d"] == pytest.approx(1.0)
