"""Property checks: AUC equals the pairwise brute force and ignores monotone transforms; KM is
non-increasing in [0, 1] and its at-risk counts start at the group size; folds partition the rows."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlens.operators import evaluate as EV
from cohortlens.operators.splits import kfold
from cohortlens.operators.survival import km_curve

SETTINGS = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))

scores = st.lists(st.tuples(st.integers(0, 1), st.integers(0, 20)), min_size=4, max_size=60).filter(
    lambda xs: 0 < sum(y for y, _ in xs) < len(xs))


@SETTINGS
@given(scores)
def test_auc_equals_pairwise_brute_force(spark, data):
    df = spark.createDataFrame([(y, float(s)) for y, s in data], "y int, s double")
    pos = [s for y, s in data if y == 1]
    neg = [s for y, s in data if y == 0]
    brute = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    got = EV.roc_auc(df, "y", "s").first()["auc"]
    assert abs(got - brute) < 1e-12
    shifted = EV.roc_auc(df.withColumn("s", F.col("s") * 7 + 3), "y", "s").first()["auc"]
    assert abs(shifted - got) < 1e-12


subjects = st.lists(st.tuples(st.sampled_from("ab"), st.integers(1, 15), st.integers(0, 1)), min_size=1, max_size=80)


@SETTINGS
@given(subjects)
def test_km_is_a_survival_function(spark, data):
    df = spark.createDataFrame([(g, float(t), e) for g, t, e in data], "g string, t double, e int")
    rows = km_curve(df, "t", "e", ["g"]).orderBy("g", "time").collect()
    for g in {x[0] for x in data}:
        curve = [r for r in rows if r["g"] == g]
        s = [r["survival"] for r in curve]
        assert all(0.0 <= x <= 1.0 for x in s) and all(a >= b - 1e-15 for a, b in zip(s, s[1:]))
        assert curve[0]["at_risk"] == sum(1 for x in data if x[0] == g)


@SETTINGS
@given(st.integers(5, 120), st.integers(2, 7))
def test_folds_partition_the_rows(spark, n, k):
    df = spark.range(n).select(F.col("id"))
    folds = [r["fold"] for r in kfold(df, "id", k).collect()]
    sizes = sorted(folds.count(f) for f in range(k))
    assert len(folds) == n and set(folds) <= set(range(k)) and sizes[-1] - sizes[0] <= 1
