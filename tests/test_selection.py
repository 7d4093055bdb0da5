"""Order statistics by bracket and count against sorting, with brackets that hold a part of the rows only."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import distributions as D
from cohortlens.operators import selection as S
from cohortlens.operators import splits as SP

PLACES = [0.001, 0.25, 0.5, 0.9, 1.0]


def ranks(n):
    return [F.ceil(n * F.lit(p)) for p in PLACES]


@pytest.fixture(params=[(100, 50, 8), (2000, 8000, 256)])
def small_brackets(request, monkeypatch):
    for name, value in zip(("ACCURACY", "FEW", "BINS"), request.param, strict=True):
        monkeypatch.setattr(S, name, value)


def values(kind, rng, n):
    draw = {"spread": lambda: rng.gauss(0, 1), "ties": lambda: float(rng.choice([0, 0, 0, 1, 7])), "far": lambda: rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300),
            "ends": lambda: rng.choice([float("inf"), float("-inf"), 0.0, rng.random()])}[kind]
    return [draw() for _ in range(n)]


@pytest.mark.parametrize("kind", ["spread", "ties", "far", "ends"])
def test_keys_at_ranks_match_sorting(spark, small_brackets, kind):
    rng = random.Random(kind)
    groups = {"a": values(kind, rng, 3000), "b": values(kind, rng, 700), None: values(kind, rng, 40), "one": values(kind, rng, 1)}
    rows = [(g, v, f"{i % 5}") for g, vs in groups.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "g string, v double, k string").repartition(7)
    for by, small in ((["g"], True), (["g"], False), ([], True)):
        got = S.order_statistics(df, by, F.col("v"), F.struct("v", "k"), PLACES, ranks, small).collect()
        parts = groups if by else {None: None}
        assert len(got) == len(parts)
        for r in got:
            own = sorted((v, k) for g, v, k in rows if not by or g == r["g"])
            assert r["n"] == len(own)
            for i, p in enumerate(PLACES):
                assert tuple(r[f"s{i}"]) == own[math.ceil(len(own) * p) - 1], (kind, by, p)


def test_quantiles_and_boxes_match_numpy(spark, small_brackets):
    rng = random.Random(3)
    data = {"x": values("spread", rng, 2500), "y": values("ties", rng, 900)}
    rows = [(g, v) for g, vs in data.items() for v in vs] + [("x", None), ("x", float("nan")), ("z", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in D.quantiles(df, "v", [0.1, 0.5, 0.99], ["g"]).collect()}
    assert set(got) == {"x", "y"}
    for g, vs in data.items():
        assert got[g]["n"] == len(vs) and np.allclose([got[g][f"q{i}"] for i in range(3)], np.quantile(vs, [0.1, 0.5, 0.99]), rtol=0, atol=1e-12)
    box = {r["g"]: r for r in D.box_summary(df, "v", ["g"]).collect()}
    for g, vs in data.items():
        q1, q3 = np.quantile(vs, [0.25, 0.75])
        inside = [v for v in vs if q1 - 1.5 * (q3 - q1) <= v <= q3 + 1.5 * (q3 - q1)]
        assert (box[g]["whisker_low"], box[g]["whisker_high"], box[g]["outliers"]) == (min(inside), max(inside), len(vs) - len(inside))
    none = D.quantiles(df.where("g = 'z'"), "v", [0.5]).collect()
    assert [(r["n"], r["q0"]) for r in none] == [(0, None)]


def test_splits_and_folds_of_large_tables_match_ranking(spark, small_brackets):
    import hashlib

    ids = [(i * 7919) % 100_003 for i in range(2500)] + [None, None, 5, 5]
    df = spark.createDataFrame([(i, "ab"[(i or 0) % 2]) for i in ids], "id long, c string")
    order = sorted(range(len(ids)), key=lambda k: hashlib.md5(str(ids[k]).encode()).hexdigest() if ids[k] is not None else "")
    last = ids[order[math.ceil(0.2 * len(ids)) - 1]]
    split = {r["id"]: r["is_test"] for r in SP.random_split(df, "id", 0.2).collect()}
    ranked = [ids[k] for k in order]
    assert [split[i] for i in ranked] == [1] * (ranked.index(last) + ranked.count(last)) + [0] * (len(ids) - ranked.index(last) - ranked.count(last))
    folds = SP.kfold(df, "id", 5).orderBy("fold", "id").collect()
    assert [r["id"] for r in folds] == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert all(abs(sum(r["fold"] == f for r in folds) - len(ids) / 5) <= 2 for f in range(5))
    by_class = SP.kfold(df, "id", 4, label="c").groupBy("c", "fold").count().collect()
    for c in "ab":
        sizes = [r["count"] for r in by_class if r["c"] == c]
        assert len(sizes) == 4 and max(sizes) - min(sizes) <= 2
    assert SP.kfold(df.limit(0), "id", 3).count() == 0 and SP.stratified_split(df.limit(0), "id", "c").count() == 0


def test_nothing_runs_while_a_split_is_built(spark):
    before = spark.sparkContext.statusTracker().getJobIdsForGroup()
    df = spark.range(20_000).withColumnRenamed("id", "key")
    SP.random_split(df, "key"), SP.kfold(df, "key")
    assert spark.sparkContext.statusTracker().getJobIdsForGroup() == before
