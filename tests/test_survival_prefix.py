"""Kaplan–Meier fixtures and properties; distributed running totals equal a plain window."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortlens.operators import prefix
from cohortlens.operators.survival import km_at, km_curve, km_event_table


def test_km_small(spark):  # km_small
    df = spark.createDataFrame([(1.0, 1), (2.0, 1), (2.0, 1), (3.0, 1), (3.0, 1)], "t double, e int")
    c = {r["time"]: r for r in km_curve(df, "t", "e").collect()}
    assert [c[t]["at_risk"] for t in (1.0, 2.0, 3.0)] == [5, 4, 2]
    assert [c[t]["survival"] for t in (0.0, 1.0, 2.0, 3.0)] == pytest.approx([1.0, 0.8, 0.4, 0.0])
    assert c[3.0]["ci_lower"] is None and c[0.0]["ci_upper"] is None


def test_km_without_censoring_is_one_minus_ecdf(spark):  # km_no_censoring
    rng = random.Random(3)
    ts = [float(rng.randint(1, 30)) for _ in range(300)]
    df = spark.createDataFrame([(t, 1) for t in ts], "t double, e int")
    arr = np.array(ts)
    for r in km_curve(df, "t", "e", origin=False).collect():
        assert r["survival"] == pytest.approx(1 - np.mean(arr <= r["time"]), abs=1e-12)


def test_km_properties_and_band(spark):
    rng = random.Random(5)
    data = [(rng.choice("abc"), float(rng.randint(1, 40)), rng.randint(0, 1)) for _ in range(600)]
    df = spark.createDataFrame(data, "g string, t double, e int")
    cur = km_curve(df, "t", "e", ["g"]).orderBy("g", "time").collect()
    for g in "abc":
        s = [r["survival"] for r in cur if r["g"] == g]
        assert all(0 <= x <= 1 for x in s) and all(a >= b for a, b in zip(s, s[1:]))
        for r in cur:
            if r["g"] == g and r["ci_lower"] is not None:
                assert r["ci_lower"] <= r["survival"] <= r["ci_upper"]
    et = km_event_table(df, "t", "e", ["g"]).collect()
    assert sum(r["removed"] for r in et) == 600
    med = km_at(km_curve(df, "t", "e", ["g"]), 10.0, ["g"]).collect()
    assert len(med) == 3


def test_km_blocked_path_equals_plain(spark, monkeypatch):
    rng = random.Random(7)
    data = [("hot" if rng.random() < 0.6 else rng.choice("xyz"), round(rng.random() * 100, 1), rng.randint(0, 1))
            for _ in range(2000)]
    df = spark.createDataFrame(data, "g string, t double, e int")
    plain = {(r["g"], r["time"]): r for r in km_curve(df, "t", "e", ["g"]).collect()}
    monkeypatch.setattr(prefix, "BLOCKS", 16)
    blocked = {(r["g"], r["time"]): r for r in km_curve(df, "t", "e", ["g"]).collect()}
    assert plain.keys() == blocked.keys()
    for k, r in plain.items():
        b = blocked[k]
        assert b["at_risk"] == r["at_risk"]
        assert b["survival"] == pytest.approx(r["survival"], abs=1e-12)


def test_running_totals_blocked_equals_window(spark, monkeypatch):
    monkeypatch.setattr(prefix, "BLOCKS", 8)
    rng = random.Random(11)
    data = [(rng.choice(["a", "b", None]), float(i), rng.randint(0, 9)) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, k double, v int")
    w = Window.partitionBy("g").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    expect = {(r["g"], r["k"]): r["s"] for r in df.select("g", "k", F.sum("v").over(w).alias("s")).collect()}
    got = prefix.running_totals(df, "k", {"s": "v"}, partition_by=["g"], ascending=False)
    assert prefix.with_blocks(df, ["k"], ["g"]).select(prefix.BLOCK).distinct().count() == 8
    assert {(r["g"], r["k"]): r["s"] for r in got.collect()} == expect
    tot = prefix.running_totals(df, "k", {"s": "v"}, partition_by=["g"], with_totals=True)
    sums = {}
    for g, _, v in data:
        sums[g] = sums.get(g, 0) + v
    assert all(r["s_total"] == sums[r["g"]] for r in tot.collect())


@pytest.mark.parametrize("blocked", [False, True])
def test_rank_rows_matches_row_number(spark, monkeypatch, blocked):
    rng = random.Random(13)
    data = [(i, rng.choice(["p", "q"]), float(rng.randint(0, 50))) for i in range(500)]
    df = spark.createDataFrame(data, "id int, g string, k double")
    w = Window.partitionBy("g").orderBy("k", "id")
    expect = {r["id"]: r["rn"] for r in df.select("id", F.row_number().over(w).alias("rn")).collect()}
    sizes = {g: sum(1 for _, x, _ in data if x == g) for g in "pq"}
    if blocked:
        monkeypatch.setattr(prefix, "BLOCKS", 8)
    got = prefix.rank_rows(df, F.col("k"), F.col("id"), ["g"], size_name="n").collect()
    assert {r["id"]: r["rank"] for r in got} == expect
    assert all(r["n"] == sizes[r["g"]] for r in got)


def test_running_totals_with_more_than_255_blocks_null_keys_and_a_hot_value(spark, monkeypatch):
    rng = random.Random(37)
    data = [(rng.choice(["a", "b"]), float(i) if i % 9 else None, i, rng.randint(0, 9)) for i in range(4000)]
    data += [("a", 0.0, 5000 + i, 1) for i in range(9 * 600)]  # most rows of one value
    df = spark.createDataFrame(data, "g string, k double, id long, v int")
    w = Window.partitionBy("g").orderBy("k", "id").rowsBetween(Window.unboundedPreceding, 0)
    expect = {r["id"]: r["s"] for r in df.select("id", F.sum("v").over(w).alias("s")).collect()}
    monkeypatch.setattr(prefix, "BLOCKS", 300)
    sizes = [r["count"] for r in prefix.with_blocks(df, ["k", "id"], ["g"]).groupBy(prefix.BLOCK).count().collect()]
    assert len(sizes) > 255 and max(sizes) < 8 * len(data) / 300  # ties and hot groups spread
    got = prefix.running_totals(df, ["k", "id"], {"s": "v"}, partition_by=["g"]).collect()
    assert {r["id"]: r["s"] for r in got} == expect and len(got) == len(data)


def test_km_beyond_the_range_of_bigint_products_and_with_missing_values(spark):
    df = spark.createDataFrame([(1.0, 4_000_000_000, 1_000_000_000), (2.0, 3_000_000_000, 3)], "t double, n long, d long")
    from cohortlens.operators import survival

    et = df.select(F.col("t").alias("time"), F.col("d").alias("events"), F.col("n").alias("removed"))
    monkey = survival._event_table
    try:
        survival._event_table = lambda *a: prefix.running_totals(
            prefix.with_blocks(et, ["time"]), "time", {"at_risk": "removed"}, ascending=False, with_totals=True, keep_blocks=True
        ).withColumn("censored", F.col("removed") - F.col("events"))
        c = {r["time"]: r for r in km_curve(df, "t", "d").collect()}
    finally:
        survival._event_table = monkey
    assert c[1.0]["at_risk"] == 7_000_000_000 and c[1.0]["survival"] == pytest.approx(6 / 7)
    missing = spark.createDataFrame([(1.0, None), (1.0, None), (2.0, 1), (float("nan"), 1), (None, 1)], "t double, e int")
    rows = {r["time"]: (r["events"], r["censored"], r["at_risk"]) for r in km_event_table(missing, "t", "e").collect()}
    assert rows == {1.0: (0, 2, 3), 2.0: (1, 0, 1)}
