"""Null rules N2, N3, N5–N8, N12 and decisions Q2, Q4 for the column builders."""

import datetime as dt
import math

from pyspark.sql import functions as F

from cohortlens.functions import columns as C


def _one(spark, data, schema, expr):
    df = spark.createDataFrame(data, schema)
    return [r[0] for r in df.select(expr.alias("x")).collect()]


def test_flag_contains_null_is_zero(spark):  # N2
    out = _one(spark, [("Radiation, Surgery",), (None,), ("Chemotherapy",)], "t string",
               C.flag_contains("t", "Surgery"))
    assert out == [1, 0, 0]


def test_flag_equals_null_counts_as_absent(spark):  # N3
    assert _one(spark, [("Deceased",), ("Alive",), (None,)], "s string", C.flag_equals("s", "Deceased")) == [1, 0, 0]


def test_map_values_unmapped_is_null(spark):  # N5
    out = _one(spark, [("I",), ("IV",), ("V",), (None,)], "s string",
               C.map_values("s", {"I": 1, "II": 2, "III": 3, "IV": 4}))
    assert out == [1, 4, None, None]


def test_replace_values_keeps_unmapped(spark):  # N6
    out = _one(spark, [("Current",), ("Former",), ("Never",), ("Unknown",), (None,)], "s string",
               C.replace_values("s", {"Current": "Smoker", "Former": "Smoker"}))
    assert out == ["Smoker", "Smoker", "Never", "Unknown", None]


def test_to_number_coerces_bad_text_and_nan(spark):  # N7
    out = _one(spark, [("3.5",), ("abc",), ("nan",), (None,), ("12",)], "s string", C.to_number("s"))
    assert out == [3.5, None, None, None, 12.0]


def test_decimal_comma(spark):
    out = _one(spark, [("3,5",), ("3.5",), ("abc",), ("nan",), (None,)], "s string", C.decimal_comma("s"))
    assert out == [3.5, 3.5, None, None, None]


def test_lenient_dates(spark):  # N8
    out = _one(spark, [("2020-01-31",), ("N/A",), ("31/01/2020",), (None,)], "s string",
               C.to_date_lenient("s", "yyyy-MM-dd"))
    assert out == [dt.date(2020, 1, 31), None, None, None]


def test_days_between(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 1), dt.date(2020, 3, 1))], "a date, b date")
    assert df.select(C.days_between("b", "a")).first()[0] == 60


def test_safe_ratio_never_raises(spark):  # N12
    out = _one(spark, [(1, 0), (1, 2), (None, 2)], "a int, b int", C.safe_ratio("a", "b"))
    assert out == [0.0, 0.5, 0.0]


def test_count_tokens(spark):
    out = _one(spark, [("A",), ("A,B",), ("None",), (None,), ("A,B,C",)], "c string", C.count_tokens("c"))
    assert out == [1, 2, 0, 0, 3]


def test_multihot_and_conditional(spark):
    df = spark.createDataFrame([("Radiation, Chemotherapy", 5, 7), ("Surgery", 3, 2)], "t string, cs int, rs int")
    flags = C.multihot("t", ["Radiation", "Chemotherapy", "Targeted Therapy", "Surgery"], prefix="Received_")
    out = df.select(*flags, "cs").select("*", C.conditional_value("Received_Chemotherapy", "cs").alias("ci"))
    r = out.collect()
    assert [tuple(x)[:4] for x in r] == [(1, 1, 0, 0), (0, 0, 0, 1)]
    assert [x["ci"] for x in r] == [5, 0]


def test_weighted_flag_unknown_counts_zero(spark):  # Q4
    out = _one(spark, [(1, "Current"), (1, "Unknown"), (0, "Former"), (1, "Never")], "f int, s string",
               C.weighted_flag("f", "s", {"Never": 0, "Former": 2, "Current": 2}))
    assert out == [2, 0, 0, 0]


def test_combo_label(spark):
    df = spark.createDataFrame([(1, 0, 0, 1)], "r int, c int, t int, s int")
    assert df.select(C.combo_label({"R": "r", "C": "c", "T": "t", "S": "s"})).first()[0] == "R:1 C:0 T:0 S:1"


def test_equal_width_bins_are_right_closed(spark):  # cut_small
    values = list(range(13)) + [15, 20]
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    lo, hi = F.lit(0.0), F.lit(20.0)
    got = [r[0] for r in df.select(C.equal_width_bin("x", lo, hi, 5)).collect()]
    # pandas codes 0×5, 1×4, 2×4, 3, 4 (0-based) for the same data
    assert [g - 1 for g in got] == [0] * 5 + [1] * 4 + [2] * 4 + [3, 4]


def test_custom_order_puts_unlisted_last(spark):  # Q2
    df = spark.createDataFrame([("II",), ("I",), ("IV",), ("III",)], "s string")
    out = df.orderBy(F.asc_nulls_last(C.custom_order("s", ["I", "III", "IV"])), "s")
    assert [r[0] for r in out.collect()] == ["I", "III", "IV", "II"]


def test_strip_text(spark):
    assert _one(spark, [("Received_Surgery",)], "s string", C.strip_text("s", "Received_")) == ["Surgery"]


def test_to_number_rejects_inf_text_consistently(spark):
    out = _one(spark, [("1e3",)], "s string", C.to_number("s"))
    assert math.isclose(out[0], 1000.0)


def test_to_number_takes_what_the_reference_takes(spark):
    given = ["1", " 2.5 ", "-3e2", ".5", "7.", "1d", "3f", "0x1p3", "nan", "1e", "--1", "1,5", "", None, "inf", "12L"]
    rows = spark.createDataFrame([(t,) for t in given], "t string").select(C.to_number("t").alias("x")).collect()
    assert [r["x"] for r in rows] == [1.0, 2.5, -300.0, 0.5, 7.0, None, None, None, None, None, None, None, None, None, float("inf"), None]
    assert spark.createDataFrame([(3.5,)], "t double").select(C.to_number("t").alias("x")).first()["x"] == 3.5


def test_bins_and_labels_match_pandas(spark):
    import numpy as np
    import pandas as pd
    from pyspark.sql import functions as F

    for values, k in ((np.arange(31) / 10, 5), (np.arange(1, 51), 5), (np.arange(100) / 1000, 5), ([0.0, 10.0], 5), ([4.0, 4.0], 5), ([0.0], 2),
                      (np.random.default_rng(1).normal(size=300).round(2), 7), ([-5.0, -4.5, 3.25], 4)):
        s = pd.Series(np.asarray(values, float))
        cut = pd.cut(s, k, precision=0, include_lowest=True)
        edges = C.cut_edges(s.min(), s.max(), k)
        assert C.cut_labels(edges) == [str(c) for c in cut.cat.categories]
        df = spark.createDataFrame([(float(x),) for x in s] + [(None,)], "x double")
        got = [r[0] for r in df.select(C.equal_width_bin("x", F.lit(float(s.min())), F.lit(float(s.max())), k)).collect()]
        assert got == [*(int(c) + 1 for c in cut.cat.codes), None]
