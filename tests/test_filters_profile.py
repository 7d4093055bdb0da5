"""Filters (N4, N11/Q1) and profiling (N9, N10)."""

import math

from cohortlens.operators import filters as FL
from cohortlens.operators import profile as P
from tests.conftest import rows


def _stages(spark):
    return spark.createDataFrame([(1, "I"), (2, "II"), (3, "III"), (4, "IV"), (5, None)], "id int, s string")


def test_drop_in_keeps_null(spark):  # N4
    out = FL.drop_in(_stages(spark), "s", ["I", "II"])
    assert sorted(r[0] for r in out.select("id").collect()) == [3, 4, 5]


def test_keep_in_drops_null(spark):
    assert FL.keep_in(_stages(spark), "s", ["III", "IV"]).count() == 2


def test_regex_stage_semantics(spark):  # Q1 / regex_stage
    df = _stages(spark)
    assert FL.keep_regex(df, "s", "I").count() == 4
    assert FL.keep_regex(df, "s", "II").count() == 2
    assert FL.keep_stages(df, "s", ["I"], match="exact").count() == 1
    assert FL.keep_stages(df, "s", ["III", "IV"], match="regex").count() == 2


def test_keep_present_and_dropna(spark):
    df = spark.createDataFrame([(1, "2020-01-01", 1.0), (2, "N/A", 2.0), (3, None, None), (4, "x", float("nan"))],
                               "id int, d string, v double")
    assert sorted(r[0] for r in FL.keep_present(df, "d").select("id").collect()) == [1, 4]
    assert sorted(r[0] for r in FL.drop_incomplete(df, ["d", "v"]).select("id").collect()) == [1, 2]


def test_column_info_and_nulls(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, "a", float("nan")), (None, "b", 3.0)], "a int, b string, c double")
    info = {r["column"]: (r["dtype"], r["non_null"]) for r in P.column_info(df).collect()}
    assert info == {"a": ("int", 2), "b": ("string", 2), "c": ("double", 2)}
    nulls = dict(rows(P.null_counts(df), "column", "nulls"))
    assert nulls == {"a": 1, "b": 1, "c": 1}  # NaN counts as missing (N10)


def test_distinct_guards(spark):
    df = spark.createDataFrame([(i % 12, 1) for i in range(50)], "a int, b int")
    got = {r["column"]: (r["n_distinct"], r["over_10"], r["at_least_2"]) for r in
           P.distinct_counts(df, ["a", "b"]).collect()}
    assert got == {"a": (12, True, True), "b": (1, False, False)}


def test_head_numeric_empty_hasvalue_trim(spark):
    df = spark.createDataFrame([(3, "x"), (1, "y"), (2, "z")], "k int, v string")
    assert [r[0] for r in P.head(df, 2, ["k"]).collect()] == [1, 2]
    assert P.numeric_columns(df) == ["k"]
    assert P.is_empty(df.where("k > 5")) and not P.is_empty(df)
    assert P.has_value(df, "v", "y").first()[0] is True
    assert P.trim_names(df.toDF(" k ", "v ")).columns == ["k", "v"]
    assert [r[0] for r in P.distinct_values(df, "v").collect()] == ["x", "y", "z"]


def test_require_columns_raises_early(spark):  # Q9
    df = spark.createDataFrame([(1,)], "a int")
    try:
        P.require_columns(df, ["a", "FollowUpMonths"])
    except ValueError as e:
        assert "FollowUpMonths" in str(e)
    else:
        raise AssertionError("expected ValueError")
    assert not math.isnan(1.0)
