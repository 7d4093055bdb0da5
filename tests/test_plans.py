"""Physical-plan properties the scale design relies on (checked on the executed AQE plans)."""

import re

import __spark_entry__ as E
from cohortlens.operators import prefix, survival

SF = "/root/testdata/sf0.001"


def _final_plan(spark, name):
    df = E.queries()[name](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]  # keep the final (adaptive) plan only


def test_filter_and_projection_reach_the_scan(spark):
    plan = _final_plan(spark, "flt_in")
    assert "PushedFilters: [In(o_orderpriority" in plan or "PushedFilters: [IsNotNull(o_orderpriority), In(o_orderpriority" in plan
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_orderpriority:string>", plan)


def test_kaplan_meier_scans_once_and_never_unions(spark, monkeypatch):
    scans = []
    original = prefix.with_blocks
    monkeypatch.setattr(survival, "with_blocks", lambda df, *a: scans.append(
        df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")) or original(df, *a))
    plan = _final_plan(spark, "km_by_group")
    # the event table is made by one scan; all that follows reads its checkpoint
    assert scans == [1] and plan.count("FileScan parquet") == 0
    assert "Union" not in plan


def test_box_plot_broadcasts_only_the_per_group_side(spark):
    plan = _final_plan(spark, "dist_box")
    joins = re.findall(r"BroadcastHashJoin .*?(Build(?:Left|Right))", plan)
    assert joins and all(side == "BuildRight" for side in joins)


def test_effects_aggregate_partially_before_the_shuffle(spark):
    plan = _final_plan(spark, "effect_treatment")
    assert "partial_sum" in plan and "partial_count" in plan
