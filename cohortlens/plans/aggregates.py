"""Counts, crosstabs, domain completion, melt, sorts, top-k and treatment effects on the driver tables
(SURVEY §2.5, §2.6, §2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions import columns as C
from cohortlens.operators import filters as FL
from cohortlens.operators import tables as TB
from cohortlens.operators.effects import positive_effects, treatment_effects
from cohortlens.operators.report import findings
from cohortlens.plans.registry import query, rounded, table
from cohortlens.plans.views import (
    LINE_STATUSES,
    LINEITEM_PARTS_SQL,
    ORDER_PRIORITIES,
    ORDER_STATUSES,
    ORDERS_CUSTOMERS_SQL,
    PART_TYPES,
    SEGMENTS,
    lineitem_parts,
    orders_customers,
)

_STAGES = {"1-URGENT": "I", "2-HIGH": "II", "3-MEDIUM": "III", "4-NOT SPECIFIED": "IV"}
_STAGE_SQL = ("CASE o_orderpriority WHEN '1-URGENT' THEN 'I' WHEN '2-HIGH' THEN 'II' WHEN '3-MEDIUM' THEN 'III' "
              "WHEN '4-NOT SPECIFIED' THEN 'IV' END")
_TOKENS = ["small", "red", "ring", "bolt"]
_FLAGS_SQL = ", ".join(f"CASE WHEN contains(p_name, '{t}') THEN 1 ELSE 0 END AS received_{t}" for t in _TOKENS)


def _staged(spark, sf_dir):
    oc = orders_customers(spark, sf_dir)
    return oc.withColumn("stage", C.map_values("o_orderpriority", _STAGES))


def _part_flags(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", "p_type", "p_size", *C.multihot("p_name", _TOKENS, prefix="received_"))


def _pivot_sql(col: str, values) -> str:
    return ", ".join(f"CAST(COUNT(CASE WHEN {col} = '{v}' THEN 1 END) AS BIGINT) AS \"{v}\"" for v in values)


def _fill_sql(values) -> str:
    return ", ".join(f"COALESCE(\"{v}\", 0) AS \"{v}\"" for v in values)


# ---------------------------------------------------------------- §2.5 domain completion

@query("dom_rows", sql=f"""
WITH c AS (SELECT o_orderpriority, {_pivot_sql('o_orderstatus', ORDER_STATUSES)} FROM orders
           WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY o_orderpriority),
d AS (SELECT unnest([{", ".join(f"'{p}'" for p in ORDER_PRIORITIES)}]) AS o_orderpriority)
SELECT d.o_orderpriority, {_fill_sql(ORDER_STATUSES)} FROM d LEFT JOIN c USING (o_orderpriority)""")
def dom_rows(spark, sf_dir):
    o = FL.keep_in(table(spark, sf_dir, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"])
    return TB.crosstab(o, ["o_orderpriority"], "o_orderstatus", ORDER_STATUSES,
                       row_domain={"o_orderpriority": ORDER_PRIORITIES})


@query("dom_cols", sql=f"""
SELECT o_orderpriority, {_pivot_sql('o_orderstatus', ORDER_STATUSES + ['X'])} FROM orders GROUP BY o_orderpriority""")
def dom_cols(spark, sf_dir):
    return TB.crosstab(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus", ORDER_STATUSES + ["X"])


# ---------------------------------------------------------------- §2.6 counts

@query("cnt_values", sql="""
SELECT o_orderpriority AS value, COUNT(*) AS count FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1""")
def cnt_values(spark, sf_dir):
    return TB.value_counts(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("cnt_share", sql="""
SELECT c_mktsegment AS value, COUNT(*) AS count, round(COUNT(*) / SUM(COUNT(*)) OVER (), 6) AS share
FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1""")
def cnt_share(spark, sf_dir):
    return rounded(TB.value_counts(table(spark, sf_dir, "customer"), "c_mktsegment", normalize=True))


@query("cnt_by_value", sql="SELECT l_quantity AS value, COUNT(*) AS count FROM lineitem GROUP BY 1")
def cnt_by_value(spark, sf_dir):
    return TB.counts_by_value(table(spark, sf_dir, "lineitem"), "l_quantity")


@query("cnt_multi", sql=f"""
WITH oc AS {ORDERS_CUSTOMERS_SQL}
SELECT 'o_orderpriority' AS variable, o_orderpriority AS value, COUNT(*) AS count FROM oc GROUP BY 1, 2 UNION ALL
SELECT 'o_orderstatus', o_orderstatus, COUNT(*) FROM oc GROUP BY 1, 2 UNION ALL
SELECT 'c_mktsegment', c_mktsegment, COUNT(*) FROM oc GROUP BY 1, 2 UNION ALL
SELECT 'order_year', CAST(year(o_orderdate) AS VARCHAR), COUNT(*) FROM oc GROUP BY 1, 2 UNION ALL
SELECT 'order_month', CAST(month(o_orderdate) AS VARCHAR), COUNT(*) FROM oc GROUP BY 1, 2 UNION ALL
SELECT 'in_debt', CASE WHEN c_acctbal < 0 THEN 'true' ELSE 'false' END, COUNT(*) FROM oc GROUP BY 1, 2""")
def cnt_multi(spark, sf_dir):
    oc = orders_customers(spark, sf_dir).select(
        "o_orderpriority", "o_orderstatus", "c_mktsegment", F.year("o_orderdate").alias("order_year"),
        F.month("o_orderdate").alias("order_month"), (F.coalesce("c_acctbal", F.lit(0.0)) < 0).alias("in_debt"))
    return TB.multi_counts(oc, oc.columns)


@query("grp_size", sql=f"""
SELECT received_small, received_red, received_ring, received_bolt, COUNT(*) AS count
FROM (SELECT {_FLAGS_SQL} FROM part) GROUP BY ALL""")
def grp_size(spark, sf_dir):
    keys = [f"received_{t}" for t in _TOKENS]
    return TB.group_size(_part_flags(spark, sf_dir), keys)


@query("grp_mean", sql="SELECT event_type, round(AVG(value), 6) AS mean FROM events GROUP BY event_type")
def grp_mean(spark, sf_dir):
    return rounded(TB.group_mean(table(spark, sf_dir, "events"), ["event_type"], "value"))


@query("grp_mean_ci", sql="""
SELECT event_type, round(AVG(value), 6) AS mean, COUNT(value) AS n, round(STDDEV_SAMP(value), 6) AS sd,
  round(AVG(value) - 1.959963984540054 * STDDEV_SAMP(value) / sqrt(COUNT(value)), 6) AS ci_lower,
  round(AVG(value) + 1.959963984540054 * STDDEV_SAMP(value) / sqrt(COUNT(value)), 6) AS ci_upper
FROM events GROUP BY event_type""")
def grp_mean_ci(spark, sf_dir):
    return rounded(TB.group_mean_ci(table(spark, sf_dir, "events"), ["event_type"], "value"))


@query("ct_crosstab", sql=f"""
WITH oc AS {ORDERS_CUSTOMERS_SQL},
c AS (SELECT c_mktsegment, {_pivot_sql('o_orderstatus', ORDER_STATUSES)} FROM oc WHERE c_mktsegment IS NOT NULL GROUP BY 1),
d AS (SELECT unnest([{", ".join(f"'{s}'" for s in SEGMENTS + ['OTHER'])}]) AS c_mktsegment)
SELECT d.c_mktsegment, {_fill_sql(ORDER_STATUSES)} FROM d LEFT JOIN c USING (c_mktsegment)""")
def ct_crosstab(spark, sf_dir):
    return TB.crosstab(orders_customers(spark, sf_dir), ["c_mktsegment"], "o_orderstatus", ORDER_STATUSES,
                       row_domain={"c_mktsegment": SEGMENTS + ["OTHER"]})


_STRATA = ["I", "II", "III", "IV"]


@query("ct_stratified", sql=f"""
WITH oc AS (SELECT *, {_STAGE_SQL} AS stage FROM {ORDERS_CUSTOMERS_SQL}),
s AS (SELECT unnest([{", ".join(f"'{s}'" for s in _STRATA)}]) AS stratum),
x AS (SELECT s.stratum, oc.c_mktsegment, oc.o_orderstatus FROM oc JOIN s ON regexp_matches(oc.stage, s.stratum)
      WHERE oc.c_mktsegment IS NOT NULL),
c AS (SELECT stratum, c_mktsegment, {_pivot_sql('o_orderstatus', ORDER_STATUSES)} FROM x GROUP BY 1, 2),
d AS (SELECT stratum, seg AS c_mktsegment FROM s, (SELECT unnest([{", ".join(f"'{g}'" for g in SEGMENTS)}]) AS seg))
SELECT d.stratum, d.c_mktsegment, {_fill_sql(ORDER_STATUSES)} FROM d LEFT JOIN c USING (stratum, c_mktsegment)""")
def ct_stratified(spark, sf_dir):
    # regex strata reproduce the reference's per-stage subplots, where 'I' also selects II, III and IV (Q1)
    return TB.stratified_crosstab(_staged(spark, sf_dir), "stage", _STRATA, "c_mktsegment", SEGMENTS,
                                  "o_orderstatus", ORDER_STATUSES, match="regex")


@query("ct_stratified_shares", sql=f"""
WITH oc AS (SELECT *, {_STAGE_SQL} AS stage FROM orders),
s AS (SELECT unnest([{", ".join(f"'{s}'" for s in _STRATA)}]) AS stratum),
x AS (SELECT s.stratum, oc.o_orderstatus AS value FROM oc JOIN s ON regexp_matches(oc.stage, s.stratum)
      WHERE oc.o_orderstatus IS NOT NULL),
c AS (SELECT stratum, value, COUNT(*) AS count FROM x GROUP BY 1, 2),
t AS (SELECT stratum, SUM(count) AS tot FROM c GROUP BY 1),
d AS (SELECT stratum, v AS value FROM s, (SELECT unnest([{", ".join(f"'{v}'" for v in ORDER_STATUSES)}]) AS v))
SELECT d.stratum, d.value, COALESCE(c.count, 0) AS count,
  round(COALESCE(CAST(c.count AS DOUBLE) / t.tot, 0.0), 6) AS share
FROM d LEFT JOIN c USING (stratum, value) LEFT JOIN t USING (stratum)""")
def ct_stratified_shares(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("stage", C.map_values("o_orderpriority", _STAGES))
    return rounded(TB.stratified_shares(o, "stage", _STRATA, "o_orderstatus", ORDER_STATUSES, match="regex"))


@query("ct_gender_stage", sql=f"""
WITH oc AS (SELECT *, {_STAGE_SQL} AS stage FROM {ORDERS_CUSTOMERS_SQL})
SELECT stage, {_pivot_sql('c_mktsegment', SEGMENTS)} FROM oc WHERE stage IS NOT NULL GROUP BY stage""")
def ct_gender_stage(spark, sf_dir):
    st = _staged(spark, sf_dir)
    wide = TB.crosstab(st, ["stage"], "c_mktsegment", SEGMENTS)
    return TB.ordered_by(wide, "stage", ["I", "III", "IV", "II"])


@query("ct_overall", sql="""
SELECT 'all' AS cohort, o_orderstatus AS value, COUNT(*) AS count, round(COUNT(*) / SUM(COUNT(*)) OVER (), 6) AS share
FROM orders GROUP BY o_orderstatus
UNION ALL
SELECT 'III|IV', o_orderstatus, COUNT(*), round(COUNT(*) / SUM(COUNT(*)) OVER (), 6)
FROM orders WHERE regexp_matches(CASE o_orderpriority WHEN '1-URGENT' THEN 'I' WHEN '2-HIGH' THEN 'II'
  WHEN '3-MEDIUM' THEN 'III' WHEN '4-NOT SPECIFIED' THEN 'IV' END, 'III|IV') GROUP BY o_orderstatus""")
def ct_overall(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("stage", C.map_values("o_orderpriority", _STAGES))
    # one grouping by status and cohort: late orders are counted twice, once among all
    late = F.coalesce(F.regexp_like("stage", F.lit("III|IV")), F.lit(False))
    cohorts = F.when(late, F.array(F.lit("all"), F.lit("III|IV"))).otherwise(F.array(F.lit("all")))
    counted = o.where(F.col("o_orderstatus").isNotNull()).groupBy(F.col("o_orderstatus").alias("value"), cohorts.alias("cohorts")).agg(F.count(F.lit(1)).alias("n"))
    counts = counted.select("value", "n", F.explode("cohorts").alias("cohort")).groupBy("cohort", "value").agg(F.sum("n").alias("count"))
    total = counts.groupBy("cohort").agg(F.sum("count").alias("total"))
    return rounded(counts.join(total, "cohort").select("cohort", "value", "count", (F.col("count") / F.col("total")).alias("share")))


@query("ct_binned", sql=f"""
WITH mm AS (SELECT MIN(l_quantity) AS lo, MAX(l_quantity) AS hi FROM lineitem),
edges AS (SELECT unnest([1, 2, 3, 4]) AS i),
b AS (SELECT (SELECT CAST(1 + COUNT(*) AS INTEGER) FROM edges, mm WHERE l_quantity > i * ((hi - lo) / 5) + lo) AS bin,
        l_linestatus FROM lineitem WHERE l_quantity IS NOT NULL),
c AS (SELECT bin, {_pivot_sql('l_linestatus', LINE_STATUSES)} FROM b GROUP BY bin),
d AS (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS bin)
SELECT d.bin, '(' || CAST(CASE WHEN d.bin = 1 THEN round(lo - (hi - lo) * 0.001, 0) - 1 ELSE round(lo + (d.bin - 1) * ((hi - lo) / 5), 0) END AS VARCHAR) || ', ' ||
  CAST(round(lo + d.bin * ((hi - lo) / 5), 0) AS VARCHAR) || ']' AS label, {_fill_sql(LINE_STATUSES)}
FROM d CROSS JOIN mm LEFT JOIN c USING (bin)""")
def ct_binned(spark, sf_dir):
    return TB.binned_crosstab(table(spark, sf_dir, "lineitem"), "l_quantity", "l_linestatus", LINE_STATUSES)


@query("ct_sessions", sql=f"""
SELECT p_size, {_pivot_sql('p_type', PART_TYPES)} FROM part WHERE p_size IS NOT NULL GROUP BY p_size""")
def ct_sessions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return TB.crosstab(p, ["p_size"], "p_type", PART_TYPES)


_SMOKING = {"R": "Smoker", "A": "Smoker", "N": "Never"}


@query("ct_age_smoking", sql=f"""
WITH lp AS (SELECT p_size, CASE l_returnflag WHEN 'R' THEN 'Smoker' WHEN 'A' THEN 'Smoker' WHEN 'N' THEN 'Never'
            ELSE l_returnflag END AS smoking, l_linestatus FROM {LINEITEM_PARTS_SQL}),
c AS (SELECT p_size, smoking, {_pivot_sql('l_linestatus', LINE_STATUSES)} FROM lp
      WHERE p_size IS NOT NULL AND smoking IN ('Smoker', 'Never') GROUP BY 1, 2),
d AS (SELECT p_size, smoking FROM (SELECT DISTINCT p_size FROM lp WHERE p_size IS NOT NULL),
      (SELECT unnest(['Smoker', 'Never']) AS smoking))
SELECT d.p_size, d.smoking, {_fill_sql(LINE_STATUSES)} FROM d LEFT JOIN c USING (p_size, smoking)""")
def ct_age_smoking(spark, sf_dir):
    lp = lineitem_parts(spark, sf_dir).withColumn("smoking", C.replace_values("l_returnflag", _SMOKING))
    return TB.completed_counts(lp, "p_size", "smoking", ["Smoker", "Never"], "l_linestatus", LINE_STATUSES)


@query("ct_metastasis", sql=f"""
WITH x AS (SELECT CASE l_returnflag WHEN 'R' THEN 'Yes' WHEN 'A' THEN 'No' WHEN 'N' THEN 'No' END AS metastasis, l_linestatus
  FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE COALESCE(regexp_matches(o_orderpriority, 'URGENT|HIGH'), FALSE)))
SELECT metastasis, {_pivot_sql('l_linestatus', LINE_STATUSES)} FROM x WHERE metastasis IS NOT NULL GROUP BY metastasis""")
def ct_metastasis(spark, sf_dir):
    urgent = FL.keep_regex(table(spark, sf_dir, "orders"), "o_orderpriority", "URGENT|HIGH").select(
        F.col("o_orderkey").alias("l_orderkey"))
    li = table(spark, sf_dir, "lineitem").join(urgent, "l_orderkey", "left_semi")
    li = li.withColumn("metastasis", C.map_values("l_returnflag", {"R": "Yes", "A": "No", "N": "No"}))
    return TB.crosstab(li, ["metastasis"], "l_linestatus", LINE_STATUSES)


@query("melt_rates", sql=f"""
WITH f AS (SELECT p_type, {_FLAGS_SQL} FROM part),
m AS (UNPIVOT f ON {", ".join(f"received_{t}" for t in _TOKENS)} INTO NAME variable VALUE value)
SELECT p_type, replace(variable, 'received_', '') AS variable, round(AVG(value), 6) AS mean FROM m GROUP BY ALL""")
def melt_rates(spark, sf_dir):
    flags = [f"received_{t}" for t in _TOKENS]
    return rounded(TB.melt_means(_part_flags(spark, sf_dir), ["p_type"], flags, strip="received_"))


def _return_flags():
    return {"Returned": C.flag_contains("l_returnflag", "R"), "Accepted": C.flag_contains("l_returnflag", "A"),
            "None": C.flag_contains("l_returnflag", "N")}


@query("agg_prevalence", sql="""
SELECT * FROM (VALUES ('Returned', 0), ('Accepted', 1), ('None', 2)) AS k(name, i) JOIN (
  SELECT round(AVG(CASE WHEN contains(l_returnflag, 'R') THEN 1 ELSE 0 END) * 100, 6) AS p0,
         round(AVG(CASE WHEN contains(l_returnflag, 'A') THEN 1 ELSE 0 END) * 100, 6) AS p1,
         round(AVG(CASE WHEN contains(l_returnflag, 'N') THEN 1 ELSE 0 END) * 100, 6) AS p2 FROM lineitem) ON TRUE
""".replace("SELECT * FROM", "SELECT name, CASE i WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS percent FROM"))
def agg_prevalence(spark, sf_dir):
    return rounded(TB.prevalence(table(spark, sf_dir, "lineitem"), _return_flags()))


_COMBO_SQL = ("'R:' || CAST(CASE WHEN contains(p_name, 'red') THEN 1 ELSE 0 END AS VARCHAR) || ' C:' || "
              "CAST(CASE WHEN contains(p_name, 'cold') THEN 1 ELSE 0 END AS VARCHAR) || ' T:' || "
              "CAST(CASE WHEN contains(p_name, 'small') THEN 1 ELSE 0 END AS VARCHAR) || ' S:' || "
              "CAST(CASE WHEN contains(p_name, 'ring') THEN 1 ELSE 0 END AS VARCHAR)")


def _combo(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    parts = {"R": C.flag_contains("p_name", "red"), "C": C.flag_contains("p_name", "cold"),
             "T": C.flag_contains("p_name", "small"), "S": C.flag_contains("p_name", "ring")}
    return p.select(C.combo_label(parts).alias("combo"))


@query("top_combos", sql=f"""
WITH c AS (SELECT {_COMBO_SQL} AS value, COUNT(*) AS count FROM part GROUP BY 1)
SELECT value, count, round(count * 100.0 / (SELECT SUM(count) FROM c), 6) AS percent FROM c
ORDER BY count DESC, value LIMIT 3""")
def top_combos(spark, sf_dir):
    return rounded(TB.top_values(_combo(spark, sf_dir), "combo", 3))


@query("srt_index", sql="SELECT p_size AS value, COUNT(*) AS count FROM part GROUP BY 1 ORDER BY 1")
def srt_index(spark, sf_dir):
    return TB.counts_by_value(table(spark, sf_dir, "part"), "p_size")


@query("srt_custom", sql=f"""
WITH oc AS (SELECT {_STAGE_SQL} AS stage FROM orders)
SELECT stage, NULLIF(list_position(['IV', 'II', 'I'], stage), 0) AS position, COUNT(*) AS count FROM oc GROUP BY stage""")
def srt_custom(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(C.map_values("o_orderpriority", _STAGES).alias("stage"))
    counts = TB.group_size(o, ["stage"])
    return TB.ordered_by(counts, "stage", ["IV", "II", "I"]).select(
        "stage", C.custom_order("stage", ["IV", "II", "I"]).alias("position"), "count")


# ---------------------------------------------------------------- effects and report

_EFFECT_SQL = f"""
WITH lp AS (SELECT p_type, CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END AS y,
    CASE WHEN contains(l_returnflag, 'R') THEN 1 ELSE 0 END AS f0, CASE WHEN contains(l_returnflag, 'A') THEN 1 ELSE 0 END AS f1,
    CASE WHEN contains(l_returnflag, 'N') THEN 1 ELSE 0 END AS f2 FROM {LINEITEM_PARTS_SQL}),
u AS (SELECT p_type, 'Returned' AS treatment, f0 AS f, y FROM lp UNION ALL SELECT p_type, 'Accepted', f1, y FROM lp
      UNION ALL SELECT p_type, 'None', f2, y FROM lp),
g AS (SELECT p_type, treatment, AVG(CASE WHEN f = 1 THEN y END) AS mt, AVG(CASE WHEN f = 0 THEN y END) AS mc,
      COUNT(CASE WHEN f = 1 THEN 1 END) AS n1, COUNT(CASE WHEN f = 0 THEN 1 END) AS n0 FROM u GROUP BY 1, 2),
e AS (SELECT p_type, treatment, mc - mt AS efficacy, mt, mc, n1, n0 FROM g WHERE n1 > 10 AND n0 > 10)
"""


def _effects(spark, sf_dir):
    lp = lineitem_parts(spark, sf_dir)
    return treatment_effects(lp, ["p_type"], _return_flags(), C.flag_equals("l_linestatus", "F"))


@query("effect_treatment", sql=_EFFECT_SQL + """
SELECT p_type, treatment, round(efficacy, 6) AS efficacy, round(mt, 6) AS mortality_treatment,
  round(mc, 6) AS mortality_control, n1 AS sample_size, n0 AS control_size FROM e""")
def effect_treatment(spark, sf_dir):
    return rounded(_effects(spark, sf_dir))


@query("effect_positive", sql=_EFFECT_SQL + """
SELECT p_type, treatment, round(efficacy * 100, 6) AS efficacy_pct, round(mc * 100, 6) AS control_pct,
  round(mt * 100, 6) AS treated_pct FROM e WHERE efficacy > 0""")
def effect_positive(spark, sf_dir):
    return rounded(positive_effects(_effects(spark, sf_dir)))


@query("snk_report", sql=_EFFECT_SQL + f""",
prev AS (SELECT AVG(CASE WHEN contains(l_returnflag, 'R') THEN 1 ELSE 0 END) * 100 AS p0,
         AVG(CASE WHEN contains(l_returnflag, 'A') THEN 1 ELSE 0 END) * 100 AS p1,
         AVG(CASE WHEN contains(l_returnflag, 'N') THEN 1 ELSE 0 END) * 100 AS p2 FROM {LINEITEM_PARTS_SQL}),
combos AS (SELECT {_COMBO_SQL} AS value, COUNT(*) AS count FROM part GROUP BY 1),
top AS (SELECT value, count, count * 100.0 / (SELECT SUM(count) FROM combos) AS percent,
        ROW_NUMBER() OVER (ORDER BY count DESC, value) AS rk FROM combos),
pos AS (SELECT p_type || ' | ' || treatment AS k, efficacy * 100 AS v,
        ROW_NUMBER() OVER (ORDER BY efficacy DESC, p_type, treatment) AS rk FROM e WHERE efficacy > 0)
SELECT '1 prevalence' AS section, CAST(1 AS INTEGER) AS rank, 'Returned' AS key, round(p0, 6) AS value FROM prev UNION ALL
SELECT '1 prevalence', 2, 'Accepted', round(p1, 6) FROM prev UNION ALL
SELECT '1 prevalence', 3, 'None', round(p2, 6) FROM prev UNION ALL
SELECT '2 top combinations', CAST(rk AS INTEGER), value, round(percent, 6) FROM top WHERE rk <= 3 UNION ALL
SELECT '3 positive effects', CAST(rk AS INTEGER), k, round(v, 6) FROM pos""")
def snk_report(spark, sf_dir):
    lp = lineitem_parts(spark, sf_dir)
    prev = TB.prevalence(lp, _return_flags())
    top = TB.top_values(_combo(spark, sf_dir), "combo", 3)
    pos = positive_effects(_effects(spark, sf_dir))
    return rounded(findings(prev, top, pos, ["p_type", "treatment"], list(_return_flags())))
