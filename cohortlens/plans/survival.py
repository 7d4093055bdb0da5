"""Survival queries on the driver tables (SURVEY §2.7, §7.3: duration l_quantity, event l_linestatus = 'F',
group l_returnflag)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators.survival import km_at, km_curve, km_event_table
from cohortlens.plans.registry import query, rounded, table

_KM_SQL_BODY = """
WITH s AS (
  SELECT {gsel} l_quantity AS t, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS e
  FROM lineitem {where} ),
et AS (
  SELECT {gsel} t, CAST(SUM(e) AS BIGINT) AS events, COUNT(*) AS removed FROM s GROUP BY {gby} t ),
r AS (
  SELECT *, CAST(SUM(removed) OVER (PARTITION BY {gpart} ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS at_risk
  FROM et ),
k AS (
  SELECT *,
    PRODUCT(1 - events / at_risk) OVER (PARTITION BY {gpart} ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS survival,
    SUM(CASE WHEN at_risk > events THEN events / (at_risk * (at_risk - events)) ELSE 0 END)
        OVER (PARTITION BY {gpart} ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gw
  FROM r ),
curve AS (
  SELECT {gsel} t AS time, at_risk, events, removed - events AS censored, survival,
    CASE WHEN survival > 0 AND survival < 1
         THEN exp(-exp(ln(-ln(survival)) - 1.959963984540054 * sqrt(gw) / ln(survival))) END AS ci_lower,
    CASE WHEN survival > 0 AND survival < 1
         THEN exp(-exp(ln(-ln(survival)) + 1.959963984540054 * sqrt(gw) / ln(survival))) END AS ci_upper
  FROM k
  UNION ALL
  SELECT {gsel} 0.0 AS time, CAST(SUM(removed) AS BIGINT) AS at_risk, CAST(0 AS BIGINT) AS events,
    CAST(0 AS BIGINT) AS censored, 1.0 AS survival, CAST(NULL AS DOUBLE) AS ci_lower, CAST(NULL AS DOUBLE) AS ci_upper
  FROM et GROUP BY {gby_all} HAVING MIN(t) > 0 )
"""


def _km_sql(group: str | None, where: str = "", tail: str = "") -> str:
    gsel = f"{group}, " if group else ""
    gby = f"{group}, " if group else ""
    gpart = group if group else "NULL"
    gby_all = group if group else "()"
    body = _KM_SQL_BODY.format(gsel=gsel, gby=gby, gpart=gpart, gby_all=gby_all, where=where)
    return body + (tail or f"""
SELECT {gsel} time, at_risk, events, censored, round(survival, 6) AS survival,
       round(ci_lower, 6) AS ci_lower, round(ci_upper, 6) AS ci_upper FROM curve""")


def _lineitem_km(spark, sf_dir, group, where=None):
    li = table(spark, sf_dir, "lineitem")
    if where is not None:
        li = li.where(where)
    return km_curve(li, "l_quantity", (F.col("l_linestatus") == "F").cast("int"), group=group)


@query("km_by_group", sql=_km_sql("l_returnflag"))
def km_by_group(spark, sf_dir):
    return rounded(_lineitem_km(spark, sf_dir, ["l_returnflag"]))


@query("km_curve", sql=_km_sql(None))
def km_whole(spark, sf_dir):
    return rounded(_lineitem_km(spark, sf_dir, []))


@query("km_ci", sql=_km_sql(None, tail="""
SELECT time, round(survival, 6) AS survival, round(ci_lower, 6) AS ci_lower, round(ci_upper, 6) AS ci_upper,
       CASE WHEN ci_lower IS NULL THEN NULL WHEN ci_lower <= survival AND survival <= ci_upper THEN 1 ELSE 0 END AS brackets
FROM curve"""))
def km_ci(spark, sf_dir):
    c = _lineitem_km(spark, sf_dir, [])
    inside = F.when(F.col("ci_lower").isNull(), F.lit(None)).when(
        (F.col("ci_lower") <= F.col("survival")) & (F.col("survival") <= F.col("ci_upper")), 1
    ).otherwise(0)
    return rounded(c.select("time", "survival", "ci_lower", "ci_upper", inside.cast("int").alias("brackets")))


@query("km_event_table", sql="""
WITH s AS (SELECT l_returnflag, l_quantity AS t, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS e FROM lineitem),
et AS (SELECT l_returnflag, t AS time, CAST(SUM(e) AS BIGINT) AS events, COUNT(*) AS removed FROM s GROUP BY l_returnflag, t)
SELECT l_returnflag, time, events, removed, removed - events AS censored,
  CAST(SUM(removed) OVER (PARTITION BY l_returnflag ORDER BY time DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS at_risk
FROM et""")
def km_events(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return km_event_table(li, "l_quantity", (F.col("l_linestatus") == "F").cast("int"), ["l_returnflag"]).select(
        "l_returnflag", "time", "events", "removed", "censored", "at_risk"
    )


# km_cohort: curve per group inside a filtered cohort (the reference keeps stages III/IV, then one curve per
# province).  Bound here to orders with priority 1/2 joined to their line items, one curve per ship mode proxy
# l_returnflag.
@query("km_cohort", sql=_km_sql(
    "l_returnflag",
    where="WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))",
))
def km_cohort(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    cohort = li.join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    return rounded(km_curve(cohort, "l_quantity", (F.col("l_linestatus") == "F").cast("int"), ["l_returnflag"]))


@query("km_at", sql=_km_sql("l_returnflag", tail="""
SELECT l_returnflag, round(max_by(survival, CASE WHEN time <= 25 THEN time END), 6) AS survival_at,
       min(CASE WHEN survival <= 0.5 THEN time END) AS median_time
FROM curve GROUP BY l_returnflag"""))
def km_at_query(spark, sf_dir):
    return rounded(km_at(_lineitem_km(spark, sf_dir, ["l_returnflag"]), 25.0, ["l_returnflag"]))
