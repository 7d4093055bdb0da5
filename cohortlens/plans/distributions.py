"""Distribution, correlation and error summaries on the driver tables (SURVEY §2.6 dist_*, corr_matrix,
pair_grid, reg_sse_sst_r2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions import columns as C
from cohortlens.operators import distributions as D
from cohortlens.plans.registry import query, rounded, table

_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("dist_box", sql="""
WITH q AS (SELECT l_returnflag, COUNT(*) AS n, quantile_cont(l_extendedprice, 0.25) AS q1,
             quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3
           FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY l_returnflag),
w AS (SELECT l.l_returnflag, MIN(l_extendedprice) AS mn, MAX(l_extendedprice) AS mx,
        MIN(CASE WHEN l_extendedprice >= q1 - 1.5 * (q3 - q1) AND l_extendedprice <= q3 + 1.5 * (q3 - q1) THEN l_extendedprice END) AS wl,
        MAX(CASE WHEN l_extendedprice >= q1 - 1.5 * (q3 - q1) AND l_extendedprice <= q3 + 1.5 * (q3 - q1) THEN l_extendedprice END) AS wh,
        COUNT(CASE WHEN NOT (l_extendedprice >= q1 - 1.5 * (q3 - q1) AND l_extendedprice <= q3 + 1.5 * (q3 - q1)) THEN 1 END) AS outliers
      FROM lineitem l JOIN q USING (l_returnflag) WHERE l_extendedprice IS NOT NULL GROUP BY l.l_returnflag)
SELECT l_returnflag, n, round(mn, 6) AS min, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  round(mx, 6) AS max, round(wl, 6) AS whisker_low, round(wh, 6) AS whisker_high, outliers
FROM q JOIN w USING (l_returnflag)""")
def dist_box(spark, sf_dir):
    return rounded(D.box_summary(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"]))


@query("dist_quantiles", sql="""
SELECT event_type, COUNT(*) AS n, round(quantile_cont(value, 0.1), 6) AS q0, round(quantile_cont(value, 0.5), 6) AS q1,
  round(quantile_cont(value, 0.9), 6) AS q2, round(quantile_cont(value, 0.99), 6) AS q3
FROM events WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY event_type""")
def dist_quantiles(spark, sf_dir):
    return rounded(D.quantiles(table(spark, sf_dir, "events"), "value", [0.1, 0.5, 0.9, 0.99], ["event_type"]))


_HIST_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS variable, CAST({c} AS DOUBLE) AS value FROM lineitem WHERE {c} IS NOT NULL" for c in _NUM)


@query("dist_hist", sql=f"""
WITH long AS ({_HIST_SQL}),
s AS (SELECT variable, MIN(value) AS mn, MAX(value) AS mx, (MAX(value) - MIN(value)) / 10 AS w FROM long GROUP BY variable),
b AS (SELECT variable, CAST(CASE WHEN w = 0 THEN 0 ELSE LEAST(FLOOR((value - mn) / w), 9) END AS INTEGER) AS bin
      FROM long JOIN s USING (variable)),
c AS (SELECT variable, bin, COUNT(*) AS count FROM b GROUP BY 1, 2),
g AS (SELECT variable, mn, w, CAST(unnest(range(0, 10)) AS INTEGER) AS bin FROM s)
SELECT g.variable, g.bin, round(mn + g.bin * w, 6) AS lo, round(mn + (g.bin + 1) * w, 6) AS hi,
  CAST(COALESCE(c.count, 0) AS BIGINT) AS count FROM g LEFT JOIN c USING (variable, bin)""")
def dist_hist(spark, sf_dir):
    return rounded(D.histogram(table(spark, sf_dir, "lineitem"), _NUM, bins=10))


@query("dist_kde", sql="""
WITH v AS (SELECT value AS v FROM events WHERE value IS NOT NULL AND NOT isnan(value)),
s AS (SELECT COUNT(*) AS n, STDDEV_SAMP(v) * POW(COUNT(*), -0.2) AS bw, MIN(v) AS mn, MAX(v) AS mx FROM v),
g AS (SELECT unnest(range(0, 200)) AS point),
c AS (SELECT v, COUNT(*) AS c FROM v GROUP BY v),
pts AS (SELECT point, mn - 3 * bw + point * ((mx + 3 * bw) - (mn - 3 * bw)) / 199 AS x, bw, n FROM g, s)
SELECT CAST(point AS INTEGER) AS point, round(x, 6) AS x,
  round(SUM(c * exp(-0.5 * ((x - v) / bw) * ((x - v) / bw))) / (n * bw * sqrt(2 * pi())), 6) AS density
FROM pts, c GROUP BY point, x, n, bw""")
def dist_kde(spark, sf_dir):
    return rounded(D.kde(table(spark, sf_dir, "events"), "value", grid_size=200).withColumn(
        "point", F.col("point").cast("int")))


@query("dist_violin", sql="""
WITH v AS (SELECT event_type, value AS v FROM events WHERE value IS NOT NULL AND NOT isnan(value)),
s AS (SELECT event_type, COUNT(*) AS n, STDDEV_SAMP(v) * POW(COUNT(*), -0.2) AS bw, MIN(v) AS mn, MAX(v) AS mx
      FROM v GROUP BY event_type),
g AS (SELECT unnest(range(0, 200)) AS point),
c AS (SELECT event_type, v, COUNT(*) AS c FROM v GROUP BY event_type, v),
pts AS (SELECT event_type, point, mn - 3 * bw + point * ((mx + 3 * bw) - (mn - 3 * bw)) / 199 AS x, bw, n FROM g, s)
SELECT pts.event_type, CAST(point AS INTEGER) AS point, round(x, 6) AS x,
  round(SUM(c * exp(-0.5 * ((x - v) / bw) * ((x - v) / bw))) / (n * bw * sqrt(2 * pi())), 6) AS density
FROM pts JOIN c USING (event_type) GROUP BY pts.event_type, point, x, n, bw""")
def dist_violin(spark, sf_dir):
    return rounded(D.kde_by_group(table(spark, sf_dir, "events"), "value", ["event_type"], grid_size=200))


_PAIRS = [(a, b) for i, a in enumerate(_NUM) for b in _NUM[i + 1:]]


@query("corr_matrix", sql=" UNION ALL ".join(
    [f"SELECT '{a}' AS var1, '{a}' AS var2, 1.0 AS corr" for a in _NUM]
    + [f"SELECT '{a}', '{b}', round(corr({a}, {b}), 6) FROM lineitem" for a, b in _PAIRS]
    + [f"SELECT '{b}', '{a}', round(corr({a}, {b}), 6) FROM lineitem" for a, b in _PAIRS]))
def corr_matrix(spark, sf_dir):
    return rounded(D.corr_matrix(table(spark, sf_dir, "lineitem"), _NUM))


_PG = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_suppkey"]
_PG_BIN = {c: f"CAST(CASE WHEN (mx_{c} - mn_{c}) / 10 = 0 THEN 0 ELSE LEAST(FLOOR(({c} - mn_{c}) / ((mx_{c} - mn_{c}) / 10)), 9) END AS INTEGER)"
           for c in _PG}


@query("pair_grid", sql=f"""
WITH d AS (SELECT {", ".join(_PG)} FROM lineitem WHERE {" AND ".join(f"{c} IS NOT NULL" for c in _PG)}),
s AS (SELECT {", ".join(f"MIN({c}) AS mn_{c}, MAX({c}) AS mx_{c}" for c in _PG)} FROM d),
b AS (SELECT {", ".join(f"{_PG_BIN[c]} AS b_{c}" for c in _PG)} FROM d, s)
""" + " UNION ALL ".join(
    f"SELECT '{a}' AS var1, '{b}' AS var2, b_{a} AS bin1, b_{b} AS bin2, COUNT(*) AS count FROM b GROUP BY 3, 4"
    for i, a in enumerate(_PG) for b in _PG[i + 1:]))
def pair_grid(spark, sf_dir):
    return D.pair_grid(table(spark, sf_dir, "lineitem"), _PG, bins=10)


@query("reg_sse_sst_r2", sql="""
WITH d AS (SELECT CAST(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS DOUBLE) AS y,
                  CAST(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS DOUBLE) AS p FROM lineitem),
a AS (SELECT SUM((y - p) * (y - p)) AS sse, VAR_POP(y) * COUNT(y) AS sst FROM d)
SELECT round(sse, 6) AS sse, round(sst, 6) AS sst, round(CASE WHEN sst = 0 THEN 0 ELSE 1 - sse / sst END, 6) AS r2 FROM a""")
def reg_sse_sst_r2(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return rounded(D.regression_errors(li, C.flag_equals("l_linestatus", "F"), C.flag_equals("l_returnflag", "N")))
