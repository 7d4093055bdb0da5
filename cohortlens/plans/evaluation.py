"""Metrics, splits, folds and weights on driver columns:
label l_linestatus = 'F', score l_extendedprice, hard prediction l_discount ≥ 0.05."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions import columns as C
from cohortlens.operators import evaluate as EV
from cohortlens.operators import splits as SP
from cohortlens.plans.registry import query, rounded, table


def _scored(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", C.flag_equals("l_linestatus", "F").alias("label"),
                     F.col("l_extendedprice").alias("score"),
                     F.when(F.col("l_discount") >= 0.05, 1).otherwise(0).alias("prediction"))


_SCORED_SQL = """(SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS label,
  l_extendedprice AS score, CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END AS prediction FROM lineitem)"""
_COUNTS_SQL = f"""
WITH s AS {_SCORED_SQL},
c AS (SELECT COUNT(CASE WHEN label = 1 AND prediction = 1 THEN 1 END) AS tp,
             COUNT(CASE WHEN label = 0 AND prediction = 1 THEN 1 END) AS fp,
             COUNT(CASE WHEN label = 0 AND prediction = 0 THEN 1 END) AS tn,
             COUNT(CASE WHEN label = 1 AND prediction = 0 THEN 1 END) AS fn FROM s)
"""


def _div(a, b):
    return f"COALESCE(CAST({a} AS DOUBLE) / NULLIF({b}, 0), 0.0)"


@query("evl_confusion", sql=f"""
WITH s AS {_SCORED_SQL}
SELECT a.actual, p.predicted, COUNT(s.label) AS count
FROM (VALUES (0), (1)) a(actual) CROSS JOIN (VALUES (0), (1)) p(predicted)
LEFT JOIN s ON s.label = a.actual AND s.prediction = p.predicted GROUP BY 1, 2""")
def evl_confusion(spark, sf_dir):
    return EV.confusion(_scored(spark, sf_dir), "label", "prediction")


@query("evl_accuracy", sql=_COUNTS_SQL + f"SELECT round({_div('tp + tn', 'tp + fp + tn + fn')}, 6) AS accuracy FROM c")
def evl_accuracy(spark, sf_dir):
    return rounded(EV.binary_metrics(_scored(spark, sf_dir), "label", "prediction").select("accuracy"))


@query("evl_rates", sql=_COUNTS_SQL + f"""
SELECT tp, fp, tn, fn, round({_div('tp', 'tp + fn')}, 6) AS sensitivity, round({_div('tn', 'tn + fp')}, 6) AS specificity,
  round({_div('tp', 'tp + fp')}, 6) AS precision FROM c""")
def evl_rates(spark, sf_dir):
    m = EV.binary_metrics(_scored(spark, sf_dir), "label", "prediction")
    return rounded(m.select("tp", "fp", "tn", "fn", "sensitivity", "specificity", "precision"))


@query("evl_f1", sql=f"""
WITH s AS (SELECT *, CASE WHEN ROW_NUMBER() OVER (ORDER BY md5(CAST(l_orderkey * 10 + l_linenumber AS VARCHAR)))
             <= CEIL(0.2 * COUNT(*) OVER ()) THEN 1 ELSE 0 END AS is_test FROM {_SCORED_SQL}),
c AS (SELECT is_test, COUNT(CASE WHEN label = 1 AND prediction = 1 THEN 1 END) AS tp,
             COUNT(CASE WHEN label = 0 AND prediction = 1 THEN 1 END) AS fp,
             COUNT(CASE WHEN label = 1 AND prediction = 0 THEN 1 END) AS fn FROM s GROUP BY is_test)
SELECT is_test, round({_div('2 * tp', '2 * tp + fp + fn')}, 6) AS f1 FROM c""")
def evl_f1(spark, sf_dir):
    s = _scored(spark, sf_dir).withColumn("row_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    split = SP.random_split(s, "row_id", 0.2)
    return rounded(EV.binary_metrics(split, "label", "prediction", group_by=["is_test"]).select("is_test", "f1"))


@query("evl_report", sql=_COUNTS_SQL + f""",
r AS (SELECT {_div('tn', 'tn + fn')} AS p0, {_div('tn', 'tn + fp')} AS r0, {_div('tp', 'tp + fp')} AS p1,
        {_div('tp', 'tp + fn')} AS r1, CAST(tn + fp AS DOUBLE) AS s0, CAST(tp + fn AS DOUBLE) AS s1,
        {_div('tp + tn', 'tp + fp + tn + fn')} AS acc FROM c),
f AS (SELECT *, {_div('2 * p0 * r0', 'p0 + r0')} AS f0, {_div('2 * p1 * r1', 'p1 + r1')} AS f1, s0 + s1 AS n FROM r)
SELECT '0' AS class, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1, s0 AS support FROM f UNION ALL
SELECT '1', round(p1, 6), round(r1, 6), round(f1, 6), s1 FROM f UNION ALL
SELECT 'accuracy', round(acc, 6), round(acc, 6), round(acc, 6), n FROM f UNION ALL
SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), n FROM f UNION ALL
SELECT 'weighted avg', round({_div('p0 * s0 + p1 * s1', 'n')}, 6), round({_div('r0 * s0 + r1 * s1', 'n')}, 6),
  round({_div('f0 * s0 + f1 * s1', 'n')}, 6), n FROM f""")
def evl_report(spark, sf_dir):
    return rounded(EV.classification_report(_scored(spark, sf_dir), "label", "prediction"))


_ROC_SQL = f"""
WITH s AS {_SCORED_SQL},
per AS (SELECT score, SUM(label) AS pos, SUM(1 - label) AS neg FROM s WHERE score IS NOT NULL GROUP BY score),
cum AS (SELECT score, pos, neg, SUM(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cp,
          SUM(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cn FROM per),
tot AS (SELECT SUM(pos) AS P, SUM(neg) AS N FROM per),
pts AS (SELECT score AS threshold, {_div('cn', 'N')} AS fpr, {_div('cp', 'P')} AS tpr FROM cum, tot
        UNION ALL SELECT 'inf'::DOUBLE, 0.0, 0.0)
"""


@query("evl_roc", sql=_ROC_SQL + "SELECT threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM pts")
def evl_roc(spark, sf_dir):
    return rounded(EV.roc_points(_scored(spark, sf_dir), "label", "score"))


@query("evl_auc", sql=_ROC_SQL + """,
tr AS (SELECT (fpr - LAG(fpr) OVER (ORDER BY threshold DESC)) * (tpr + LAG(tpr) OVER (ORDER BY threshold DESC)) / 2 AS a FROM pts)
SELECT round(SUM(a), 6) AS auc, (SELECT CAST(P AS BIGINT) FROM tot) AS positives, (SELECT CAST(N AS BIGINT) FROM tot) AS negatives
FROM tr""")
def evl_auc(spark, sf_dir):
    return rounded(EV.roc_auc(_scored(spark, sf_dir), "label", "score"))


# ---------------------------------------------------------------- splits, folds, weights

@query("spl_random", sql="""
SELECT o_orderkey, CASE WHEN ROW_NUMBER() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR))) <= CEIL(0.2 * COUNT(*) OVER ())
  THEN 1 ELSE 0 END AS is_test FROM orders""")
def spl_random(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return SP.random_split(o, "o_orderkey", 0.2)


@query("spl_stratified", sql="""
SELECT o_orderkey, o_orderstatus, CASE WHEN ROW_NUMBER() OVER (PARTITION BY o_orderstatus ORDER BY md5(CAST(o_orderkey AS VARCHAR)))
  <= CEIL(0.3 * COUNT(*) OVER (PARTITION BY o_orderstatus)) THEN 1 ELSE 0 END AS is_test FROM orders""")
def spl_stratified(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return SP.stratified_split(o, "o_orderkey", "o_orderstatus", 0.3)


@query("fld_kfold", sql="SELECT o_orderkey, CAST(NTILE(5) OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS fold FROM orders")
def fld_kfold(spark, sf_dir):
    return SP.kfold(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 5)


@query("fld_kfold_stratified", sql="""
SELECT o_orderkey, o_orderstatus, CAST(NTILE(5) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS INTEGER) AS fold
FROM orders""")
def fld_kfold_stratified(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return SP.kfold(o, "o_orderkey", 5, label="o_orderstatus")


@query("wgt_balanced", sql="""
SELECT o_orderkey, o_orderstatus, round(COUNT(*) OVER () / (3.0 * COUNT(*) OVER (PARTITION BY o_orderstatus)), 6) AS weight
FROM orders""")
def wgt_balanced(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return rounded(SP.balanced_weights(o, "o_orderstatus"))
