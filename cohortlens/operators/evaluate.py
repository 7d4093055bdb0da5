"""Classification metrics on (label, prediction, score) columns.

All counts come from one aggregate; ratios use ``try_divide`` with the reference's zero guard.  ROC points and AUC
reduce the scores to distinct values first and take the cumulative counts from ``running_totals`` (blocked when
large), so no step sorts the whole table in one task.  AUC is the trapezoid area of the full ROC curve, i.e. the
Mann–Whitney statistic with ties counted as one half.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.columns import col
from cohortlens.operators.prefix import running_totals
from cohortlens.operators.tables import domain_frame


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, label: str | Column, prediction: str | Column, classes=(0, 1)) -> DataFrame:
    """(actual, predicted, count) for every pair of classes, zeros included."""
    d = df.select(col(label).cast("int").alias("actual"), col(prediction).cast("int").alias("predicted"))
    counts = d.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("count"))
    dom = domain_frame(df.sparkSession, {"actual": list(classes), "predicted": list(classes)})
    return dom.join(counts, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"))


def _counts(df: DataFrame, label, prediction, positive=1, group_by=()) -> DataFrame:
    y = col(label) == F.lit(positive)
    p = col(prediction) == F.lit(positive)
    return df.groupBy(*group_by).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"),
    )


def binary_metrics(df: DataFrame, label: str | Column, prediction: str | Column, positive=1,
                   group_by=()) -> DataFrame:
    """One row (per group): tp, fp, tn, fn, accuracy, sensitivity, specificity, precision, f1."""
    c = _counts(df, label, prediction, positive, group_by)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return c.select(
        *group_by, "tp", "fp", "tn", "fn",
        _ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        _ratio(tp, tp + fn).alias("sensitivity"),
        _ratio(tn, tn + fp).alias("specificity"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def classification_report(df: DataFrame, label: str | Column, prediction: str | Column) -> DataFrame:
    """Rows (class, precision, recall, f1, support) for classes '0', '1', 'accuracy', 'macro avg' and
    'weighted avg', laid out like scikit-learn's report (accuracy row: the value in every metric column, support
    = total)."""
    c = _counts(df, label, prediction, 1)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    # class 1 sees (tp, fp, fn); class 0 sees the mirror (tn, fn, fp)
    p1, r1 = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    p0, r0 = _ratio(tn, tn + fn), _ratio(tn, tn + fp)
    f1_1, f1_0 = _ratio(2 * p1 * r1, p1 + r1), _ratio(2 * p0 * r0, p0 + r0)
    s1, s0 = (tp + fn).cast("double"), (tn + fp).cast("double")
    n = s0 + s1
    acc = _ratio(tp + tn, n)

    def row(name, p, r, f, s):
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"),
                        s.alias("support"))

    rows = [
        row("0", p0, r0, f1_0, s0),
        row("1", p1, r1, f1_1, s1),
        row("accuracy", acc, acc, acc, n),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f1_0 + f1_1) / 2, n),
        row("weighted avg", _ratio(p0 * s0 + p1 * s1, n), _ratio(r0 * s0 + r1 * s1, n),
            _ratio(f1_0 * s0 + f1_1 * s1, n), n),
    ]
    return c.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _score_table(df: DataFrame, label, score, positive=1):
    """Positives and negatives per distinct score, with running counts from the top; rows without a label or a score
    are left out, as in the other metrics."""
    d = df.select(F.when(col(label) == F.lit(positive), 1).otherwise(0).alias("y"),
                  F.nanvl(col(score).cast("double"), F.lit(None).cast("double")).alias("score"), col(label).alias("__label"))
    d = d.where(F.col("score").isNotNull() & F.col("__label").isNotNull())
    per = d.groupBy("score").agg(F.sum("y").cast("long").alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    return running_totals(per, "score", {"cum_pos": "pos", "cum_neg": "neg"}, ascending=False, with_totals=True)


def roc_points(df: DataFrame, label: str | Column, score: str | Column, positive=1) -> DataFrame:
    """ROC curve points (threshold, fpr, tpr) at every distinct score, plus the (0, 0) origin with threshold
    +∞ (``roc_curve(drop_intermediate=False)``)."""
    cum = _score_table(df, label, score, positive)
    # class totals ride along with the running counts: no second aggregation over the scores
    pts = cum.select(F.col("score").alias("threshold"), _ratio(F.col("cum_neg"), F.col("cum_neg_total")).alias("fpr"),
                     _ratio(F.col("cum_pos"), F.col("cum_pos_total")).alias("tpr"))
    origin = df.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"),
                                             F.lit(0.0).alias("tpr"))
    return pts.unionByName(origin)


def roc_auc(df: DataFrame, label: str | Column, score: str | Column, positive=1) -> DataFrame:
    """One row (auc, positives, negatives): trapezoid area under the ROC curve, exact with tied scores."""
    cum = _score_table(df, label, score, positive)
    # each negative at score s is beaten by the positives above s and ties with half of those at s
    agg = cum.agg(
        F.sum(F.col("neg").cast("double") * (F.col("cum_pos") - F.col("pos") / 2.0)).alias("w"),
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"),
    )
    return agg.select(_ratio(F.col("w"), F.col("positives").cast("double") * F.col("negatives").cast("double")).alias("auc"),
                      F.col("positives").cast("long").alias("positives"),
                      F.col("negatives").cast("long").alias("negatives"))
