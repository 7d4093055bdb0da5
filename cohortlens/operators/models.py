"""Encoders, Spark ML classifiers, grid search and model reports.

Estimators are Spark ML's own; the trees of searches over folds and grids on a table of moderate size are grown in
tasks (``fits``), which the table reaches as a broadcast.  Else data never passes
through the driver: fits read the DataFrame, metrics come from the distributed operators in ``evaluate``.  Only
model state (encoder labels, tree structure, coefficients, importances — sized by the number of features or
levels, never by rows) is read on the driver, as Spark ML itself does.
"""

from __future__ import annotations

import math
import statistics
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from cohortlens.operators import fits
from cohortlens.operators.distributions import regression_errors
from cohortlens.operators.evaluate import binary_metrics, classification_report, roc_auc
from cohortlens.operators.prefix import running_totals
from cohortlens.session import ensure_checkpoint_dir

# Spark ML refuses trees deeper than this (scikit-learn grids may ask for more; such points are clamped).
MAX_TREE_DEPTH = 30
# Rows of a partition where a table is read by very many small jobs (every level of every tree).
ROWS_PER_TASK = 100_000
# A single fit has the cores to itself: its table is dealt to up to SPREAD partitions of at least LEAST_ROWS rows.  Both depend
# on the number of rows alone, as draws of a forest depend on the partitions.
SPREAD = 24
LEAST_ROWS = 2_500
# Rows x trees of a forest that are fitted at once: what Spark ML keeps of them (draws and nodes, some 16 bytes each) is in
# memory or on local disk until the fit ends.
MOST_NOTED = 256_000_000


# ---------------------------------------------------------------- encoders

# A table of one row per level is broadcast up to this many levels.
SMALL_LEVELS = 100_000


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """(level, code): the sorted distinct values with their 0-based positions (``LabelEncoder.classes_``), found by
    distributed running counts, however many there are; NULL is no level."""
    levels_ = df.select(F.col(column).alias("level")).where(F.col("level").isNotNull()).distinct()
    counted = running_totals(levels_, "level", {"__n": F.lit(1).cast("long")})
    return counted.select("level", (F.col("__n") - 1).cast("int").alias("code"))


def _small(codes: DataFrame) -> DataFrame:
    return F.broadcast(codes) if codes.count() <= SMALL_LEVELS else codes


def label_encode(df: DataFrame, column: str, output: str, fit_on: DataFrame | None = None) -> DataFrame:
    """Alphabetical ordinal code (0-based, ``LabelEncoder``) of the levels of ``fit_on`` (e.g. the training rows;
    by default the table itself); NULL and levels unseen there give NULL."""
    codes = _small(label_codes(df if fit_on is None else fit_on, column).select(F.col("level").alias("__level"), F.col("code").alias(output)))
    return df.join(codes, F.col(column) == F.col("__level"), "left").select(df["*"], output)


def label_decode(df: DataFrame, codes: DataFrame, column: str, output: str) -> DataFrame:
    """The level of a code (``inverse_transform``), with ``codes`` from ``label_codes``; unknown codes give NULL."""
    back = _small(codes.select(F.col("code").alias("__code"), F.col("level").alias(output)))
    return df.join(back, F.col(column) == F.col("__code"), "left").select(df["*"], output)


def levels(df: DataFrame, column: str, max_levels: int = 1000) -> list:
    """Sorted distinct non-null values; refuses more than ``max_levels`` (a column per level is no sensible schema
    beyond; ``one_hot_vector`` has no such bound).

    A HyperLogLog pass rejects high-cardinality columns before any distinct shuffle is planned."""
    if (df.agg(F.approx_count_distinct(column, 0.01)).first()[0] or 0) > 1.05 * max_levels:
        raise ValueError(f"{column} has more than {max_levels} levels; use one_hot_vector")
    vals = [r[0] for r in df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)
            .limit(max_levels + 1).collect()]
    if len(vals) > max_levels:
        raise ValueError(f"{column} has more than {max_levels} levels; use one_hot_vector")
    return vals


def one_hot(df: DataFrame, columns: Sequence[str], drop_first: bool = True, max_levels: int = 1000,
            fit_on: DataFrame | None = None) -> DataFrame:
    """0/1 dummies ``{column}_{level}`` (``pd.get_dummies``) of the levels of ``fit_on`` (by default the table
    itself), in one projection; the alphabetically first level is dropped with ``drop_first``; NULL gives all zeros."""
    dummies = []
    for c in columns:
        lv = levels(df if fit_on is None else fit_on, c, max_levels)
        dummies += [F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}") for v in (lv[1:] if drop_first else lv)]
    return df.select("*", *dummies)


def one_hot_vector(df: DataFrame, column: str, output: str, drop_first: bool = True, fit_on: DataFrame | None = None) -> DataFrame:
    """The dummies of a column with any number of levels as one sparse vector; position = code of the level (less
    one with ``drop_first``); NULL and unseen levels give an all-zero vector."""
    src = df if fit_on is None else fit_on
    codes = label_codes(src, column)
    n = codes.count()
    size = max(n - drop_first, 0)
    coded = label_encode(df, column, "__code", fit_on=src)
    # the encoder drops what lies past the last category; a missing level is sent there
    at = F.coalesce(F.col("__code") - F.lit(int(drop_first)), F.lit(-1))
    coded = coded.withColumn("__at", F.when(at >= 0, at).otherwise(F.lit(size)).cast("double"))
    from pyspark.ml.feature import OneHotEncoder

    spread = df.sparkSession.range(size + 1).select(F.col("id").cast("double").alias("__at"))
    model = OneHotEncoder(inputCols=["__at"], outputCols=[output], dropLast=True).fit(spread)
    return model.transform(coded).drop("__code", "__at")


# ---------------------------------------------------------------- estimators

def assemble(df: DataFrame, features: Sequence[str], label: str, handle_invalid: str = "error",
             impute: str | None = None) -> DataFrame:
    """(features vector, label double) next to the input columns.

    Rows with NULL features raise (``handle_invalid='error'``) or are skipped (``'skip'``); ``impute='mean'`` or
    ``'median'`` fills them first with Spark ML's ``Imputer`` (gradient boosting in the reference accepts missing
    values, Spark vectors do not)."""
    d = df.withColumn("label", F.col(label).cast("double"))
    cols = list(features)
    if impute:
        from pyspark.ml.feature import Imputer

        d = d.select("*", *[F.col(c).cast("double").alias(f"__imp_{c}") for c in cols])
        imp = Imputer(strategy=impute, inputCols=[f"__imp_{c}" for c in cols],
                      outputCols=[f"__imputed_{c}" for c in cols]).fit(d)
        d = imp.transform(d).drop(*[f"__imp_{c}" for c in cols])
        cols = [f"__imputed_{c}" for c in cols]
    va = VectorAssembler(inputCols=cols, outputCol="features", handleInvalid=handle_invalid)
    out = va.transform(d)
    return out.drop(*[c for c in cols if c.startswith("__imputed_")])


def logistic(C: float = 1.0, n_rows: int | None = None, max_iter: int = 100, tol: float = 1e-4,
             weight_col: str | None = None) -> LogisticRegression:
    """L2 logistic regression matching scikit-learn's objective: regParam = 1 / (C · n), no standardisation."""
    reg = 0.0 if not n_rows else 1.0 / (C * n_rows)
    lr = LogisticRegression(regParam=reg, elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=tol)
    if weight_col:
        lr.setWeightCol(weight_col)
    return lr


def _depth(requested: int) -> int:
    if requested > MAX_TREE_DEPTH:
        raise ValueError(f"trees can't be deeper than {MAX_TREE_DEPTH}, asked for {requested}; grids clamp and record it")
    return requested


def tree(max_depth: int = 5, min_leaf: int = 1, weight_col: str | None = None, seed: int = 42, max_bins: int = 32):
    m = DecisionTreeClassifier(maxDepth=_depth(max_depth), minInstancesPerNode=min_leaf, seed=seed, maxBins=max_bins)
    if weight_col:
        m.setWeightCol(weight_col)
    return m


def forest(n_trees: int = 100, max_depth: int = 15, min_leaf: int = 1, weight_col: str | None = None, seed: int = 42):
    m = RandomForestClassifier(numTrees=n_trees, maxDepth=_depth(max_depth), minInstancesPerNode=min_leaf, seed=seed)
    if weight_col:
        m.setWeightCol(weight_col)
    return m


def boosted(n_trees: int = 100, max_depth: int = 3, step: float = 0.1, subsample: float = 1.0, seed: int = 42,
            weight_col: str | None = None):
    """Gradient-boosted trees (first-order; XGBoost's regularised objective is not reproduced)."""
    m = GBTClassifier(maxIter=n_trees, maxDepth=_depth(max_depth), stepSize=step, subsamplingRate=subsample, seed=seed)
    if weight_col:
        m.setWeightCol(weight_col)
    return m


# Grid dimensions of scikit-learn that Spark ML's trees have no parameter for.
NO_COUNTERPART = ("min_samples_split",)


def grid(estimator, params: Mapping[str, Sequence]) -> list:
    """Exhaustive parameter grid; depths beyond Spark's limit are clamped and duplicates removed (``grid_notes``
    tells which), dimensions without a counterpart are left out."""
    b = ParamGridBuilder()
    for name, values in params.items():
        if name in NO_COUNTERPART:
            continue
        vals = list(values)
        if name == "maxDepth":
            vals = sorted({min(int(v), MAX_TREE_DEPTH) for v in vals})
        b = b.addGrid(estimator.getParam(name), vals)
    return b.build()


def grid_notes(params: Mapping[str, Sequence]) -> str:
    """What of a requested grid was changed: clamped depths and dimensions that were left out."""
    notes = [f"maxDepth {v} -> {MAX_TREE_DEPTH}" for v in params.get("maxDepth", ()) if v > MAX_TREE_DEPTH]
    notes += [f"{name} left out" for name in params if name in NO_COUNTERPART]
    return "; ".join(notes)


def grid_search(estimator, params: Mapping[str, Sequence], train: DataFrame, fold_col: str = "fold",
                parallelism: int = 4, k: int = 5, refit: bool = True):
    """k-fold grid search scored by exact ROC AUC (no score binning), refitting the best point on all rows; without ``refit``
    that is left to the caller."""
    ev = BinaryClassificationEvaluator(metricName="areaUnderROC", numBins=0)
    points = grid(estimator, params)
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=points, evaluator=ev,
                        foldCol=fold_col, numFolds=k, parallelism=parallelism, seed=42)
    with compact(train) as rows:
        dealt = [estimator.copy(p) for p in points]
        dealt = fits.scores(rows, dealt, [fits.whole(e) for e in dealt], "auc", fold_col, k)
        found = [[fold[0][0] for fold in point] for point in dealt] if dealt else _fold_metrics(estimator, points, ev, rows, fold_col, k, parallelism)
    means = [statistics.fmean(m) for m in found]
    best = means.index(max(means)) if ev.isLargerBetter() else means.index(min(means))
    return cv._copyValues(CrossValidatorModel(fit_single(estimator.copy(points[best]), train) if refit else None, means, None, [statistics.pstdev(m) for m in found]))


def _fold_metrics(estimator, points: Sequence[Mapping], evaluator, rows: DataFrame, fold_col: str, k: int,
                  parallelism: int) -> list[list[float]]:
    """Per point its metric on every fold.  ``CrossValidator`` fits the points of one fold side by side and the folds
    one after the other; here all fits are independent tasks, a core for each."""

    def one(point: Mapping, fold: int) -> float:
        inside = F.col(fold_col) == fold
        model = estimator.fit(rows.where(~inside), point)
        return float(evaluator.evaluate(model.transform(rows.where(inside), point)))

    found = _fit_all([lambda p=p, f=f: one(p, f) for p in points for f in range(k)], _threads(rows, parallelism))
    return [found[i * k:(i + 1) * k] for i in range(len(points))]


def _threads(df: DataFrame, parallelism: int) -> int:
    """Fits side by side: one per core at least, as a fit of a small table keeps one core busy."""
    return max(parallelism, df.sparkSession.sparkContext.defaultParallelism)


def first_rounds(model, rounds: int):
    """The model of the first ``rounds`` rounds of a boosted fit.  Rounds build on what came before only, so this is
    what a fit of that many rounds with the same seed gives."""
    java = model._java_obj
    n = min(rounds, model.getNumTrees)
    if n == model.getNumTrees:
        return model
    sc = SparkContext._active_spark_context
    trees = sc._gateway.new_array(sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = sc._gateway.new_array(sc._jvm.double, n)
    for i, (t, w) in enumerate(zip(java.trees()[:n], java.treeWeights()[:n])):
        trees[i], weights[i] = t, w
    cut = sc._jvm.org.apache.spark.ml.classification.GBTClassificationModel(model.uid, trees, weights, java.numFeatures(), java.numClasses())
    java.copyValues(cut, java.extractParamMap())
    return GBTClassificationModel(cut)


def boosted_scores(estimator, params: Mapping[str, Sequence], train: DataFrame, fold_col: str = "fold", k: int = 5,
                   parallelism: int = 8) -> list[tuple[dict, list[float]]]:
    """Per grid point of a boosted estimator, whose grid asks for several numbers of rounds (``maxIter``), its parameters and fold AUCs.

    One fit of the longest run per fold and point of the other dimensions; shorter runs are its first rounds.  The fits
    are independent and run side by side, as tasks where the table is moderate (``fits``)."""
    rounds = sorted(params["maxIter"])
    others = {name: values for name, values in params.items() if name != "maxIter"}
    points = [{**p, estimator.maxIter: rounds[-1]} for p in grid(estimator, others)]
    ev = BinaryClassificationEvaluator(metricName="areaUnderROC", numBins=0)

    with compact(train.select("features", "label", *_weights(estimator), fold_col)) as rows_:
        def one(point: int, fold: int) -> list[float]:
            inside = F.col(fold_col) == fold
            model = estimator.copy(points[point]).fit(rows_.where(~inside))
            return [float(ev.evaluate(first_rounds(model, n).transform(rows_.where(inside)))) for n in rounds]

        dealt = fits.scores(rows_, [estimator.copy(p) for p in points], [rounds] * len(points), "auc", fold_col, k)
        found = [[s[0] for s in fold] for point in dealt for fold in point] if dealt else _fit_all(
            [lambda p=p, f=f: one(p, f) for p in range(len(points)) for f in range(k)], _threads(rows_, parallelism))
    return [({**{q.name: v for q, v in point.items()}, "maxIter": n}, [found[p * k + f][j] for f in range(k)])
            for p, point in enumerate(points) for j, n in enumerate(rounds)]


def boosted_search(estimator, params: Mapping[str, Sequence], train: DataFrame, fold_col: str = "fold", k: int = 5,
                   parallelism: int = 8) -> DataFrame:
    """``grid_results`` of ``boosted_scores``."""
    rows = [Row(params=", ".join(f"{q}={v}" for q, v in sorted(named.items())), mean_auc=statistics.fmean(aucs),
                sd_auc=statistics.pstdev(aucs), notes=grid_notes(params))
            for named, aucs in boosted_scores(estimator, params, train, fold_col, k, parallelism)]
    return train.sparkSession.createDataFrame(rows, "params string, mean_auc double, sd_auc double, notes string")


def boosted_best(estimator, params: Mapping[str, Sequence], train: DataFrame, fold_col: str = "fold", k: int = 5):
    """The estimator at the point of ``boosted_scores`` with the highest mean AUC, the first of equal ones."""
    named, _ = max(boosted_scores(estimator, params, train, fold_col, k), key=lambda found: statistics.fmean(found[1]))
    return estimator.copy({estimator.getParam(q): v for q, v in named.items()})


def few_partitions(df: DataFrame, rows: int) -> DataFrame:
    """A table of so many rows in partitions of ``ROWS_PER_TASK`` rows at least, as tree fits run a job per level."""
    return df.coalesce(max(1, math.ceil(rows / ROWS_PER_TASK)))


def spread(df: DataFrame, rows: int, key: str) -> DataFrame:
    """A table of so many rows for single fits: dealt by the hash of ``key`` and sorted by it, so that partitions are of one size
    and the same whatever files the rows came from; as ``few_partitions`` where one partition does."""
    n = max(math.ceil(rows / ROWS_PER_TASK), min(SPREAD, math.ceil(rows / LEAST_ROWS)))
    return few_partitions(df, rows) if n <= 1 else df.repartition(n, key).sortWithinPartitions(key)


@contextmanager
def compact(df: DataFrame) -> Iterator[DataFrame]:
    """Rows for very many small jobs: cached, in few partitions."""
    rows = few_partitions(df, df.count()).persist()
    try:
        yield rows
    finally:
        rows.unpersist()


def _weights(estimator) -> list[str]:
    return [estimator.getWeightCol()] if estimator.isDefined("weightCol") and estimator.getWeightCol() else []


def grid_results(cv_model, estimator, params: Mapping[str, Sequence] | None = None) -> DataFrame:
    """One row per grid point: its parameters as text, mean and sd of the fold AUCs, and what of the requested
    grid was changed."""
    from pyspark.sql import SparkSession

    rows = []
    for pm, m, s in zip(cv_model.getEstimatorParamMaps(), cv_model.avgMetrics, cv_model.stdMetrics):
        rows.append(Row(params=", ".join(f"{p.name}={v}" for p, v in sorted(pm.items(), key=lambda kv: kv[0].name)),
                        mean_auc=float(m), sd_auc=float(s), notes=grid_notes(params or {})))
    return SparkSession.getActiveSession().createDataFrame(rows, "params string, mean_auc double, sd_auc double, notes string")


def predict(model, df: DataFrame) -> DataFrame:
    """Hard label and class-1 probability next to the input columns."""
    out = model.transform(df)
    return out.withColumn("p1", vector_to_array("probability")[1])


def _scored(model, df: DataFrame) -> DataFrame:
    """(label, prediction, p1) of every row, checkpointed: rows are scored once, whatever is computed from them."""
    ensure_checkpoint_dir(df.sparkSession)
    return predict(model, df).select("label", "prediction", "p1").checkpoint()


def report_text(scored: DataFrame) -> str:
    """The classification report (five lines) as text, as it stands in a saved model record."""
    return "\n".join(f"{r['class']} precision={r['precision']:.4f} recall={r['recall']:.4f} f1={r['f1']:.4f} support={r['support']:.0f}"
                     for r in classification_report(scored, "label", "prediction").collect())


def fit_single(estimator, train: DataFrame):
    """A fit that has the cores to itself.

    By default a forest walks every tree from its root for each row and level.  Here the rows' nodes are noted from level to
    level (in memory or on local disk, not in the checkpoint folder): the same trees in less time.  Beyond ``MOST_NOTED`` the
    trees are fitted some at a time, each part with draws of its own.  As neither is a property of the forest, the model states
    the parameters that were asked for."""
    if not isinstance(estimator, RandomForestClassifier):
        return estimator.fit(train)
    noted = {estimator.cacheNodeIds: True, estimator.checkpointInterval: -1}
    trees = estimator.getNumTrees()
    parts = min(trees, math.ceil(train.count() * trees / MOST_NOTED)) if trees > 1 else 1
    if parts <= 1:
        model = estimator.fit(train, noted)
        for p in noted:
            model.set(model.getParam(p.name), estimator.getOrDefault(p))
        return model
    if estimator.getFeatureSubsetStrategy() == "auto":  # of a forest; a part may have one tree
        noted[estimator.featureSubsetStrategy] = "sqrt"
    bounds = [trees * i // parts for i in range(parts + 1)]
    # bags are drawn by seed and partition: the seeds of parts lie far apart
    fitted = [estimator.fit(train, {**noted, estimator.numTrees: b - a, estimator.seed: estimator.getSeed() + 1_000_003 * i})
              for i, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    sc = SparkContext._active_spark_context
    grown = [t for part in fitted for t in part._java_obj.trees()]
    found = sc._gateway.new_array(sc._jvm.org.apache.spark.ml.classification.DecisionTreeClassificationModel, trees)
    for i, t in enumerate(grown):
        found[i] = t
    first = fitted[0]._java_obj
    whole = sc._jvm.org.apache.spark.ml.classification.RandomForestClassificationModel(first.uid(), found, first.numFeatures(), first.numClasses())
    first.copyValues(whole, first.extractParamMap())
    model = estimator._copyValues(RandomForestClassificationModel(whole))
    model._transfer_params_to_java()
    return model


def train_eval(name: str, estimator, train: DataFrame, test: DataFrame):
    """Fit (timed on the driver), predict the test rows once and return (model record, model).

    The record, one row: accuracy, auc (exact), train_seconds, the confusion counts and the classification report."""
    t0 = time.time()
    model = fit_single(estimator, train)
    secs = time.time() - t0
    scored = _scored(model, test)
    m = binary_metrics(scored, "label", "prediction").first()
    auc = roc_auc(scored, "label", "p1").first()["auc"]
    row = Row(model=name, accuracy=m["accuracy"], train_seconds=secs, tn=m["tn"], fp=m["fp"], fn=m["fn"], tp=m["tp"], auc=auc,
              report=report_text(scored))
    return train.sparkSession.createDataFrame(
        [row], "model string, accuracy double, train_seconds double, tn long, fp long, fn long, tp long, auc double, report string"), model


def metric_table(model, features: Sequence[str], train: DataFrame, test: DataFrame, top: int = 5) -> DataFrame:
    """(section, name, value) of a fitted model, as the reference saves them: its parameters, F1 on train and test,
    SSE, SST and R² of the test labels, and the most important features where the model has importances."""
    rows = [("parameter", r["param"], r["value"]) for r in param_table(model).collect()]
    on_train, on_test = _scored(model, train), _scored(model, test)
    for part, scored in (("train", on_train), ("test", on_test)):
        rows.append(("metric", f"f1_{part}", f"{binary_metrics(scored, 'label', 'prediction').first()['f1']:.4f}"))
    e = regression_errors(on_test, "label", "prediction").first()
    rows += [("metric", k, f"{e[k]:.4f}") for k in ("sse", "sst", "r2")]
    if hasattr(model, "featureImportances"):
        rows += [("importance", r["feature"], f"{r['importance']:.4f}") for r in top_importances(importances(model, features), top).collect()]
    return train.sparkSession.createDataFrame(rows, "section string, name string, value string")


def best_model(results: DataFrame, metric: str = "auc") -> DataFrame:
    """The result row with the highest metric (ties by model name)."""
    return results.orderBy(F.desc(metric), F.asc("model")).limit(1)


def importances(model, features: Sequence[str]) -> DataFrame:
    """(feature, importance) from a fitted tree model."""
    from pyspark.sql import SparkSession

    imp = model.featureImportances.toArray().tolist()
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame([Row(feature=f, importance=float(v)) for f, v in zip(features, imp)],
                                 "feature string, importance double")


def top_importances(imp: DataFrame, n: int = 5) -> DataFrame:
    return imp.orderBy(F.desc("importance"), F.asc("feature")).limit(n)


def tree_text(model, features: Sequence[str]) -> DataFrame:
    """Readable tree: one row per line of ``toDebugString`` with feature indices replaced by names."""
    import re

    from pyspark.sql import SparkSession

    text = model.toDebugString
    text = re.sub(r"feature (\d+)", lambda m: features[int(m.group(1))], text)
    lines = [Row(line_no=i, line=ln) for i, ln in enumerate(text.splitlines())]
    return SparkSession.getActiveSession().createDataFrame(lines, "line_no int, line string")


def cv_accuracy(estimator, data: DataFrame, fold_col: str = "fold", k: int = 5) -> DataFrame:
    """Mean and sd of accuracy over the folds (``cross_val_score(scoring='accuracy')``)."""
    ev = MulticlassClassificationEvaluator(metricName="accuracy")
    with compact(data) as rows:
        dealt = fits.scores(rows, [estimator], [fits.whole(estimator)], "accuracy", fold_col, k)
        found = [fold[0][0] for fold in dealt[0]] if dealt else _fold_metrics(estimator, [{}], ev, rows, fold_col, k, k)[0]
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession().createDataFrame(
        [Row(mean_accuracy=statistics.fmean(found), sd_accuracy=statistics.pstdev(found))],
        "mean_accuracy double, sd_accuracy double")


def _fit_all(tasks: Sequence[Callable[[], Row]], parallelism: int) -> list[Row]:
    """Independent fits side by side: each is a Spark job of its own, the driver only waits."""
    with ThreadPoolExecutor(parallelism) as pool:
        return list(pool.map(lambda t: t(), tasks))


def _right(model, df: DataFrame, inside) -> tuple[float, float]:
    """Accuracy inside and outside a condition, from one scoring pass."""
    hit = (F.col("prediction") == F.col("label")).cast("double")
    r = model.transform(df).agg(F.avg(F.when(inside, hit)), F.avg(F.when(~inside, hit))).first()
    return r[0], r[1]


def validation_curve(make_estimator, depths: Sequence[int], data: DataFrame, fold_col: str = "fold",
                     k: int = 5, parallelism: int = 8) -> DataFrame:
    """Train and validation accuracy (mean, sd over folds) per depth (``validation_curve``).

    ``CrossValidator`` reports no training scores, so each (depth, fold) is fitted here; the fits are independent
    and run side by side, and each model scores all rows once.  A fold's deepest fit comes first: where none of its trees
    reaches the limit, every limit beyond the deepest tree gives the same model, and is not fitted again."""
    depths = sorted(depths)

    with compact(data) as rows_:
        def one(depth: int, fold: int) -> tuple[int, tuple[float, float]]:
            inside = F.col(fold_col) == fold
            model = make_estimator(depth).fit(rows_.where(~inside))
            return _deepest(model), _right(model, rows_, inside)

        parallelism = _threads(rows_, parallelism)
        some = _dealt_curve(make_estimator, depths, rows_, fold_col, k)
        if some is None:
            last = _fit_all([lambda f=f: one(depths[-1], f) for f in range(k)], parallelism)
            todo = [(d, f) for d in depths[:-1] for f in range(k) if d <= last[f][0]]
            some = dict(zip(todo, _fit_all([lambda d=d, f=f: one(d, f)[1] for d, f in todo], parallelism), strict=True))
            some = {(d, f): some.get((d, f), last[f][1]) for d in depths for f in range(k)}
    rows = []
    for d in depths:
        va, tr = zip(*(some[d, f] for f in range(k)), strict=True)
        rows.append(Row(depth=int(d), train_mean=statistics.fmean(tr), train_sd=statistics.pstdev(tr),
                        valid_mean=statistics.fmean(va), valid_sd=statistics.pstdev(va)))
    return data.sparkSession.createDataFrame(
        rows, "depth int, train_mean double, train_sd double, valid_mean double, valid_sd double")


def _dealt_curve(make_estimator, depths: Sequence[int], rows: DataFrame, fold_col: str, k: int) -> dict | None:
    """By (depth, fold) the accuracy inside and outside the fold, from fits that are tasks; None if they are left to Spark ML."""
    if fits.specification(make_estimator(depths[0])) is None:
        return None
    estimators = [make_estimator(d) for d in depths]
    dealt = fits.scores(rows, estimators, [fits.whole(e) for e in estimators], "accuracy", fold_col, k)
    return dealt and {(d, f): tuple(dealt[i][f][0]) for i, d in enumerate(depths) for f in range(k)}


def _deepest(model) -> int:
    """Depth of the deepest tree of a fitted tree or ensemble."""
    java = model._java_obj
    return max(t.depth() for t in java.trees()) if hasattr(model, "treeWeights") else java.depth()


def depth_curve(make_estimator, depths: Sequence[int], train: DataFrame, test: DataFrame, parallelism: int = 8) -> DataFrame:
    """Train and test accuracy per depth on one hold-out split (overfitting curve)."""
    both = train.select("features", "label", F.lit(False).alias("held")).unionByName(test.select("features", "label", F.lit(True).alias("held")))

    def one(depth: int) -> Row:
        held, fitted = _right(make_estimator(depth).fit(train), both, F.col("held"))
        return Row(depth=int(depth), train_accuracy=fitted, test_accuracy=held)

    return train.sparkSession.createDataFrame(_fit_all([lambda d=d: one(d) for d in depths], parallelism),
                                              "depth int, train_accuracy double, test_accuracy double")


def logistic_trend(df: DataFrame, x: str, y: str, points: int = 50) -> DataFrame:
    """One-variable logistic trend of a 0/1 outcome: (x, p) on an even grid over [min x, max x].

    Raises when the outcome has fewer than two classes (the reference's guard)."""
    d = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("label")).na.drop()
    n_classes = d.select("label").distinct().limit(2).count()
    if n_classes < 2:
        raise ValueError("logistic trend needs both outcome classes")
    train = VectorAssembler(inputCols=["x"], outputCol="features").transform(d)
    model = LogisticRegression(regParam=0.0, maxIter=100).fit(train)
    mm = d.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    lo, hi = mm.select("lo").scalar(), mm.select("hi").scalar()
    g = df.sparkSession.range(points).select(
        (lo + F.col("id") * (hi - lo) / F.lit(max(points - 1, 1))).alias("x"))
    g = VectorAssembler(inputCols=["x"], outputCol="features").transform(g)
    return model.transform(g).select("x", vector_to_array("probability")[1].alias("p"))


def param_table(model_or_estimator) -> DataFrame:
    """(param, value) rows of the explicitly set and default parameters (the reference's parameter dump)."""
    from pyspark.sql import SparkSession

    pm = model_or_estimator.extractParamMap()
    rows = [Row(param=p.name, value=str(v)) for p, v in sorted(pm.items(), key=lambda kv: kv[0].name)]
    return SparkSession.getActiveSession().createDataFrame(rows, "param string, value string")


