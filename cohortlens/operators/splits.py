"""Repeatable train/test splits, folds and class weights.

Order comes from ``md5(id)`` (the same hex in Spark and DuckDB), so splits are reproducible on any engine and
after any task retry.  A split needs one cutoff key per class, k folds need k − 1: the cutoffs are selected by
``order_statistics`` and applied to the rows as a comparison, so the table itself is neither shuffled nor ranked.  Rows
that share an id stay together.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.prefix import running_totals
from cohortlens.operators.selection import attach, few_groups, order_statistics

# Hex digits of the hash that bracket it: a number that doubles hold exactly.
PREFIX_DIGITS = 13
# Types of ids whose order numbers keep.
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
# A table of one row per class is broadcast up to this many classes.
SMALL_CLASSES = 100_000


def _hash_key(id_col: str) -> Column:
    """Hash order of an id; a missing id comes first."""
    return F.coalesce(F.md5(F.col(id_col).cast("string")), F.lit(""))


def _hash_number(id_col: str) -> Column:
    return F.coalesce(F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, PREFIX_DIGITS), 16, 10).cast("double"), F.lit(-1.0))


def _id_number(df: DataFrame, id_col: str) -> Column | None:
    """A number that never falls where the id rises, None for types without one."""
    kind = df.schema[id_col].dataType.simpleString()
    at = F.col(id_col)
    if kind == "date":
        at = F.unix_date(at)
    elif kind == "timestamp":
        at = F.unix_micros(at)
    elif kind.split("(")[0] not in NUMBERS:
        return None
    return F.coalesce(F.nanvl(at.cast("double"), F.lit(float("inf"))), F.lit(float("-inf")))


def _ranked_cutoffs(df: DataFrame, key: Column, ends: Callable[[Column], list[Column]], labels: Sequence[str]) -> DataFrame:
    """(labels, s0, s1, ...) for keys without a number: from running counts over all of them."""
    d = df.select(*labels, key.alias("__key"))
    run = running_totals(d.groupBy(*labels, "__key").agg(F.count(F.lit(1)).alias("c")), "__key", {"__cum": "c"}, labels, with_totals=True)
    hits = F.array(*[F.when((F.col("__cum") - F.col("c") < e) & (e <= F.col("__cum")), F.lit(j)) for j, e in enumerate(ends(F.col("__cum_total")))])
    found = run.select(*labels, "__key", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("j"))
    return found.groupBy(*labels).agg(*[F.max(F.when(F.col("j") == j, F.col("__key"))).alias(f"s{j}") for j in range(len(ends(F.lit(1))))])


def _with_cutoffs(df: DataFrame, key: Column, number: Column | None, places: Sequence[float], ends: Callable[[Column], list[Column]],
                  label: str | None, use: Callable[[list[Column], Column], Column], name: str) -> DataFrame:
    """Add ``name``, computed from a row's key and its class's cutoffs."""
    labels = [label] if label else []
    small = few_groups(df, labels)
    cuts = _ranked_cutoffs(df, key, ends, labels) if number is None else order_statistics(df, labels, number, key, places, ends, small)
    cuts = cuts.select(*labels, *[f"s{j}" for j in range(len(places))])
    joined = attach(df, cuts, labels, small, "__cuts")
    return joined.select(*[df[c] for c in df.columns], use([F.col(f"__cuts.s{j}") for j in range(len(places))], key).alias(name))


def _test_end(fraction: float) -> Callable[[Column], list[Column]]:
    return lambda n: [F.ceil(n * F.lit(fraction))]


def random_split(df: DataFrame, id_col: str, test_fraction: float = 0.2) -> DataFrame:
    """Add ``is_test`` (0/1): the first ceil(fraction·n) rows in md5(id) order are the test set
    (scikit-learn's test size rule); rows that share the last id come along."""
    return _with_cutoffs(df, _hash_key(id_col), _hash_number(id_col), [test_fraction], _test_end(test_fraction), None,
                         lambda cut, key: F.coalesce(key <= cut[0], F.lit(False)).cast("int"), "is_test")


def stratified_split(df: DataFrame, id_col: str, label: str, test_fraction: float = 0.3) -> DataFrame:
    """Add ``is_test`` keeping class shares: within each class the first ceil(fraction·n_class) rows by md5(id).
    (scikit-learn rounds the total instead, so each class may differ by one row.)"""
    return _with_cutoffs(df, _hash_key(id_col), _hash_number(id_col), [test_fraction], _test_end(test_fraction), label,
                         lambda cut, key: F.coalesce(key <= cut[0], F.lit(False)).cast("int"), "is_test")


def _fold_ends(k: int) -> Callable[[Column], list[Column]]:
    """Last ranks of the first k − 1 folds: the first n % k folds hold one extra row (unshuffled KFold sizes)."""

    def ends(n: Column) -> list[Column]:
        q = F.floor(n / k)
        rem = n - q * k
        return [F.lit(j) * q + F.least(F.lit(j), rem) for j in range(1, k)]

    return ends


def kfold(df: DataFrame, id_col: str, k: int = 5, label: str | None = None, order: str = "id") -> DataFrame:
    """Add ``fold`` (0..k-1): contiguous folds in id order (``KFold(shuffle=False)``; ids of any ordered type, a
    missing id first), or in md5(id) order (``order='hash'``), or per class when ``label`` is given (stratified
    folds; sizes may differ by one row from scikit-learn)."""
    if k < 2:
        raise ValueError("k must be at least 2")
    # a struct with a flag gives a missing id a place among the cutoffs
    if order == "hash":
        key, number = _hash_key(id_col), _hash_number(id_col)
    else:
        key, number = F.struct(F.col(id_col).isNotNull().alias("a"), F.col(id_col).alias("b")), _id_number(df, id_col)
    return _with_cutoffs(df, key, number, [j / k for j in range(1, k)], _fold_ends(k), label, lambda cuts, x: sum(
        (F.coalesce(x > c, F.lit(False)).cast("int") for c in cuts), F.lit(0)), "fold")


def balanced_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Add ``n / (n_classes · n_c)`` per row (``class_weight='balanced'``); NULL counts as a class.

    One row per class joins the rows; it is broadcast where the class count, checked first, is small."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("__nc"))
    total, k = per.agg(F.coalesce(F.sum("__nc"), F.lit(0)), F.count(F.lit(1))).first()
    w = per.select(F.col(label).alias("__label"), (F.lit(float(total)) / (F.lit(k) * F.col("__nc"))).alias(name))
    side = F.broadcast(w) if k <= SMALL_CLASSES else w
    return df.join(side, df[label].eqNullSafe(side["__label"]), "left").select(df["*"], side[name])
