"""Table profiling.  Per-column loops of the reference become one multi-expression aggregate that is
unpivoted afterwards, so a wide table is scanned once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.columns import col


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Raise one clear error at plan time when a required column is missing (Q9); no job runs."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns {missing}; available: {df.columns}")
    return df


def trim_names(df: DataFrame) -> DataFrame:
    """Strip blanks around column names."""
    return df.toDF(*[c.strip() for c in df.columns])


def _is_nullish(f: T.StructField) -> Column:
    x = F.col(f"`{f.name}`")
    if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
        return x.isNull() | F.isnan(x)
    return x.isNull()


def column_info(df: DataFrame) -> DataFrame:
    """(column, position, dtype, non_null) for every column, like ``df.info()``; one scan."""
    fields = df.schema.fields
    counts = df.agg(*[F.sum((~_is_nullish(f)).cast("long")).alias(f"c{i}") for i, f in enumerate(fields)])
    stack = [
        F.struct(F.lit(f.name).alias("column"), F.lit(i).alias("position"),
                 F.lit(f.dataType.simpleString()).alias("dtype"),
                 F.coalesce(F.col(f"c{i}"), F.lit(0)).cast("long").alias("non_null"))
        for i, f in enumerate(fields)
    ]
    return counts.select(F.explode(F.array(*stack)).alias("r")).select("r.*")


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, nulls) per column, like ``df.isnull().sum()``; NaN counts as missing (N10)."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    agg = df.agg(*[F.sum(_is_nullish(f).cast("long")).alias(f"c{i}") for i, f in enumerate(fields)])
    stack = [F.struct(F.lit(f.name).alias("column"), F.coalesce(F.col(f"c{i}"), F.lit(0)).cast("long").alias("nulls"))
             for i, f in enumerate(fields)]
    return agg.select(F.explode(F.array(*stack)).alias("r")).select("r.*")


def head(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """First ``n`` rows by an explicit key (Spark tables have no row order); planned as a top-k."""
    return df.orderBy(*order_by).limit(n)


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of numeric columns (``select_dtypes(include=number)``), a schema lookup with no job."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def distinct_values(df: DataFrame, c: str | Column, dropna: bool = True) -> DataFrame:
    """Sorted distinct values of a column."""
    x = col(c).alias("value")
    d = df.select(x)
    if dropna:
        d = d.where(F.col("value").isNotNull())
    return d.distinct().orderBy("value")


def distinct_counts(df: DataFrame, columns: Sequence[str], approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """(column, n_distinct, over_10, at_least_2) per column (the reference's > 10 and ≥ 2 guards).

    ``approx`` switches to HyperLogLog for wide or very large profiles (fixed memory per column)."""
    fn = (lambda c: F.approx_count_distinct(c, rsd)) if approx else F.count_distinct
    agg = df.agg(*[fn(F.col(c)).alias(f"c{i}") for i, c in enumerate(columns)])
    stack = [
        F.struct(F.lit(c).alias("column"), F.col(f"c{i}").cast("long").alias("n_distinct"),
                 (F.col(f"c{i}") > 10).alias("over_10"), (F.col(f"c{i}") >= 2).alias("at_least_2"))
        for i, c in enumerate(columns)
    ]
    return agg.select(F.explode(F.array(*stack)).alias("r")).select("r.*")


def constant_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns holding at most one distinct non-null value (Q6: such features are reported, never dropped
    silently).  Output: (column, n_distinct)."""
    return distinct_counts(df, columns).where(F.col("n_distinct") <= 1).select("column", "n_distinct")


def is_empty(df: DataFrame) -> bool:
    """Empty-after-filter guard (reads at most one row)."""
    return df.isEmpty()


def has_value(df: DataFrame, c: str | Column, value) -> DataFrame:
    """One row, one boolean: does ``value`` occur in the column (``bool_or`` with partial aggregation)."""
    return df.agg(F.coalesce(F.bool_or(col(c) == F.lit(value)), F.lit(False)).alias("present"))
