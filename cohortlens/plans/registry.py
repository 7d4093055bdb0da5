"""Registry of driver-bound queries: each binds a generic operator to the driver tables and carries the equivalent
DuckDB SQL used as the correctness oracle (None for operators that SQL cannot express, e.g. model fits)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


@dataclass(frozen=True)
class QuerySpec:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, QuerySpec] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its oracle SQL."""

    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = QuerySpec(name, fn, sql)
        return fn

    return deco


_SCANS: dict[tuple[int, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy parquet scan of one driver table (filters and projections are pushed into it by Catalyst).

    The scan DataFrame is reused per session and path, so repeated bindings skip the file listing and footer
    read; it holds no data (the driver tables are read-only inputs)."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (id(spark), path)
    cached = _SCANS.get(key)
    if cached is None or cached.sparkSession is not spark or spark.sparkContext._jsc is None:
        cached = _SCANS[key] = spark.read.parquet(path)
    return cached


def round_half_away(c, digits: int = 6):
    """Round to ``digits`` decimals, halves away from zero, in plain double arithmetic (the SQL oracle's
    rounding; Spark's ``round`` goes through BigDecimal per value, which dominates wide projections)."""
    scale = float(10 ** digits)
    y = c * F.lit(scale)
    r = F.rint(y)
    r = F.when(F.abs(y - r) == 0.5, y + F.lit(0.5) * F.signum(y)).otherwise(r)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), c).otherwise(r / F.lit(scale))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column so results compare stably with the SQL oracle."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(round_half_away(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
