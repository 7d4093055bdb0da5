"""Rows of vectors for the vector operators: which rows count, equal vectors once, shards met by blocks of queries."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_finite(vector: Column) -> Column:
    """Whether a vector exists, has components, and all of them are finite."""
    inside = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) > 0) & inside, F.lit(False))


def first_ids(rows: DataFrame, by: list[str], keep: int) -> DataFrame:
    """``(by..., ids)``: rows that agree in ``by`` as one, with their ``keep`` smallest ids in order.

    Nothing is gathered beyond ``keep`` ids of a group: ranks are cut within each partition before the shuffle, so
    a vector that a third of all rows share is no hot group."""
    spot = F.xxhash64(*by)
    once = rows.select("id", *by).distinct().withColumn("spot", spot)
    ranked = once.withColumn("place", F.row_number().over(Window.partitionBy("spot", *by).orderBy("id"))).where(F.col("place") <= keep)
    return ranked.groupBy("spot", *by).agg(F.array_sort(F.collect_list("id")).alias("ids"))


def parts(rows: int, most: int) -> int:
    """Number of equal parts of at most about ``most`` rows."""
    return max(1, math.ceil(rows / most))


def meet(index: DataFrame, queries: DataFrame, shards: int, blocks: int, work: Callable, schema: str) -> DataFrame:
    """Runs ``work(shard rows, query rows)`` for every block of queries and every shard of their number of dimensions.

    One task group holds one shard and one block, both of bounded size; there are ``shards * blocks`` groups, shuffled
    by Spark, so any of them can be computed again alone."""
    keys = ["dims", "shard", "block"]
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(work, schema)


def flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column one after another, and the length of every list."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), lengths


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    jump = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return jump + np.arange(total)


def on_sphere(points: np.ndarray) -> np.ndarray:
    """Points with one more component that gives all of them the norm of the longest.

    With a zero in that place for queries, inner products stay as they are, and the nearest point is the one of
    largest inner product."""
    squares = np.einsum("ij,ij->i", points, points)
    rest = np.sqrt(np.maximum(squares.max(initial=0.0) - squares, 0.0))
    return np.column_stack([points, rest])
