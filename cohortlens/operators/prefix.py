"""Distributed running totals.

Cumulative statistics (Kaplan–Meier at-risk counts and products, ROC counts, exact quantile ranks) need a running
sum over an ordered key.  A window with no partition, or partitioned by a group that may hold a third of all rows,
runs in one task.  ``running_totals`` has one way for every size:

1. The table (for most callers one row per partition keys and order key) is range-partitioned on (partition keys,
   order key).  Every row notes the number of its range, its block, and the result is checkpointed, so that a
   re-executed task finds the same blocks.  Blocks follow the data: there are ``spark.sql.shuffle.partitions`` of
   them at most, of about equal size, a hot group spans many, NULL is an ordinary (lowest) key.
2. Block totals are turned into offsets by a window over at most one row per block and partition key.
3. A window inside each block gives the running sums, the block's offset is added.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.session import ensure_checkpoint_dir

BLOCK = "__rt_blk"
# Number of ranges; None leaves it to spark.sql.shuffle.partitions and adaptive coalescing.
BLOCKS: int | None = None


def with_blocks(df: DataFrame, order_cols: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """``df`` range-partitioned on (partition keys, order columns) with the block number, checkpointed."""
    keys = [F.col(c).asc_nulls_first() for c in (*partition_by, *order_cols)]
    dealt = df.repartitionByRange(BLOCKS, *keys) if BLOCKS else df.repartitionByRange(*keys)
    ensure_checkpoint_dir(df.sparkSession)
    return dealt.withColumn(BLOCK, F.spark_partition_id()).checkpoint()


def running_totals(
    df: DataFrame,
    order_cols: str | Sequence[str],
    sums: Mapping[str, str | Column],
    partition_by: Sequence[str] = (),
    ascending: bool = True,
    with_totals: bool = False,
    keep_blocks: bool = False,
) -> DataFrame:
    """Add inclusive running sums ``out = sum(expr)`` in the order of ``order_cols`` within ``partition_by``.

    (partition_by, order_cols) should be unique per row; among equal rows the order is arbitrary.  ``sums`` maps
    output names to expressions (or column names).  NULL keys come first in ascending order.  ``with_totals`` adds
    ``<out>_total``, the partition's grand total.  A table that already carries blocks of the same keys (see
    ``with_blocks`` and ``keep_blocks``) is not dealt again.
    """
    order_cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    pb = list(partition_by)
    if BLOCK not in df.columns:
        df = with_blocks(df, order_cols, pb)
    exprs = {k: (F.col(v) if isinstance(v, str) else v) for k, v in sums.items()}
    tmp = {k: f"__rt_v_{i}" for i, k in enumerate(exprs)}
    d = df.select("*", *[e.alias(tmp[k]) for k, e in exprs.items()])
    order = [F.col(c).asc_nulls_first() if ascending else F.col(c).desc_nulls_last() for c in order_cols]
    blk_order = F.col(BLOCK).asc() if ascending else F.col(BLOCK).desc()
    tot = d.groupBy(*pb, BLOCK).agg(*[F.sum(tmp[k]).alias(f"__rt_t_{i}") for i, k in enumerate(exprs)])
    wo = Window.partitionBy(*pb).orderBy(blk_order).rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(
        *[F.col(c).alias(f"__rt_k_{c}") for c in pb],
        F.col(BLOCK).alias("__rt_kblk"),
        *[F.coalesce(F.sum(f"__rt_t_{i}").over(wo), F.lit(0)).alias(f"__rt_o_{i}") for i, _ in enumerate(exprs)],
        *[F.sum(f"__rt_t_{i}").over(Window.partitionBy(*pb)).alias(f"__rt_T_{i}") for i, _ in enumerate(exprs)],
    )
    cond = [d[c].eqNullSafe(off[f"__rt_k_{c}"]) for c in pb] + [d[BLOCK] == off["__rt_kblk"]]
    j = d.join(off, cond, "inner")
    wi = Window.partitionBy(*pb, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return j.select(
        *[d[c] for c in df.columns if keep_blocks or c != BLOCK],
        *[(F.col(f"__rt_o_{i}") + F.sum(tmp[k]).over(wi)).alias(k) for i, k in enumerate(exprs)],
        *([F.col(f"__rt_T_{i}").alias(f"{k}_total") for i, k in enumerate(exprs)] if with_totals else []),
    )


def rank_rows(
    df: DataFrame,
    key: Column,
    tie: Column,
    partition_by: Sequence[str] = (),
    ascending: bool = True,
    name: str = "rank",
    size_name: str | None = None,
) -> DataFrame:
    """Add a 1-based ``row_number`` in (key, tie) order within ``partition_by`` without a global sort: rows are
    counted by ``running_totals``, which splits ties and hot partitions over blocks.

    ``size_name`` also adds the partition's row count."""
    d = df.select("*", key.alias("__rk_k"), tie.alias("__rk_t"))
    out = running_totals(d, ["__rk_k", "__rk_t"], {name: F.lit(1).cast("long")}, partition_by, ascending,
                         with_totals=size_name is not None)
    if size_name:
        out = out.withColumnRenamed(f"{name}_total", size_name)
    return out.drop("__rk_k", "__rk_t")
