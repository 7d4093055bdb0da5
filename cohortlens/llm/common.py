"""DataFrame helpers shared by the text operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.session import ensure_checkpoint_dir

WHITESPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def take(df: DataFrame, **columns: str) -> DataFrame:
    """Select columns by their exact name (first match wins) under new names.

    The columns are addressed by position, so extra columns whose names clash (also by case alone) do no harm."""
    names = df.columns
    placed = df.toDF(*[f"_c{i}" for i in range(len(names))])
    picked = []
    for new, old in columns.items():
        if old not in names:
            raise ValueError(f"column {old!r} is missing; the table has {names}")
        picked.append(F.col(f"_c{names.index(old)}").alias(new))
    return placed.select(*picked)


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def text_key(c: Column) -> Column:
    """Second part of a row's key: tells rows of one id with different texts apart, and is never null."""
    return F.xxhash64(F.coalesce(c, F.lit("")), c.isNull())


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder of ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """Parquet tables in the shared checkpoint folder that live as long as one operator's eager work.

    Written tables survive the loss of executors; leaving the ``with`` block deletes them."""

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark = spark
        self.path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/scratch-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table and read it back."""
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")


def same_row(a: str, b: str) -> Column:
    """Rows of one (id, key), null ids included."""
    return F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.key") == F.col(f"{b}.key"))


def shuffle_width(df: DataFrame) -> int:
    """Number of shuffle partitions that the session is set to; it follows the cluster and the input."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
