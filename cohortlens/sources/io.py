"""Sources and sinks: format dispatch, CSV with missing-value tokens, conversion, filtered save with
row counts, writers and per-run output folders.

Everything is a Spark reader or writer: files are read and written in parallel by the executors, never through the
driver.  Scratch output goes under the shared folder named by ``spark.checkpoint.dir`` (a cluster-wide location),
never a machine-local temporary folder.
"""

from __future__ import annotations

import datetime as _dt
import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.columns import _NUMBER
from cohortlens.session import ensure_checkpoint_dir
from cohortlens.sources.records import parse_records, read_records

# The text tokens pandas' CSV reader treats as missing by default (library default, N1).
PANDAS_NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)

FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".orc": "orc"}


def format_of(path: str) -> str:
    """Reader format from the path's extension; anything else is refused (the reference raises too)."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext not in FORMATS:
        raise ValueError(f"unsupported file type {ext!r} for {path}; use one of {sorted(FORMATS)}")
    return FORMATS[ext]


def normalise_missing(df: DataFrame, tokens: Sequence[str] = PANDAS_NA_TOKENS) -> DataFrame:
    """Turn missing-value tokens in text columns into NULL (Spark's CSV reader knows one ``nullValue`` only)."""
    toks = list(tokens)
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = F.when(c.isin(toks), F.lit(None).cast("string")).otherwise(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


# Quotes inside a quoted field are doubled, in files read and written.
_CSV_QUOTES = {"quote": '"', "escape": '"'}
# What stands for an absent field while CSV is read, so that a quoted empty text stays a text.
_ABSENT = "\ufdd0absent"


def _typed(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Text columns as bigint, double or boolean where every value present is one (one aggregate over the rows)."""
    tests = {"bigint": r"^[+-]?[0-9]{1,18}$", "double": _NUMBER, "boolean": r"^(?i:true|false)$"}
    found = df.agg(*[F.count(F.col(f"`{n}`")).alias(f"n{i}") for i, n in enumerate(names)],
                   *[F.count_if(F.col(f"`{n}`").rlike(t)).alias(f"{k}{i}") for i, n in enumerate(names) for k, t in tests.items()]).first()
    cast = {n: next((k for k in tests if found[f"n{i}"] and found[f"{k}{i}"] == found[f"n{i}"]), None) for i, n in enumerate(names)}
    return df.select(*[F.col(f"`{c}`").cast(cast[c]).alias(c) if cast.get(c) else F.col(f"`{c}`") for c in df.columns])


def read_table(spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | str | None = None,
               sep: str = ",", encoding: str | None = None, header: bool = True,
               na_tokens: Sequence[str] | None = PANDAS_NA_TOKENS, multi_line: bool = True) -> DataFrame:
    """Lazy scan of a CSV / Parquet / JSON / ORC table chosen by extension (or ``fmt``).

    CSV: a quoted field may hold separators, doubled quotes and line breaks; large files are read by many tasks all the
    same (see ``records``: a first pass, run here, finds how blocks begin).  ``multi_line=False`` saves that pass where
    fields hold no line breaks; in encodings other than UTF-8 and ASCII, and in partitioned folders, a file is one task.  Missing tokens become
    NULL before columns are typed: by ``schema`` when given (unparseable values are NULL), else by one aggregate over
    the file, as bigint, double or boolean where all present values are (a full pass; give a schema at scale).
    Without ``na_tokens`` only absent fields are NULL, and a quoted empty text stays a text."""
    fmt = fmt or format_of(path)
    if fmt != "csv":
        reader = spark.read.format(fmt)
        return (reader.schema(schema) if schema is not None else reader).load(path)
    options = {"header": header, "sep": sep, "mode": "PERMISSIVE", "multiLine": multi_line, "nullValue": _ABSENT, **_CSV_QUOTES}
    reader = spark.read.options(**options, **({"encoding": encoding} if encoding else {}))
    coding = (encoding or "UTF-8").upper()
    split = multi_line and coding in ("UTF-8", "US-ASCII") and spark.read.text(path).columns == ["value"]

    def rows(fields: T.StructType) -> DataFrame:
        if not split:
            return reader.schema(fields).csv(path)
        # bytes that are no ASCII, one mark for each, as the reader gives them
        text = F.col("record")
        for marks, kind in ((2, r"[\u0080-\u07FF]"), (3, r"[\u0800-\uFFFF]"), (4, r"[\x{10000}-\x{10FFFF}]")) if coding == "US-ASCII" else ():
            text = F.regexp_replace(text, kind, "\ufffd" * marks)
        return parse_records(read_records(spark, path, sep, header), fields, {"sep": sep, "mode": "PERMISSIVE", "nullValue": _ABSENT, **_CSV_QUOTES}, text)

    if schema is None:
        df = reader.csv(path)  # for the names
        df = rows(df.schema) if df.columns else df
        df = normalise_missing(df, na_tokens) if na_tokens else df
        return _typed(df, df.columns) if df.columns else df
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    text = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.NumericType) else f.dataType) for f in wanted])
    df = rows(text)
    df = normalise_missing(df, na_tokens) if na_tokens else df
    return df.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in wanted])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location; the caller drops it with ``drop_scratch`` after use."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/cohortlens-io/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a folder made by ``scratch_path``, in whatever store it lies; other paths are refused."""
    if "/cohortlens-io/" not in path:
        raise ValueError(f"{path} is no scratch folder")
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def write_table(df: DataFrame, path: str, fmt: str | None = None, mode: str = "overwrite",
                partition_by: Sequence[str] = (), replace_partitions: bool = False) -> str:
    """Parallel write (one file per task); CSV gets a header line and reads back as it was (see ``read_table``).
    ``replace_partitions`` overwrites only the partitions that ``df`` has rows of."""
    fmt = fmt or format_of(path)
    w = df.write.mode(mode).format(fmt)
    if replace_partitions:
        w = w.option("partitionOverwriteMode", "dynamic")
    if fmt == "csv":
        w = w.options(header=True, nullValue="", emptyValue='""', **_CSV_QUOTES)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return path


def convert(spark: SparkSession, src: str, dst: str, src_fmt: str | None = None, dst_fmt: str | None = None,
            schema=None) -> str:
    """Copy a table between formats (csv ⇄ parquet ⇄ json ⇄ orc)."""
    return write_table(read_table(spark, src, src_fmt, schema=schema), dst, dst_fmt)


def filter_and_save(df: DataFrame, column: str, drop_values: Sequence, path: str, fmt: str | None = None) -> dict:
    """Remove rows whose ``column`` is listed (NULL kept, N4), save the rest and report the row counts.

    The counts come from one column-pruned aggregate over the input (partial aggregation, a single row back);
    ``Observation`` would fold them into the write job, but in Spark 4.1 an observed plan leaves a
    non-serialisable manager behind that breaks later RDD-based jobs (Spark ML) in the same session."""
    x = F.col(column)
    keep = ~x.isin(list(drop_values)) | x.isNull()
    write_table(df.where(keep), path, fmt)
    m = df.agg(F.count(F.lit(1)).alias("before"), F.count_if(keep).alias("after")).first()
    return {"path": path, "before": m["before"], "after": m["after"], "removed": m["before"] - m["after"]}


def run_stamp(now: _dt.datetime | None = None) -> str:
    """Timestamp used to separate the outputs of each run (``YYYY-mm-dd_HH-MM-SS``)."""
    return (now or _dt.datetime.now()).strftime("%Y-%m-%d_%H-%M-%S")


def write_run(df: DataFrame, base: str, stamp: str | None = None, fmt: str = "parquet") -> str:
    """Write ``df`` as the ``run_ts=<stamp>`` partition of ``base``: one output folder per run.  The same stamp again
    replaces that run's folder, others stay."""
    stamp = stamp or run_stamp()
    write_table(df.withColumn("run_ts", F.lit(stamp)), base, fmt, partition_by=["run_ts"], replace_partitions=True)
    return f"{base}/run_ts={stamp}"
