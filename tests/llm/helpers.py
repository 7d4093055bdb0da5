"""Awkward tables for every operator: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

from pyspark.sql import types as T

AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog and runs away"),
    (2, "The quick brown fox jumps over the lazy dog and runs away"),
    (2, "The quick brown fox jumps over the lazy dog and runs away"),
    (3, None),
    (None, "a text without an id, but with words enough to make a window of ten"),
    (None, None),
    (4, ""),
    (5, " \n\t "),
    (6, "é ß 漢字 \U0001f600 ▁ done\nline two\nline two"),
    (6, "another text of one id"),
    (7, "word " * 20_000),
    (8, "x" * 30_000),
]


def table(spark, rows=AWKWARD, extra=True):
    """Rows (doc_id, text) with columns that clash with likely inner names and, by case, with the real ones."""
    fields = [T.StructField("key", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
    fields += [T.StructField(n, T.StringType()) for n in ("TEXT", "id", "words", "hashes", "score", "spans", "_c0")] if extra else []
    data = [(f"k{i}", d, t, *["z"] * (7 if extra else 0)) for i, (d, t) in enumerate(rows)]
    df = spark.createDataFrame(data, T.StructType(fields))
    return df if extra else df.select("doc_id", "text")


def got(df, *columns):
    """Rows as tuples in a stable order, nulls first."""
    out = [tuple(r[df.columns.index(c)] for c in columns) for r in df.collect()]
    return sorted(out, key=lambda t: [(x is not None, str(type(x)), x) if not isinstance(x, list) else (True, "list", str(x)) for x in t])


def order(rows):
    return sorted(rows, key=lambda t: [(x is not None, str(type(x)), x) if not isinstance(x, list) else (True, "list", str(x)) for x in t])
