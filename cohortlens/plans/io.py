"""Source and sink round trips on the driver tables.  Each query writes a projection of a driver
table to the shared scratch folder and reads it back through the library's readers, so the oracle is the plain
projection in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import tables as TB
from cohortlens.operators.profile import require_columns
from cohortlens.plans.aggregates import _EFFECT_SQL, _effects
from cohortlens.plans.registry import query, rounded, table
from cohortlens.sources import io as IO

def _kept(spark, df, *paths):
    """A result that no longer needs its scratch copies, which go at once."""
    held = df.checkpoint()
    for p in paths:
        IO.drop_scratch(spark, p)
    return held


_LI_COLS = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag"]
_LI_SCHEMA = "l_orderkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string"
_LI_SQL = "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag FROM lineitem"


@query("src_csv", sql=_LI_SQL)
def src_csv(spark, sf_dir):
    path = IO.scratch_path(spark, "lineitem") + ".csv"
    IO.write_table(table(spark, sf_dir, "lineitem").select(*_LI_COLS), path)
    return _kept(spark, IO.read_table(spark, path, schema=_LI_SCHEMA, encoding="US-ASCII"), path)


@query("src_csv_text", sql="""
SELECT doc_id, CASE WHEN text IN ('', 'NA', 'NULL', 'None', 'nan', 'null') THEN NULL ELSE text END AS text, lang, n_chars FROM documents""")
def src_csv_text(spark, sf_dir):
    """Whole texts with quotes, separators and line breaks, written as CSV and read back with inferred types."""
    path = IO.scratch_path(spark, "documents") + ".csv"
    IO.write_table(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars"), path)
    return _kept(spark, IO.read_table(spark, path), path)


@query("src_dispatch", sql="""
SELECT 'json' AS source, o_orderkey, o_orderpriority FROM orders UNION ALL
SELECT 'orc', o_orderkey, o_orderpriority FROM orders""")
def src_dispatch(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    base = IO.scratch_path(spark, "orders")
    out = None
    for ext in ("json", "orc"):
        p = IO.write_table(o, f"{base}.{ext}")
        part = IO.read_table(spark, p, schema="o_orderkey bigint, o_orderpriority string").select(
            F.lit(ext).alias("source"), "o_orderkey", "o_orderpriority")
        out = part if out is None else out.unionByName(part)
    return _kept(spark, out, f"{base}.json", f"{base}.orc")


@query("src_require", sql="SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def src_require(spark, sf_dir):
    li = require_columns(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_quantity"])
    return li.select("l_orderkey", "l_linenumber", "l_quantity")


@query("src_convert", sql=_LI_SQL)
def src_convert(spark, sf_dir):
    base = IO.scratch_path(spark, "convert")
    IO.write_table(table(spark, sf_dir, "lineitem").select(*_LI_COLS), f"{base}.csv")
    IO.convert(spark, f"{base}.csv", f"{base}.parquet", schema=_LI_SCHEMA)
    return _kept(spark, IO.read_table(spark, f"{base}.parquet"), f"{base}.csv", f"{base}.parquet")


@query("src_filter_save", sql="""
SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') OR o_orderpriority IS NULL""")
def src_filter_save(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    res = IO.filter_and_save(o, "o_orderpriority", ["1-URGENT", "2-HIGH"], IO.scratch_path(spark, "kept") + ".parquet")
    return _kept(spark, IO.read_table(spark, res["path"]), res["path"])


@query("snk_csv", sql=_EFFECT_SQL + """
SELECT p_type, treatment, round(efficacy, 6) AS efficacy, round(mt, 6) AS mortality_treatment,
  round(mc, 6) AS mortality_control, n1 AS sample_size, n0 AS control_size FROM e""")
def snk_csv(spark, sf_dir):
    eff = _effects(spark, sf_dir)
    path = IO.write_table(eff, IO.scratch_path(spark, "effects") + ".csv")
    return _kept(spark, rounded(IO.read_table(spark, path, schema=eff.schema, na_tokens=None)), path)


@query("snk_rundir", sql="SELECT o_orderpriority AS value, COUNT(*) AS count FROM orders GROUP BY 1")
def snk_rundir(spark, sf_dir):
    counts = TB.value_counts(table(spark, sf_dir, "orders"), "o_orderpriority")
    base = IO.scratch_path(spark, "runs")
    return _kept(spark, IO.read_table(spark, IO.write_run(counts, base), fmt="parquet"), base)
