"""Profiling, column derivations and filters on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions import columns as C
from cohortlens.operators import filters as FL
from cohortlens.operators import profile as P
from cohortlens.operators.distributions import standardize
from cohortlens.plans.registry import query, rounded, table
from cohortlens.plans.views import ORDER_PRIORITIES

_DUCK_TYPE = """CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
  WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END"""

# ---------------------------------------------------------------- §2.2 profiling


@query("prof_info", sql=f"""
WITH nn AS (UNPIVOT (SELECT COUNT(l_orderkey) AS l_orderkey, COUNT(l_partkey) AS l_partkey, COUNT(l_suppkey) AS l_suppkey,
    COUNT(l_linenumber) AS l_linenumber, COUNT(CASE WHEN NOT isnan(l_quantity) THEN 1 END) AS l_quantity,
    COUNT(CASE WHEN NOT isnan(l_extendedprice) THEN 1 END) AS l_extendedprice,
    COUNT(CASE WHEN NOT isnan(l_discount) THEN 1 END) AS l_discount, COUNT(CASE WHEN NOT isnan(l_tax) THEN 1 END) AS l_tax,
    COUNT(l_returnflag) AS l_returnflag, COUNT(l_linestatus) AS l_linestatus, COUNT(l_shipdate) AS l_shipdate FROM lineitem)
  ON COLUMNS(*) INTO NAME "column" VALUE non_null)
SELECT c.column_name AS "column", CAST(c.ordinal_position - 1 AS INTEGER) AS position, {_DUCK_TYPE} AS dtype,
       CAST(nn.non_null AS BIGINT) AS non_null
FROM information_schema.columns c JOIN nn ON nn."column" = c.column_name WHERE c.table_name = 'lineitem'""")
def prof_info(spark, sf_dir):
    return P.column_info(table(spark, sf_dir, "lineitem"))


@query("prof_nulls", sql="""
UNPIVOT (SELECT CAST(SUM(CASE WHEN event_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS event_id,
    CAST(SUM(CASE WHEN ts IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS ts,
    CAST(SUM(CASE WHEN user_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS user_id,
    CAST(SUM(CASE WHEN event_type IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS event_type,
    CAST(SUM(CASE WHEN value IS NULL OR isnan(value) THEN 1 ELSE 0 END) AS BIGINT) AS value,
    CAST(SUM(CASE WHEN props IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS props FROM events)
ON COLUMNS(*) INTO NAME "column" VALUE nulls""")
def prof_nulls(spark, sf_dir):
    return P.null_counts(table(spark, sf_dir, "events"))


@query("prof_head", sql="""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 5""")
def prof_head(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                             "o_orderpriority")
    return P.head(o, 5, ["o_orderkey"])


@query("prof_numeric", sql="""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem""")
def prof_numeric(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(*P.numeric_columns(li))


@query("prof_distinct", sql="SELECT DISTINCT p_type AS value FROM part WHERE p_type IS NOT NULL")
def prof_distinct(spark, sf_dir):
    return P.distinct_values(table(spark, sf_dir, "part"), "p_type")


@query("prof_nunique", sql="""
WITH d AS (
  SELECT 'l_returnflag' AS "column", COUNT(DISTINCT l_returnflag) AS n_distinct FROM lineitem UNION ALL
  SELECT 'l_quantity', COUNT(DISTINCT l_quantity) FROM lineitem UNION ALL
  SELECT 'l_linestatus', COUNT(DISTINCT l_linestatus) FROM lineitem UNION ALL
  SELECT 'l_suppkey', COUNT(DISTINCT l_suppkey) FROM lineitem)
SELECT "column", CAST(n_distinct AS BIGINT) AS n_distinct, n_distinct > 10 AS over_10, n_distinct >= 2 AS at_least_2 FROM d""")
def prof_nunique(spark, sf_dir):
    return P.distinct_counts(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_quantity", "l_linestatus",
                                                                "l_suppkey"])


@query("prof_empty", sql="""
SELECT COUNT(*) = 0 AS empty FROM (SELECT 1 FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'X' LIMIT 1)""")
def prof_empty(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "X"))
    # lazy form of ``profile.is_empty``: reads at most one matching row
    return o.limit(1).agg((F.count(F.lit(1)) == 0).alias("empty"))


@query("prof_hasvalue", sql="SELECT COALESCE(BOOL_OR(l_returnflag = 'R'), FALSE) AS present FROM lineitem")
def prof_hasvalue(spark, sf_dir):
    return P.has_value(table(spark, sf_dir, "lineitem"), "l_returnflag", "R")


@query("prof_trimnames", sql="SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def prof_trimnames(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias(" l_orderkey"),
                                                F.col("l_linenumber").alias("l_linenumber "),
                                                F.col("l_quantity").alias("  l_quantity  "))
    return P.trim_names(li)


# ---------------------------------------------------------------- §2.3 derivations

_PRIORITY_CODES = {p: i + 1 for i, p in enumerate(ORDER_PRIORITIES[:4])}  # '5-LOW' deliberately unmapped


@query("prj_select", sql="SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus FROM lineitem")
def prj_select(spark, sf_dir):
    features = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return table(spark, sf_dir, "lineitem").select(*features, "l_linestatus")


@query("map_values", sql="""
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3
  WHEN '4-NOT SPECIFIED' THEN 4 END AS priority_code FROM orders""")
def map_values(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", C.map_values("o_orderpriority", _PRIORITY_CODES).alias("priority_code"))


@query("replace_values", sql="""
SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 'Returned' WHEN 'A' THEN 'Accepted' ELSE l_returnflag END AS flag
FROM lineitem""")
def replace_values(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     C.replace_values("l_returnflag", {"R": "Returned", "A": "Accepted"}).alias("flag"))


@query("flag_in", sql="""
SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS advanced FROM orders""")
def flag_in(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", C.flag_in("o_orderpriority", ["1-URGENT", "2-HIGH"]).alias("advanced"))


@query("flag_equals", sql="""
SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS event FROM lineitem""")
def flag_equals(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", C.flag_equals("l_linestatus", "F").alias("event"))


_TOKENS = ["small", "red", "ring", "bolt"]


@query("flag_multihot", sql="SELECT p_partkey, " + ", ".join(
    f"CASE WHEN contains(p_name, '{t}') THEN 1 ELSE 0 END AS \"received_{t}\"" for t in _TOKENS) + " FROM part")
def flag_multihot(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", *C.multihot("p_name", _TOKENS, prefix="received_"))


@query("flag_contains_ci", sql="""
SELECT p_partkey, CASE WHEN contains(lower(p_type), 'prom') THEN 1 ELSE 0 END AS is_promo FROM part""")
def flag_contains_ci(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", C.flag_contains("p_type", "Prom", case_insensitive=True).alias("is_promo"))


@query("flag_and", sql="""
SELECT p_partkey, CASE WHEN contains(p_name, 'small') AND p_size > 25 THEN 1 ELSE 0 END AS small_and_big FROM part""")
def flag_and(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    f1 = C.flag_contains("p_name", "small")
    f2 = F.when(F.col("p_size") > 25, 1).otherwise(0)
    return p.select("p_partkey", C.flag_and(f1, f2).alias("small_and_big"))


@query("feat_product", sql="""
SELECT p_partkey, (CASE WHEN contains(p_name, 'red') THEN 1 ELSE 0 END) *
  COALESCE(CASE p_type WHEN 'STANDARD' THEN 0 WHEN 'PROMO' THEN 2 WHEN 'LARGE' THEN 2 END, 0) AS red_weight FROM part""")
def feat_product(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    w = C.weighted_flag(C.flag_contains("p_name", "red"), "p_type", {"STANDARD": 0, "PROMO": 2, "LARGE": 2})
    return p.select("p_partkey", w.alias("red_weight"))


@query("feat_conditional", sql="""
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END AS returned_qty FROM lineitem""")
def feat_conditional(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     C.conditional_value(C.flag_equals("l_returnflag", "R"), "l_quantity", 0.0).alias("returned_qty"))


@query("fill_map", sql="""
SELECT o_orderkey, COALESCE(CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3
  WHEN '4-NOT SPECIFIED' THEN 4 END, 0) AS priority_code,
  COALESCE(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, 'Unknown') AS status FROM orders""")
def fill_map(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", C.map_values("o_orderpriority", _PRIORITY_CODES).alias("priority_code"),
        C.map_values("o_orderstatus", {"F": "F", "O": "O"}).alias("status"))
    return o.na.fill({"priority_code": 0, "status": "Unknown"})


@query("count_tokens", sql="""
SELECT doc_id, CAST(CASE WHEN text IS NULL OR text = 'None' THEN 0 ELSE len(string_split(text, ',')) END AS INTEGER) AS n_items
FROM documents""")
def count_tokens(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", C.count_tokens("text").alias("n_items"))


@query("num_coerce", sql="""
SELECT event_id, CASE WHEN isnan(TRY_CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE)) THEN NULL
  ELSE TRY_CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) END AS k,
  TRY_CAST(event_type AS DOUBLE) AS bad FROM events""")
def num_coerce(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", C.to_number(F.regexp_extract("props", r"[0-9]+", 0)).alias("k"),
                    C.to_number("event_type").alias("bad"))


@query("num_decimal_comma", sql="""
SELECT l_orderkey, l_linenumber, round(l_extendedprice, 6) AS price FROM lineitem""")
def num_decimal_comma(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    text = F.replace(F.col("l_extendedprice").cast("string"), F.lit("."), F.lit(","))
    return rounded(li.select("l_orderkey", "l_linenumber", C.decimal_comma(text).alias("price")))


@query("date_parse", sql="""
SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS order_date,
  CAST(NULL AS VARCHAR) AS broken FROM orders""")
def date_parse(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    good = C.to_date_lenient(F.date_format("o_orderdate", "yyyy-MM-dd"), "yyyy-MM-dd")
    bad = C.to_date_lenient(F.concat(F.lit("N/A "), F.col("o_orderkey").cast("string")), "yyyy-MM-dd")
    return o.select("o_orderkey", F.date_format(good, "yyyy-MM-dd").alias("order_date"),
                    F.date_format(bad, "yyyy-MM-dd").alias("broken"))


@query("date_days_between", sql="""
SELECT l_orderkey, l_linenumber, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INTEGER) AS days
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def date_days_between(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    j = li.join(o, "l_orderkey")
    return j.select("l_orderkey", "l_linenumber",
                    C.days_between(F.to_date("l_shipdate"), F.to_date("o_orderdate")).alias("days"))


@query("str_label", sql="""
SELECT p_partkey, 'R:' || CAST(CASE WHEN contains(p_name, 'red') THEN 1 ELSE 0 END AS VARCHAR) || ' C:' ||
  CAST(CASE WHEN contains(p_name, 'cold') THEN 1 ELSE 0 END AS VARCHAR) || ' T:' ||
  CAST(CASE WHEN contains(p_name, 'small') THEN 1 ELSE 0 END AS VARCHAR) || ' S:' ||
  CAST(CASE WHEN contains(p_name, 'ring') THEN 1 ELSE 0 END AS VARCHAR) AS combo FROM part""")
def str_label(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    parts = {"R": C.flag_contains("p_name", "red"), "C": C.flag_contains("p_name", "cold"),
             "T": C.flag_contains("p_name", "small"), "S": C.flag_contains("p_name", "ring")}
    return p.select("p_partkey", C.combo_label(parts).alias("combo"))


@query("str_strip_prefix", sql="""
SELECT p_partkey, replace('Received_' || split_part(p_name, ' ', 2), 'Received_', '') AS treatment FROM part""")
def str_strip_prefix(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    named = F.concat(F.lit("Received_"), F.split_part("p_name", F.lit(" "), F.lit(2)))
    return p.select("p_partkey", C.strip_text(named, "Received_").alias("treatment"))


@query("bin_equal_width", sql="""
WITH mm AS (SELECT MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi FROM lineitem)
SELECT l_orderkey, l_linenumber, (SELECT CAST(1 + COUNT(*) AS INTEGER) FROM (SELECT unnest([1, 2, 3, 4]) AS i), mm
  WHERE l_extendedprice > i * ((hi - lo) / 5) + lo) AS bin
FROM lineitem""")
def bin_equal_width(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    mm = li.agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))
    b = C.equal_width_bin("l_extendedprice", mm.select("lo").scalar(), mm.select("hi").scalar(), 5)
    return li.select("l_orderkey", "l_linenumber", b.alias("bin"))


@query("enc_label", sql="""
SELECT p_partkey, CAST(DENSE_RANK() OVER (ORDER BY p_type) - 1 AS INTEGER) AS type_code FROM part""")
def enc_label(spark, sf_dir):
    from cohortlens.operators.models import label_encode

    p = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return label_encode(p, "p_type", "type_code").select("p_partkey", "type_code")


@query("enc_onehot", sql="""
SELECT p_partkey, CASE WHEN p_type = 'LARGE' THEN 1 ELSE 0 END AS "p_type_LARGE",
  CASE WHEN p_type = 'MEDIUM' THEN 1 ELSE 0 END AS "p_type_MEDIUM", CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END AS "p_type_PROMO",
  CASE WHEN p_type = 'SMALL' THEN 1 ELSE 0 END AS "p_type_SMALL", CASE WHEN p_type = 'STANDARD' THEN 1 ELSE 0 END AS "p_type_STANDARD"
FROM part""")
def enc_onehot(spark, sf_dir):
    from cohortlens.operators.models import one_hot

    p = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return one_hot(p, ["p_type"], drop_first=True).drop("p_type")


@query("scale_standard", sql="""
SELECT l_orderkey, l_linenumber,
  round((l_quantity - AVG(l_quantity) OVER ()) / STDDEV_POP(l_quantity) OVER (), 6) AS l_quantity_z,
  round((l_extendedprice - AVG(l_extendedprice) OVER ()) / STDDEV_POP(l_extendedprice) OVER (), 6) AS l_extendedprice_z,
  round((l_discount - AVG(l_discount) OVER ()) / STDDEV_POP(l_discount) OVER (), 6) AS l_discount_z,
  round((l_tax - AVG(l_tax) OVER ()) / STDDEV_POP(l_tax) OVER (), 6) AS l_tax_z
FROM lineitem""")
def scale_standard(spark, sf_dir):
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *cols)
    z = standardize(li, cols, suffix="_z")
    return rounded(z.select("l_orderkey", "l_linenumber", *[f"{c}_z" for c in cols]))


@query("col_guard", sql="SELECT l_orderkey, l_linenumber, l_quantity AS follow_up FROM lineitem")
def col_guard(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    # plan-time guard (Q9): a missing column raises one clear error before any job runs
    P.require_columns(li, ["l_quantity"])
    return li.select("l_orderkey", "l_linenumber", C.to_number("l_quantity").alias("follow_up"))


# ---------------------------------------------------------------- §2.4 filters


@query("flt_in", sql="SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def flt_in(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return FL.keep_in(o, "o_orderpriority", ["1-URGENT", "2-HIGH"])


@query("flt_not_in", sql="""
WITH m AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'I' WHEN '2-HIGH' THEN 'II' WHEN '3-MEDIUM' THEN 'III'
  WHEN '4-NOT SPECIFIED' THEN 'IV' END AS stage FROM orders)
SELECT o_orderkey, stage FROM m WHERE stage NOT IN ('I', 'II') OR stage IS NULL""")
def flt_not_in(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    staged = o.select("o_orderkey", C.map_values("o_orderpriority", dict(zip(ORDER_PRIORITIES, ["I", "II", "III", "IV"]))
                                                 ).alias("stage"))
    return FL.drop_in(staged, "stage", ["I", "II"])


@query("flt_equals", sql="""
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus IN ('F')""")
def flt_equals(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    out = FL.keep_equal(FL.keep_equal(li, "l_returnflag", "R"), "l_linestatus", ["F"])
    return out.select("l_orderkey", "l_linenumber", "l_quantity")


@query("flt_regex", sql="""
SELECT o_orderkey, o_orderpriority FROM orders WHERE COALESCE(regexp_matches(o_orderpriority, 'URGENT|HIGH'), FALSE)""")
def flt_regex(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return FL.keep_regex(o, "o_orderpriority", "URGENT|HIGH")


@query("flt_not_null", sql="""
WITH m AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'N/A' WHEN '2-HIGH' THEN NULL ELSE o_orderpriority END AS surgery
  FROM orders)
SELECT o_orderkey, surgery FROM m WHERE surgery IS NOT NULL AND surgery <> 'N/A'""")
def flt_not_null(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    s = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("N/A")).when(
        F.col("o_orderpriority") == "2-HIGH", F.lit(None)).otherwise(F.col("o_orderpriority"))
    return FL.keep_present(o.select("o_orderkey", s.alias("surgery")), "surgery", ["N/A"])


@query("flt_dropna", sql="""
WITH m AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3
  WHEN '4-NOT SPECIFIED' THEN 4 END AS priority_code, o_totalprice FROM orders)
SELECT o_orderkey, priority_code, o_totalprice FROM m WHERE priority_code IS NOT NULL AND o_totalprice IS NOT NULL""")
def flt_dropna(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", C.map_values("o_orderpriority", _PRIORITY_CODES).alias("priority_code"), "o_totalprice")
    return FL.drop_incomplete(o, ["priority_code", "o_totalprice"])
