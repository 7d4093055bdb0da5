"""Driver-table stand-ins for the reference's patient table.  Each view is a lazy join/projection; the
join keys are the tables' own foreign keys, so Spark chooses (and AQE may switch to) the join strategy from sizes it
measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.plans.registry import table

# The driver domains used as completed axes (observed in the driver tables).
ORDER_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
ORDER_STATUSES = ["F", "O", "P"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
LINE_STATUSES = ["F", "O"]
PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
RETURN_FLAGS = ["A", "N", "R"]


def orders_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders ⋈ customer: priority plays the stage, market segment the gender, order status the outcome."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus",
                                             "o_totalprice", "o_orderdate")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_acctbal")
    return o.join(c, "o_custkey", "inner")


def lineitem_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem ⋈ part: part type is the stratum, return flags the treatments, line status the outcome."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
                                                "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_size", "p_name",
                                           "p_brand")
    return li.join(p, "l_partkey", "inner")


LINEITEM_PARTS_SQL = "(SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey)"
ORDERS_CUSTOMERS_SQL = "(SELECT * FROM orders JOIN customer ON o_custkey = c_custkey)"
