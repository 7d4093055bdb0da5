"""URL filter: host-suffix and path-prefix expressions, joined on short hash prefixes, confirmed by full digests.

Native DataFrame code only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, take

PREFIX_HEX = 8  # hash prefix of an expression: 32 bits
MAX_RULE_SHAPES = 4096


@dataclass(frozen=True)
class Rule:
    """``host`` and all its subdomains, under paths that start with ``path`` (which begins with ``/``)."""

    action: str
    host: str
    path: str


#: The rules of the registered query (fixed values).
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def rules_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """(action, host, path) of the rules."""
    return spark.createDataFrame([(r.action, r.host, r.path) for r in rules], "action string, host string, path string")


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = _after_scheme(url)
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for a null or a text without ``://``."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*(/[^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    return F.when(at > 0, F.substr(u, at + F.lit(3))).otherwise(F.lit(""))


def _expression(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url",
                default: str = "allow") -> DataFrame:
    """Judge every URL: ``(id, host, path, rule, verdict, n_rules)``, one row per input row.

    A rule fits its host and all subdomains if the URL's path starts with the rule's path; the longest rule text
    (host and path) wins, ties go to the longer path, then to ``block``.  ``n_rules`` counts the fitting rules.

    Each URL becomes one expression per host suffix and path prefix whose label count and length occur among the
    rules (so the number of expressions is bounded by the rules' shapes, not by the URL's length), expressions are
    equi-joined to rules on a 32-bit hash prefix, and the full digest confirms the match.  Rules are read once by
    a driver aggregate for their shapes (at most ``MAX_RULE_SHAPES`` rows, else an error).

    Null URLs, texts without ``://`` and empty texts have empty host and path and get the default.  Repeated rows
    (also of one id) are judged one by one; tables without rows give no rows; other columns are not read.
    Distinct URLs are judged once, so hot URLs cost one expansion.
    """
    if default not in ("allow", "block"):
        raise ValueError("default must be 'allow' or 'block'")
    ruled = (take(rules, action="action", host="host", path="path").dropna()
             .withColumn("host", F.translate("host", UPPER, LOWER)).distinct())
    ruled = ruled.withColumn("digest", _expression(F.col("host"), F.col("path")))
    shapes = ruled.select(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars")).distinct()
    found = shapes.limit(MAX_RULE_SHAPES + 1).collect()
    if len(found) > MAX_RULE_SHAPES:
        raise ValueError(f"rules have more than {MAX_RULE_SHAPES} pairs of label count and path length")
    rows = take(pages, id=id_col, url=url_col)
    rows = rows.select("id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    if not found:
        fits = rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default), "n_rules": F.lit(0).cast("long")})
        return fits.withColumnRenamed("id", id_col)
    labels = F.split("host", r"\.")
    expressions = F.array(*[
        F.when((F.size(labels) >= a) & (F.length("path") >= b),
               F.struct(F.array_join(F.slice(labels, F.size(labels) - F.lit(a - 1), a), ".").alias("host"),
                        F.substring("path", 1, b).alias("path")))
        for a, b in sorted((r["labels"], r["chars"]) for r in found)])
    places = rows.select("host", "path").distinct()
    looked = places.select("host", "path", F.explode(F.filter(expressions, lambda e: e.isNotNull())).alias("e"))
    looked = looked.withColumn("digest", _expression(F.col("e.host"), F.col("e.path")))
    ruled = ruled.select("action", "digest", F.concat("host", "path").alias("rule"), F.length("path").alias("chars"),
                         F.substring("digest", 1, PREFIX_HEX).alias("short"))
    hits = (looked.withColumn("short", F.substring("digest", 1, PREFIX_HEX)).alias("l")
            .join(ruled.alias("r"), (F.col("l.short") == F.col("r.short")) & (F.col("l.digest") == F.col("r.digest"))
                  & (F.concat(F.col("l.e.host"), F.col("l.e.path")) == F.col("r.rule")))
            .groupBy("l.host", "l.path")
            .agg(F.max(F.struct(F.length("r.rule").alias("size"), F.col("r.chars").alias("chars"),
                                F.col("r.action").alias("action"), F.col("r.rule").alias("rule"))).alias("best"),
                 F.count_distinct("r.rule").alias("n_rules")))
    judged = rows.join(hits, ["host", "path"], "left")
    return judged.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"),
                         F.coalesce("best.action", F.lit(default)).alias("verdict"),
                         F.coalesce("n_rules", F.lit(0)).cast("long").alias("n_rules"))
