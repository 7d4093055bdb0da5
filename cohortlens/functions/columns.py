"""Column-expression builders for cleaning and recoding.

Every function returns a ``Column`` built from native Spark SQL expressions: no job runs, nothing leaves the JVM,
and the expressions fuse into whole-stage codegen with the surrounding projection.  Null behaviour follows the
reference's pandas code (rules N2–N7, N12): flags treat a missing value as "absent", coercions turn bad text into
NULL, divisions never raise.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def map_values(c: str | Column, mapping: Mapping) -> Column:
    """Value lookup; an unmapped value (or NULL) gives NULL, like ``Series.map(dict)`` (N5)."""
    m = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))
    x = col(c)
    return F.when(x.isNull(), F.lit(None)).otherwise(F.try_element_at(m, x))


def replace_values(c: str | Column, mapping: Mapping) -> Column:
    """Recode listed values, keep every other value as it is, like ``Series.replace(dict)`` (N6)."""
    x = col(c)
    return F.coalesce(map_values(x, mapping), x)


def flag_in(c: str | Column, values: Sequence) -> Column:
    """0/1 membership flag; NULL gives 0."""
    return F.coalesce(col(c).isin(list(values)), F.lit(False)).cast("int")


def flag_equals(c: str | Column, value) -> Column:
    """0/1 equality flag; NULL gives 0 (N3)."""
    return F.when(col(c) == F.lit(value), F.lit(1)).otherwise(F.lit(0))


def flag_contains(c: str | Column, token: str, case_insensitive: bool = False) -> Column:
    """0/1 substring flag; NULL gives 0 (N2)."""
    x = col(c)
    if case_insensitive:
        x, token = F.lower(x), token.lower()
    return F.coalesce(x.contains(F.lit(token)), F.lit(False)).cast("int")


def multihot(c: str | Column, tokens: Sequence[str], prefix: str = "") -> list[Column]:
    """One 0/1 substring flag per token, named ``prefix + token``."""
    return [flag_contains(c, t).alias(f"{prefix}{t}") for t in tokens]


def flag_and(a: str | Column, b: str | Column) -> Column:
    """Conjunction of two 0/1 flags as 0/1."""
    return ((col(a) == 1) & (col(b) == 1)).cast("int")


def conditional_value(flag: str | Column, value: str | Column, otherwise=0) -> Column:
    """``value`` where the flag is 1, else ``otherwise`` (intensity columns)."""
    return F.when(col(flag) == 1, col(value)).otherwise(F.lit(otherwise))


def weighted_flag(flag: str | Column, c: str | Column, weights: Mapping, unknown=0) -> Column:
    """Interaction ``flag × weight(c)``; values without a weight count as ``unknown`` (Q4)."""
    return col(flag) * F.coalesce(map_values(c, weights), F.lit(unknown))


def count_tokens(c: str | Column, sep: str = ",", none_token: str = "None") -> Column:
    """Number of ``sep``-separated items; the sentinel (and NULL, which the reference fills with it) gives 0."""
    x = col(c)
    return (
        F.when(x.isNull() | (x == F.lit(none_token)), F.lit(0))
        .otherwise(F.size(F.split(x, F.lit(sep), -1)))
        .cast("int")
    )


# A number as text: digits with an optional point and exponent, or an infinity (type suffixes and hexadecimal
# forms, which a cast would take, are not numbers to the reference).
_NUMBER = r"^\s*[+-]?(([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*$"


def to_number(c: str | Column) -> Column:
    """Text → double, anything unparseable (including the text 'nan') → NULL (N7)."""
    v = F.when(col(c).cast("string").rlike(_NUMBER), col(c).try_cast("double"))
    return F.nanvl(v, F.lit(None).cast("double"))


def decimal_comma(c: str | Column) -> Column:
    """Accept a decimal comma ('3,5' → 3.5), then coerce like ``to_number``."""
    return to_number(F.regexp_replace(col(c).cast("string"), ",", "."))


def to_date_lenient(c: str | Column, fmt: str | None = None) -> Column:
    """Text → date, unparseable → NULL (N8; the failure count is an aggregate on the result)."""
    x = col(c).cast("string")
    return F.try_to_date(x, fmt) if fmt else F.try_to_date(x)


def days_between(end: str | Column, start: str | Column) -> Column:
    """Whole days from ``start`` to ``end`` (days to surgery)."""
    return F.datediff(col(end), col(start))


def combo_label(parts: Mapping[str, str | Column]) -> Column:
    """Label such as ``R:1 C:0 T:0 S:1`` built from short names and 0/1 columns."""
    return F.concat_ws(" ", *[F.concat(F.lit(f"{k}:"), col(v).cast("string")) for k, v in parts.items()])


def strip_text(c: str | Column, text: str) -> Column:
    """Remove every occurrence of ``text`` (e.g. a ``Received_`` prefix)."""
    return F.replace(col(c), F.lit(text), F.lit(""))


def safe_ratio(num: str | Column, den: str | Column, zero=0.0) -> Column:
    """num / den, ``zero`` when the denominator is 0 or NULL (N12)."""
    return F.coalesce(F.try_divide(col(num), col(den)), F.lit(zero))


def equal_width_bin(x: str | Column, lo: Column, hi: Column, k: int) -> Column:
    """1-based right-closed equal-width bin over [lo, hi], lowest value included (``pd.cut(include_lowest)``): one
    more than the number of inner edges ``lo + i·step`` below the value.  A range of one value is widened by a
    thousandth to both sides first.  NULL stays NULL.

    ``lo``/``hi`` are typically scalar subqueries, so the bin edges never pass through the driver.
    """
    v = col(x).cast("double")
    margin = F.when(hi == lo, F.when(lo == 0, F.lit(0.001)).otherwise(F.abs(lo) * 0.001)).otherwise(F.lit(0.0))
    step = ((hi + margin) - (lo - margin)) / F.lit(float(k))
    above = sum(((v > F.lit(float(i)) * step + (lo - margin)).cast("int") for i in range(1, k)), F.lit(1))
    return F.when(v.isNotNull(), above)


def cut_edges(lo: float, hi: float, k: int) -> list[float]:
    """The k + 1 edges of equal-width bins over [lo, hi]; the first lies a thousandth of the range below ``lo``."""
    if lo == hi:
        margin = 0.001 * abs(lo) if lo else 0.001
        lo, hi = lo - margin, hi + margin
        return [i * ((hi - lo) / k) + lo for i in range(k)] + [hi]
    edges = [i * ((hi - lo) / k) + lo for i in range(k)] + [hi]
    return [edges[0] - (hi - lo) * 0.001, *edges[1:]]


def cut_labels(edges: Sequence[float], digits: int = 0) -> list[str]:
    """Labels ``(a, b]`` of bins: edges rounded to as few digits, at least ``digits``, as keep them apart; the first
    edge is lowered by one unit of the last digit, as the lowest value belongs to the first bin."""

    def rounded(x: float, places: int) -> float:
        whole = int(x)
        if x == 0 or whole:
            return round(x, places)
        return round(x, places - 1 - math.floor(math.log10(abs(x))))

    for places in range(digits, digits + 20):
        shown = [rounded(e, places) for e in edges]
        if len(set(shown)) == len(shown):
            break
    shown[0] -= 10.0 ** -places
    return [f"({float(a)}, {float(b)}]" for a, b in zip(shown, shown[1:])]


def custom_order(c: str | Column, order: Sequence) -> Column:
    """Sort key following a caller-given order; unlisted values sort last (Q2)."""
    pos = F.array_position(F.array(*[F.lit(v) for v in order]), col(c))
    return F.when(pos == 0, F.lit(None)).otherwise(pos).cast("int")
