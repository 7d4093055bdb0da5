"""Kaplan–Meier survival curves (km_event_table, km_curve, km_by_group, km_cohort, km_ci, km_at).

The subject table is reduced to one row per (group, distinct time) before any window, so the windowed part grows
with the number of distinct times, never with the number of subjects; the running sums themselves go through
``running_totals``, which splits a hot group into blocks.  One job covers every group: no loop over groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.prefix import BLOCK, running_totals, with_blocks

# Fixed value: two-sided 95 % normal quantile used by the log-log confidence band (norm.ppf(0.975)).
Z_95 = 1.959963984540054


def _as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def km_event_table(df: DataFrame, time: str | Column, event: str | Column, group: Sequence[str] = ()) -> DataFrame:
    """Per (group, distinct time): events, censored, removed and subjects at risk (time ≥ t).

    A NULL event counts as censored (N3), a NULL or NaN time is left out."""
    return _event_table(df, time, event, group).drop("at_risk_total", BLOCK)


def _event_table(df, time, event, group):
    """Event table with ``at_risk_total``, the group size, and its blocks."""
    gcols = list(group)
    subj = df.select(*gcols, _as_col(time).cast("double").alias("time"), _as_col(event).cast("long").alias("__e"))
    subj = subj.where(F.col("time").isNotNull() & ~F.isnan("time"))
    et = subj.groupBy(*gcols, "time").agg(
        F.sum(F.coalesce("__e", F.lit(0))).alias("events"),
        F.count(F.lit(1)).alias("removed"),
    )
    cum = running_totals(with_blocks(et, ["time"], gcols), "time", {"at_risk": "removed"}, partition_by=gcols, ascending=False,
                         with_totals=True, keep_blocks=True)
    return cum.withColumn("censored", F.col("removed") - F.col("events"))


def km_curve(
    df: DataFrame,
    time: str | Column,
    event: str | Column,
    group: Sequence[str] = (),
    origin: bool = True,
    z: float = Z_95,
) -> DataFrame:
    """Kaplan–Meier estimate with Greenwood variance and the log-log 95 % band.

    Output columns: group columns, time, at_risk, events, censored, survival, ci_lower, ci_upper.  The band is NULL
    where the survival is 0 or 1 (undefined there).  With ``origin`` a (time 0, survival 1) row is added to each
    group whose first observed time is positive.
    """
    gcols = list(group)
    et = _event_table(df, time, event, gcols)
    d, n = F.col("events"), F.col("at_risk")
    terms = et.select(
        "*",
        F.when(d < n, F.log1p(-d / n)).otherwise(F.lit(0.0)).alias("__lt"),
        F.when(d >= n, F.lit(1)).otherwise(F.lit(0)).alias("__zero"),
        F.when(n > d, d.cast("double") / n.cast("double") / (n - d).cast("double")).otherwise(F.lit(0.0)).alias("__gw"),
    )
    cum = running_totals(
        terms, "time", {"__cl": "__lt", "__cz": "__zero", "__cgw": "__gw"}, partition_by=gcols, ascending=True,
    )
    s = F.when(F.col("__cz") > 0, F.lit(0.0)).otherwise(F.exp("__cl"))
    curve = cum.select(*gcols, "time", "at_risk", "events", "censored", s.alias("survival"),
                       F.col("__cgw").alias("__v"), "at_risk_total")
    ls = F.log("survival")
    inner = F.log(-ls)
    spread = z * F.sqrt("__v") / ls
    defined = (F.col("survival") > 0) & (F.col("survival") < 1)
    cols = [*gcols, "time", "at_risk", "events", "censored", "survival", "ci_lower", "ci_upper"]
    curve = curve.select(
        *gcols, "time", "at_risk", "events", "censored", "survival",
        F.when(defined, F.exp(-F.exp(inner - spread))).alias("ci_lower"),
        F.when(defined, F.exp(-F.exp(inner + spread))).alias("ci_upper"),
        "at_risk_total",
    )
    if not origin:
        return curve.select(*cols)
    # The (time 0, survival 1) row is emitted next to each group's first time (where everyone is still at risk)
    # by exploding a one- or two-element array: same pass, no union with a second scan of the subjects.
    this = F.struct(*[F.col(c) for c in cols])
    start = F.struct(
        *[F.col(c) for c in gcols],
        F.lit(0.0).alias("time"), F.col("at_risk_total").alias("at_risk"), F.lit(0).cast("long").alias("events"),
        F.lit(0).cast("long").alias("censored"), F.lit(1.0).alias("survival"),
        F.lit(None).cast("double").alias("ci_lower"), F.lit(None).cast("double").alias("ci_upper"),
    )
    first = (F.col("at_risk") == F.col("at_risk_total")) & (F.col("time") > 0)
    rows = F.when(first, F.array(start, this)).otherwise(F.array(this))
    return curve.select(F.explode(rows).alias("__r")).select("__r.*")


def km_at(curve: DataFrame, t0: float, group: Sequence[str] = ()) -> DataFrame:
    """Survival at time ``t0`` (last step at or before it) and median survival time per group.

    Works on a ``km_curve`` result, which already has one row per distinct time.
    """
    gcols = list(group)
    return curve.groupBy(*gcols).agg(
        F.max_by("survival", F.when(F.col("time") <= t0, F.col("time"))).alias("survival_at"),
        F.min(F.when(F.col("survival") <= 0.5, F.col("time"))).alias("median_time"),
    )
