"""Distribution and correlation summaries (SURVEY §2.6 dist_*, corr_matrix, pair_grid, reg_sse_sst_r2; §2.3
scale_standard, bin_equal_width).

Exact quantiles are computed from selected order statistics, not with ``percentile``: the latter keeps a value→count map
per group in one task, which a hot group with continuous values would blow up.  ``selection.order_statistics`` brackets
the ranks by a sketch and counts; no value outside the brackets is shuffled.  ``approx=True`` switches to
``percentile_approx`` alone (fixed-size sketch per group).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.columns import col
from cohortlens.operators.selection import attach, few_groups, order_statistics

# The quartile probabilities of a box plot and its whisker reach in IQRs.
QUARTILES = (0.25, 0.5, 0.75)
WHISKER = 1.5


def _clean(x: Column) -> Column:
    x = x.cast("double")
    return F.nanvl(x, F.lit(None).cast("double"))


# A per-group result (one row per group) is broadcast to the per-value rows only up to this many groups.
SMALL_SIDE_ROWS = 100_000


def _values(df: DataFrame, value: str | Column, groups: Sequence[str]) -> DataFrame:
    return df.select(*groups, _clean(col(value)).alias("v")).where(F.col("v").isNotNull())


def quantiles(df: DataFrame, value: str | Column, probs: Sequence[float], groups: Sequence[str] = (),
              approx: bool = False, accuracy: int = 10000, small: bool | None = None) -> DataFrame:
    """Quantiles with linear interpolation (numpy's default, DuckDB ``quantile_cont``) per group.

    Output: groups..., n, q0, q1, ... (one column per probability, in order).  ``small`` tells whether one row per group may
    be broadcast; it is looked up where it isn't given.
    """
    g = list(groups)
    v = _values(df, value, g)
    if approx:
        return v.groupBy(*g).agg(
            F.count(F.lit(1)).alias("n"),
            F.percentile_approx("v", list(probs), accuracy).alias("__q"),
        ).select(*g, "n", *[F.col("__q")[i].alias(f"q{i}") for i in range(len(probs))])

    def ranks(n: Column) -> list[Column]:
        at = [(n - 1) * F.lit(float(p)) for p in probs]
        return [f(h) + 1 for h in at for f in (F.floor, F.ceil)]

    picked = order_statistics(v, g, F.col("v"), F.col("v"), probs, ranks, few_groups(v, g) if small is None else small)
    out = []
    for i, p in enumerate(probs):
        h = (F.col("n") - 1) * F.lit(float(p))
        low, high = F.col(f"s{2 * i}"), F.col(f"s{2 * i + 1}")
        out.append((low + (h - F.floor(h)) * (high - low)).alias(f"q{i}"))
    # a table without values has no groups, and one row of nulls where none are asked for
    return picked.select(*g, F.coalesce("n", F.lit(0)).alias("n"), *out)


def box_summary(df: DataFrame, value: str | Column, groups: Sequence[str] = (), approx: bool = False) -> DataFrame:
    """Box-plot table per group: n, min, q1, median, q3, max, whisker_low, whisker_high, outliers.

    Whiskers are the most extreme data points within 1.5 IQR of the quartiles (the seaborn/matplotlib rule);
    ``outliers`` counts the points beyond them.  The quartiles (one row per group) meet the rows in a join that shuffles
    none of them where the groups are few, and one partial aggregate per group gives the rest.
    """
    g = list(groups)
    v = _values(df, value, g)
    small = few_groups(df, g)
    q = quantiles(df, value, QUARTILES, g, approx=approx, small=small)
    q = q.select(*g, "n", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
    j = attach(v, q, g, small, "__q")
    j = j.select(*g, "v", *[F.col(f"__q.{c}").alias(c) for c in ("n", "q1", "median", "q3")])
    iqr = F.col("q3") - F.col("q1")
    low_fence, high_fence = F.col("q1") - WHISKER * iqr, F.col("q3") + WHISKER * iqr
    inside = (F.col("v") >= low_fence) & (F.col("v") <= high_fence)
    return j.groupBy(*g).agg(
        F.first("n").alias("n"),
        F.min("v").alias("min"),
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.max("v").alias("max"),
        F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
        F.sum(F.when(~inside, F.lit(1)).otherwise(F.lit(0))).alias("outliers"),
    )


def _long_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    d = df.select(*[_clean(F.col(c)).alias(c) for c in columns])
    return d.unpivot([], list(columns), "variable", "value").where(F.col("value").isNotNull())


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """(variable, bin, lo, hi, count) for each numeric column: ``bins`` equal-width bins over [min, max], the last
    bin closed on the right (numpy's rule).  Every bin is listed, empty ones with 0."""
    long = _long_numeric(df, columns)
    stats = long.groupBy("variable").agg(F.min("value").alias("mn"), F.max("value").alias("mx"))
    width = (F.col("mx") - F.col("mn")) / F.lit(bins)
    # one row per listed column: the size of this side is fixed by the call, so it is broadcast
    stats = F.broadcast(stats.select("variable", "mn", "mx", width.alias("w")))
    b = F.when(F.col("w") == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("value") - F.col("mn")) / F.col("w")), F.lit(bins - 1))).cast("int")
    counts = long.join(stats, "variable").groupBy("variable", b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = stats.select("variable", "mn", "w", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = grid.join(counts, ["variable", "bin"], "left").select(
        "variable", "bin",
        (F.col("mn") + F.col("bin") * F.col("w")).alias("lo"),
        (F.col("mn") + (F.col("bin") + 1) * F.col("w")).alias("hi"),
        F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"),
    )
    return out


def kde(df: DataFrame, value: str | Column, grid_size: int = 200, cut: float = 3.0,
        bandwidth: float | None = None) -> DataFrame:
    """Gaussian kernel density on an even grid (seaborn's ``kdeplot`` defaults: Scott bandwidth sd·n^(−1/5),
    grid from min − 3·bw to max + 3·bw, 200 points).  Output: (point, x, density).

    The data is first reduced to (value, count).  Each distinct value then adds its kernel to the grid points
    within 40 bandwidths of it, through an exploded index range aggregated with a partial ``groupBy``.  Beyond 40
    bandwidths exp(−z²/2) is exactly 0.0 in double precision, so leaving those points out changes no sum, while the
    work per value shrinks as the data (and so n^(−1/5)) grows.  There is no join with the data; the grid never grows.
    """
    v = df.select(_clean(col(value)).alias("v")).where(F.col("v").isNotNull())
    counts = v.groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    stats = v.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("v").alias("sd"), F.min("v").alias("mn"),
                  F.max("v").alias("mx"))
    n = stats.select("n").scalar()
    if bandwidth is None:
        bw = stats.select(F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))).scalar()
    else:
        bw = F.lit(float(bandwidth))
    lo = stats.select("mn").scalar() - F.lit(cut) * bw
    hi = stats.select("mx").scalar() + F.lit(cut) * bw
    step = (hi - lo) / F.lit(grid_size - 1)
    reach = F.lit(40.0) * bw
    first = F.greatest(F.lit(0), (F.ceil((F.col("v") - reach - lo) / step) - 1).cast("int"))
    last = F.least(F.lit(grid_size - 1), (F.floor((F.col("v") + reach - lo) / step) + 1).cast("int"))
    # a zero bandwidth (one distinct value) has no density: no contributions, NULL density below
    near = counts.where(bw > 0).select("v", "c", F.explode(F.sequence(first, last)).alias("point"))
    x = lo + F.col("point") * step
    z = (x - F.col("v")) / bw
    sums = near.groupBy("point").agg(F.sum(F.col("c") * F.exp(F.lit(-0.5) * z * z)).alias("s"))
    grid = df.sparkSession.range(grid_size).select(F.col("id").cast("int").alias("point"))
    norm = n * bw * F.lit(math.sqrt(2 * math.pi))
    return grid.join(sums, "point", "left").select(
        "point", (lo + F.col("point") * step).alias("x"),
        F.when(bw > 0, F.coalesce(F.col("s"), F.lit(0.0)) / norm).alias("density"))


def kde_by_group(df: DataFrame, value: str | Column, groups: Sequence[str], grid_size: int = 200, cut: float = 3.0
                 ) -> DataFrame:
    """One density per group (the violins of the reference's charts): each group gets its own Scott bandwidth
    and its own grid over [min − 3·bw, max + 3·bw].  Output: (groups..., point, x, density).

    Same reach rule as ``kde``.  The per-group statistics (one row per group) are broadcast to the per-value rows
    only below a checked group count; otherwise both sides are shuffled and AQE splits a hot group."""
    g = list(groups)
    v = df.select(*g, _clean(col(value)).alias("v")).where(F.col("v").isNotNull())
    counts = v.groupBy(*g, "v").agg(F.count(F.lit(1)).alias("c"))
    stats = v.groupBy(*g).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("v").alias("sd"),
                              F.min("v").alias("mn"), F.max("v").alias("mx"))
    bw = F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    stats = stats.select(*[F.col(k).alias(f"__g_{k}") for k in g], "n", bw.alias("bw"),
                         (F.col("mn") - F.lit(cut) * bw).alias("lo"), (F.col("mx") + F.lit(cut) * bw).alias("hi"))
    stats = stats.withColumn("step", (F.col("hi") - F.col("lo")) / F.lit(grid_size - 1))
    n_groups = int(v.agg(F.approx_count_distinct(F.struct(*g))).first()[0] or 0)
    side = F.broadcast(stats) if n_groups <= SMALL_SIDE_ROWS else stats
    per = counts if n_groups <= SMALL_SIDE_ROWS else counts.hint("merge")
    j = per.join(side, [per[k].eqNullSafe(side[f"__g_{k}"]) for k in g], "inner").where(F.col("bw") > 0)
    reach = F.lit(40.0) * F.col("bw")
    first = F.greatest(F.lit(0), (F.ceil((F.col("v") - reach - F.col("lo")) / F.col("step")) - 1).cast("int"))
    last = F.least(F.lit(grid_size - 1), (F.floor((F.col("v") + reach - F.col("lo")) / F.col("step")) + 1).cast("int"))
    near = j.select(*g, "v", "c", "lo", "step", "bw", F.explode(F.sequence(first, last)).alias("point"))
    z = (F.col("lo") + F.col("point") * F.col("step") - F.col("v")) / F.col("bw")
    sums = near.groupBy(*g, "point").agg(F.sum(F.col("c") * F.exp(F.lit(-0.5) * z * z)).alias("s"))
    grid = stats.select(*[F.col(f"__g_{k}").alias(k) for k in g], "n", "bw", "lo", "step",
                        F.explode(F.sequence(F.lit(0), F.lit(grid_size - 1))).alias("point"))
    out = grid.join(sums, [grid[k].eqNullSafe(sums[k]) for k in g] + [grid["point"] == sums["point"]], "left")
    norm = F.col("n") * F.col("bw") * F.lit(math.sqrt(2 * math.pi))
    return out.select(
        *[grid[k] for k in g], grid["point"].alias("point"),
        (F.col("lo") + grid["point"] * F.col("step")).alias("x"),
        F.when(F.col("bw") > 0, F.coalesce(F.col("s"), F.lit(0.0)) / norm).alias("density"))


def corr_matrix(df: DataFrame, columns: Sequence[str], min_columns: int = 4) -> DataFrame:
    """Pearson correlation of every ordered pair (var1, var2, corr), pairwise-complete, one aggregate; NULL where a
    column is constant, also with itself.

    The reference draws the heat map only when at least four numeric columns exist; fewer raise here."""
    cols = list(columns)
    if len(cols) < min_columns:
        raise ValueError(f"correlation matrix needs at least {min_columns} numeric columns, got {len(cols)}")
    d = df.select(*[_clean(F.col(c)).alias(c) for c in cols])
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]

    def corr(a: str, b: str) -> Column:
        # over the rows that have both; a column without spread has no correlation
        x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
        return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y)))

    agg = d.agg(*[corr(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)],
                *[F.when(F.var_pop(c) > 0, F.lit(1.0)).alias(f"d{i}") for i, c in enumerate(cols)])
    rows = [F.struct(F.lit(a).alias("var1"), F.lit(a).alias("var2"), F.col(f"d{i}").alias("corr")) for i, a in enumerate(cols)]
    for i, (a, b) in enumerate(pairs):
        rows.append(F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), F.col(f"p{i}").alias("corr")))
        rows.append(F.struct(F.lit(b).alias("var1"), F.lit(a).alias("var2"), F.col(f"p{i}").alias("corr")))
    return agg.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def pair_grid(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Joint 2-D histogram of every pair of ``columns`` over complete rows: (var1, var2, bin1, bin2, count).

    Bin edges are equal-width over each column's [min, max] (scalar subqueries), last bin closed."""
    cols = list(columns)
    d = df.select(*[_clean(F.col(c)).alias(c) for c in cols]).na.drop("any")
    stats = d.agg(*[F.min(c).alias(f"mn{i}") for i, c in enumerate(cols)],
                  *[F.max(c).alias(f"mx{i}") for i, c in enumerate(cols)])
    bin_cols = []
    for i, c in enumerate(cols):
        mn, mx = stats.select(f"mn{i}").scalar(), stats.select(f"mx{i}").scalar()
        w = (mx - mn) / F.lit(bins)
        bin_cols.append(F.when(w == 0, F.lit(0)).otherwise(
            F.least(F.floor((F.col(c) - mn) / w), F.lit(bins - 1))).cast("int").alias(f"b{i}"))
    binned = d.select(*bin_cols)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    rows = [F.struct(F.lit(cols[i]).alias("var1"), F.lit(cols[j]).alias("var2"), F.col(f"b{i}").alias("bin1"),
                     F.col(f"b{j}").alias("bin2")) for i, j in pairs]
    long = binned.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return long.groupBy("var1", "var2", "bin1", "bin2").agg(F.count(F.lit(1)).alias("count"))


def regression_errors(df: DataFrame, y: str | Column, p: str | Column) -> DataFrame:
    """SSE, SST and R² of predictions (R² = 0 when SST = 0, Q7)."""
    yy, pp = col(y).cast("double"), col(p).cast("double")
    agg = df.agg(F.sum(F.pow(yy - pp, 2)).alias("sse"), (F.var_pop(yy) * F.count(yy)).alias("sst"))
    return agg.select("sse", "sst", F.when(F.col("sst") == 0, F.lit(0.0))
                      .otherwise(1 - F.col("sse") / F.col("sst")).alias("r2"))


def standardize(df: DataFrame, columns: Sequence[str], suffix: str = "", fit_on: DataFrame | None = None
                ) -> DataFrame:
    """(x − mean) / population sd for each column (scikit-learn's scaler; a zero sd leaves x − mean).

    ``fit_on`` is the table the statistics are learned from (e.g. the training rows); by default the scaled table
    itself, which is what the reference does when it scales before splitting (Q5).  Means and sds are scalar
    subqueries over one aggregate, so the scaling stays lazy and distributed."""
    src = df if fit_on is None else fit_on
    stats = src.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)],
                   *[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(columns)])
    out = df
    for i, c in enumerate(columns):
        m, s = stats.select(f"m{i}").scalar(), stats.select(f"s{i}").scalar()
        scaled = F.when(s == 0, F.col(c) - m).otherwise((F.col(c) - m) / s)
        out = out.withColumn(f"{c}{suffix}", scaled)
    return out
