"""Exact order statistics without a sort: bracket and count.

Split cutoffs, fold ends and quantiles need the keys at a few ranks.  Sorting or ranking every row for them moves the whole
table.  ``order_statistics`` reads it twice instead, column-pruned, and shuffles little:

1. A mergeable sketch per group (``percentile_approx``) brackets every rank: its error bound tells how far apart
   the bracket's ends must be.
2. One counting pass.  The ends of all brackets cut the values into cells; rows outside the brackets only add to their
   cell's count before the shuffle, rows inside are counted by key and dealt to narrow bins by value.
3. Running counts over the cells and bins of a group, a bounded number, tell the bin of each rank, and a window over
   that bin's different keys tells the key.

Groups too small for a bracket are counted whole.  Nothing runs until the result is used.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Relative accuracy of the sketch is 1 / ACCURACY; brackets reach SLACK of it to either side.
ACCURACY = 2_000
SLACK = 4
# Groups of so many rows or fewer lie inside one bracket as a whole.
FEW = 4 * ACCURACY
# Bins of a cell.
BINS = 256
# One row per group is broadcast up to this many groups.
SMALL_GROUPS = 100_000


def few_groups(df: DataFrame, groups: Sequence[str]) -> bool:
    """Whether a table of one row per group may be broadcast; an estimate from the group columns alone."""
    if not groups:
        return True
    return (df.agg(F.approx_count_distinct(F.struct(*groups))).first()[0] or 0) <= SMALL_GROUPS


def attach(df: DataFrame, side: DataFrame, groups: Sequence[str], small: bool, name: str) -> DataFrame:
    """``df`` with the group's row of ``side`` as a struct: a scalar subquery without groups, else a join that
    broadcasts ``side`` only where it is known to be small."""
    rest = [c for c in side.columns if c not in groups]
    if not groups:
        return df.withColumn(name, side.select(F.struct(*rest)).scalar())
    keyed = side.select(*[F.col(g).alias(f"__g_{g}") for g in groups], F.struct(*rest).alias(name))
    left = df if small else df.hint("merge")
    on = [left[g].eqNullSafe(keyed[f"__g_{g}"]) for g in groups]
    return left.join(F.broadcast(keyed) if small else keyed, on, "left").drop(*[f"__g_{g}" for g in groups])


def order_statistics(df: DataFrame, groups: Sequence[str], value: Column, key: Column, places: Sequence[float],
                     ranks: Callable[[Column], list[Column]], small: bool = True) -> DataFrame:
    """``(groups..., n, s0, s1, ...)``: per group its row count and the key at each rank.

    ``key`` is of any ordered type and not null; ``value`` is a double, not null or NaN, that never falls where the key
    rises.  ``ranks`` maps a group's size to 1-based ranks, each within one row of a share ``places`` of the group;
    a rank of 0 has no key.  ``small`` tells whether one row per group may be broadcast (see ``few_groups``)."""
    g = list(groups)
    d = df.select(*g, value.alias("__v"), key.alias("__key"))
    reach = SLACK / ACCURACY
    ends = [max(p - reach, 0.0) for p in places] + [min(p + reach, 1.0) for p in places]
    low, high = F.lit(float("-inf")), F.lit(float("inf"))
    sketch = d.groupBy(*g).agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"),
                               F.percentile_approx("__v", ends, ACCURACY).alias("q"))
    m = len(places)
    sketch = sketch.select(
        *g, "lo", "hi", *[F.when(F.col("n") > FEW, F.col("q")[i] if 0 < p < 1 else low if i < m else high)
                          .otherwise(low if i < m else high).alias(f"b{i}") for i, p in enumerate(ends)])
    a = attach(d, sketch, g, small, "__a")
    v, lows, highs = F.col("__v"), [F.col(f"__a.b{i}") for i in range(m)], [F.col(f"__a.b{m + i}") for i in range(m)]
    inside, cell = F.lit(False), F.lit(0)
    for x, y in zip(lows, highs, strict=True):
        inside = inside | ((v >= x) & (v <= y))
        cell = cell + (v >= x).cast("int") + (v > y).cast("int")
    # a cell's own ends, the same for all its rows
    begin = F.greatest(F.col("__a.lo"), *[F.when(v >= x, x) for x in lows], *[F.when(v > y, y) for y in highs])
    end = F.least(F.col("__a.hi"), *[F.when(v <= y, y) for y in highs], *[F.when(v < x, x) for x in lows])
    share = F.try_divide(v - begin, end - begin)
    share = F.coalesce(F.nanvl(share, F.lit(0.0)), F.lit(0.0))
    spot = F.least(F.greatest(F.floor(share * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int")
    # never null, so that no filter repeats the brackets
    cell, spot = F.coalesce(cell, F.lit(-1)), F.coalesce(F.when(inside, spot), F.lit(0))
    dealt = a.select(*g, cell.alias("__cell"), spot.alias("__bin"), F.when(inside, F.col("__key")).alias("__key"))
    counted = dealt.groupBy(*g, "__cell", "__bin", "__key").agg(F.count(F.lit(1)).alias("__c"))

    bins = counted.groupBy(*g, "__cell", "__bin").agg(F.sum("__c").alias("__c"))
    whole = Window.partitionBy(*g)
    ahead = F.sum("__c").over(whole.orderBy("__cell", "__bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__c")
    bins = bins.select("*", ahead.alias("__ahead"), F.sum("__c").over(whole).alias("__n"))
    wanted = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), (r - F.col("__ahead")).cast("long").alias("need")) for i, r in enumerate(ranks(F.col("__n")))]),
                      lambda r: (r["need"] > 0) & (r["need"] <= F.col("__c")))
    hit = bins.select(*[F.col(c).alias(f"__g_{c}") for c in g], F.col("__cell").alias("__hc"), F.col("__bin").alias("__hb"), "__n", F.explode(wanted).alias("w"))
    on = [counted[c].eqNullSafe(hit[f"__g_{c}"]) for c in g] + [counted["__cell"] == hit["__hc"], counted["__bin"] == hit["__hb"]]
    # a row per group and rank
    few = counted.join(F.broadcast(hit) if small else hit, on).drop(*[f"__g_{c}" for c in g])
    order = Window.partitionBy(*g, "__cell", "__bin", "w.i").orderBy("__key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    few = few.withColumn("__upto", F.sum("__c").over(order))
    few = few.where((F.col("__upto") >= F.col("w.need")) & (F.col("__upto") - F.col("__c") < F.col("w.need")))
    found = F.when(F.col("__key").isNull(), F.raise_error(F.lit("a rank lies outside its bracket"))).otherwise(F.col("__key"))
    some = few.groupBy(*g).agg(F.max("__n").alias("n"), *[F.max(F.when(F.col("w.i") == i, found)).alias(f"s{i}") for i in range(len(ranks(F.lit(1))))])
    return some
