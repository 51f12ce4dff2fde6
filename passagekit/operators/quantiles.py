"""Exact quantiles by nearest rank, without any task that holds a group's values.

A pass takes two pivots around the wanted rank from a mergeable sketch of the values still in
question, and counts the values below, at, between and above them, with map-side sums. The
zone that has the rank is what is left. Pivots are values that occur and zones are counted, so
the result is exact whatever the sketch's error; by its bound a pass leaves about one in
``GRID / 4`` values, whatever their distribution. Once few are left they are ranked.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagekit.plans.shared import stored

#: Points of the sketch that pivots are chosen from, its accuracy, and how many values of a
#: group may be ranked at once.
GRID, ACCURACY, FEW = 200, 10_000, 4096
#: Groups whose intervals are broadcast at most.
GROUPS = 100_000


def nearest_rank(df: DataFrame, value: str, share: str, *by: str, few: int = FEW) -> DataFrame:
    """``(*by, quantile)``: the least value that at least ``share`` (a decimal, as ``'0.95'``)
    of a group's values do not exceed.

    Nulls, NaN and infinite values are left out; groups without others have no row, null keys
    are a group of their own. Equal values count each; an empty table gives no row.
    """
    keys = [f"_k{i}" for i in range(max(1, len(by)))]
    v = F.col(value).cast("double")
    rows = df.select(*(c.alias(k) for c, k in zip(map(F.col, by) if by else [F.lit(0)], keys, strict=True)), v.alias("v")).where("v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('infinity')")
    known = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    rank = F.greatest(F.lit(1), F.ceil(F.lit(Decimal(share)) * F.col("n"))).cast("bigint")
    held = stored(known.select(*keys, rank.alias("rank"), F.col("n").alias("left"), "lo", "hi"))
    small = held.count() <= GROUPS

    def within(intervals: DataFrame) -> DataFrame:
        """The values in their group's interval, with what is known of it."""
        side = (F.broadcast(intervals) if small else intervals.repartition(*keys)).alias("b")
        same = F.lit(True)
        for k in keys:
            same &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        return rows.alias("a").join(side, same).where("v BETWEEN lo AND hi").select(*(f"b.{c}" for c in intervals.columns), "v")

    ended = (F.col("left") <= few) | (F.col("lo") == F.col("hi"))
    done, open_ = held.where(ended), held.where(~ended)
    while not open_.isEmpty():
        grid = F.percentile_approx("v", [i / GRID for i in range(GRID + 1)], ACCURACY).alias("grid")
        at = F.col("rank") / F.col("left") * GRID
        point = lambda i: F.element_at("grid", (F.greatest(F.lit(0), F.least(F.lit(GRID), i)) + 1).cast("int"))
        sketch = within(open_).groupBy(*keys).agg(grid, *(F.any_value(c).alias(c) for c in ("rank", "left", "lo", "hi")))
        pivots = stored(sketch.select(*keys, "rank", "left", "lo", "hi", point(F.floor(at) - 1).alias("a"), point(F.ceil(at) + 1).alias("b")))
        zones = {"below": "v < a", "at_a": "v = a", "between": "v > a AND v < b", "at_b": "v = b AND b > a", "above": "v > b"}
        counts = within(pivots).groupBy(*keys).agg(
            *(F.any_value(c).alias(c) for c in ("rank", "lo", "hi", "a", "b")),
            *(F.count_if(F.expr(x)).alias(z) for z, x in zones.items()),
            F.expr("max(v) FILTER (WHERE v < a)").alias("top"), F.expr("min(v) FILTER (WHERE v > a AND v < b)").alias("low"),
            F.expr("max(v) FILTER (WHERE v > a AND v < b)").alias("high"), F.expr("min(v) FILTER (WHERE v > b)").alias("bottom"),
        )
        before, found = F.lit(0), None
        for zone, (lo, hi) in zip(zones, (("lo", "top"), ("a", "a"), ("low", "high"), ("b", "b"), ("bottom", "hi")), strict=True):
            part = F.struct((F.col("rank") - before).cast("bigint").alias("rank"), F.col(zone).cast("bigint").alias("left"), F.col(lo).alias("lo"), F.col(hi).alias("hi"))
            here = F.col("rank") <= before + F.col(zone)
            found = F.when(here, part) if found is None else found.when(here, part)
            before = before + F.col(zone)
        held = stored(counts.select(*keys, found.alias("x")).select(*keys, "x.rank", "x.left", "x.lo", "x.hi"))
        done, open_ = done.unionByName(held.where(ended)), held.where(~ended)
    ranked = within(done.where("lo < hi")).withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy("v"))).where(F.col("i") == F.col("rank"))
    found = done.where("lo = hi").select(*keys, F.col("lo").alias("quantile")).unionByName(ranked.select(*keys, F.col("v").alias("quantile")))
    return found.select(*(F.col(k).alias(c) for k, c in zip(keys, by, strict=False)), "quantile")
