"""Dense numbers in a sorted order, without one task that sees all rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagekit.plans.shared import stored

#: Bits of `monotonically_increasing_id` that number the rows of a partition.
ROW_BITS = 33


def numbered(df: DataFrame, *order: str | Column, name: str = "index", first: int = 0) -> DataFrame:
    """``df`` with ``name``: the place of each row in the order, counted from ``first``.

    Spark cuts the order into ranges at sampled bounds and sorts each on its own; the numbers
    of rows in the ranges, a row each, are summed up on the driver and sent back. The sorted
    table is stored, so numbers stay the same when tasks are repeated. Equal rows of the order
    get different numbers, in no particular order among them. A column named like the new one
    is replaced; an empty table gives an empty result.
    """
    rows = df.drop(name).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(rows.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", ROW_BITS)
    sizes = sorted(tuple(r) for r in placed.groupBy(part.alias("part")).count().collect())
    before = list(accumulate((n for _, n in sizes), initial=first))
    starts = df.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before, strict=False)], "_part bigint, _before bigint")
    out = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return out.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << ROW_BITS) - 1)).drop("_part", "_before", "_at")
