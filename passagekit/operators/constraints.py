"""Rules that records have to meet, each as a table of what breaks it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagekit.functions import geometry as G
from passagekit.operators.splits import incomplete_variants, split_violations


def invalid_boxes(boxes: DataFrame, key: str = "image_id") -> DataFrame:
    """``(rule, key)`` of boxes that are not finite, inside ``width`` and ``height``, and of
    positive area."""
    good = G.valid(G.box(), F.col("width"), F.col("height"))
    return boxes.where(~good).select(F.lit("box").alias("rule"), F.col(key).cast("string").alias("key"))


def repeated(df: DataFrame, *columns: str) -> DataFrame:
    """Keys that stand more than once."""
    key = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated").alias("rule"), "key")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Keys of children without a parent."""
    return child.join(parent, key, "left_anti").select(F.lit("orphan").alias("rule"), F.col(key).cast("string").alias("key")).distinct()


def entry_violations(entries: DataFrame) -> DataFrame:
    """All rules on a manifest's rows: paths once each, splits that leak nothing."""
    return repeated(entries, "image_path").unionByName(split_violations(entries))


def variant_violations(entries: DataFrame) -> DataFrame:
    return incomplete_variants(entries).select(F.lit("variants").alias("rule"), F.col("source_id").alias("key"))


def require_none(violations: DataFrame, what: str = "rules") -> None:
    """Raises with the first few violations, if there are any."""
    bad = violations.limit(10).collect()
    if bad:
        raise ValueError(f"{what} violated: {[tuple(r) for r in bad]}")
