"""Filters, whitelists, limits and samples over images and detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagekit import constants as C
from passagekit.functions.values import seeded


def transcribed(entries: DataFrame, allow_empty: bool = False) -> DataFrame:
    """Images whose boxes all have a text; images without boxes only if allowed."""
    known = F.forall("boxes", lambda b: b["text"].isNotNull() & (F.lit(allow_empty) | (b["text"] != "")))
    return entries.where(known if allow_empty else known & (F.size("boxes") > 0))


def unverified(entries: DataFrame, column: str = "full_image_labels_verified") -> DataFrame:
    """Rows marked as not verified; unmarked ones (null) are not among them."""
    return entries.where(F.col(column).eqNullSafe(F.lit(False)))


def whitelisted_vehicles(detections: DataFrame, key: str = "image_id", ord_col: str = "ord") -> DataFrame:
    """Detections of known vehicle types (``other`` counts as ``unknown``) of enough
    confidence, numbered from 1 within their image in the detector's order."""
    kept = detections.where(F.col("vehicle_type").isin(*C.VEHICLE_TYPES) & (F.col("confidence") >= C.VEHICLE_DETECTION))
    number = F.row_number().over(Window.partitionBy(key).orderBy(ord_col))
    kind = F.when(F.col("vehicle_type") == "other", "unknown").otherwise(F.col("vehicle_type"))
    return kept.withColumns({"vehicle_id": number, "vehicle_type": kind})


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def fixed_sample(df: DataFrame, n: int, key: str, seed: int = C.SEED) -> DataFrame:
    """A sample of n rows without replacement that is the same for the same keys."""
    return df.withColumn("_order", seeded(seed, F.col(key))).orderBy("_order", key).limit(n).drop("_order")
