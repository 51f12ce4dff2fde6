"""Joins of plates with the vehicles that hold them. Boxes share one image's coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagekit import constants as C
from passagekit.functions import geometry as G


def _candidates(plates: DataFrame, vehicles: DataFrame, key: str, share: float, centre: bool, kind: str) -> DataFrame:
    """Plates with the vehicles of their image that contain a share of them; the equal key
    keeps the range condition from becoming a nested loop."""
    p, v = G.box("p_"), G.box("v_")
    left = plates.select(key, "plate_id", *(F.col(c).alias(f"p_{c}") for c in ("x1", "y1", "x2", "y2")))
    right = vehicles.select(
        key, "vehicle_id", "vehicle_type", F.col("confidence").alias("vehicle_confidence"), *(F.col(c).alias(f"v_{c}") for c in ("x1", "y1", "x2", "y2"))
    )
    inside: Column = G.contained(p, v) >= share
    if centre:
        inside &= G.centre_in(p, v)
    return left.join(right.withColumnRenamed(key, "_key"), (F.col(key) == F.col("_key")) & inside, kind).drop("_key")


def associate(plates: DataFrame, vehicles: DataFrame, key: str = "image_id", min_confidence: float = C.VEHICLE_CONFIDENCE) -> DataFrame:
    """Plate to vehicle, or a reason why not: one row per plate.

    A single containing vehicle matches if its type is known and its confidence suffices;
    none is ``unmatched``, several are ``ambiguous``, else ``unsupported`` or
    ``low_confidence``. All plates that claim the same vehicle are ambiguous.
    """
    found = _candidates(plates, vehicles, key, C.CONTAINED, True, "left")
    one = found.groupBy(key, "plate_id").agg(
        F.count("vehicle_id").alias("n"), F.min(F.struct("vehicle_id", "vehicle_type", "vehicle_confidence")).alias("v")
    )
    status = (
        F.when(F.col("n") == 0, "unmatched")
        .when(F.col("n") > 1, "ambiguous")
        .when(F.col("v.vehicle_type") == "unknown", "unsupported")
        .when(F.col("v.vehicle_confidence") >= min_confidence, "matched")
        .otherwise("low_confidence")
    )
    claimed = F.when(status == "matched", F.col("v.vehicle_id"))
    claims = F.count("claim").over(Window.partitionBy(key, "claim"))
    judged = one.select(key, "plate_id", "v", status.alias("status"), claimed.alias("claim")).withColumn("claims", claims)
    contested = F.col("claim").isNotNull() & (F.col("claims") > 1)
    matched = F.col("claim").isNotNull() & ~contested
    return judged.select(
        key,
        "plate_id",
        F.when(contested, "ambiguous").otherwise(F.col("status")).alias("vehicle_match_status"),
        F.when(matched, F.col("claim")).alias("vehicle_id"),
        F.when(matched, F.col("v.vehicle_type")).otherwise("unknown").alias("vehicle_type"),
        F.when(matched, F.col("v.vehicle_confidence")).alias("vehicle_confidence"),
    )


def first_match(plates: DataFrame, vehicles: DataFrame, key: str = "image_id") -> DataFrame:
    """Plate to the first containing vehicle by id, with the looser share; no abstention."""
    found = _candidates(plates, vehicles, key, C.FIRST_CONTAINED, False, "inner")
    first = F.min(F.struct("vehicle_id", "vehicle_type")).alias("v")
    return found.groupBy(key, "plate_id").agg(first).select(key, "plate_id", "v.vehicle_id", "v.vehicle_type")


def without_match(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``left`` that have no partner (anti-join)."""
    return left.join(right, on, "left_anti")
