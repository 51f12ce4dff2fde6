"""Queries over streams of frames, sorted orders and sources of our own."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagekit.operators.ordering import numbered
from passagekit.plans.registry import query
from passagekit.plans.shared import shared_dir
from passagekit.sources import detections
from passagekit.streaming import tracks

#: Silence that ends a passage, and how late a frame may be.
GAP, LATE = 30 * 60_000, 10 * 60_000


@query(
    """, x AS (SELECT track_id, epoch_us(ts) // 1000 AS ms, frame_idx, sharpness FROM fx_frame WHERE ts IS NOT NULL AND track_id IS NOT NULL AND sharpness IS NOT NULL),
fresh AS (SELECT *, coalesce(ms - lag(ms) OVER w > 1800000, true) AS fresh FROM x WINDOW w AS (PARTITION BY track_id ORDER BY ms, frame_idx)),
runs AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY track_id ORDER BY ms, frame_idx) AS no FROM fresh),
spans AS (SELECT *, min(ms) OVER w AS first_ms, max(ms) OVER w AS last_ms, count(*) OVER w AS frames, row_number() OVER (PARTITION BY track_id, no ORDER BY sharpness DESC, frame_idx) AS sharpest
  FROM runs WINDOW w AS (PARTITION BY track_id, no))
SELECT track_id, first_ms, last_ms, frames, CAST(sharpest AS INT) AS sharpest, frame_idx, sharpness FROM spans
WHERE sharpest <= 5 AND last_ms + 1800000 < (SELECT max(ms) FROM x) - 600000""",
    "fx_frame",
)
def streamed_passages(t):
    return tracks.closed_passages(t.fx_frame, GAP, LATE)


@query("SELECT doc_id, concat(source, '/', lang, '_', doc_id) AS path, row_number() OVER (ORDER BY concat(source, '/', lang, '_', doc_id), doc_id) - 1 AS index FROM documents")
def dense_index(t):
    path = F.concat("source", F.lit("/"), "lang", F.lit("_"), F.col("doc_id").cast("string"))
    return numbered(t.documents.select("doc_id", path.alias("path")), "path", "doc_id")


_CLASSES = ("unknown", "bus", "truck", "motorcycle", "car")


@query(
    """, c AS (SELECT *, list_position(['unknown', 'bus', 'truck', 'motorcycle', 'car'], vehicle_type) - 1 AS class FROM fx_vehicle)
SELECT image_id AS image, vehicle_id AS box, CAST(class AS INTEGER) AS class, CAST(printf('%.9f', (x1+x2)/12e2) AS DOUBLE) AS xc, CAST(printf('%.9f', (y1+y2)/4.8e2) AS DOUBLE) AS yc,
  CAST(printf('%.9f', (x2-x1)/6e2) AS DOUBLE) AS w, CAST(printf('%.9f', (y2-y1)/2.4e2) AS DOUBLE) AS h, confidence FROM c WHERE class IN (1, 2, 4) AND confidence >= 0.35""",
    "fx_vehicle",
)
def pushed_detections(t):
    label = F.array_position(F.array(*map(F.lit, _CLASSES)), F.col("vehicle_type")) - 1
    boxes = t.fx_vehicle.withColumnsRenamed({"image_id": "image", "vehicle_id": "box"}).withColumn("class", label)
    path = shared_dir(t.spark)
    detections.write(boxes, path, F.lit(600), F.lit(240))
    return detections.scan(t.spark, path, classes=(1, 2, 4), confidence=0.35)
