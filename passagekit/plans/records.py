"""Queries over records and labels: rules that rows have to meet, literals, boxes after a
crop or a resize, scores of classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagekit.functions import geometry as G
from passagekit.functions import text as T
from passagekit.functions import values as V
from passagekit.operators import constraints, metrics, rows, select, splits
from passagekit.plans.readings import CLEANED
from passagekit.plans.registry import query

_CORNERS = ("x1", "y1", "x2", "y2")


@query(
    " SELECT 'box' AS rule, CAST(image_id AS VARCHAR) AS key FROM fx_plate WHERE NOT (x1 >= 0 AND y1 >= 0 AND x2 <= 560 AND y2 <= 150 AND x1 < x2 AND y1 < y2)",
    "fx_plate",
)
def invalid_boxes(t):
    return constraints.invalid_boxes(t.fx_plate.withColumns({"width": F.lit(560), "height": F.lit(150)}))


@query(" SELECT DISTINCT 'orphan' AS rule, CAST(plate_id AS VARCHAR) AS key FROM fx_reading WHERE plate_id NOT IN (SELECT target_id FROM fx_truth)", "fx_reading", "fx_truth")
def orphan_keys(t):
    return constraints.orphans(t.fx_reading, t.fx_truth.withColumnRenamed("target_id", "plate_id"), "plate_id")


@query(" SELECT 'repeated' AS rule, concat(source, '|', condition) AS key FROM fx_image GROUP BY source, condition HAVING count(*) > 1", "fx_image")
def repeated_keys(t):
    return constraints.repeated(t.fx_image, "source", "condition")


@query(
    """ SELECT image_id, plate_id, arg_max(status, selection_score) = 'accepted' AND max(ocr_confidence) >= 0.95e0 AND 2 * (max(selection_score) - min(selection_score)) >= 0.15e0 AS strong
FROM fx_reading GROUP BY image_id, plate_id""",
    "fx_reading",
)
def strong_readings(t):
    score = F.col("selection_score") * 2
    views = t.fx_reading.groupBy("image_id", "plate_id").agg(
        F.sort_array(F.collect_list(F.struct(score.alias("selection_score"), F.col("proposed_text").alias("text"))), asc=False).alias("alternatives"),
        F.max_by("status", F.struct("selection_score", -F.col("ord"))).alias("status"),
        F.max("ocr_confidence").alias("confidence"),
    )
    return views.select("image_id", "plate_id", select.strong(F.col("status"), F.lit(1.0), F.col("confidence"), F.col("alternatives")).alias("strong"))


@query(
    CLEANED
    + """, s AS (SELECT a.image_id, string_agg(m.text, '' ORDER BY m.i) AS text FROM g a JOIN g b ON a.image_id = b.image_id AND a.i <= b.i
  JOIN g m ON m.image_id = a.image_id AND m.i BETWEEN a.i AND b.i GROUP BY a.image_id, a.i, b.i)
SELECT image_id, bool_or(text = CASE WHEN image_id % 2 = 0 THEN 'KA01AB' ELSE 'MH12XY' END) AS found FROM s GROUP BY 1""",
    "fx_region",
)
def literal_search(t):
    expected = F.when(F.col("image_id") % 2 == 0, "KA01AB").otherwise("MH12XY")
    return select.literal_found(select.clean_regions(t.fx_region).withColumn("expected", expected), "image_id", "expected")


@query(" SELECT image_id, string_agg(text, '' ORDER BY ord) AS text, round(avg(conf), 9) AS conf FROM fx_region GROUP BY image_id", "fx_region")
def joined_regions(t):
    parts = t.fx_region.groupBy("image_id").agg(T.naive_join(F.array_sort(F.collect_list(F.struct("ord", "text", F.col("conf").cast("double").alias("conf"))))).alias("j"))
    return parts.select("image_id", "j.text", F.round("j.conf", 9).alias("conf"))


@query(
    """, b AS (SELECT plate_id, CAST(floor(x1 + (plate_id % 10) / 1e1) AS INTEGER) AS x1, CAST(floor(y1 + (plate_id % 7) / 1e1) AS INTEGER) AS y1,
  CAST(ceil(x2 + (plate_id % 9) / 1e1) AS INTEGER) AS x2, CAST(ceil(y2 + (plate_id % 8) / 1e1) AS INTEGER) AS y2 FROM fx_plate),
p AS (SELECT *, greatest(2, CAST(round_even((x2 - x1) * 4e-2, 0) AS INTEGER)) AS dx, greatest(2, CAST(round_even((y2 - y1) * 4e-2, 0) AS INTEGER)) AS dy FROM b)
SELECT plate_id, greatest(0, x1 - dx) AS x1, greatest(0, y1 - dy) AS y1, least(600, x2 + dx) AS x2, least(240, y2 + dy) AS y2 FROM p""",
    "fx_plate",
)
def crop_boxes(t):
    moved = tuple(F.col(c) + (F.col("plate_id") % n) / 10 for c, n in zip(_CORNERS, (10, 7, 9, 8), strict=True))
    return t.fx_plate.select("plate_id", *(c.alias(n) for c, n in zip(G.crop(moved, F.lit(600), F.lit(240)), _CORNERS, strict=True)))


@query(
    """, s AS (SELECT *, least(1, 6.4e2 / (600 + plate_id % 100)) AS f FROM fx_plate)
SELECT plate_id, round(x1 * f, 9) AS x1, round(y1 * f, 9) AS y1, round(x2 * f, 9) AS x2, round(y2 * f, 9) AS y2 FROM s""",
    "fx_plate",
)
def scaled_boxes(t):
    boxes = G.scaled(F.array(F.struct(*_CORNERS)), F.lit(640.0) / (600 + F.col("plate_id") % 100))
    return t.fx_plate.select("plate_id", boxes[0].alias("b")).select("plate_id", *(F.round(f"b.{c}", 9).alias(c) for c in _CORNERS))


@query(
    """, l AS (SELECT event_id, [k % 7 / 2e0, k % 5 / 2e0, k % 3 / 2e0] AS s FROM ev),
e AS (SELECT event_id, s, list_transform(s, lambda x: exp(x - list_max(s))) AS e FROM l)
SELECT event_id, ['car', 'bus', 'truck'][list_position(s, list_max(s))] AS label, round(1 / list_sum(e), 9) AS confidence, round(e[1] / list_sum(e), 9) AS car, round(e[3] / list_sum(e), 9) AS truck FROM e""",
    "ev",
)
def softmax_labels(t):
    scores = F.array(*((F.col("k") % n / 2).cast("double") for n in (7, 5, 3)))
    best = V.softmax_top(F.array(*map(F.lit, ("car", "bus", "truck"))), scores)
    out = t.ev.select("event_id", best.alias("b"))
    return out.select("event_id", "b.label", F.round("b.confidence", 9).alias("confidence"), *(F.round(F.col("b.probs")[c], 9).alias(c) for c in ("car", "truck")))


_ENTRIES = ", e AS (SELECT image_id, list(nullif(text, 'Q1')) AS texts FROM fx_region GROUP BY image_id)"


@query(
    _ENTRIES
    + """ SELECT image_id, 'all' AS kind FROM e WHERE len(list_filter(texts, lambda x: x IS NULL OR x = '')) = 0
UNION ALL SELECT image_id, 'eligible' FROM e WHERE len(list_filter(texts, lambda x: x IS NULL)) = 0""",
    "fx_region",
)
def transcribed_images(t):
    entries = t.fx_region.groupBy("image_id").agg(F.collect_list(F.struct(F.nullif("text", F.lit("Q1")).alias("text"))).alias("boxes"))
    part = lambda empty, kind: rows.transcribed(entries, empty).select("image_id", F.lit(kind).alias("kind"))
    return part(False, "all").unionByName(part(True, "eligible"))


@query(" SELECT event_id FROM ev WHERE k % 3 = 0", "ev")
def unverified_labels(t):
    verified = F.when(F.col("k") % 3 == 0, False).when(F.col("k") % 3 == 1, True)
    return rows.unverified(t.ev.withColumn("full_image_labels_verified", verified)).select("event_id")


@query(" SELECT image_id, source FROM fx_image ORDER BY source, image_id LIMIT 25", "fx_image")
def first_rows(t):
    return rows.first_rows(t.fx_image.select("image_id", "source"), 25, "source", "image_id")


@query(
    """, v AS (SELECT image_id, unnest(['haze', 'rain', 'blur', 'lowlight']) AS condition FROM fx_image),
w AS (SELECT image_id, CASE WHEN image_id % 5 = 0 AND condition = 'rain' THEN 'haze' ELSE condition END AS condition, unnest(['mild', 'moderate', 'severe']) AS severity FROM v
  UNION ALL SELECT image_id, 'clear', 'none' FROM fx_image)
SELECT image_id AS source_id, count(*) AS rows, count(DISTINCT condition || severity) AS variants FROM w GROUP BY 1 HAVING count(*) <> 13 OR count(DISTINCT condition || severity) <> 13""",
    "fx_image",
)
def incomplete_variants(t):
    entries = splits.variants(t.fx_image.select(F.col("image_id").alias("source_id")))
    twice = F.when((F.col("source_id") % 5 == 0) & (F.col("condition") == "rain"), "haze").otherwise(F.col("condition"))
    return splits.incomplete_variants(entries.withColumn("condition", twice))


@query(
    """ SELECT ocr_source, CAST(count(*) FILTER (WHERE status = 'accepted') AS BIGINT) AS accepted, CAST(count(*) FILTER (WHERE status = 'uncertain') AS BIGINT) AS uncertain,
  CAST(0 AS BIGINT) AS unreadable FROM fx_reading GROUP BY 1""",
    "fx_reading",
)
def status_counts(t):
    return metrics.status_counts(t.fx_reading, "ocr_source")
