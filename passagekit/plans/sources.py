"""Queries over annotations under a policy of reviewed decisions, and over saved reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagekit.operators import curation
from passagekit.plans.registry import query
from passagekit.plans.shared import shared_dir
from passagekit.sources import reports

#: Annotations made of plates, each with its own kind of flaw now and then.
_NOTES = """, n AS (SELECT plate_id AS i, concat('set', plate_id % 3, '/N', plate_id, '.xml') AS annotation, concat('set', plate_id % 3, '/n', plate_id, '.JPG') AS image,
  CASE plate_id % 10 WHEN 0 THEN concat('old/m', plate_id, '.jpg') WHEN 1 THEN NULL ELSE concat('a/n', plate_id, '.JPG') END AS filename, CASE WHEN plate_id % 37 = 0 THEN 601 ELSE 600 END AS width,
  plate_id % 19 <> 0 AS there, x1, y1, CASE WHEN plate_id % 43 = 0 THEN 700 ELSE x2 END AS x2, y2 FROM fx_plate),
u AS (SELECT *, there AND (i % 10 > 1 OR i % 31 <> 0) AS found, i % 10 = 0 AS misnamed FROM n),
o AS (SELECT u.*, j, CASE (i + j * 5) % 17 WHEN 0 THEN 'blur!' WHEN 1 THEN 'hand-written' WHEN 2 THEN 'X' WHEN 3 THEN '' ELSE concat('ka01 AB', lpad(CAST(i % 10000 AS VARCHAR), 4, '0')) END AS raw_text,
  j = 1 AND i % 41 = 0 AS unboxed FROM u, (SELECT unnest([0, 1]) AS j) WHERE found AND i % 29 <> 0 AND j <= 1 - i % 2),
b AS (SELECT *, (i + j * 5) % 17 AS k FROM o)"""


def _notes(t):
    """``(annotations, images, policy)`` of the same flaws."""
    p = t.fx_plate.withColumnRenamed("plate_id", "i")
    label = (
        "CASE (i + {j} * 5) % 17 WHEN 0 THEN 'blur!' WHEN 1 THEN 'hand-written' WHEN 2 THEN 'X' WHEN 3 THEN NULL ELSE concat('ka01 AB', lpad(cast(i % 10000 AS string), 4, '0')) END"
    )
    box = "named_struct('xmin', cast(x1 AS double), 'ymin', cast(y1 AS double), 'xmax', cast(if(i % 43 = 0, 700, x2) AS double), 'ymax', cast(y2 AS double))"
    first, second = (f"named_struct('name', {label.format(j=j)}, 'bndbox', if({j} = 1 AND i % 41 = 0, NULL, {box}))" for j in (0, 1))
    annotations = p.selectExpr(
        "concat('set', i % 3, '/N', i, '.xml') AS annotation", "CASE i % 10 WHEN 0 THEN concat('old/m', i, '.jpg') WHEN 1 THEN NULL ELSE concat('a/n', i, '.JPG') END AS filename",
        "if(i % 37 = 0, 601, 600) AS width", "240 AS height", f"CASE WHEN i % 29 = 0 THEN array() WHEN i % 2 = 0 THEN array({first}, {second}) ELSE array({first}) END AS objects",
    )
    images = p.selectExpr(
        "explode(filter(array(if(i % 19 <> 0, concat('set', i % 3, '/n', i, '.JPG'), NULL), if(i % 31 = 0 AND i % 19 <> 0, concat('set', i % 3, '/n', i, '.png'), NULL),"
        " if(i % 23 = 0, concat('set', i % 3, '/z', i, '.png'), NULL)), x -> x IS NOT NULL)) AS image", "600 AS width", "240 AS height",
    )
    note = "concat('set', i % 3, '/N', i, '.xml')"
    made = [
        ("i % 38 = 0", ("'missing_image'", note, "'gone'")),
        ("i % 20 = 0", ("'filename_repair'", note, "concat('n', i, '.JPG')")),
        ("i % 30 = 10", ("'filename_repair'", note, "concat('n', i, '.JPG', if(i % 20 = 0, '', 'x'))")),
        ("i % 74 = 0", ("'dimension_repair'", note, "'601x240>600x240'")),
        ("i % 46 = 0", ("'unannotated_image'", "concat('set', i % 3, '/z', i, '.png')", "''")),
    ]
    policy = t.spark.createDataFrame(
        [("exclude_label", "BLUR", "unreadable"), ("detection_only", "HANDWRITTEN", "not_transcribed"), ("identity_alias", "KA01AB0003", "KA01AB0004")], "rule string, key string, value string"
    )
    for condition, columns in made:
        policy = policy.unionByName(p.where(condition).selectExpr(*(f"{c} AS {n}" for c, n in zip(columns, ("rule", "key", "value"), strict=True))))
    return annotations, images, policy


@query(
    _NOTES
    + """, lone AS (SELECT image, i % 46 = 0 AND z AS reviewed FROM (SELECT i, concat('set', i % 3, '/z', i, '.png') AS image, true AS z FROM n WHERE i % 23 = 0
    UNION ALL SELECT i, concat('set', i % 3, '/n', i, '.png'), false FROM n WHERE i % 31 = 0 AND i % 19 <> 0
    UNION ALL SELECT i, image, false FROM u WHERE there AND NOT found)),
f AS (
  SELECT 'violation' AS kind, 'ambiguous_image' AS rule, annotation AS key, '' AS detail FROM u WHERE there AND NOT found
  UNION ALL SELECT 'violation', 'missing_image', annotation, '' FROM u WHERE NOT there AND i % 38 <> 0
  UNION ALL SELECT 'violation', 'filename', annotation, '' FROM u WHERE found AND (i % 10 = 1 OR misnamed AND i % 20 <> 0)
  UNION ALL SELECT 'violation', 'dimensions', annotation, '' FROM u WHERE found AND width = 601 AND i % 74 <> 0
  UNION ALL SELECT 'violation', 'empty_annotation', annotation, '' FROM u WHERE found AND i % 29 = 0
  UNION ALL SELECT 'violation', 'missing_box', annotation, '' FROM b WHERE unboxed
  UNION ALL SELECT 'violation', 'box', annotation, '' FROM b WHERE NOT unboxed AND NOT (x1 >= 0 AND y1 >= 0 AND x2 <= 600 AND y2 <= 240 AND x1 < x2 AND y1 < y2)
  UNION ALL SELECT 'violation', 'label', annotation, '' FROM b WHERE k IN (2, 3)
  UNION ALL SELECT 'violation', 'unannotated_image', image, '' FROM lone WHERE NOT reviewed
  UNION ALL SELECT 'exclusion', 'annotation', annotation, 'missing_source_image' FROM u WHERE NOT there AND i % 38 = 0
  UNION ALL SELECT 'exclusion', 'annotation', annotation, 'unreadable' FROM b WHERE k = 0
  UNION ALL SELECT 'exclusion', 'image', image, 'alternate_encoding_without_separate_annotation' FROM lone WHERE reviewed
  UNION ALL SELECT 'repair', 'filename', annotation, concat(filename, '>n', i, '.JPG') FROM u WHERE found AND i % 20 = 0
  UNION ALL SELECT 'repair', 'dimensions', annotation, '601x240>600x240' FROM u WHERE found AND i % 74 = 0)
SELECT DISTINCT * FROM f""",
    "fx_plate",
)
def annotation_findings(t):
    found = curation.inspect(*_notes(t))
    none = F.lit("").alias("detail")
    return (
        found["violations"].select(F.lit("violation").alias("kind"), "rule", "key", none)
        .unionByName(found["exclusions"].select(F.lit("exclusion").alias("kind"), F.col("kind").alias("rule"), "key", F.col("reason").alias("detail")))
        .unionByName(found["repairs"].select(F.lit("repair").alias("kind"), F.col("kind").alias("rule"), F.col("annotation").alias("key"), F.concat_ws(">", "original", "corrected").alias("detail")))
    )


@query(
    _NOTES
    + """, c AS (SELECT *, upper(regexp_replace(raw_text, '[^A-Za-z0-9]', '', 'g')) AS cleaned FROM b WHERE i NOT IN (SELECT i FROM b WHERE k = 0))
SELECT annotation, image, CAST(j AS INTEGER) AS ord, CASE WHEN NOT unboxed THEN CAST(x1 AS DOUBLE) END AS xmin, CASE WHEN NOT unboxed THEN CAST(y1 AS DOUBLE) END AS ymin, CASE WHEN NOT unboxed THEN CAST(x2 AS DOUBLE) END AS xmax,
  CASE WHEN NOT unboxed THEN CAST(y2 AS DOUBLE) END AS ymax, raw_text, CASE WHEN k > 3 THEN cleaned END AS text, CASE WHEN k > 3 THEN 'transcribed' WHEN k = 1 THEN 'detection_only' END AS text_status,
  CASE WHEN k = 1 THEN 'not_transcribed' END AS reason, CASE cleaned WHEN 'KA01AB0003' THEN 'KA01AB0004' ELSE cleaned END AS leakage_identity FROM c""",
    "fx_plate",
)
def annotated_boxes(t):
    return curation.inspect(*_notes(t))["boxes"]


@query(
    """, r AS (SELECT concat('c', plate_id % 4) AS condition, plate_id AS i FROM fx_plate),
c AS (SELECT condition, 'detected' AS counter, i % 3 AS n FROM r UNION ALL SELECT condition, 'accepted', i % 2 FROM r
  UNION ALL SELECT condition, 'missed', i % 5 FROM r WHERE i % 2 = 1 UNION ALL SELECT condition, concat('kind_', i % 7), 1 FROM r WHERE i % 2 = 0)
SELECT condition, counter, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY ALL""",
    "fx_plate",
)
def report_counters(t):
    flat = "to_json(named_struct('condition', concat('c', i % 4), 'counts', map('detected', i % 3, 'accepted', i % 2, concat('kind_', i % 7), 1)))"
    nested = "to_json(named_struct('run', named_struct('condition', concat('c', i % 4)), 'result', named_struct('counts', named_struct('missed', i % 5, 'accepted', i % 2, 'detected', i % 3))))"
    path = shared_dir(t.spark)
    t.fx_plate.withColumnRenamed("plate_id", "i").selectExpr(f"CASE WHEN i % 2 = 0 THEN {flat} ELSE {nested} END AS value").write.text(path)
    saved = reports.read(t.spark, path)
    condition = reports.part(["$.condition", "$.run.condition"], "string")
    return reports.counters(saved.withColumn("condition", condition), ["$.counts", "$.result.counts"], "condition")
