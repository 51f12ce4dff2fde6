"""Queries over boxes and readings: association, selection, fusion, matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagekit import constants as C
from passagekit.functions import geometry as G
from passagekit.functions import text as T
from passagekit.functions import values as V
from passagekit.operators import associate, fuse, matching, select
from passagekit.plans.registry import query

_INTER = "greatest(0, least(p.x2, v.x2) - greatest(p.x1, v.x1)) * greatest(0, least(p.y2, v.y2) - greatest(p.y1, v.y1))"
_IOU = "({0}) / greatest(CAST((p.x2-p.x1)*(p.y2-p.y1) + (v.x2-v.x1)*(v.y2-v.y1) - ({0}) AS DOUBLE), 1e-12)".format(_INTER)


@query(
    f""", cand AS (
  SELECT p.image_id, p.plate_id, v.vehicle_id, v.vehicle_type, v.confidence AS vc FROM fx_plate p LEFT JOIN fx_vehicle v ON p.image_id = v.image_id
    AND ({_INTER}) / CAST((p.x2-p.x1)*(p.y2-p.y1) AS DOUBLE) >= 0.9 AND (p.x1+p.x2)/2e0 BETWEEN v.x1 AND v.x2 AND (p.y1+p.y2)/2e0 BETWEEN v.y1 AND v.y2),
one AS (SELECT image_id, plate_id, count(vehicle_id) AS n, min(vehicle_id) AS vid, min(vehicle_type) AS vt, min(vc) AS vc FROM cand GROUP BY ALL),
judged AS (SELECT *, CASE WHEN n = 0 THEN 'unmatched' WHEN n > 1 THEN 'ambiguous' WHEN vt = 'unknown' THEN 'unsupported' WHEN vc >= 0.5 THEN 'matched' ELSE 'low_confidence' END AS s FROM one),
claims AS (SELECT *, CASE WHEN s = 'matched' THEN count(*) FILTER (WHERE s = 'matched') OVER (PARTITION BY image_id, vid) END AS c FROM judged)
SELECT image_id, plate_id, CASE WHEN c > 1 THEN 'ambiguous' ELSE s END AS vehicle_match_status, CASE WHEN c = 1 THEN vid END AS vehicle_id,
  CASE WHEN c = 1 THEN vt ELSE 'unknown' END AS vehicle_type, CASE WHEN c = 1 THEN vc END AS vehicle_confidence FROM claims""",
    "fx_plate", "fx_vehicle",
)
def assoc_vehicle_plate(t):
    return associate.associate(t.fx_plate, t.fx_vehicle)


@query(
    f""" SELECT p.image_id, p.plate_id, min(v.vehicle_id) AS vehicle_id, arg_min(v.vehicle_type, v.vehicle_id) AS vehicle_type FROM fx_plate p JOIN fx_vehicle v
  ON p.image_id = v.image_id AND ({_INTER}) / CAST((p.x2-p.x1)*(p.y2-p.y1) AS DOUBLE) >= 0.85 GROUP BY 1, 2""",
    "fx_plate", "fx_vehicle",
)
def first_match_assoc(t):
    return associate.first_match(t.fx_plate, t.fx_vehicle)


@query(" SELECT image_id, plate_id FROM fx_plate WHERE plate_id NOT IN (SELECT target_id FROM fx_truth)", "fx_plate", "fx_truth")
def anti_unmatched(t):
    return associate.without_match(t.fx_plate.select("image_id", "plate_id"), t.fx_truth.withColumnRenamed("target_id", "plate_id"), ["image_id", "plate_id"])


@query(f" SELECT v.image_id, v.target_id, p.plate_id, round({_IOU}, 9) AS iou FROM fx_truth v JOIN fx_plate p USING (image_id) WHERE {_IOU} >= 0.5", "fx_truth", "fx_plate")
def iou_edges(t):
    return matching.iou_edges(t.fx_truth, t.fx_plate).withColumn("iou", F.round("iou", 9))


@query(
    """, d AS (SELECT image_id, {'id': plate_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2} AS b, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, plate_id) AS i FROM fx_plate),
walk AS (
  SELECT image_id, 0 AS i, CAST([] AS STRUCT(id BIGINT, x1 INTEGER, y1 INTEGER, x2 INTEGER, y2 INTEGER)[]) AS kept FROM (SELECT DISTINCT image_id FROM fx_plate)
  UNION ALL
  SELECT w.image_id, w.i + 1, CASE WHEN len(list_filter(w.kept, lambda k:
      (greatest(0, least(k.x2, d.b.x2) - greatest(k.x1, d.b.x1)) * greatest(0, least(k.y2, d.b.y2) - greatest(k.y1, d.b.y1)))
      / CAST((k.x2-k.x1)*(k.y2-k.y1) + (d.b.x2-d.b.x1)*(d.b.y2-d.b.y1) - greatest(0, least(k.x2, d.b.x2) - greatest(k.x1, d.b.x1)) * greatest(0, least(k.y2, d.b.y2) - greatest(k.y1, d.b.y1)) AS DOUBLE) >= 0.5)) > 0
    THEN w.kept ELSE list_append(w.kept, d.b) END
  FROM walk w JOIN d ON d.image_id = w.image_id AND d.i = w.i + 1)
SELECT image_id, unnest(list_transform(arg_max(kept, i), lambda k: k.id)) AS plate_id FROM walk GROUP BY image_id""",
    "fx_plate",
)
def nms_greedy(t):
    return matching.suppress(t.fx_plate)


@query()
def max_matching(t):
    return matching.match_boxes(t.fx_truth, t.fx_plate)


@query(
    """, r AS (SELECT image_id, event_id AS ord, slot, CASE WHEN k % 3 = 0 THEN 'car' ELSE 'bus' END AS label, k / 1e2 AS confidence,
  (k*7 + slot*3) % 200 AS x1, k % 50 AS y1, (k*7 + slot*3) % 200 + 60 AS x2, k % 50 + 60 AS y2 FROM ev),
pairs AS (SELECT p.image_id, p.label, p.ord, p.confidence, v.ord AS t, """
    + _IOU
    + """ AS iou FROM r p JOIN r v ON p.image_id = v.image_id AND p.label = v.label AND p.slot < 3 AND v.slot >= 3),
turns AS (SELECT image_id, label, row_number() OVER (PARTITION BY image_id, label ORDER BY confidence DESC, ord) AS i, c FROM
  (SELECT image_id, label, ord, confidence, list(t ORDER BY iou DESC, t DESC) AS c FROM pairs WHERE iou >= 0.5 GROUP BY ALL)),
walk AS (
  SELECT DISTINCT image_id, label, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS taken FROM turns
  UNION ALL
  SELECT w.image_id, w.label, t.i, list_concat(w.taken, list_filter(t.c, lambda x: NOT list_contains(w.taken, x))[1:1])
  FROM walk w JOIN turns t ON t.image_id = w.image_id AND t.label = w.label AND t.i = w.i + 1),
hits AS (SELECT image_id, label, len(arg_max(taken, i)) AS tp FROM walk GROUP BY 1, 2)
SELECT image_id, label, CAST(coalesce(tp, 0) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE slot < 3) - coalesce(tp, 0) AS BIGINT) AS fp,
  CAST(count(*) FILTER (WHERE slot >= 3) - coalesce(tp, 0) AS BIGINT) AS fn FROM r LEFT JOIN hits USING (image_id, label) GROUP BY image_id, label, tp""",
    "ev",
)
def greedy_class_match(t):
    label = F.when(F.col("k") % 3 == 0, "car").otherwise("bus")
    box = [((F.col("k") * 7 + F.col("slot") * 3) % 200).alias("x1"), (F.col("k") % 50).alias("y1"), ((F.col("k") * 7 + F.col("slot") * 3) % 200 + 60).alias("x2"), (F.col("k") % 50 + 60).alias("y2")]
    rows = t.ev.select("image_id", F.col("event_id").alias("ord"), label.alias("label"), (F.col("k") / 100).alias("confidence"), "slot", *box)
    return matching.match_by_class(rows.where("slot < 3").drop("slot"), rows.where("slot >= 3").drop("slot", "confidence"))


@query(
    """ SELECT t.target_id, round(CASE WHEN length(t.text) > 0 THEN greatest(0, 1 - levenshtein(t.text, r.proposed_text) / CAST(greatest(length(t.text), length(r.proposed_text)) AS DOUBLE)) ELSE 0 END, 9) AS char_accuracy,
  CAST(hamming(t.text, r.proposed_text) AS INTEGER) AS differences, contains(t.text, r.proposed_text) OR contains(r.proposed_text, t.text) AS overlapping, r.ord
FROM fx_truth t JOIN fx_reading r ON r.plate_id = t.target_id""",
    "fx_truth", "fx_reading",
)
def levenshtein_accuracy(t):
    pairs = t.fx_truth.join(t.fx_reading.drop("image_id"), F.col("plate_id") == F.col("target_id"))
    a, b = F.col("text"), F.col("proposed_text")
    return pairs.select("target_id", F.round(T.char_accuracy(a, b), 9).alias("char_accuracy"), T.hamming(a, b).alias("differences"), T.overlaps(a, b).alias("overlapping"), "ord")


@query(
    """ SELECT CAST(ord AS INTEGER) AS ord, count(*) AS n, CAST(sum(CASE WHEN t.text = r.proposed_text THEN 1 ELSE 0 END) AS BIGINT) AS exact,
  round(avg(1 - levenshtein(t.text, r.proposed_text) / CAST(length(t.text) AS DOUBLE)), 6) AS mean_accuracy FROM fx_truth t JOIN fx_reading r ON r.plate_id = t.target_id GROUP BY ord""",
    "fx_truth", "fx_reading",
)
def accuracy_by_variant(t):
    pairs = t.fx_truth.join(t.fx_reading.drop("image_id"), F.col("plate_id") == F.col("target_id"))
    exact = F.count_if(F.col("text") == F.col("proposed_text"))
    return pairs.groupBy("ord").agg(F.count("*").alias("n"), exact.alias("exact"), F.round(F.avg(T.char_accuracy(F.col("text"), F.col("proposed_text"))), 6).alias("mean_accuracy"))


@query(
    """ SELECT plate_id, round((x1+x2)/2e0/600, 9) AS xc, round((y1+y2)/2e0/240, 9) AS yc, round((x2-x1)/6e2, 9) AS w, round((y2-y1)/2.4e2, 9) AS h,
  printf('%d %.6f %.6f %.6f %.6f', 0, (x1+x2)/2e0/600, (y1+y2)/2e0/240, (x2-x1)/6e2, (y2-y1)/2.4e2) AS line FROM fx_plate""",
    "fx_plate",
)
def yolo_normalize(t):
    from passagekit.sources.writers import label_line

    w, h = F.lit(600), F.lit(240)
    xc, yc, bw, bh = G.normalised(G.box(), w, h)
    return t.fx_plate.select("plate_id", *(F.round(c, 9).alias(n) for c, n in ((xc, "xc"), (yc, "yc"), (bw, "w"), (bh, "h"))), label_line(G.box(), w, h).alias("line"))


@query(
    """, p AS (SELECT *, greatest(2, CAST(round_even((x2-x1)*4e-2, 0) AS INTEGER)) AS dx, greatest(2, CAST(round_even((y2-y1)*4e-2, 0) AS INTEGER)) AS dy FROM fx_plate)
SELECT plate_id, greatest(0, x1-dx) AS x1, greatest(0, y1-dy) AS y1, least(600, x2+dx) AS x2, least(240, y2+dy) AS y2 FROM p""",
    "fx_plate",
)
def pad_box(t):
    return t.fx_plate.select("plate_id", *(c.alias(n) for c, n in zip(G.padded(G.box(), F.lit(600), F.lit(240)), ("x1", "y1", "x2", "y2"), strict=True)))


@query(
    """ SELECT image_id, plate_id, ord, CASE WHEN status = 'accepted' AND ocr_confidence < 0.9 THEN 'uncertain' ELSE status END AS status,
  CASE WHEN status = 'accepted' AND ocr_confidence >= 0.9 THEN proposed_text ELSE '' END AS plate_text, proposed_text,
  CASE WHEN status = 'accepted' AND ocr_confidence < 0.9 THEN 'low_final_ocr_confidence' END AS review_reason FROM fx_reading""",
    "fx_reading",
)
def acceptance_gate(t):
    rows = t.fx_reading.withColumn("plate_text", F.when(F.col("status") == "accepted", F.col("proposed_text")).otherwise(""))
    return select.acceptance_gate(rows).select("image_id", "plate_id", "ord", "status", "plate_text", "proposed_text", "review_reason")


@query(
    """, r AS (SELECT *, row_number() OVER (PARTITION BY image_id, plate_id ORDER BY selection_score DESC, ord) AS i FROM fx_reading),
b AS (SELECT * FROM r WHERE i = 1),
rival AS (SELECT r.image_id, r.plate_id, max(r.selection_score) AS s FROM r JOIN b USING (image_id, plate_id) WHERE r.i > 1 AND r.proposed_text <> b.proposed_text GROUP BY 1, 2)
SELECT image_id, plate_id, CAST(ord AS INTEGER) AS ord, proposed_text, CASE WHEN b.selection_score - s < 0.08 THEN 'uncertain' ELSE status END AS status,
  CASE WHEN status = 'accepted' AND NOT coalesce(b.selection_score - s < 0.08, false) THEN proposed_text ELSE '' END AS plate_text,
  CASE WHEN b.selection_score - s < 0.08 THEN 'conflicting_image_views' END AS review_reason, round(b.selection_score, 9) AS selection_score, ocr_confidence
FROM b LEFT JOIN rival USING (image_id, plate_id)""",
    "fx_reading",
)
def choose_reading(t):
    return select.choose_reading(t.fx_reading, ["image_id", "plate_id"]).withColumn("selection_score", F.round("selection_score", 9))


CLEANED = """, c AS (SELECT image_id, ord, least(1, greatest(0, conf)) AS conf, regexp_replace(upper(text), '[^A-Z0-9]', '', 'g') AS text FROM fx_region),
g AS (SELECT image_id, text, conf, row_number() OVER (PARTITION BY image_id ORDER BY ord) - 1 AS i FROM c WHERE text NOT IN ('', 'IND'))"""


@query(
    CLEANED
    + """, n AS (SELECT image_id, count(*) AS n, sum(CASE WHEN length(text) <= 4 THEN 1 ELSE 0 END) AS short FROM g GROUP BY 1),
s AS (SELECT a.image_id, a.i AS start, b.i + 1 AS stop, string_agg(m.text, '' ORDER BY m.i) AS text, min(m.conf) AS confidence, sum(CASE WHEN length(m.text) <= 4 THEN 1 ELSE 0 END) AS own
  FROM g a JOIN g b ON a.image_id = b.image_id AND a.i <= b.i JOIN g m ON m.image_id = a.image_id AND m.i BETWEEN a.i AND b.i GROUP BY 1, 2, 3)
SELECT image_id, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, text, confidence, round(8e-2 * (short - own), 9) AS penalty FROM s JOIN n USING (image_id) WHERE length(text) <= 14""",
    "fx_region",
)
def span_enumeration(t):
    regions = select.clean_regions(t.fx_region.drop("x1", "y1", "x2", "y2"))
    return select.spans(regions, "image_id").withColumn("penalty", F.round("penalty", 9))


#: Places of the regions of ``fx_region`` in reading order.
_PLACED = """, b AS (SELECT image_id, {'x1': x1, 'y1': y1, 'y2': y2, 'i': region_id} AS b, row_number() OVER (PARTITION BY image_id ORDER BY (y1 + y2) / 2, ord) AS i FROM fx_region),
walk AS (
  SELECT DISTINCT image_id, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(n INTEGER, t DOUBLE, b DOUBLE, top DOUBLE, m STRUCT(x DOUBLE, i BIGINT, r BIGINT)[])[]) AS l FROM fx_region
  UNION ALL
  SELECT image_id, i, CASE WHEN coalesce(list_max(o), 0) >= 0.5
    THEN list_transform(l, lambda x, j: CASE WHEN j = list_position(o, list_max(o))
      THEN {'n': x.n + 1, 't': x.t + b.y1, 'b': x.b + b.y2, 'top': least(x.top, b.y1), 'm': list_append(x.m, {'x': b.x1, 'i': i, 'r': b.i})} ELSE x END)
    ELSE list_append(l, {'n': 1, 't': b.y1, 'b': b.y2, 'top': b.y1, 'm': [{'x': b.x1, 'i': i, 'r': b.i}]}) END
  FROM (SELECT w.image_id, b.i, w.l, b.b, list_transform(w.l, lambda x: greatest(0, least(x.b / x.n, b.b.y2) - greatest(x.t / x.n, b.b.y1)) / greatest(1, least(x.b / x.n - x.t / x.n, b.b.y2 - b.b.y1))) AS o
    FROM walk w JOIN b ON b.image_id = w.image_id AND b.i = w.i + 1)),
lines AS (SELECT image_id, unnest(l) AS x, generate_subscripts(l, 1) AS line FROM (SELECT image_id, arg_max(l, i) AS l FROM walk GROUP BY 1)),
m AS (SELECT image_id, x.top AS top, line, unnest(x.m) AS m FROM lines),
placed AS (SELECT m.r AS region_id, row_number() OVER (PARTITION BY image_id ORDER BY top, line, m.x, m.i) - 1 AS place FROM m)"""


@query(_PLACED + "\nSELECT f.* REPLACE (CAST(place AS INTEGER) AS ord) FROM fx_region f JOIN placed USING (region_id)", "fx_region")
def ordered_regions(t):
    return select.order_regions(t.fx_region, "image_id")


# Fixed values, written out here on their own: templates with their scores, letters read for
# digits, and the layout that a person has to review.
_LAYOUT = "^[A-Z]{2}([0-9]{1,2}[A-Z]{1,3}[0-9]{1,4}|[0-9]{3,6})$"
_FITS = (
    r"""p(template, base) AS (VALUES ('LLDDLDDDD', 1e0), ('LLDDLLDDDD', 1e0), ('LLDLDDDD', 1e0), ('LLDLLDDDD', 1e0), ('LLDDDDDD', 0.7e0), ('LLDDLDDD', 1e0)),
swapped(letter, digit) AS (VALUES ('O', '0'), ('I', '1'), ('Z', '2'), ('S', '5'), ('B', '8'), ('G', '6'), ('Q', '0'), ('D', '0'), ('T', '7')),
c AS (SELECT chr(CAST(i AS INTEGER)) AS have, 'L' AS due, chr(CAST(i AS INTEGER)) AS may FROM range(65, 91) r(i) UNION ALL SELECT CAST(i AS VARCHAR), 'D', CAST(i AS VARCHAR) FROM range(0, 10) r(i)
  UNION ALL SELECT letter, 'D', digit FROM swapped UNION ALL SELECT digit, 'L', letter FROM swapped),
made AS (
  SELECT text, template, base, 0 AS i, '' AS proposal FROM t JOIN p ON length(text) = length(template)
  UNION ALL SELECT text, template, base, i + 1, proposal || may FROM made JOIN c ON have = substring(text, i + 1, 1) AND due = substring(template, i + 1, 1)),
scored AS (SELECT text, proposal, greatest(0, base - 0.08e0 * len(list_filter(range(1, length(text) + 1), lambda j: regexp_matches(substring(text, j, 1), '[A-Z]') <> (substring(template, j, 1) = 'L')))) AS score
  FROM made WHERE i = length(text) UNION ALL SELECT text, text, 0.7e0 FROM t WHERE regexp_matches(text, '@layout')),
best AS (SELECT text, proposal, max(score) AS score FROM scored GROUP BY 1, 2),
own AS (SELECT text, score AS own FROM best WHERE proposal = text AND regexp_matches(text, '@layout')),
fits AS (SELECT text, proposal, CASE WHEN own IS NULL OR proposal = text THEN score ELSE least(score, greatest(0, own - 0.08e0)) END AS score FROM best LEFT JOIN own USING (text))"""
).replace("@layout", _LAYOUT)


@query(
    """, cl AS (SELECT image_id, region_id, ord, regexp_replace(upper(text), '[^A-Z0-9]', '', 'g') AS text, least(1, greatest(0, conf)) AS conf, x1, y1, x2, y2 FROM fx_region
  WHERE regexp_replace(upper(text), '[^A-Z0-9]', '', 'g') NOT IN ('', 'IND'))"""
    + _PLACED.replace("fx_region", "cl")
    + """, g AS (SELECT image_id, text, conf, place AS i FROM cl JOIN placed USING (region_id)),
whole AS (SELECT image_id, string_agg(text, '' ORDER BY i) AS literal, min(conf) AS least, count(*) FILTER (WHERE length(text) <= 4) AS short FROM g GROUP BY 1),
s AS (SELECT a.image_id, a.i * 1000000000 + z.i AS o, string_agg(m.text, '' ORDER BY m.i) AS text, min(m.conf) AS conf, count(*) FILTER (WHERE length(m.text) <= 4) AS own
  FROM g a JOIN g z ON a.image_id = z.image_id AND a.i <= z.i JOIN g m ON m.image_id = a.image_id AND m.i BETWEEN a.i AND z.i GROUP BY a.image_id, a.i, z.i),
span AS (SELECT image_id, o, text, conf, 0.08e0 * (short - own) AS penalty FROM s JOIN whole USING (image_id) WHERE length(text) <= 14),
t AS (SELECT DISTINCT text FROM span),
"""
    + _FITS
    + """, l AS (SELECT image_id, text, min(o) AS first, arg_max({'c': conf, 'p': penalty}, (conf - penalty, -o)) AS e FROM span WHERE regexp_matches(text, '"""
    + _LAYOUT
    + """') GROUP BY 1, 2),
f AS (SELECT image_id, proposal, arg_max({'raw': text, 'f': score, 'c': conf, 's': greatest(0, conf * score - penalty)}, (greatest(0, conf * score - penalty), -o)) AS h
  FROM span JOIN fits USING (text) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY h.s DESC, proposal) AS i FROM f),
evidence AS (SELECT image_id, string_agg(concat(text, ':', CAST(round(e.c * 1e6) AS BIGINT), ':', CAST(round(e.p * 1e6) AS BIGINT)), ',' ORDER BY first) AS evidence FROM l GROUP BY 1),
options AS (SELECT image_id, string_agg(concat(proposal, ':', CAST(round(h.s * 1e6) AS BIGINT)), ',' ORDER BY i) AS options FROM r WHERE i <= 5 GROUP BY 1),
against AS (SELECT r.image_id, string_agg(DISTINCT l.text, ',' ORDER BY l.text) AS against FROM r JOIN l ON l.image_id = r.image_id AND r.i = 1 AND l.text <> r.proposal
  AND NOT contains(l.text, r.proposal) AND NOT contains(r.proposal, l.text) AND l.e.c >= 0.8e0 AND r.h.c - l.e.c < 0.08e0 AND l.e.p = 0 GROUP BY 1),
j AS (SELECT w.*, b.proposal, b.h, b.image_id IS NOT NULL AS has, regexp_matches(literal, '^[A-Z]{2}[A-Z0-9]{3,12}$') AND regexp_matches(literal, '[0-9]') AS kept,
    coalesce(b.h.s - n.h.s < 0.08e0, false) AS close, against, evidence, options
  FROM whole w LEFT JOIN r b ON b.image_id = w.image_id AND b.i = 1 LEFT JOIN r n ON n.image_id = w.image_id AND n.i = 2
  LEFT JOIN against ON against.image_id = w.image_id LEFT JOIN evidence ON evidence.image_id = w.image_id LEFT JOIN options ON options.image_id = w.image_id),
v AS (SELECT *, has AND NOT close AND against IS NULL AND h.c >= 0.8e0 AND h.s >= 0.75e0 AND h.f >= 0.84e0 AS ok FROM j)
SELECT image_id, CASE WHEN ok THEN proposal ELSE '' END AS plate_text, CASE WHEN has THEN proposal WHEN kept THEN literal ELSE '' END AS proposed_text,
  CASE WHEN ok THEN 'accepted' WHEN has OR kept THEN 'uncertain' ELSE 'unreadable' END AS status,
  CASE WHEN against IS NOT NULL THEN 'conflicting_literal_readings' WHEN close THEN 'ambiguous_interpretations' WHEN has AND NOT ok THEN 'reading_requires_review' WHEN NOT has AND kept THEN 'unsupported_layout' END AS review_reason,
  round(CASE WHEN has THEN h.f ELSE 0 END, 9) AS format_score, round(CASE WHEN has THEN h.c WHEN kept THEN least ELSE 0 END, 9) AS ocr_confidence,
  round(CASE WHEN has THEN h.s WHEN kept THEN least * 0.4e0 ELSE 0 END, 9) AS selection_score, h.raw AS raw_text,
  proposal = h.raw AND regexp_matches(h.raw, '"""
    + _LAYOUT
    + """') AS literal_layout, coalesce(evidence, '') AS literal_evidence,
  CASE WHEN has THEN options WHEN kept THEN concat(literal, ':', CAST(round(least * 0.4e0 * 1e6) AS BIGINT)) ELSE '' END AS alternatives, CASE WHEN has THEN coalesce(against, '') END AS conflicting_texts FROM v""",
    "fx_region",
)
def select_candidate(t):
    regions = select.order_regions(select.clean_regions(t.fx_region), "image_id")
    out = select.select_reading(regions, "image_id")
    # Lists as texts of their items, numbers in millionths, so that every column is compared.
    shown = lambda c, *fields: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["text"], *(F.round(x[f] * 1e6).cast("bigint").cast("string") for f in fields))), ",")
    lists = {"literal_evidence": shown("literal_evidence", "ocr_confidence", "omission_penalty"), "alternatives": shown("alternatives", "selection_score"), "conflicting_texts": F.array_join("conflicting_texts", ",")}
    return out.withColumns(lists | {c: F.round(c, 9) for c in ("format_score", "ocr_confidence", "selection_score")})


@query(
    """, x AS (SELECT proposed_text AS text FROM fx_observation UNION SELECT regexp_replace(upper(text), '[^A-Z0-9]', '', 'g') FROM fx_region UNION SELECT text FROM fx_layout),
t AS (SELECT text FROM x WHERE text NOT IN ('', 'IND')),
"""
    + _FITS
    + " SELECT text, proposal, round(score, 9) AS score FROM fits",
    "fx_observation", "fx_region", "fx_layout",
)
def template_fits(t):
    texts = t.fx_observation.select(F.col("proposed_text").alias("text")).unionByName(select.clean_regions(t.fx_region).select("text")).unionByName(t.fx_layout.select("text"))
    return T.template_fits(texts).withColumn("score", F.round("score", 9))


@query(
    r""" SELECT region_id, regexp_replace(upper(text), '[^A-Z0-9]', '', 'g') AS cleaned, regexp_matches(upper(text), '^[A-Z]{2}([0-9]{1,2}[A-Z]{1,3}[0-9]{1,4}|[0-9]{3,6})$') AS layout,
  regexp_matches(upper(text), '^[A-Z]{2}[A-Z0-9]{3,12}$') AND regexp_matches(text, '[0-9]') AS plausible FROM fx_region""",
    "fx_region",
)
def layout_regex(t):
    up = F.upper("text")
    return t.fx_region.select("region_id", T.clean(F.col("text")).alias("cleaned"), T.is_review_layout(up).alias("layout"), T.is_plausible(up).alias("plausible"))


_VARIANTS = """, v AS (SELECT image_id, event_id - image_id*6 AS ord, concat('MH12AB', lpad(CAST((image_id + CASE WHEN k%5 = 0 THEN 1 ELSE 0 END) % 10000 AS VARCHAR), 4, '0')) AS t, (k % 50 + 50) / 1e2 AS s,
  CASE WHEN (k % 50 + 50) >= 80 THEN 'accepted' ELSE 'uncertain' END AS status, k % 50 + 50 >= 95 AS strong FROM ev)"""


@query(
    _VARIANTS
    + """, w AS (
  SELECT image_id, 0 AS i, [{'o': ord, 't': t, 's': s, 'g': strong}] AS r, strong OR status = 'accepted' AS done FROM v WHERE ord = 0
  UNION ALL
  SELECT image_id, i, r, top.g AND len(list_filter(r, lambda x: x.t <> top.t AND top.s - x.s < 0.08)) = 0
  FROM (SELECT image_id, i, r, list_filter(r, lambda x: x.s = list_max(list_transform(r, lambda y: y.s)))[1] AS top
    FROM (SELECT w.image_id, w.i + 1 AS i, list_append(w.r, {'o': v.ord, 't': v.t, 's': v.s, 'g': v.strong}) AS r FROM w JOIN v ON v.image_id = w.image_id AND v.ord = w.i + 1 WHERE NOT w.done)))
SELECT image_id, array_to_string(list_transform(arg_max(r, i), lambda x: CAST(x.o AS VARCHAR)), ',') AS variants FROM w GROUP BY image_id""",
    "ev",
)
def cascade_fallback(t):
    k = F.col("k") % 50 + 50
    text = F.concat(F.lit("MH12AB"), F.lpad(((F.col("image_id") + F.when(F.col("k") % 5 == 0, 1).otherwise(0)) % 10000).cast("string"), 4, "0"))
    rows = t.ev.select(
        "image_id", (F.col("event_id") - F.col("image_id") * 6).alias("ord"), text.alias("proposed_text"), (k / 100).alias("selection_score"), F.when(k >= 80, "accepted").otherwise("uncertain").alias("status"), (k >= 95).alias("strong")
    )
    out = select.cascade(rows.withColumn("variant", F.col("ord").cast("string")), ["image_id"])
    return out.select("image_id", F.array_join("variants", ",").alias("variants"))


_TALLY = """, w AS (SELECT *, greatest(1e-2, ocr_confidence * (1 + 0.5*format_score) * (1 + 0.1*ln(1 + greatest(0, sharpness)))) AS w FROM fx_observation),
tally AS (SELECT track_id, proposed_text AS text, sum(w) AS score, count(*) AS frames, max(ocr_confidence) AS max_conf, avg(ocr_confidence) AS mean_conf, min(frame_idx) AS first FROM w GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY score DESC, first) AS i FROM tally)"""


@query(_TALLY + " SELECT track_id, text, round(score, 6) AS score, frames, max_conf, round(mean_conf, 9) AS mean_conf, first FROM tally", "fx_observation")
def vote_tally(t):
    return fuse.vote_tally(t.fx_observation).withColumns({"score": F.round("score", 6), "mean_conf": F.round("mean_conf", 9)})


@query(_TALLY + " SELECT a.track_id, a.text, round(a.score - b.score, 6) AS margin FROM ranked a LEFT JOIN ranked b ON a.track_id = b.track_id AND b.i = a.i + 1 WHERE a.i = 1", "fx_observation")
def runner_up_margin(t):
    from pyspark.sql import Window

    order = Window.partitionBy("track_id").orderBy(F.desc("score"), "first")
    tally = fuse.vote_tally(t.fx_observation).withColumns({"i": F.row_number().over(order), "next": F.lead("score").over(order)})
    return tally.where("i = 1").select("track_id", "text", F.round(F.col("score") - F.col("next"), 6).alias("margin"))


_CHARS = """, len AS (SELECT track_id, length(text) AS n, sum(score) AS w, min(first) AS f FROM tally GROUP BY 1, 2),
best_len AS (SELECT track_id, n FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY w DESC, f) AS i FROM len) WHERE i = 1),
ch AS (SELECT t.track_id, unnest(range(1, length(t.text) + 1)) AS p, t.text, t.score, t.first, t.mean_conf, t.frames FROM tally t JOIN best_len b ON b.track_id = t.track_id AND length(t.text) = b.n),
vt AS (SELECT track_id, p, substring(text, p, 1) AS c, sum(score) AS w, min(first) AS f, sum(mean_conf*frames)/sum(frames) AS conf FROM ch GROUP BY 1, 2, 3),
pl AS (SELECT *, row_number() OVER (PARTITION BY track_id, p ORDER BY w DESC, f) AS i FROM vt),
chars AS (SELECT track_id, string_agg(c, '' ORDER BY p) AS text, avg(conf) AS confidence FROM pl WHERE i = 1 GROUP BY 1)"""


@query(_TALLY + _CHARS + " SELECT track_id, text, round(confidence, 6) AS confidence FROM chars", "fx_observation")
def char_consensus(t):
    return fuse.char_consensus(t.fx_observation).withColumn("confidence", F.round("confidence", 6))


#: For these texts (two letters, two digits, two letters, four digits) the fit is 1.
_FUSED = (
    _TALLY
    + """, b AS (SELECT * FROM ranked WHERE i = 1), n AS (SELECT track_id, score AS ns, frames AS nf, text AS nt FROM ranked WHERE i = 2),
seen AS (SELECT track_id, count(*) AS total, arg_max(frame_idx, (sharpness, -frame_idx)) AS sharpest FROM fx_observation GROUP BY 1),
j AS (SELECT *, least(0.99, mean_conf + CASE WHEN frames >= 2 THEN 0.03*least(4, frames - 1) ELSE 0 END) AS fused, coalesce((score - ns)/greatest(1e-6, score) < 0.08 AND nf >= 2, false) AS conflict
  FROM b LEFT JOIN n USING (track_id) JOIN seen USING (track_id)),
r AS (SELECT *, CASE WHEN conflict THEN 'conflicting_temporal_readings' WHEN fused < 0.88 THEN 'low_temporal_confidence' WHEN frames < 2 AND fused < 0.92 THEN 'insufficient_frame_agreement' END AS reason FROM j)"""
)


@query(
    _FUSED
    + """ SELECT track_id, CASE WHEN reason IS NULL THEN text ELSE '' END AS plate_text, text AS proposed_text, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'uncertain' END AS status, reason AS review_reason,
  round(fused, 4) AS fused_confidence, 1e0 AS format_score, frames AS agreement_count, total AS total_observations, sharpest AS sharpest_frame_idx, CASE WHEN conflict THEN nt ELSE '' END AS conflicting, alternatives
FROM r JOIN (SELECT track_id, string_agg(concat(text, ':', frames, ':', CAST(round(max_conf * 1e4) AS BIGINT)), ',' ORDER BY i) AS alternatives FROM ranked WHERE i <= 5 GROUP BY 1) USING (track_id)""",
    "fx_observation",
)
def fuse_tracks(t):
    out = fuse.fuse(t.fx_observation)
    options = F.transform("alternatives", lambda x: F.concat_ws(":", x["text"], x["frame_count"].cast("string"), F.round(x["max_confidence"] * 1e4).cast("bigint").cast("string")))
    return out.withColumns({"conflicting": F.array_join("conflicting_texts", ","), "alternatives": F.array_join(options, ",")}).drop("conflicting_texts")


@query(" SELECT track_id, frame_idx, i AS rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY track_id ORDER BY sharpness DESC, frame_idx) AS INTEGER) AS i FROM fx_observation) WHERE i <= 5", "fx_observation")
def topk_sharpest(t):
    return fuse.sharpest(t.fx_observation).select("track_id", "frame_idx", "rank")


@query(
    ", best AS (SELECT * FROM fx_observation QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY sharpness DESC, frame_idx) <= 5)"
    + _FUSED.replace("fx_observation", "best")
    + """, o AS (SELECT o.*, e.event_type FROM fx_observation o JOIN ev e ON e.event_id = o.frame_idx),
span AS (SELECT track_id, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame, count(*) AS frames, round(avg(ocr_confidence), 9) AS mean_conf, arg_min(event_type, frame_idx) AS vehicle_type,
  round(min(frame_idx)/25e0, 2) AS first_sec, round(max(frame_idx)/25e0, 2) AS last_sec FROM o GROUP BY 1)
SELECT span.*, CASE WHEN reason IS NULL THEN text ELSE '' END AS plate_text, text AS proposed_text, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'uncertain' END AS status, reason AS review_reason,
  round(fused, 4) AS fused_confidence FROM span JOIN r USING (track_id)""",
    "fx_observation", "ev",
)
def passages(t):
    frames = t.fx_observation.join(t.ev.select(F.col("event_id").alias("frame_idx"), F.col("event_type").alias("vehicle_type")), "frame_idx")
    return fuse.passages(frames)


@query(" SELECT plate_id, round(greatest(0, least(1, confidence*3 - 1)), 9) AS unit, round(2*confidence*(1-confidence)/greatest(1, 1e-12), 9) AS harmonic FROM fx_plate", "fx_plate")
def value_functions(t):
    c = F.col("confidence")
    return t.fx_plate.select("plate_id", F.round(V.unit(c * 3 - 1), 9).alias("unit"), F.round(V.harmonic(c, 1 - c), 9).alias("harmonic"))


@query(" SELECT image_id, CAST(count(*) AS BIGINT) AS length, array_to_string(CASE WHEN 10 + count(*)*7 <= 16 THEN [0] ELSE list_sort(list_distinct(list_concat(range(0, 10 + count(*)*7 - 16 + 1, 12), [10 + count(*)*7 - 16]))) END, ',') AS starts FROM ev GROUP BY image_id", "ev")
def tile_grid(t):
    # Tiles of 16 that overlap by 4 over an axis whose length comes from the image's rows.
    rows = t.ev.groupBy("image_id").agg(F.count("*").alias("length"))
    starts = G.tile_starts((F.lit(10) + F.col("length") * 7).cast("int"), 16, 4)
    return rows.select("image_id", "length", F.array_join(F.transform(starts, lambda x: x.cast("string")), ",").alias("starts"))


@query(" SELECT image_id, CASE WHEN (k % 100)/1e2 >= 0.55 AND (k % 4 = 0 OR k % 3 <> 0) THEN ['haze','rain','blur','lowlight'][k % 4 + 1] END AS restoration FROM ev WHERE slot = 0", "ev")
def restoration_route(t):
    rows = t.ev.where("slot = 0").select(
        "image_id", F.element_at(F.array(*map(F.lit, C.CONDITIONS)), F.col("k") % 4 + 1).alias("condition"), ((F.col("k") % 100) / 100).alias("condition_confidence"),
        F.when(F.col("k") % 4 == 0, "severe").otherwise("mild").alias("severity"), F.lit(0.9).alias("severity_confidence"), (F.col("k") % 3 == 0).alias("all_strong"),
    )
    return select.route_restoration(rows).select("image_id", "restoration")
