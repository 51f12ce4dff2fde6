"""Queries over records and reports: identities, groups, splits, provenance, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagekit import constants as C
from passagekit.functions import text as T
from passagekit.functions import values as V
from passagekit.operators import grouping, metrics, provenance, rows, splits
from passagekit.operators.components import components as connected
from passagekit.plans.registry import query
from passagekit.sources import readers
from passagekit.streaming import passages as streams


def _entries(t):
    """Documents as manifest entries with some identities given and some not."""
    i = F.col("doc_id")
    return t.documents.select(
        F.concat(F.lit("raw\\"), "source", F.lit("\\"), "lang", F.lit("_"), i.cast("string"), F.lit(".v1.jpg")).alias("image_path"),
        F.when(i % 3 == 0, "").when(i % 3 == 1, F.concat(F.lit("given-"), i.cast("string"))).alias("source_id"),
        F.when(i % 5 == 0, F.concat(F.lit("g"), (i % 7).cast("string"))).otherwise("").alias("leakage_group"),
        F.when(i % 2 == 0, "").alias("orig_source"),
        "source",
    )


_ENTRIES = """WITH e AS (SELECT concat('raw\\', source, '\\', lang, '_', doc_id, '.v1.jpg') AS image_path, CASE WHEN doc_id%3=0 THEN '' WHEN doc_id%3=1 THEN concat('given-', doc_id) END AS source_id,
  CASE WHEN doc_id%5=0 THEN concat('g', doc_id%7) ELSE '' END AS leakage_group, source, lang, doc_id FROM documents),
i AS (SELECT image_path, coalesce(nullif(source_id, ''), concat(source, ':', lang, '_', doc_id, '.v1')) AS source_id, leakage_group AS g FROM e),
ids AS (SELECT image_path, source_id, coalesce(nullif(g, ''), source_id) AS leakage_group FROM i)"""


@query(_ENTRIES + " SELECT * FROM ids")
def source_identity(t):
    return splits.identities(_entries(t)).select("image_path", "source_id", "leakage_group")


@query(
    _ENTRIES
    + """, k AS (SELECT leakage_group, row_number() OVER (ORDER BY sha256(concat('42:', leakage_group)), leakage_group) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT leakage_group FROM ids))
SELECT image_path, leakage_group, CASE WHEN i < greatest(1, floor(n*0.15e0)) THEN 'val' WHEN i < greatest(1, floor(n*0.15e0)) + greatest(1, floor(n*0.15e0)) THEN 'test' ELSE 'train' END AS split FROM ids JOIN k USING (leakage_group)"""
)
def leakage_split(t):
    return splits.by_seeded_order(splits.identities(_entries(t))).select("image_path", "leakage_group", "split")


@query(
    _ENTRIES.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, g AS (SELECT leakage_group, size, row_number() OVER (ORDER BY size DESC, sha256(concat('42:', leakage_group)), leakage_group) AS i
  FROM (SELECT leakage_group, count(*) AS size FROM ids GROUP BY 1)),
n AS (SELECT sum(size) * (1 - 0.15e0 - 0.15e0) AS wt, sum(size) * 0.15e0 AS wv, sum(size) * 0.15e0 AS ws FROM g),
walk AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS t, CAST(0 AS BIGINT) AS v, CAST(0 AS BIGINT) AS s, '' AS leakage_group, '' AS split
  UNION ALL
  SELECT i, t + CASE WHEN split = 'train' THEN size ELSE 0 END, v + CASE WHEN split = 'val' THEN size ELSE 0 END, s + CASE WHEN split = 'test' THEN size ELSE 0 END, leakage_group, split
  FROM (SELECT g.i, w.t, w.v, w.s, g.size, g.leakage_group, CASE WHEN (wt - w.t) / wt >= (wv - w.v) / wv AND (wt - w.t) / wt >= (ws - w.s) / ws THEN 'train'
    WHEN (wv - w.v) / wv >= (ws - w.s) / ws THEN 'val' ELSE 'test' END AS split FROM walk w JOIN g ON g.i = w.i + 1, n))
SELECT image_path, leakage_group, split FROM ids JOIN (SELECT leakage_group, split FROM walk WHERE i > 0) USING (leakage_group)"""
)
def greedy_group_assign(t):
    return splits.by_filling(splits.identities(_entries(t))).select("image_path", "leakage_group", "split")


@query(
    _ENTRIES
    + """, k AS (SELECT leakage_group, row_number() OVER (ORDER BY sha256(concat('42:', leakage_group)), leakage_group) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT leakage_group FROM ids))
SELECT leakage_group, CASE WHEN i < greatest(1, round_even(n*0.15e0, 0)) THEN 'test' WHEN i < greatest(2, round_even(n*0.30e0, 0)) THEN 'val' ELSE 'train' END AS split FROM k"""
)
def cut_point_split(t):
    return splits.by_cut_points(splits.identities(_entries(t)), "leakage_group")


@query(
    "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256(concat('balanced-sampling-v1:', CAST(doc_id AS VARCHAR))), doc_id) <= 20 AS kept FROM documents"
)
def group_cap_hash(t):
    return splits.group_cap(t.documents, group="source", path="doc_id").select("doc_id", "source", "kept")


_SPLIT = "CASE {0} % 7 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END"


@query(
    f"""WITH r AS (SELECT doc_id AS source_id, concat(lang, doc_id % 50) AS leakage_group, {_SPLIT.format('doc_id')} AS split,
  [{{'split': {_SPLIT.format('(doc_id // 3)')}, 'leakage_group': concat('x', doc_id % 11)}}, {{'split': {_SPLIT.format('doc_id')}, 'leakage_group': concat('x', doc_id % 4)}}] AS m FROM documents),
w AS (SELECT *, list(DISTINCT split) OVER (PARTITION BY leakage_group) AS s FROM r)
SELECT source_id, split, CASE WHEN list_contains(s, 'test') THEN 'reserved_historical_test_identity' WHEN len(s) <> 1 THEN 'historical_identity_crosses_partitions'
  WHEN m[1].split <> split OR m[2].split <> split THEN 'cross_dataset_identity_crosses_partitions' WHEN m[1].leakage_group <> m[2].leakage_group THEN 'cross_dataset_group_needs_resolution' END AS reason, m[1].leakage_group AS joins FROM w"""
)
def eligibility_cascade(t):
    split = lambda e: F.expr(_SPLIT.format(e))
    match = lambda s, n: F.struct(split(s).alias("split"), F.concat(F.lit("x"), (F.col("doc_id") % n).cast("string")).alias("leakage_group"))
    rows = t.documents.select(
        F.col("doc_id").alias("source_id"), F.concat("lang", (F.col("doc_id") % 50).cast("string")).alias("leakage_group"), split("doc_id").alias("split"), F.array(match("(doc_id div 3)", 11), match("doc_id", 4)).alias("matches")
    )
    return splits.eligibility(rows).select("source_id", "split", "reason", "joins")


@query("SELECT doc_id, c.condition, c.severity FROM documents, (SELECT 'clear' AS condition, 'none' AS severity UNION ALL SELECT * FROM (VALUES ('haze'), ('rain'), ('blur'), ('lowlight')) a(c), (VALUES ('mild'), ('moderate'), ('severe')) b(s)) c")
def variant_cross_join(t):
    return splits.variants(t.documents.select("doc_id"))


@query(
    f"""WITH e AS (SELECT doc_id // 4 AS source_id, {_SPLIT.format('(doc_id // 4)')} AS split, CASE WHEN doc_id % 28 = 0 THEN 'haze' WHEN doc_id % 4 = 0 THEN 'clear' ELSE 'rain' END AS condition, CAST(doc_id % 4 AS VARCHAR) AS severity, CAST(doc_id AS VARCHAR) AS image_path FROM documents)
SELECT a.source_id, a.split, a.severity, a.image_path AS degraded, b.image_path AS clear FROM e a LEFT JOIN e b ON b.condition = 'clear' AND a.source_id = b.source_id AND a.split = b.split WHERE a.condition = 'rain'"""
)
def pair_clear_degraded(t):
    rows = t.documents.selectExpr(
        "doc_id div 4 AS source_id", _SPLIT.format("(doc_id div 4)") + " AS split", "CASE WHEN doc_id % 28 = 0 THEN 'haze' WHEN doc_id % 4 = 0 THEN 'clear' ELSE 'rain' END AS condition", "CAST(doc_id % 4 AS STRING) AS severity", "CAST(doc_id AS STRING) AS image_path"
    )
    return splits.clear_pairs(rows, "rain")


def _copies(t):
    return t.documents.select(F.md5(F.col("text").cast("binary")).alias("pixel_sha256"), F.col("doc_id").alias("path"))


@query("SELECT md5(text) AS pixel_sha256, min(doc_id) AS kept, count(*) AS copies FROM documents GROUP BY 1")
def exact_dedupe(t):
    return grouping.exact_dedupe(_copies(t))


@query("WITH d AS (SELECT doc_id AS path, md5(text) AS pixel_sha256, min(doc_id) OVER (PARTITION BY md5(text)) AS kept FROM documents) SELECT DISTINCT * FROM d WHERE path <> kept")
def dedupe_aliases(t):
    return grouping.aliases(_copies(t))


@query(
    """ SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY vehicle_id) AS INTEGER) AS vehicle_id, CASE vehicle_type WHEN 'other' THEN 'unknown' ELSE vehicle_type END AS vehicle_type, confidence
FROM (SELECT image_id, vehicle_id, confidence, CASE vehicle_type WHEN 'unknown' THEN 'other' WHEN 'truck' THEN 'tram' ELSE vehicle_type END AS vehicle_type FROM fx_vehicle) WHERE vehicle_type <> 'tram' AND confidence >= 0.35""",
    "fx_vehicle",
)
def vehicle_whitelist(t):
    kind = F.when(F.col("vehicle_type") == "unknown", "other").when(F.col("vehicle_type") == "truck", "tram").otherwise(F.col("vehicle_type"))
    rows_ = t.fx_vehicle.select("image_id", F.col("vehicle_id").alias("ord"), kind.alias("vehicle_type"), "confidence")
    return rows.whitelisted_vehicles(rows_).drop("ord")


@query("SELECT doc_id, lang FROM documents ORDER BY sha256(concat('42:', CAST(doc_id AS VARCHAR))), doc_id LIMIT 500")
def fixed_sample(t):
    return rows.fixed_sample(t.documents.select("doc_id", "lang"), 500, "doc_id")


@query(
    """WITH h AS (SELECT xor(user_id*2654435761, CAST(1 AS BIGINT) << CAST(CAST(json_extract_string(props,'$.k') AS INT) % 20 + 30 AS INT)) AS h, min(event_id) AS id FROM events GROUP BY 1)
SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance FROM h a JOIN h b ON a.id < b.id AND bit_count(xor(a.h, b.h)) <= 4"""
)
def near_duplicates(t):
    h = F.expr("(user_id*2654435761L) ^ shiftleft(1L, k % 20 + 30)")
    return grouping.near_duplicates(t.ev.select(F.col("event_id").alias("id"), h.alias("dhash")))


@query(
    """WITH e AS (SELECT event_id AS id, user_id, xor(user_id*2654435761, CAST(1 AS BIGINT) << CAST(CAST(json_extract_string(props,'$.k') AS INT) % 20 + 30 AS INT)) AS dhash, event_type FROM events),
k AS (SELECT dhash, min(id) AS kept, arg_min(event_type, id) AS first FROM e GROUP BY 1)
SELECT id, dhash, kept, event_type IS DISTINCT FROM first AS other_pixels FROM e JOIN k USING (dhash)"""
)
def near_members(t):
    h = F.expr("(user_id*2654435761L) ^ shiftleft(1L, k % 20 + 30)")
    return grouping.members(t.ev.select(F.col("event_id").alias("id"), h.alias("dhash"), "event_type"), pixels="event_type")


@query(
    """WITH o AS (SELECT o_orderkey AS b, CASE WHEN o_orderkey % 5 = 0 THEN concat('x', o_custkey) ELSE strftime(o_orderdate, '%Y%m%d') END AS folder FROM orders),
m AS (SELECT min(b) AS a, folder FROM o WHERE regexp_full_match(folder, '[0-9]{8}') GROUP BY folder) SELECT a, b FROM o JOIN m USING (folder) WHERE a <> b"""
)
def same_date_links(t):
    folder = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("x"), F.col("o_custkey").cast("string"))).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return grouping.same_date(t.orders.select(F.col("o_orderkey").alias("id"), folder.alias("folder")))


_LINKS = """WITH RECURSIVE n AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS x, min(doc_id) OVER (PARTITION BY lang, n_chars) AS y FROM documents),
e AS (SELECT doc_id AS a, x AS b FROM n UNION SELECT x, doc_id FROM n UNION SELECT doc_id, y FROM n UNION SELECT y, doc_id FROM n),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)"""


@query(_LINKS + " SELECT a AS doc_id, min(b) AS root FROM reach GROUP BY 1")
def components(t):
    edges = grouping.stars(t.documents, "doc_id", F.md5(F.col("text").cast("binary"))).unionByName(grouping.stars(t.documents, "doc_id", F.concat_ws("|", "lang", F.col("n_chars").cast("string"))))
    roots = connected(edges)
    return t.documents.select("doc_id").join(roots, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("root", "doc_id").alias("root"))


@query(
    """WITH RECURSIVE d AS (SELECT doc_id, md5(text) AS p, concat_ws('|', lang, CAST(n_chars AS VARCHAR)) AS s, CASE WHEN doc_id % 10 = 0 THEN concat('KA01AB', lpad(CAST(doc_id // 20 AS VARCHAR), 4, '0')) END AS plate,
  CASE WHEN doc_id % 2 = 0 THEN xor((doc_id // 5) * 2654435761, CAST(1 AS BIGINT) << CAST(doc_id % 20 + 30 AS INTEGER)) END AS h FROM documents),
same AS (SELECT doc_id AS a, unnest([min(doc_id) OVER (PARTITION BY p), min(doc_id) OVER (PARTITION BY s), CASE WHEN plate IS NOT NULL THEN min(doc_id) OVER (PARTITION BY plate) END,
  CASE WHEN h IS NOT NULL THEN min(doc_id) OVER (PARTITION BY h) END]) AS b FROM d),
near AS (SELECT x.a, y.a AS b FROM (SELECT h, min(doc_id) AS a FROM d WHERE h IS NOT NULL GROUP BY h) x JOIN (SELECT h, min(doc_id) AS a FROM d WHERE h IS NOT NULL GROUP BY h) y ON x.a < y.a AND bit_count(xor(x.h, y.h)) <= 4),
one AS (SELECT a, b FROM same WHERE b IS NOT NULL AND a <> b UNION SELECT a, b FROM near),
e AS (SELECT a, b FROM one UNION SELECT b, a FROM one),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
root AS (SELECT a AS doc_id, min(b) AS root FROM reach GROUP BY 1), name AS (SELECT root, sha256(string_agg(DISTINCT p, chr(10) ORDER BY p)) AS leakage_group FROM root JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, root, leakage_group FROM root JOIN name USING (root)"""
)
def leakage_groups(t):
    # All four kinds of links; a text that is no plausible plate links nothing.
    plate = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("KA01AB"), F.lpad(F.expr("doc_id div 20").cast("string"), 4, "0"))).otherwise("plate")
    rows = t.documents.select(
        F.col("doc_id").alias("id"), F.md5(F.col("text").cast("binary")).alias("pixel_sha256"), F.concat_ws("|", "lang", F.col("n_chars").cast("string")).alias("sequence"),
        F.expr("CASE WHEN doc_id % 2 = 0 THEN ((doc_id div 5) * 2654435761L) ^ shiftleft(1L, cast(doc_id % 20 + 30 as int)) END").alias("dhash"), F.array(plate).alias("identities"),
    )
    return grouping.leakage_groups(rows).withColumnRenamed("id", "doc_id")


@query(
    """WITH f AS (SELECT substring(sha256(CAST(doc_id AS VARCHAR)), 1, 3) AS b, concat(CAST(doc_id AS VARCHAR), chr(0), md5(text)) AS r FROM documents),
e AS (SELECT b, sha256(string_agg(r, chr(10) ORDER BY r)) AS h FROM f GROUP BY 1) SELECT sha256(string_agg(concat(b, h), chr(10) ORDER BY concat(b, h))) AS sha256 FROM e"""
)
def dataset_fingerprint(t):
    return grouping.fingerprint(t.documents.select(F.col("doc_id").cast("string").alias("path"), F.md5(F.col("text").cast("binary")).alias("digest")))


def _hashed(t):
    return t.documents.selectExpr("doc_id AS image_path", "source AS source_id", "md5(text) AS pixel_sha256", _SPLIT.format("doc_id") + " AS split", "array(md5(concat('a', lang, doc_id % 3)), NULL) AS duplicate_source_sha256")


@query(
    f"""WITH d AS (SELECT doc_id, {_SPLIT.format('doc_id')} AS split, concat('s', doc_id // 9) AS s, concat('g', lang, n_chars) AS g, md5(text) AS p,
  md5(concat('a', CAST(doc_id // 8 AS VARCHAR))) AS a, md5(concat('a', CAST(doc_id // 5 AS VARCHAR))) AS c FROM documents),
k AS (SELECT doc_id, split, unnest([concat('s', s), concat('g', g), concat('p', p), concat('a', a), concat('a', c)]) AS k FROM d)
SELECT DISTINCT doc_id AS image_path FROM k WHERE split = 'test' AND k IN (SELECT k FROM k WHERE split <> 'test')"""
)
def leakage_semi_join(t):
    rows = t.documents.selectExpr(
        "doc_id AS image_path", _SPLIT.format("doc_id") + " AS split", "concat('s', doc_id div 9) AS source_id", "concat('g', lang, n_chars) AS leakage_group", "md5(cast(text AS binary)) AS pixel_sha256",
        "md5(concat('a', doc_id div 8)) AS source_sha256", "array(md5(concat('a', doc_id div 5)), NULL) AS duplicate_source_sha256",
    )
    return provenance.leaked(rows.where("split = 'test'"), provenance.seen(rows))


@query(
    f"""WITH d AS (SELECT *, {_SPLIT.format('doc_id')} AS split FROM documents) SELECT DISTINCT kind, value FROM (
  SELECT 'source_ids' AS kind, source AS value FROM d WHERE split <> 'test' UNION ALL SELECT 'pixel_sha256', md5(text) FROM d WHERE split <> 'test'
  UNION ALL SELECT 'source_sha256', md5(concat('a', lang, doc_id % 3)) FROM d WHERE split <> 'test')"""
)
def provenance_sets(t):
    return provenance.seen(_hashed(t))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def resume_anti_join(t):
    return provenance.remaining(t.customer.select("c_custkey"), t.orders.where("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT 'left' AS side, o_custkey AS k FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 3) UNION ALL SELECT 'right', c_custkey FROM customer WHERE c_nationkey <> 3 AND c_custkey NOT IN (SELECT o_custkey FROM orders)")
def set_equality(t):
    return provenance.set_difference(t.orders.select(F.col("o_custkey").alias("k")), t.customer.where("c_nationkey <> 3").select(F.col("c_custkey").alias("k")))


@query(
    """WITH l AS (SELECT doc_id, count(*) AS n, min(lang) AS lang FROM documents GROUP BY 1), r AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'en' ELSE 'fr' END AS lang FROM labels)
SELECT coalesce(l.doc_id, r.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'only_right' WHEN r.doc_id IS NULL THEN 'only_left' ELSE 'differs' END AS problem FROM l FULL JOIN r USING (doc_id) WHERE l.doc_id IS NULL OR r.doc_id IS NULL OR l.lang <> r.lang"""
)
def coverage_join(t):
    return provenance.coverage(t.documents, t.labels.select("doc_id", F.when(F.col("quality") == 1, "en").otherwise("fr").alias("lang")), "doc_id", ["lang"])


def _judged(t):
    """Targets, plates with status and text, and the match of each target with its own plate."""
    plates = t.fx_reading.where("ord = 0").select("image_id", "plate_id", "status", "proposed_text", F.when(F.col("status") == "accepted", F.col("proposed_text")).otherwise("").alias("plate_text"))
    matches = t.fx_truth.where("target_id % 10 <> 1").select("image_id", "target_id", F.col("target_id").alias("plate_id"))
    return t.fx_truth.withColumn("text", F.when(F.col("target_id") % 6 == 0, "MH12AB0000").otherwise(F.col("text"))), plates, matches


_JUDGED = """, tr AS (SELECT image_id, target_id, CASE WHEN target_id % 6 = 0 THEN 'MH12AB0000' ELSE text END AS text FROM fx_truth),
pl AS (SELECT image_id, plate_id, status, proposed_text, CASE WHEN status = 'accepted' THEN proposed_text ELSE '' END AS plate_text FROM fx_reading WHERE ord = 0),
m AS (SELECT image_id, target_id FROM tr WHERE target_id % 10 <> 1),
oc AS (SELECT tr.image_id, tr.target_id, CASE WHEN m.target_id IS NULL THEN 'missed' WHEN status = 'accepted' THEN CASE WHEN plate_text = text THEN 'correct_accepted' ELSE 'wrong_accepted' END
  ELSE CASE WHEN proposed_text = text THEN 'correct_uncertain' ELSE 'wrong_uncertain' END END AS outcome
  FROM tr LEFT JOIN m USING (image_id, target_id) LEFT JOIN pl ON pl.image_id = m.image_id AND pl.plate_id = m.target_id)"""

_SCORES = (
    _JUDGED
    + """, t1 AS (SELECT image_id, count(*) AS ground_truth_plates FROM tr GROUP BY 1), p1 AS (SELECT image_id, count(*) AS detections, count(*) FILTER (WHERE status = 'accepted') AS accepted_readings FROM pl GROUP BY 1),
m1 AS (SELECT m.image_id, count(*) AS matched_detections, count(*) FILTER (WHERE status = 'accepted' AND plate_text = text) AS exact_readings FROM m JOIN tr USING (image_id, target_id) JOIN pl ON pl.image_id = m.image_id AND pl.plate_id = m.target_id GROUP BY 1),
sc AS (SELECT image_id, coalesce(ground_truth_plates, 0) AS ground_truth_plates, coalesce(detections, 0) AS detections, coalesce(matched_detections, 0) AS matched_detections, coalesce(accepted_readings, 0) AS accepted_readings, coalesce(exact_readings, 0) AS exact_readings
  FROM t1 FULL JOIN p1 USING (image_id) LEFT JOIN m1 USING (image_id)),
sx AS (SELECT *, ground_truth_plates - matched_detections AS missed_plates, detections - matched_detections AS extra_detections, accepted_readings - exact_readings AS incorrect_accepted_readings, detections - accepted_readings AS abstentions FROM sc)"""
)


@query(_SCORES + " SELECT * FROM sx", "fx_truth", "fx_reading")
def score_image(t):
    return metrics.score_images(*_judged(t))


@query(
    _SCORES
    + """ SELECT image_id % 5 AS bucket, count(*) AS images, """
    + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("ground_truth_plates", "detections", "matched_detections", "accepted_readings", "exact_readings", "missed_plates", "extra_detections", "incorrect_accepted_readings", "abstentions"))
    + """, round(sum(matched_detections) / nullif(CAST(sum(ground_truth_plates) AS DOUBLE), 0), 9) AS detection_recall, round(sum(matched_detections) / nullif(CAST(sum(detections) AS DOUBLE), 0), 9) AS detection_precision,
  round(sum(exact_readings) / nullif(CAST(sum(ground_truth_plates) AS DOUBLE), 0), 9) AS end_to_end_exact_recall, round(sum(exact_readings) / nullif(CAST(sum(accepted_readings) AS DOUBLE), 0), 9) AS accepted_reading_precision FROM sx GROUP BY 1""",
    "fx_truth", "fx_reading",
)
def score_summary(t):
    return metrics.summarize(metrics.score_images(*_judged(t)).withColumn("bucket", F.col("image_id") % 5), "bucket")


@query(_JUDGED + " SELECT image_id, target_id, outcome FROM oc", "fx_truth", "fx_reading")
def target_outcomes(t):
    return metrics.outcomes(*_judged(t))


@query(
    _JUDGED
    + " SELECT image_id % 5 AS bucket, count(*) AS targets, "
    + ", ".join(f"count(*) FILTER (WHERE outcome = '{o}') AS {o}" for o in ("missed", *C.OUTCOMES))
    + """, round(count(*) FILTER (WHERE outcome = 'correct_accepted') / CAST(count(*) AS DOUBLE), 9) AS exact_accepted_fraction,
  round(count(*) FILTER (WHERE outcome = 'correct_accepted') / nullif(CAST(count(*) FILTER (WHERE outcome IN ('correct_accepted', 'wrong_accepted')) AS DOUBLE), 0), 9) AS accepted_target_precision FROM oc GROUP BY 1""",
    "fx_truth", "fx_reading",
)
def outcome_summary(t):
    return metrics.outcome_summary(metrics.outcomes(*_judged(t)).withColumn("bucket", F.col("image_id") % 5), "bucket")


@query(
    _JUDGED + ", g AS (SELECT image_id % 92 AS g, avg(CASE WHEN outcome = 'correct_accepted' THEN 1e0 ELSE 0e0 END) AS share FROM oc GROUP BY 1) SELECT count(*) AS groups, round(avg(share), 9) AS macro_mean FROM g",
    "fx_truth", "fx_reading",
)
def group_macro_recall(t):
    rows = metrics.outcomes(*_judged(t)).withColumn("g", F.col("image_id") % 92)
    return metrics.macro_mean(rows, "g", F.col("outcome") == "correct_accepted")


@query(
    """, f AS (SELECT coalesce(condition, 'unspecified') AS c, coalesce(severity, 'unspecified') AS s, quality FROM fx_image LEFT JOIN labels ON doc_id = image_id)
SELECT c AS condition, s AS severity, CAST(GROUPING_ID(c, s) AS INTEGER) AS level, count(*) AS n, round(avg(quality), 9) AS mean FROM f GROUP BY GROUPING SETS ((), (c), (c, s))""",
    "fx_image",
)
def metrics_grouping_sets(t):
    rows = t.fx_image.join(t.labels, F.col("doc_id") == F.col("image_id"), "left")
    return metrics.by_grouping_sets(rows, "quality")


@query(
    """SELECT event_type, count(value) AS n, round(arg_min(value, event_id), 9) AS first, round(sum(value)/count(value), 9) AS mean, round((sum(value) - arg_min(value, event_id))/nullif(CAST(count(value) - 1 AS DOUBLE), 0), 9) AS warm_mean,
  quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1"""
)
def latency_p95(t):
    return metrics.latency(t.events, "value", "event_id", "event_type")


@query(" SELECT a.status AS before, b.status AS after, count(*) AS n FROM fx_reading a JOIN fx_reading b USING (image_id, plate_id) WHERE a.ord = 0 AND b.ord = 1 GROUP BY 1, 2", "fx_reading")
def transition_matrix(t):
    return metrics.transitions(t.fx_reading.where("ord = 0"), t.fx_reading.where("ord = 1"), ["image_id", "plate_id"])


@query(" SELECT key, CAST(sum(value) AS BIGINT) AS total FROM (SELECT event_type AS key, k AS value FROM ev UNION ALL SELECT 'calls', 1 FROM ev) GROUP BY 1", "ev")
def map_counter_sum(t):
    return metrics.map_sum(t.ev.select(F.create_map("event_type", "k", F.lit("calls"), F.lit(1)).alias("counts")), "counts")


@query("SELECT coalesce(nullif(CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END, ''), 'none') AS brand, count(*) AS n FROM part GROUP BY 1")
def null_frequency(t):
    return metrics.frequency(t.part.select(F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_brand")).alias("brand")), "brand")


@query(
    """ SELECT threshold, count(*) FILTER (WHERE ok AND plate_id % 4 <> 0) AS correct, count(*) FILTER (WHERE ok AND plate_id % 4 = 0) AS wrong, count(*) FILTER (WHERE NOT ok) AS review
FROM (SELECT *, status = 'accepted' AND ocr_confidence >= threshold AS ok FROM fx_reading, (VALUES (0.8e0), (0.85e0), (0.9e0), (0.95e0)) t(threshold)) GROUP BY 1""",
    "fx_reading",
)
def threshold_sweep(t):
    return metrics.sweep(t.fx_reading, [0.8, 0.85, 0.9, 0.95], F.col("plate_id") % 4 != 0)


@query("SELECT l AS label, count(doc_id) AS n, round((SELECT count(*) FROM documents) / (5e0 * greatest(count(doc_id), 1)), 9) AS weight FROM (VALUES ('de'), ('en'), ('es'), ('fr'), ('it')) c(l) LEFT JOIN documents ON lang = l GROUP BY 1")
def class_weights(t):
    return metrics.class_weights(t.documents, "lang", ["de", "en", "es", "fr", "it"])


@query(
    """, c AS (SELECT event_type AS label, CAST(sum(CASE WHEN k%3=0 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN k%3=1 THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN k%3=2 THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM ev GROUP BY 1)
SELECT label, tp, fp, fn, round(tp/CAST(greatest(1, tp+fp) AS DOUBLE), 9) AS precision, round(tp/CAST(greatest(1, tp+fn) AS DOUBLE), 9) AS recall, round(2*tp/CAST(greatest(1, 2*tp+fp+fn) AS DOUBLE), 9) AS f1 FROM c""",
    "ev",
)
def class_prf(t):
    flag = lambda r: (F.col("k") % 3 == r).cast("int")
    return metrics.per_class(t.ev.select(F.col("event_type").alias("label"), flag(0).alias("tp"), flag(1).alias("fp"), flag(2).alias("fn")))


@query(
    """, c AS (SELECT event_type AS label, sum(CASE WHEN k%3=0 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN k%3<>0 THEN 1 ELSE 0 END) AS r FROM ev GROUP BY 1)
SELECT count(*) AS classes, round(avg(2*tp/CAST(greatest(1, 2*tp + r) AS DOUBLE)), 6) AS macro_f1 FROM c""",
    "ev",
)
def class_prf_macro(t):
    return class_prf(t).agg(F.count("*").alias("classes"), F.round(F.avg("f1"), 6).alias("macro_f1"))


@query("SELECT count(l_quantity) AS n, min(l_quantity) AS least, max(l_quantity) AS largest, round(avg(l_quantity), 9) AS mean FROM lineitem")
def eda_profile(t):
    return metrics.profile(t.lineitem, "l_quantity")


@query("SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 5")
def top_modes(t):
    return metrics.most_frequent(t.part, "p_type")


@query("WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT CAST(least(30, floor((value - lo)*30/(hi - lo)) + 1) AS INTEGER) AS bin, count(*) AS n FROM events, e GROUP BY 1")
def value_histogram(t):
    return metrics.histogram(t.events, "value")


@query(
    f"SELECT split, count(*) FILTER (WHERE label = 'de') AS de, count(*) FILTER (WHERE label = 'en') AS en, count(*) FILTER (WHERE label = 'it') AS it FROM (SELECT {_SPLIT.format('doc_id')} AS split, lang AS label FROM documents) GROUP BY 1"
)
def split_class_pivot(t):
    return metrics.split_by_class(t.documents.selectExpr(_SPLIT.format("doc_id") + " AS split", "lang AS label"), ["de", "en", "it"])


@query(f"SELECT split, count(*) AS n, count(DISTINCT source) AS groups FROM (SELECT {_SPLIT.format('doc_id')} AS split, source FROM documents) GROUP BY 1")
def build_report(t):
    return metrics.build_report(t.documents.selectExpr(_SPLIT.format("doc_id") + " AS split", "source AS leakage_group"))


@query("SELECT l_returnflag, round(sum(l_discount*l_quantity)/sum(l_quantity), 9) AS mean FROM lineitem GROUP BY 1")
def weighted_mean(t):
    return metrics.weighted_mean(t.lineitem, "l_discount", "l_quantity", "l_returnflag")


@query("SELECT p_partkey, regexp_replace(upper(concat(p_name, '-', p_brand)), '[^A-Z0-9]', '', 'g') AS cleaned, regexp_replace(concat('video_', p_partkey, '_', p_size), '[_-][0-9]+$', '') AS sequence, concat('a/b.c/', p_name, '.X.JPG') AS path, concat(p_name, '.X') AS stem, '.jpg' AS suffix FROM part")
def clean_text(t):
    path = F.concat(F.lit("a/b.c/"), "p_name", F.lit(".X.JPG"))
    frame = F.concat(F.lit("video_"), F.col("p_partkey").cast("string"), F.lit("_"), F.col("p_size").cast("string"))
    return t.part.select("p_partkey", T.clean(F.concat("p_name", F.lit("-"), "p_brand")).alias("cleaned"), T.sequence_of(frame).alias("sequence"), path.alias("path"), T.stem(path).alias("stem"), T.suffix(path).alias("suffix"))


@query(" SELECT event_id, CAST(bit_count(xor(user_id*2654435761, event_id)) AS INTEGER) AS bits, round(event_id/25e0, 9) AS seconds, user_id/nullif(CAST(k % 5 AS DOUBLE), 0) AS ratio, sha256(concat('42:', CAST(event_id AS VARCHAR))) AS seeded FROM ev", "ev")
def scalar_values(t):
    i = F.col("event_id")
    bits = V.differing_bits(F.expr("user_id*2654435761L"), i).cast("int")
    return t.ev.select("event_id", bits.alias("bits"), F.round(V.frame_seconds(i, F.lit(25)), 9).alias("seconds"), V.ratio(F.col("user_id"), F.col("k") % 5).alias("ratio"), V.seeded(42, i).alias("seeded"))


@query("SELECT event_id, user_id FROM events WHERE event_id % 3 = 0")
def frame_stride(t):
    return readers.stride(t.events.select("event_id", "user_id"), 3, "event_id")


@query(
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM g)
SELECT user_id AS track_id, count(*) AS frames, min(ts) AS first_ts, max(ts) AS last_ts, round(avg(value), 9) AS mean_value FROM s GROUP BY user_id, n"""
)
def passages_session(t):
    out = streams.sessions(t.events.withColumnRenamed("user_id", "track_id"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_ts", "last_ts")})


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(avg(value), 9) AS mean_value FROM events GROUP BY 1, 2")
def hourly_windows(t):
    return streams.hourly(t.events).withColumn("hour", F.col("hour").cast("timestamp_ntz"))
