"""The queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagekit.llm import alignment, bpe, conversations, decontaminate, imatch, langid, lm, quality, simhash, token_counts, token_files, toxicity, warc
from passagekit.llm.common import read, remainder


def op1_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    model = langid.learn(docs, public_tokenizers.path("piece_bpe_32k.model"), ~held)
    return langid.identify(docs, model, ["doc_id"]).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op2_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = read(spark, sf_dir, "documents"), F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    model = toxicity.learn(docs, read(spark, sf_dir, "labels"), ~held)
    out = toxicity.score(docs, model, ["doc_id"])
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = imatch.fingerprints(read(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.contamination(docs, read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, h: n + h["stop"] - h["start"])
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, ["doc_id"])
    return bpe.decode(encoded, path).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.records(warc.archive(read(spark, sf_dir, "pages")))


def op9_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = read(spark, sf_dir, "documents"), F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    net = quality.learn(docs, read(spark, sf_dir, "labels"), ~held)
    out = quality.classify(docs, net, ["doc_id"])
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = remainder("doc_id", 10)
    kind = F.when(fold == 0, lm.HELD).when(fold == 1, lm.DELETED).otherwise(lm.COUNTED)
    out, _ = lm.score(read(spark, sf_dir, "documents"), kind)
    return out.select(
        "doc_id", (F.col("kind") == lm.HELD).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_files.write_and_read(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align(read(spark, sf_dir, "documents"), a, b)


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digests(conversations.damage(read(spark, sf_dir, "conversations")))


QUERIES = {
    "op1_segmentation": op1_segmentation,
    "op2_supervision": op2_supervision,
    "op3_imatch": op3_imatch,
    "op4_simhash": op4_simhash,
    "op5_winnowing": op5_winnowing,
    "op6_bpe": op6_bpe,
    "op7_token_counts": op7_token_counts,
    "op8_warc": op8_warc,
    "op9_bytes": op9_bytes,
    "op10_interpolation": op10_interpolation,
    "op11_token_files": op11_token_files,
    "op12_alignment": op12_alignment,
    "op13_conversations": op13_conversations,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_TERMS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda t: t <> ''))"
_SUBSETS = ", ".join(
    f"coalesce(left(md5(string_agg(t, ' ' ORDER BY t) FILTER (WHERE substring(md5(t), {3 * seed + 1}, 3) < '{bound}')), 6), '-')"
    for seed in range(imatch.SEEDS)
    for bound in imatch.BOUNDS
)
_IMATCH = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
e AS (
  SELECT doc_id, text, n, coalesce(lead(text) OVER o, first_value(text) OVER o) AS after,
    coalesce(lead(doc_id) OVER o, first_value(doc_id) OVER o) AS next_id
  FROM d WINDOW o AS (ORDER BY doc_id, text)
),
f AS (SELECT doc_id, next_id, n, text, left(text, n - n // 2) || left(after, n // 2) AS edited FROM e),
forms AS (SELECT doc_id, 0 AS form, text FROM f UNION ALL SELECT doc_id, 1, edited FROM f),
each AS (SELECT doc_id, form, unnest({terms}) AS t FROM forms),
once AS (SELECT DISTINCT text FROM d),
lex AS (
  SELECT t FROM (SELECT unnest({terms}) AS t FROM once) GROUP BY t
  HAVING count(*) BETWEEN {low} * (SELECT count(*) FROM once) AND {high} * (SELECT count(*) FROM once)
),
signed AS (
  SELECT doc_id, form, [left(md5(string_agg(t, ' ' ORDER BY t)), 6), {subsets}] AS sig
  FROM each JOIN lex USING (t) GROUP BY doc_id, form
),
sigs AS (
  SELECT doc_id, form, coalesce(sig, list_concat([left(md5('=' || text), 6)], list_transform(range({n}), lambda i: '-'))) AS sig
  FROM forms LEFT JOIN signed USING (doc_id, form)
)
SELECT f.doc_id, CAST(n AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256,
  array_to_string(a.sig, ':') AS fingerprint, array_to_string(b.sig, ':') AS edited_fingerprint,
  CAST(len(list_filter(list_zip(a.sig, b.sig), lambda x: x[1] = x[2] AND x[1] <> '-')) AS DOUBLE)
    / len(list_filter(list_zip(a.sig, b.sig), lambda x: x[1] <> '-' OR x[2] <> '-')) AS near_edited,
  CAST(len(list_filter(list_zip(a.sig, c.sig), lambda x: x[1] = x[2] AND x[1] <> '-')) AS DOUBLE)
    / len(list_filter(list_zip(a.sig, c.sig), lambda x: x[1] <> '-' OR x[2] <> '-')) AS near_next
FROM f JOIN sigs a ON a.doc_id = f.doc_id AND a.form = 0 JOIN sigs b ON b.doc_id = f.doc_id AND b.form = 1
JOIN sigs c ON c.doc_id = f.next_id AND c.form = 0
"""

ORACLE_SQL: dict[str, str] = {
    "op3_imatch": _IMATCH.format(
        terms=_TERMS.format("text"), low=imatch.LOW, high=imatch.HIGH, subsets=_SUBSETS, n=imatch.SEEDS * len(imatch.BOUNDS)
    ),
    "op5_winnowing": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(list_slice(w, p, p + 9), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0)
),
grams AS (
  SELECT doc_id, k, p, array_to_string(list_slice(w, p, p + k - 1), ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)
),
found AS (SELECT doc_id, grams.k, p, item_id FROM grams JOIN windows ON grams.k = windows.k AND grams.g = windows.g),
hit AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM found) GROUP BY doc_id),
item AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(item.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN item USING (doc_id)
""",
    "op8_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS n, upper(sha1(payload)) AS h FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS keep FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((CAST('0x' || substring(h, 5 * (i // 4) + 1, 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM k
""",
    "op13_conversations": r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
  FROM conversations
),
fated AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(key) + 1), lambda i: ascii(substring(key, i, 1))::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)),
    4294967295) % 20 AS fate
  FROM keyed
),
kept AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM fated WHERE fate <> 0
),
spoken AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said, md5(length(role) || ':' || role || text) AS digest FROM kept),
ordered AS (
  SELECT *, row_number() OVER w AS n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, left(role, 1) AS initial,
    lag(left(role, 1)) OVER w AS before
  FROM spoken WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest, copy)
),
faults AS (
  SELECT *, CASE WHEN said = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'fine' END AS fault
  FROM ordered
),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS size
  FROM faults GROUP BY conv_id
),
ins AS (SELECT * FROM (VALUES (0,0,0,''),(1,1,0,''),(2,2,0,''),(3,3,0,''),(0,2,2,'I'),(1,2,2,'I'),(3,2,2,'I'),(2,3,2,'I'),(0,3,4,'II'),(1,3,4,'II')) AS t(i, j, c, e)),
moves AS (SELECT * FROM (VALUES ('s',0,1),('u',0,2),('u',1,2),('u',3,2),('a',2,3)) AS t(role, i, j)),
cases AS (SELECT DISTINCT initial, fault FROM faults),
edit AS (
  SELECT initial, fault, i, i AS j, 3 AS c, 'D' AS e FROM cases, (SELECT unnest([0, 1, 2, 3]) AS i)
  UNION ALL SELECT initial, fault, i, j, CAST(fault = 'truncated' AS INT), 'K' FROM cases JOIN moves ON role = initial WHERE fault IN ('truncated', 'fine')
  UNION ALL SELECT initial, fault, i, j, 2 + CAST(fault = 'truncated' AS INT), 'R' FROM cases, moves WHERE role <> 's' AND fault IN ('truncated', 'fine')
),
step AS (SELECT initial, fault, ins.i, edit.j, ins.c + edit.c AS c, ins.e || edit.e AS e FROM edit JOIN ins ON ins.j = edit.i),
dp AS (
  SELECT conv_id, 0::BIGINT AS n, 0 AS state, printf('%09d', 0) AS best FROM counts
  UNION ALL
  SELECT f.conv_id, f.n, s.j, min(printf('%09d', CAST(left(d.best, 9) AS INT) + s.c) || substring(d.best, 10) || s.e)
  FROM dp d JOIN faults f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.n = d.n + 1 JOIN step s ON s.initial = f.initial AND s.fault = f.fault AND s.i = d.state
  GROUP BY f.conv_id, f.n, s.j
),
cheapest AS (
  SELECT c.conv_id, min(printf('%09d', CAST(left(best, 9) AS INT) + ins.c) || substring(best, 10) || ins.e) AS best
  FROM dp JOIN counts c ON c.conv_id IS NOT DISTINCT FROM dp.conv_id AND c.size = dp.n JOIN ins ON ins.i = dp.state AND ins.j IN (0, 3) GROUP BY c.conv_id
),
audits AS (SELECT conv_id, CAST(left(best, 9) AS BIGINT) AS cost, substring(best, 10) AS audit FROM cheapest),
letters AS (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS k FROM audits),
placed AS (
  SELECT conv_id, substring(audit, k, 1) AS e, k, length(replace(left(audit, k), 'I', '')) AS n, length(replace(left(audit, k), 'D', '')) - 1 AS position,
    length(replace(audit, 'D', '')) % 2 AS odd
  FROM letters
),
lines AS (
  SELECT p.conv_id, k, CASE WHEN e = 'K' THEN role WHEN (position - odd) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END AS line
  FROM placed p LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.n = p.n AND e <> 'I' WHERE e <> 'D'
),
shas AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY k)) AS sha FROM lines GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
  coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN shas s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
""",
}
