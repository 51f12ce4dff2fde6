"""From raw documents to token ids, in five stages.

Every stage takes all that its predecessor kept, its decisions take effect, and what it
returns is written as Parquet and read again before the next one starts, so a lost executor
costs no more than the stage at work. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagekit.llm import bpe, decontaminate, langid, quality, simhash
from passagekit.llm.common import read, remainder, stored

#: A text goes if its language is unknown or less likely than this, or its quality lower.
LANGUAGE, QUALITY = 0.5, 0.3


def _apart(docs: DataFrame, *more: Column) -> DataFrame:
    """``doc_id``, ``text``, ``more`` and all other columns as one, whatever they are called."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others, F.lit(1).alias("_")).alias("_rest"), *more)


def _together(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*(F.col(c) if c in ("doc_id", "text") else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, null ones too, and of no likely language go."""
    path, rows = public_tokenizers.path("piece_bpe_32k.model"), _apart(docs)
    learn_from = F.coalesce(remainder("doc_id", 3) != 1, F.lit(True))
    model = langid.learn(docs, path, learn_from)
    kept = langid.identify(rows, model).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LANGUAGE))
    return _together(kept, docs)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts of low quality go."""
    net = quality.learn(docs, read(spark, sf_dir, "labels"), F.coalesce(remainder("doc_id", 5) != 0, F.lit(True)))
    return _together(quality.classify(_apart(docs), net).where(F.col("score") >= QUALITY), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the least id stays.

    Linked are texts whose five-word shingles have a similarity of 0.8 or more. Rows are told
    apart by their file and their place in it, also where ids repeat or are null (null ids
    count as least). A table that is not read from Parquet is written first, as numbers given
    while it is computed would depend on how it is dealt to tasks.
    """
    try:
        place = docs.metadataColumn("_metadata")
        rows = _apart(docs, F.struct(place["file_path"], place["row_index"]).alias("_row"))
    except AnalysisException:
        rows = stored(_apart(docs, F.monotonically_increasing_id().alias("_row")))
    gone = simhash.later_of_groups(rows.select("doc_id", "_row", "text"), "_row")
    return _together(rows.join(gone, "_row", "left_anti"), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window of words with a benchmark item go."""
    marked = decontaminate.contamination(_apart(docs), read(spark, sf_dir, "benchmark"))
    return _together(marked.where(F.size("hits") == 0), docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with a digest of what they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN, ["doc_id"])
    return bpe.decode(encoded, path).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("bytes", 256).alias("decoded_sha256")
    )


STAGES = [
    ("language_id", language_id),
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: Learned models and connected components are beyond SQL; the tests compare by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; the last one's rows."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
