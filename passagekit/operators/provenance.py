"""What a model has seen, and that an evaluation set holds nothing of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Identity columns of an entry and the kind of key each gives.
KINDS = {
    "source_id": "source_ids",
    "leakage_group": "leakage_groups",
    "image_sha256": "image_sha256",
    "source_sha256": "source_sha256",
    "duplicate_source_sha256": "source_sha256",
    "pixel_sha256": "pixel_sha256",
    "source_pixel_sha256": "pixel_sha256",
}


def keys_of(entries: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(*keep, kind, value)``: all identity keys of the entries, arrays unfolded, absent
    ones dropped. Columns that the entries lack are skipped."""
    array = lambda c: F.col(c) if entries.schema[c].dataType.simpleString().startswith("array") else F.array(c)

    def pairs_of(column: str, kind: str):
        return F.transform(array(column), lambda v: F.struct(F.lit(kind).alias("kind"), v.cast("string").alias("value")))

    pairs = [pairs_of(c, kind) for c, kind in KINDS.items() if c in entries.columns]
    all_ = F.concat(*(F.coalesce(p, F.expr("cast(array() as array<struct<kind string, value string>>)")) for p in pairs))
    return entries.select(*keep, F.explode(all_).alias("k")).select(*keep, "k.kind", "k.value").where("value IS NOT NULL AND value <> ''")


def seen(entries: DataFrame) -> DataFrame:
    """Distinct ``(kind, value)`` of everything fitted on or selected by: all but test rows."""
    return keys_of(entries.where(F.coalesce(F.col("split") != "test", F.lit(True)))).distinct()


def as_record(keys: DataFrame) -> DataFrame:
    """One row of sorted arrays, as it is written beside a checkpoint."""
    kinds = sorted(set(KINDS.values()))
    sets = (F.sort_array(F.collect_set(F.when(F.col("kind") == k, F.col("value")))).alias(k) for k in kinds)
    return keys.agg(*sets)


def union_of(records: list[DataFrame]) -> DataFrame:
    """Distinct keys over several checkpoints' keys."""
    return reduce(DataFrame.unionByName, records).distinct()


def leaked(entries: DataFrame, seen_keys: DataFrame, id_col: str = "image_path") -> DataFrame:
    """Ids of entries that share any key with what was seen (semi-join, each id once)."""
    return keys_of(entries, (id_col,)).join(seen_keys, ["kind", "value"], "left_semi").select(id_col).distinct()


def remaining(all_: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """What a resumed run still has to do."""
    return all_.join(done.select(*on).distinct(), on, "left_anti")


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(side, ...)`` rows that only one side has; empty for equal sets."""
    left, right = a.distinct(), b.distinct()
    only = lambda x, y, name: x.exceptAll(y).withColumn("side", F.lit(name))
    return only(left, right, "left").unionByName(only(right, left, "right"))


def coverage(left: DataFrame, right: DataFrame, key: str, equal: list[str]) -> DataFrame:
    """Keys that are not 1:1 between two tables or differ in a column: ``(key, problem)``."""
    l = left.groupBy(key).agg(F.count("*").alias("ln"), *(F.min(c).alias(f"l_{c}") for c in equal))  # noqa: E741
    r = right.groupBy(key).agg(F.count("*").alias("rn"), *(F.min(c).alias(f"r_{c}") for c in equal))
    differs = reduce(lambda a, b: a | b, (~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")) for c in equal), F.lit(False))
    problem = F.when(F.col("ln").isNull(), "only_right").when(F.col("rn").isNull(), "only_left").when((F.col("ln") > 1) | (F.col("rn") > 1), "repeated").when(differs, "differs")
    return l.join(r, key, "full_outer").select(key, problem.alias("problem")).where("problem IS NOT NULL")
