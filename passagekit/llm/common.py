"""Helpers shared by the text operators: tables, the shared folder, Arrow batches.

Nothing here swallows errors. Every folder an operator writes lies under
``spark.checkpoint.dir``, the one place drivers and executors share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from passagekit.plans.shared import shared_dir, stored

__all__ = ["add_columns", "read", "remainder", "sample_texts", "shared_dir", "small_batches", "stored"]

#: Characters of a sample of texts that a model is fitted on.
SAMPLE_CHARACTERS = 48 << 20
#: Rows and bytes of one Arrow batch handed to Python; bounds a worker's memory.
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table ``table`` of a data folder, whole."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and bytes, as texts may be very long. The bounds are the
    same for all operators, so plans that are built in any order and run later agree."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def add_columns(df: DataFrame, text_col: str, make: Callable[[], Callable[[list], list[pa.Array]]], schema: str, keep: list[str] | None = None) -> DataFrame:
    """``df`` with the columns of ``schema``, computed from its column ``text_col``.

    ``make()`` gives, once a task, a function from the texts of a batch to the new columns.
    ``keep``: the columns of ``df`` to return, all by default; they pass Python untouched.
    Columns of ``df`` named like new ones are replaced.
    """
    new = [f.name for f in StructType.fromDDL(schema)]
    kept = [f for f in df.schema if f.name not in new and (keep is None or f.name in keep)]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            if batch.num_rows:
                step = step or make()
                at = batch.schema.get_field_index
                added = step(batch.column(at(text_col)).to_pylist())
                yield pa.RecordBatch.from_arrays([*(batch.column(at(n)) for n in names), *added], names=[*names, *new])

    wanted = df.select(*dict.fromkeys([*names, text_col]))
    return wanted.mapInArrow(run, StructType([*kept, *StructType.fromDDL(schema)]))


def remainder(key: str, modulus: int):
    """crc32 of the key as text, modulo ``modulus``: the folds of the contracts."""
    return F.crc32(F.col(key).cast("string")) % F.lit(modulus)


def sample_texts(rows: DataFrame, most: int, id_col: str, text_col: str, characters: int = SAMPLE_CHARACTERS) -> DataFrame:
    """At most ``most`` of ``rows``, in order of id and text, and of those, in order of a hash
    of the id, as many whole texts as have ``characters`` characters together."""
    rows = rows.orderBy(id_col, text_col).limit(most)
    sums = F.sum(F.coalesce(F.length(text_col), F.lit(0))).over(Window.orderBy(F.xxhash64(id_col), id_col, text_col).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_sum", sums).where(F.col("_sum") <= characters).drop("_sum").orderBy(id_col, text_col)
