"""Saved reports and policies of several shapes, read as VARIANT values with typed paths.

A report is a JSON object per line. Its parts are named by paths, several for one part where
shapes differ; the first that a report has counts. No schema is fixed beforehand, so fields
that only some reports have cost nothing.

Lines that are no JSON (or repeat a key) have a null ``report`` and keep their ``line``;
`malformed` lists them, all else passes them by. Blank lines are no reports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str) -> DataFrame:
    """``(line, report)`` of the text files at ``path``."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.col("value").alias("line"), F.try_parse_json("value").alias("report"))


def malformed(reports: DataFrame) -> DataFrame:
    return reports.where("report IS NULL").select("line")


def part(paths: list[str], kind: str, report: str = "report") -> Column:
    """The first of ``paths`` that leads to something, as ``kind``; null where none does or
    it cannot be read as that."""
    return F.coalesce(*(F.try_variant_get(report, p, kind) for p in paths))


def counters(reports: DataFrame, paths: list[str], *by: str) -> DataFrame:
    """``(by..., counter, total)``: the objects of whole numbers at ``paths`` added up by
    name. A null counter adds nothing but is listed; one that is no whole number is an error
    of the query. Reports without such an object add nothing."""
    spark = reports.sparkSession
    found = reports.where("report IS NOT NULL").select(*by, part(paths, "variant").alias("counts"))
    spread = found.alias("r").lateralJoin(spark.tvf.variant_explode(F.col("counts").outer()).alias("c"))
    # 1.5 would be cut to 1 by a cast, so the number is compared with what it is cut to.
    exact = F.variant_get("c.value", "$", "double")
    whole = exact.cast("bigint")
    number = F.when(exact.isNull() | (exact == whole), F.variant_get("c.value", "$", "bigint")).otherwise(F.raise_error(F.concat(F.lit("not a whole number: "), F.col("c.key"))))
    rows = spread.where("c.key IS NOT NULL").select(*(F.col(f"r.{b}").alias(b) for b in by), F.col("c.key").alias("counter"), number.alias("n"))
    return rows.groupBy(*by, "counter").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total"))


def of_other_input(reports: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Reports of which some path leads to another text than ``wanted`` gives, or to none:
    they were made for another input and can't be gone on from."""
    same = F.lit(True)
    for path, value in wanted.items():
        same &= F.try_variant_get("report", path, "string").eqNullSafe(F.lit(value))
    return reports.where("report IS NOT NULL").where(~same)
