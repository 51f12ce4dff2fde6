"""A key with a third of all rows is dealt to several tasks: the executed plan tells."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from passagekit.operators import components, grouping

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def small_partitions(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def executed(df):
    df._jdf.collectToPython()
    return df._jdf.queryExecution().executedPlan().toString()


def hot(spark):
    """A third of the rows share one value; many input partitions, so that it can be cut."""
    return spark.range(0, 60_000, 1, 12).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 20_000).alias("v"))


def test_stars_and_aliases_split_a_hot_value(spark, small_partitions):
    rows = hot(spark)
    stars = grouping.stars(rows, "id", F.col("v"))
    assert "skew=true" in executed(stars)
    assert stars.where("a = 0").count() == 19_999
    aliases = grouping.aliases(rows.withColumnRenamed("v", "pixel_sha256").withColumnRenamed("id", "path"))
    assert "skewed" in executed(aliases)


def test_both_stars_of_components_split_a_hub(spark, small_partitions):
    edges = spark.range(1, 60_000, 1, 12).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") - 1).alias("a"), F.col("id").alias("b"))
    assert "skew=true" in executed(components._large_star(edges, components.split))
    inward = spark.range(0, 60_000, 1, 12).select(F.col("id").alias("a"), F.when(F.col("id") % 3 == 0, F.lit(10**6)).otherwise(F.col("id") + 1).alias("b"))
    assert "skew=true" in executed(components._small_star(inward, components.split))
