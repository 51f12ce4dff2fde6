"""Plate layouts by hand; nothing here reads a constant of the package."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagekit.functions import text as T
from passagekit.operators import select


def test_every_layout_fits_itself(spark):
    fits = {"KA01A1234": 1.0, "KA01AB1234": 1.0, "KA1A1234": 1.0, "KA1AB1234": 1.0, "KA012345": 0.7, "KA01A123": 1.0}
    rest = {"KA01A12": 0.7, "KA01": None, "K101A123": None, "KA01A12345": None}
    df = spark.createDataFrame([(t,) for t in [*fits, *rest]], "text string")
    got = {r.text: {f.proposal: f.score for f in r.f} for r in df.select("text", T.fits(F.col("text")).alias("f")).collect()}
    assert {t: got[t].get(t) for t in got} == fits | rest


def test_many_regions_keep_the_earliest_span(spark):
    """The same plate twice among 1500 regions: the first occurrence stands for it."""
    regions = [(1, i, "x" * 15, 0.9) for i in range(1500)]
    regions[7] = (1, 7, "KA01A123", 0.95)
    regions[1400] = (1, 1400, "KA01A123", 0.95)
    df = spark.createDataFrame(regions, "image_id int, ord int, text string, conf double")
    cleaned = select.clean_regions(df)
    spans = select.spans(cleaned, "image_id").where("text = 'KA01A123'").orderBy("start").collect()
    assert [(r.start, r.stop) for r in spans] == [(7, 8), (1400, 1401)]
    assert select.spans(cleaned.where("ord < 30"), "image_id").count() == 1


def test_literals_among_regions(spark):
    rows = [(1, ["KA", "01", "A123"], "KA01"), (2, ["KA", "01A", "123"], "KA01"), (3, ["X"] * 300 + ["AB", "CD"], "ABCD"), (4, ["A"], ""), (5, ["A"], None)]
    parts = spark.createDataFrame([(k, i, t, e) for k, ts, e in rows for i, t in enumerate(ts)], "id int, ord int, text string, e string")
    assert {r.id: r.found for r in select.literal_found(parts, "id", "e").collect()} == {1: True, 2: False, 3: True, 4: False, 5: None}
