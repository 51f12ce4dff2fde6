"""One group with most of the rows: caps, reviews, members and dates against plain versions."""

from __future__ import annotations

import hashlib
from collections import defaultdict

from passagekit import constants as C
from passagekit.operators import grouping, splits


def test_cap_of_a_hot_group(spark):
    rows = [("hot" if i % 3 else f"g{i % 40}", f"p{i}") for i in range(3000)] + [(None, f"n{i}") for i in range(60)]
    rows += [("hot", "p1")]  # a path that repeats
    got = splits.group_cap(spark.createDataFrame(rows, "leakage_group string, image_path string"), 20).where("kept").collect()
    want = defaultdict(list)
    for g, p in sorted(rows, key=lambda r: (hashlib.sha256((C.CAP_SALT + r[1]).encode()).hexdigest(), r[1])):
        want[g].append(p)
    assert sorted(((r[0] or "", r[1]) for r in got)) == sorted((g or "", p) for g, ps in want.items() for p in ps[:20])
    assert splits.group_cap(spark.createDataFrame([], "leakage_group string, image_path string")).columns == ["leakage_group", "image_path", "kept"]


def test_the_second_window_meets_few_rows_of_a_group(spark, monkeypatch):
    monkeypatch.setattr(splits, "SHARES", 4)
    rows = [("hot", f"p{i}") for i in range(500)]
    assert splits.group_cap(spark.createDataFrame(rows, "leakage_group string, image_path string"), 7).where("kept").count() == 7


def test_reviews_of_null_and_crossing_groups(spark):
    match = "array<struct<split: string, leakage_group: string>>"
    rows = [
        ("a", None, "train", None), ("b", None, "train", [("train", "m")]), ("c", "", "val", []), ("d", "x", "train", None), ("e", "x", "val", None),
        ("f", "y", "test", None), ("g", "y", "train", None), ("h", "z", None, None), ("i", "w", "val", [("train", "m")]), ("j", "v", "val", [("val", "m"), ("val", "n")]),
    ]
    got = {r.source_id: ((r.reason or "").split("_")[0], r.joins) for r in splits.eligibility(spark.createDataFrame(rows, f"source_id string, leakage_group string, split string, matches {match}")).collect()}
    assert got == {
        "a": ("", None), "b": ("", "m"), "c": ("", ""), "d": ("historical", "x"), "e": ("historical", "x"), "f": ("reserved", "y"), "g": ("reserved", "y"),
        "h": ("historical", "z"), "i": ("cross", "m"), "j": ("cross", "m"),
    }


def test_members_and_dates(spark):
    rows = spark.createDataFrame([(1, 5, "p", "20240101"), (2, 5, "p", "20240101"), (3, 5, "q", "2024-01-01"), (4, 6, None, "20240102"), (5, None, "p", None), (6, 6, None, "20240101")], "id int, dhash long, px string, folder string")
    assert sorted(map(tuple, grouping.members(rows, pixels="px").collect())) == [(1, 5, 1, False), (2, 5, 1, False), (3, 5, 1, True), (4, 6, 4, False), (6, 6, 4, False)]
    assert sorted(map(tuple, grouping.members(rows).collect()))[0] == (1, 5, 1)
    assert sorted(map(tuple, grouping.same_date(rows).collect())) == [(1, 2), (1, 6)]
