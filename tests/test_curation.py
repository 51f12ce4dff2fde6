"""Annotations under a policy: each rule by hand, and that nothing is written against one."""

from __future__ import annotations

import pytest

from passagekit.operators import curation
from passagekit.sources.writers import write_manifest

NOTE = "annotation string, filename string, width int, height int, objects array<struct<name: string, bndbox: struct<xmin: double, ymin: double, xmax: double, ymax: double>>>"
IMAGE, POLICY = "image string, width int, height int", "rule string, key string, value string"
BOX = (1.0, 2.0, 9.0, 8.0)


def inspect(spark, notes, images, policy=()):
    frames = spark.createDataFrame(list(notes), NOTE), spark.createDataFrame(list(images), IMAGE), spark.createDataFrame(list(policy), POLICY)
    return {k: sorted(map(tuple, df.collect()), key=repr) for k, df in curation.inspect(*frames).items()}


def good(name="a/x.xml", file="x.jpg", objects=(("KA01AB1234", BOX),), size=(10, 10)):
    return (name, file, *size, list(objects) if objects is not None else None)


CASES = [  # annotation, images, policy, rules violated; all in folder a
    (good(), [("a/x.jpg", 10, 10)], [], []),
    (good(file="C:\\in\\x.jpg"), [("a/x.jpg", 10, 10)], [], []),
    (good(), [("a/b/x.jpg", 10, 10)], [], ["missing_image", "unannotated_image"]),
    (good(), [], [("missing_image", "a/x.xml", None)], []),
    (good(file="y.jpg"), [("a/X.png", 10, 10)], [], ["filename"]),
    (good(file="y.jpg"), [("a/X.png", 10, 10)], [("filename_repair", "a/x.xml", "X.png")], []),
    (good(file="y.jpg"), [("a/X.png", 10, 10)], [("filename_repair", "a/x.xml", "x.png")], ["filename"]),
    (good(file=None), [("a/x.png", 10, 10), ("a/x.jpg", 10, 10)], [], ["ambiguous_image", "unannotated_image"]),
    (good(size=(10, 20)), [("a/x.jpg", 10, 10)], [], ["dimensions"]),
    (good(size=(10, 20)), [("a/x.jpg", 10, 10)], [("dimension_repair", "a/x.xml", "10x20>10x10")], []),
    (good(size=(10, 20)), [("a/x.jpg", 10, 10)], [("dimension_repair", "a/x.xml", "10x21>10x10")], ["dimensions"]),
    (good(size=(None, 10)), [("a/x.jpg", 10, 10)], [], ["dimensions"]),
    (good(objects=()), [("a/x.jpg", 10, 10)], [], ["empty_annotation"]),
    (good(objects=None), [("a/x.jpg", 10, 10)], [], ["empty_annotation"]),
    (good(objects=[("KA01AB1234", None)]), [("a/x.jpg", 10, 10)], [], ["missing_box"]),
    (good(objects=[("KA01AB1234", (1.0, None, 9.0, 8.0))]), [("a/x.jpg", 10, 10)], [], ["box"]),
    (good(objects=[("KA01AB1234", (1.0, 2.0, float("nan"), 8.0))]), [("a/x.jpg", 10, 10)], [], ["box"]),
    (good(objects=[("KA01AB1234", (5.0, 2.0, 5.0, 8.0))]), [("a/x.jpg", 10, 10)], [], ["box"]),
    (good(objects=[(None, BOX)]), [("a/x.jpg", 10, 10)], [], ["label"]),
    (good(objects=[("plate", BOX)]), [("a/x.jpg", 10, 10)], [("detection_only", "PLATE", "no text")], []),
    (good(), [("a/x.jpg", 10, 10), ("a/x.jpg", 10, 10)], [], ["repeated_image"]),
]


def test_rules(spark):
    """All cases in one run, each in a folder of its own."""
    notes, images, policy = [], [], [("detection_only", "A", "one"), ("detection_only", "A", "two")]
    for i, (note, pictures, decisions, _) in enumerate(CASES):
        place = lambda path, i=i: path.replace("a/", f"c{i}/", 1)
        notes.append((place(note[0]), *note[1:]))
        images += [(place(p[0]), *p[1:]) for p in pictures]
        policy += [(d[0], place(d[1]), d[2]) for d in decisions]
    found = inspect(spark, notes, images, policy)["violations"]
    want = {(rule, f"c{i}") for i, case in enumerate(CASES) for rule in case[3]}
    assert {(rule, key.split("/")[0]) for rule, key in found} == want | {("policy", "detection_only:A")}


def test_an_excluded_label_takes_its_whole_annotation(spark):
    notes = [good(objects=[("KA01AB1234", BOX), ("blurred", BOX)]), good("a/z.xml", "z.jpg", [("MH 12-99", BOX), ("plate", BOX)])]
    policy = [("exclude_label", "BLURRED", "unreadable"), ("detection_only", "PLATE", "no text"), ("identity_alias", "MH1299", "MH1290")]
    got = inspect(spark, notes, [("a/x.jpg", 10, 10), ("a/z.jpg", 10, 10)], policy)
    assert got["violations"] == [] and got["repairs"] == []
    assert got["exclusions"] == [("annotation", "a/x.xml", "unreadable")]
    assert [(b[2], b[7], b[8], b[9], b[10], b[11]) for b in got["boxes"]] == [(0, "MH 12-99", "MH1299", "transcribed", None, "MH1290"), (1, "plate", None, "detection_only", "no text", "PLATE")]


def test_nothing_is_written_against_a_rule(spark, tmp_path):
    frames = spark.createDataFrame([good(objects=[("plate", BOX)])], NOTE), spark.createDataFrame([("a/x.jpg", 10, 10)], IMAGE), spark.createDataFrame([], POLICY)
    out = tmp_path / "manifest"
    with pytest.raises(ValueError, match="label"):
        write_manifest(frames[0].selectExpr("annotation", "'train' AS split"), curation.inspect(*frames)["violations"], str(out))
    assert not out.exists()


def test_a_policy_beyond_the_broadcast_gives_the_same(spark, monkeypatch):
    args = [good(file="y.jpg")], [("a/X.png", 10, 10)], [("filename_repair", "a/x.xml", "X.png")]
    small = inspect(spark, *args)
    monkeypatch.setattr(curation, "MAX_POLICY", 0)
    assert inspect(spark, *args) == small and small["repairs"] == [("a/x.xml", "filename", "y.jpg", "X.png")]


def test_empty_tables_and_clashing_columns(spark):
    assert not any(inspect(spark, [], []).values())
    frames = spark.createDataFrame([good()], NOTE).selectExpr("*", "1 AS found", "2 AS image", "3 AS stem"), spark.createDataFrame([("a/x.jpg", 10, 10)], IMAGE).selectExpr("*", "1 AS name"), spark.createDataFrame([], POLICY)
    assert curation.inspect(*frames)["boxes"].count() == 1
