"""Groups, splits, provenance, files in and out, streams."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from passagekit.operators import constraints, grouping, metrics, provenance, rows as row_operators, splits
from passagekit.sources import readers, writers
from passagekit.streaming import passages

ENTRY = "image_path string, source_id string, leakage_group string, orig_source string, source string, source_sha256 string, image_sha256 string, pixel_sha256 string, source_pixel_sha256 string, duplicate_source_sha256 array<string>, split string"


def entry(i, group, split, **more):
    row = dict(image_path=f"p{i}.jpg", source_id=f"s{i}", leakage_group=group, orig_source=None, source="x", source_sha256=f"a{i}", image_sha256=f"b{i}", pixel_sha256=f"c{i}", source_pixel_sha256=None, duplicate_source_sha256=[], split=split)
    return tuple({**row, **more}.values())


def test_split_rules(spark):
    good = [entry(1, "g1", "train"), entry(2, "g1", "train"), entry(3, "g2", "val")]
    df = lambda rows: spark.createDataFrame(rows, ENTRY)
    assert constraints.entry_violations(df(good)).count() == 0
    constraints.require_none(constraints.entry_violations(df(good)))
    bad = [entry(4, "g2", "train"), entry(3, "g9", "test"), entry(5, "g5", "val", duplicate_source_sha256=["a1"]), entry(6, "g6", "held")]
    rules = {(r.rule, r.key) for r in constraints.entry_violations(df(good + bad)).collect()}
    assert {("leakage_group", "g2"), ("source_id", "s3"), ("content", "a1"), ("content", "c3"), ("repeated", "p3.jpg"), ("split", "held")} <= rules
    with pytest.raises(ValueError):
        constraints.require_none(constraints.entry_violations(df(good + bad)))


def test_seeded_split_does_not_depend_on_order(spark):
    rows = [(f"g{i % 20}", i) for i in range(60)]
    one = splits.by_seeded_order(spark.createDataFrame(rows, "leakage_group string, i int"))
    two = splits.by_seeded_order(spark.createDataFrame(random.Random(1).sample(rows, 60), "leakage_group string, i int").repartition(5))
    assert sorted(one.collect()) == sorted(two.collect())
    n = {r.split: r.n for r in one.select("leakage_group", "split").distinct().groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert n == {"val": 3, "test": 3, "train": 14}
    with pytest.raises(ValueError):
        splits.by_seeded_order(one, 0.0)


def test_filling_keeps_groups_whole_and_shares_near(spark):
    rows = [(f"g{g}", i) for g in range(30) for i in range(1 + g % 5)]
    out = splits.by_filling(spark.createDataFrame(rows, "leakage_group string, i int"))
    assert out.groupBy("leakage_group").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    n = {r.split: r.n for r in out.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert n["train"] / len(rows) == pytest.approx(0.7, abs=0.06) and n["val"] and n["test"]
    with pytest.raises(Exception, match="cannot fill"):
        splits.by_filling(spark.createDataFrame([("a", 1)], "leakage_group string, i int")).collect()


def test_balanced_selection(spark):
    indian = spark.createDataFrame([(f"i{i}", f"s{i}", "g0" if i < 30 else f"g{i}", "train" if i < 33 else "val") for i in range(36)], "image_path string, source_id string, leakage_group string, split string")
    reviews = spark.createDataFrame([("h1", "k1", "train", []), ("h2", "k2", "test", []), ("h3", "k2", "train", []), ("h4", "k4", "train", [("val", "z")]), ("h5", "k5", "val", [("val", "y")]), ("h6", "k6", "train", [("train", "u"), ("train", "v")])], "source_id string, leakage_group string, split string, matches array<struct<split string, leakage_group string>>")
    reasons = {r.source_id: (r.reason or "")[:24] for r in splits.eligibility(reviews).collect()}
    assert reasons == {"h1": "", "h2": "reserved_historical_test", "h3": "reserved_historical_test", "h4": "cross_dataset_identity_c", "h5": "", "h6": "cross_dataset_group_need"}
    augmented = splits.variants(spark.createDataFrame([("h1",), ("h5",), ("h2",)], "source_id string")).withColumn("image_path", F.concat_ws("-", "source_id", "condition", "severity"))
    assert splits.incomplete_variants(augmented).count() == 0 and splits.incomplete_variants(augmented.where("severity <> 'mild'")).count() == 3
    out = splits.balanced(indian, reviews, augmented, cap=20)
    n = {(r.training_domain, r.split): r.n for r in out.groupBy("training_domain", "split").agg(F.count("*").alias("n")).collect()}
    assert n == {("indian_source", "train"): 23, ("indian_source", "val"): 3, ("legacy_synthetic", "train"): 13, ("legacy_synthetic", "val"): 13}
    assert {r.leakage_group for r in out.where("source_id = 'h5'").collect()} == {"y"}


def test_groups_over_all_kinds_of_links(spark):
    rows = [
        (1, "p1", 0, ["KA01AB1234"], None), (2, "p2", 1 << 40, ["KA01AB1234"], None), (3, "p3", (1 << 40) | 7, [], None), (4, "p1", 1 << 62, [], None),
        (5, "p5", -1, ["SHORT"], "v"), (6, "p6", 0x0F0F0F0F0F0F0F0F, ["SHORT"], "v"), (7, "p7", None, [], None),
    ]
    df = spark.createDataFrame(rows, "id int, pixel_sha256 string, dhash bigint, identities array<string>, sequence string")
    got = {r.id: r.root for r in grouping.leakage_groups(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 7}
    pairs = {(r.a, r.b, r.distance) for r in grouping.near_duplicates(df).collect()}
    assert pairs == {(1, 2, 1), (1, 3, 4), (1, 4, 1), (2, 3, 3), (2, 4, 2)}
    with pytest.raises(ValueError):
        grouping.near_duplicates(df, bits=5)
    copies = spark.createDataFrame([("h", "A"), ("h", "B"), ("i", None), ("i", None)], "pixel_sha256 string, text string")
    assert [r.pixel_sha256 for r in grouping.conflicting_copies(copies).collect()] == ["h"]


def test_names_of_groups(spark):
    members = spark.createDataFrame([(1, f"h{i % 50}") for i in range(120)] + [(2, "a"), (2, "b"), (2, "a")], "root int, pixel_sha256 string")
    import hashlib

    names = {r.root: r.leakage_group for r in grouping._names(members).collect()}
    assert names[2] == hashlib.sha256(b"a\nb").hexdigest()
    assert names[1] == hashlib.sha256("\n".join(sorted(f"h{i}" for i in range(50))).encode()).hexdigest()


def test_one_name_at_every_size(spark):
    """Above 100 000 distinct hashes a group is named as below: by its sorted hashes."""
    import hashlib

    n = 100_500
    members = spark.range(n + 50).selectExpr("1 AS root", f"concat('h', id % {n}) AS pixel_sha256")
    more = spark.createDataFrame([(2, "b"), (2, "a"), (2, None), (3, None), (None, "x")], "root int, pixel_sha256 string")
    got = {r.root: r.leakage_group for r in grouping._names(members.unionByName(more)).collect()}
    named = lambda hashes: hashlib.sha256("\n".join(sorted(hashes)).encode()).hexdigest()
    assert got == {1: named(f"h{i}" for i in range(n)), 2: named("ab"), 3: named([])}


def test_row_filters(spark):
    box = "array<struct<text string>>"
    df = spark.createDataFrame([("a", [("x",)], True), ("b", [], None), ("c", [("x",), (None,)], False), ("d", [("",)], None)], f"image_path string, boxes {box}, full_image_labels_verified boolean")
    names = lambda d: sorted(r.image_path for r in d.collect())
    assert names(row_operators.transcribed(df)) == ["a"] and names(row_operators.transcribed(df, True)) == ["a", "b", "d"]
    assert names(row_operators.unverified(df)) == ["c"] and names(row_operators.first_rows(df, 2, "image_path")) == ["a", "b"]


def test_other_rules(spark):
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 5.0, 5.0), (2, 5.0, 0.0, 5.0, 5.0), (3, None, 0.0, 5.0, 5.0), (4, 0.0, 0.0, 11.0, 5.0)], "image_id int, x1 double, y1 double, x2 double, y2 double").withColumns({"width": F.lit(10), "height": F.lit(10)})
    assert {r.key for r in constraints.invalid_boxes(boxes).collect()} == {"2", "3", "4"}
    child, parent = spark.createDataFrame([("a",), ("b",)], "source_id string"), spark.createDataFrame([("a",)], "source_id string")
    assert [r.key for r in constraints.orphans(child, parent, "source_id").collect()] == ["b"]
    whole = splits.variants(parent)
    assert constraints.variant_violations(whole).count() == 0 and constraints.variant_violations(whole.where("severity <> 'none'")).count() == 1


def test_provenance(spark):
    seen = provenance.seen(spark.createDataFrame([entry(1, "g1", "train", duplicate_source_sha256=["dup"]), entry(2, "g2", "test")], ENTRY))
    record = provenance.as_record(seen).first()
    assert record.source_sha256 == ["a1", "dup"] and record.leakage_groups == ["g1"]
    new = [entry(3, "g3", "test"), entry(4, "g1", "test"), entry(5, "g5", "test", source_sha256="dup"), entry(6, "g2", "test")]
    assert {r.image_path for r in provenance.leaked(spark.createDataFrame(new, ENTRY), seen).collect()} == {"p4.jpg", "p5.jpg"}
    assert provenance.union_of([seen, seen]).count() == seen.count()


def test_manifest_and_listing(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"image_path": "a\\b.jpg", "boxes": [{"xmin": 1, "ymin": 2, "xmax": 3, "ymax": 4, "text": None}], "extra": 1}, {"image_path": "c.jpg", "boxes": []}]))
    rows = readers.manifest(spark, str(tmp_path / "m.json"))
    assert [r.image_path for r in rows.orderBy("image_path").collect()] == ["a/b.jpg", "c.jpg"]
    parts = writers.subsets(rows)
    assert [r.image_path for r in parts["ocr"].collect()] == ["c.jpg"]
    (tmp_path / "e.json").write_text("[]")
    with pytest.raises(ValueError):
        readers.manifest(spark, str(tmp_path / "e.json"))
    d = tmp_path / "files" / "deep"
    d.mkdir(parents=True)
    for name in ("f_1.JPG", "f_2.jpg", "f_10.jpg", "x.xml", "notes.md"):
        (d / name).write_text(name)
    files = readers.listing(spark, str(tmp_path / "files"))
    assert {r.kind: r["count"] for r in files.groupBy("kind").count().collect()} == {"image": 3, "annotation": 1, "other": 1}
    assert [r.frame_idx for r in readers.frames(files, "f_", 2, 10).collect()] == [2, 10]
    assert readers.newest(spark.createDataFrame([("a", 1), ("c", 2), ("b", 2)], "path string, modificationTime int")).first().path == "c"
    text = spark.createDataFrame([(f"/x/{i}.txt", "abc") for i in range(5)] + [("/y.md", "q")], "path string, text string")
    shown = {r.suffix: (r.files, len(r.samples)) for r in readers.preview(text, 3, 2).collect()}
    assert shown == {".txt": (5, 3), ".md": (1, 1)}


def test_pairing_of_images(spark):
    notes = spark.createDataFrame([("/d/1.xml", "One.jpg"), ("/d/2.xml", "two.png"), ("/d/3.xml", "none.jpg"), ("/e/1.xml", "One.jpg")], "path string, filename string")
    images = spark.createDataFrame([("/d/One.jpg",), ("/d/TWO.jpg",), ("/d/Two.jpeg",)], "path string")
    got = {r.path: (r.image, r.candidates) for r in readers.pair_images(notes, images).collect()}
    assert got == {"/d/1.xml": ("/d/One.jpg", 1), "/d/2.xml": ("/d/TWO.jpg", 2), "/d/3.xml": (None, 0), "/e/1.xml": (None, 0)}
    a, b = (spark.createDataFrame([(1, "x"), (2, "y")], "number int, v string") for _ in range(2))
    assert {(r.number, r.annotation_v) for r in readers.pair_by_position(a, b, {1: 2, 2: 1}).collect()} == {(1, "y"), (2, "x")}


def test_voc_and_label_round_trips(spark, tmp_path):
    box = "struct<name string, xmin double, ymin double, xmax double, ymax double, text string>"
    rows = [("a.jpg", 100, 50, [("plate", 10.0, 10.0, 60.0, 30.0, "KA01"), ("plate", 1.0, 1.0, 9.0, 9.0, None)]), ("b.jpg", 10, 10, [])]
    df = spark.createDataFrame(rows, f"filename string, width int, height int, boxes array<{box}>")
    writers.write_voc(df, str(tmp_path / "voc"))
    back = {r.filename: r for r in readers.voc(spark, str(tmp_path / "voc")).collect()}
    assert [(b.xmin, b.text) for b in back["a.jpg"].boxes] == [(10.0, "KA01"), (1.0, None)] and back["b.jpg"].boxes == []
    flat = spark.createDataFrame([(1, 0, 10, 10, 60, 30, 100, 50), (1, 1, 99, 0, 140, 50, 100, 50)], "image_id int, ord int, x1 int, y1 int, x2 int, y2 int, width int, height int")
    content = writers.label_files(flat).first().content
    assert content == "0 0.350000 0.400000 0.500000 0.400000"
    assert flat.select(writers.label_line_uncut(tuple(F.col(c) for c in ("x1", "y1", "x2", "y2")), F.col("width"), F.col("height")).alias("l")).first().l == "0 0.350000000 0.400000000 0.500000000 0.400000000"
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels" / "1.txt").write_text(content + "\n1 0.5 0.5 0.1 0.1\n0 2 0 0 0\nx\n")
    assert sorted(r.valid for r in readers.labels(spark, str(tmp_path / "labels")).collect()) == [False, False, False, True]


def test_builds_are_named_by_content_and_verified(spark, tmp_path):
    df = spark.createDataFrame([entry(1, "g1", "train"), entry(2, "g2", "val")], ENTRY)
    rules = constraints.entry_violations(df)
    folder = writers.publish(df, rules, str(tmp_path), {"v": 1})
    assert writers.publish(df.repartition(3), rules, str(tmp_path), {"v": 1}) == folder
    assert writers.build_id(df, {"v": 2}) not in folder and json.loads((tmp_path / "current.json").read_text())["build"] in folder
    with pytest.raises(ValueError):
        writers.write_manifest(df, spark.createDataFrame([("r", "k")], "rule string, key string"), str(tmp_path / "no"))
    files = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"2"))], "path string, content binary")
    inventory = writers.inventory(files)
    assert writers.inventory_problems(inventory, inventory).count() == 0
    other = spark.createDataFrame([("a", "x"), ("c", "y")], "path string, digest string")
    assert {(r.path, r.problem) for r in writers.inventory_problems(inventory, other).collect()} == {("a", "changed"), ("b", "unexpected"), ("c", "missing")}
    writers.write_provenance(df, str(tmp_path / "seen"))
    assert spark.read.json(str(tmp_path / "seen")).first().source_ids == ["s1", "s2"]


def test_resuming_needs_the_same_input(spark, tmp_path):
    spark.createDataFrame([("p1", "f")], "image_path string, fingerprint string").write.json(str(tmp_path / "r"))
    done = readers.resumable(spark, str(tmp_path / "r"), "image_path string, fingerprint string", "f")
    rest = provenance.remaining(spark.createDataFrame([("p1",), ("p2",)], "image_path string"), done, ["image_path"])
    assert [r.image_path for r in rest.collect()] == ["p2"]
    with pytest.raises(ValueError):
        readers.resumable(spark, str(tmp_path / "r"), "image_path string, fingerprint string", "other")


def test_metrics_on_nothing(spark):
    none = spark.createDataFrame([], "image_id bigint, target_id bigint, outcome string")
    r = metrics.outcome_summary(none).first()
    assert r.targets == 0 and r.exact_accepted_fraction is None


FRAME = "ts timestamp, track_id bigint, frame_idx bigint, sharpness double, proposed_text string, ocr_confidence double, format_score double, value double"


def test_streams_equal_batches_on_closed_tracks(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for track in range(6):
        for i in range(rng.randrange(3, 15)):
            rows.append((f"2024-01-01 00:{track * 3:02d}:{i:02d}", track, i, rng.uniform(0, 99), "KA01AB1234", 0.9, 1.0, 1.0))
    late = [("2024-01-02 00:00:00", 99, 0, 1.0, "X", 0.5, 1.0, 1.0), ("2024-01-02 05:00:00", 99, 1, 1.0, "X", 0.5, 1.0, 1.0)]
    src = str(tmp_path / "in")
    as_df = lambda r: spark.createDataFrame(r, FRAME.replace("ts timestamp", "ts string")).withColumn("ts", F.to_timestamp("ts"))
    for part in (rows[: len(rows) // 2], rows[len(rows) // 2 :], late[:1], late[1:]):
        as_df(part).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(as_df(rows).schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = passages.stream_passages(stream, "1 minute", 60_000)
    q = out.writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r.track_id, r.frame_idx, r.frames, r.last_frame) for r in spark.table("closed").where("track_id < 99").collect()}
    from passagekit.operators.fuse import sharpest

    best = sharpest(as_df(rows)).select("track_id", "frame_idx")
    span = as_df(rows).groupBy("track_id").agg(F.count("*").alias("n"), F.max("frame_idx").alias("last"))
    assert got == {(r.track_id, r.frame_idx, r.n, r.last) for r in best.join(span, "track_id").collect()}


def test_scorers_are_checked(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    ok = passages.score_with(df, lambda: lambda pdf: pdf.assign(y=pdf.x * 2)[["y"]], "y double")
    assert sorted(r.y for r in ok.collect()) == [2.0, 4.0]
    for wrong in (lambda pdf: pdf.head(0).assign(y=1.0)[["y"]], lambda pdf: pdf.assign(y=float("nan"))[["y"]]):
        with pytest.raises(Exception, match="scorer gave"):
            passages.score_with(df.coalesce(1), lambda wrong=wrong: wrong, "y double").collect()
