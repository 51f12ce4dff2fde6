"""The source of label shards: what is pushed, what is read, what is refused."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from passagekit.sources import detections


def shards(folder, rows, broken=()):
    for i, (label, line) in enumerate(rows):
        place = folder / f"class={label}"
        place.mkdir(parents=True, exist_ok=True)
        with open(place / f"part-{i % 3}.txt", "a") as f:
            f.write(line + "\n" * random.Random(i).choice([1, 1, 2]))
    for label, text in broken:
        (folder / f"class={label}").mkdir(parents=True, exist_ok=True)
        (folder / f"class={label}" / "part-9.txt").write_text(text)
    return str(folder)


def made(n=200):
    r = random.Random(5)
    return [(i % 4, f"{i} {i * 7} {r.random():.6f} 0.5 0.25 0.125 {r.randrange(100) / 100}") for i in range(n)]


def plain(rows):
    return sorted((int(f[0]), int(f[1]), label, *map(float, f[2:])) for label, line in rows for f in [line.split()])


@pytest.mark.parametrize("split_bytes", [1, 7, 100, 1 << 20])
def test_every_cut_gives_every_line_once(spark, tmp_path, split_bytes):
    rows = made(40 if split_bytes < 10 else 200)
    reader = detections.Reader(shards(tmp_path / "s", rows), split_bytes)
    got = [tuple(r.values()) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(got) == plain(rows)


def test_what_is_wanted_keeps_the_rows(spark, tmp_path):
    path, rows = shards(tmp_path / "s", made()), plain(made())
    df = detections.scan(spark, path, classes=(1, 3), confidence=0.35, images=(20, 150), split_bytes=500)
    want = [r for r in rows if r[2] in (1, 3) and r[7] >= 0.35 and 20 <= r[0] <= 150]
    assert sorted(map(tuple, df.collect())) == want
    assert sorted(map(tuple, df.where("xc < 0.5").collect())) == [r for r in want if r[3] < 0.5]
    assert detections.scan(spark, path, classes=()).count() == 0


def test_filters_of_one_query_do_not_reach_another(spark, tmp_path):
    df = detections.scan(spark, shards(tmp_path / "s", made()))
    one, two = df.where("class = 1"), df.where("class = 2")
    assert (one.count(), two.count(), df.count()) == (50, 50, 200)
    assert one.alias("a").join(two.alias("b"), F.expr("a.image = b.image - 1")).count() == 50


def test_folders_of_other_classes_are_not_planned(spark, tmp_path):
    path = shards(tmp_path / "s", made(), broken=[(8, "no labels at all\n")])
    assert {p[1] for r in detections.Reader(path, 100, frozenset({1, 2})).partitions() for p in r.parts} == {1, 2}
    assert detections.scan(spark, path, classes=range(4)).count() == 200
    with pytest.raises(Exception, match="not a line of labels"):
        detections.scan(spark, path).count()


@pytest.mark.parametrize("line", ["1 2 3", "1 2 .5 .5 .1 .1 nan", "x 2 .5 .5 .1 .1 .9", "1 2 .5 .5 .1 .1 .9 8"])
def test_bad_lines_are_refused_even_if_filtered(spark, tmp_path, line):
    with pytest.raises(Exception, match="not a line of labels"):
        detections.scan(spark, shards(tmp_path / "s", made(8), broken=[(1, line)]), confidence=2).count()


def test_empty_and_absent_folders(spark, tmp_path):
    (tmp_path / "e").mkdir()
    assert detections.scan(spark, str(tmp_path / "e")).count() == 0
    assert detections.scan(spark, str(tmp_path / "absent"), classes=[1]).count() == 0
    assert detections.scan(spark, shards(tmp_path / "s", made(9)), classes=[77]).count() == 0


def test_written_and_read_back(spark, tmp_path):
    boxes = spark.createDataFrame([(1, 10, 0, 0, 0, 60, 24, 0.5), (1, 11, 2, 590, 0, 700, 240, 0.25), (2, 12, 2, 5, 5, 6, 6, 0.9)], "image bigint, box bigint, class int, x1 int, y1 int, x2 int, y2 int, confidence double")
    path = f"file://{tmp_path}/w"
    detections.write(boxes, path, F.lit(600), F.lit(240))
    got = sorted(map(tuple, detections.scan(spark, path).collect()))
    assert [r[:3] for r in got] == [(1, 10, 0), (1, 11, 2)]
    assert got[0][3:] == (0.05, 0.05, 0.1, 0.1, 0.5)
    with pytest.raises(Exception, match="null in box"):
        detections.write(boxes.withColumn("box", F.lit(None).cast("bigint")), f"file://{tmp_path}/n", F.lit(600), F.lit(240))
