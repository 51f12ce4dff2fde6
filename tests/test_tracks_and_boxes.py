"""Fusion, association, matching and geometry: examples by hand and plain versions."""

from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from passagekit.functions import geometry as G
from passagekit.functions import text as T
from passagekit.functions import values as V
from passagekit.operators import associate, fuse, matching

OBS = "track_id bigint, frame_idx bigint, sharpness double, proposed_text string, ocr_confidence double, format_score double"


def obs(track, *rows):
    return [(track, i + 10, float(s), t, c, 1.0) for i, (t, c, s) in enumerate(rows)]


def test_fusion_examples(spark):
    rows = (
        obs(1, ("KA01AB1234", 0.94, 150), ("KA01A81234", 0.70, 30), ("KA01AB1234", 0.95, 180))
        + obs(2, *[("KA01AB1234", 0.9, 100), ("MH12CD5678", 0.9, 100)] * 2)
        + obs(3, ("", 0.5, 9), (None, 0.4, 12))
        + obs(4, ("KA01AB1234", 0.91, 50))
        + obs(5, ("KA01AB1234", 0.95, 50))
        + obs(6, ("PY036993", 0.99, 50), ("PY036993", 0.99, 50))
        + obs(7, ("KA01AB1234", 0.5, 50), ("KA01AB1234", 0.5, 50))
    )
    df = spark.createDataFrame(rows, OBS)
    tracks = spark.createDataFrame([(i,) for i in range(1, 9)], "track_id bigint")
    got = {r.track_id: r for r in fuse.fuse(df, tracks).collect()}
    one = got[1]
    assert (one.status, one.plate_text, one.agreement_count, one.sharpest_frame_idx, one.total_observations) == ("accepted", "KA01AB1234", 2, 12, 3)
    assert one.alternatives[0].text == "KA01AB1234" and one.alternatives[1].frame_count == 1
    assert (got[2].status, got[2].review_reason, got[2].conflicting_texts) == ("uncertain", "conflicting_temporal_readings", ["MH12CD5678"])
    assert (got[3].status, got[3].review_reason) == ("unreadable", "unreadable_in_all_frames")
    assert got[4].review_reason == "insufficient_frame_agreement" and got[5].status == "accepted"
    assert got[6].review_reason == "unsupported_layout" and got[7].review_reason == "low_temporal_confidence"
    assert (got[8].status, got[8].review_reason, got[8].total_observations) == ("unreadable", "no_observations", 0)
    again = {r.track_id: r for r in fuse.fuse(df.repartition(7).orderBy(F.rand(1)), tracks).collect()}
    assert again == got


def test_means_half_way_are_those_of_sums_in_frame_order(spark):
    """Means of eight confidences of two digits: every other one lies half-way at four places."""
    rng = random.Random(3)
    confidences = {t: [rng.randrange(50, 80) / 100 for _ in range(8)] for t in range(300)}
    rows = [r for t, cs in confidences.items() for r in obs(t, *[("KA01AB1234", c, 50) for c in cs])]

    def fused(cs):
        total = 0.0
        for c in cs:
            total += c
        return math.floor(min(0.99, total / 8 + 0.12) * 1e4 + 0.5) / 1e4

    want = {t: fused(cs) for t, cs in confidences.items()}
    df = spark.createDataFrame(rows, OBS)
    for cut in (df.coalesce(1), df.repartition(7).orderBy(F.rand(1))):
        assert {r.track_id: r.fused_confidence for r in fuse.fuse(cut).collect()} == want


def test_passages_add_up_votes_from_the_sharpest_on(spark):
    """Five votes whose mean and bonus make just 0.88: the last bits of the sum decide on acceptance."""
    rng = random.Random(5)
    tracks = {}
    while len(tracks) < 200:
        cs = [rng.randrange(60, 95) for _ in range(5)]
        if sum(cs) == 380:
            tracks[len(tracks)] = [(c / 100, s) for c, s in zip(cs, rng.sample(range(50, 200), 5), strict=True)]
    rows = [(*r, "car") for t, seen in tracks.items() for r in obs(t, *[("KA01AB1234", c, s) for c, s in seen])]

    def status(seen):
        total = 0.0
        for c, _ in sorted(seen, key=lambda x: -x[1]):
            total += c
        return "uncertain" if min(0.99, total / 5 + 0.03 * 4) < 0.88 else "accepted"

    want = {t: status(seen) for t, seen in tracks.items()}
    assert len(set(want.values())) == 2
    df = spark.createDataFrame(rows, OBS + ", vehicle_type string")
    for cut in (df.coalesce(1), df.repartition(7).orderBy(F.rand(1))):
        assert {r.track_id: r.status for r in fuse.passages(cut).collect()} == want


def test_means_of_whole_passages_half_way_at_nine_places(spark):
    """Means of 256 confidences of two digits have ten places: every other one lies half-way."""
    rng = random.Random(7)
    confidences = {t: [rng.randrange(50, 80) / 100 for _ in range(256)] for t in range(60)}
    rows = [(*r, "car") for t, cs in confidences.items() for r in obs(t, *[("KA01AB1234", c, i % 97) for i, c in enumerate(cs)])]

    def mean(cs):
        total = 0.0
        for c in cs:
            total += c
        return math.floor(total / 256 * 1e9 + 0.5) / 1e9

    want = {t: mean(cs) for t, cs in confidences.items()}
    df = spark.createDataFrame(rows, OBS + ", vehicle_type string")
    for cut in (df.coalesce(1), df.repartition(7).orderBy(F.rand(1))):
        assert {r.track_id: r.mean_conf for r in fuse.passages(cut).collect()} == want


def test_consensus_by_characters(spark):
    rows = [(1, 1, 0.0, "DL01AB1234", 1.0, 0.0), (1, 2, 0.0, "DL01A81234", 0.8, 0.0), (1, 3, 0.0, "DL01AB1234", 0.9, 0.0), (1, 4, 0.0, "X", 0.1, 0.0)]
    r = fuse.char_consensus(spark.createDataFrame(rows, OBS)).first()
    assert r.text == "DL01AB1234" and 0.9 < r.confidence <= 0.95
    rescued = obs(1, *[("KAO1AB1234", 0.95, 10), ("KA01A81234", 0.95, 10), ("KA01AB123A", 0.01, 1)] * 2)
    out = fuse.fuse(spark.createDataFrame(rescued, OBS)).first()
    assert out.status in ("accepted", "uncertain") and len(out.proposed_text) == 10


BOX = "image_id bigint, {0}_id bigint, x1 int, y1 int, x2 int, y2 int{1}"


def test_association_examples(spark):
    plates = spark.createDataFrame([(1, 1, 10, 10, 20, 20), (2, 1, 10, 10, 20, 20), (3, 1, 10, 10, 20, 20), (4, 1, 10, 10, 20, 20), (4, 2, 30, 10, 40, 20), (5, 1, 10, 10, 10, 20), (6, 1, 10, 10, 20, 20), (7, 1, 10, 10, 20, 20)], BOX.format("plate", ""))
    cars = [(2, 1, 0, 0, 50, 50, "car", 0.4), (3, 1, 0, 0, 50, 50, "car", 0.9), (3, 2, 5, 5, 60, 60, "bus", 0.9), (4, 1, 0, 0, 50, 50, "car", 0.9), (5, 1, 0, 0, 50, 50, "car", 0.9), (6, 1, 0, 0, 50, 50, "unknown", 0.9), (7, 3, 0, 0, 50, 50, "car", 0.9)]
    vehicles = spark.createDataFrame(cars, BOX.format("vehicle", ", vehicle_type string, confidence double"))
    got = {(r.image_id, r.plate_id): (r.vehicle_match_status, r.vehicle_id, r.vehicle_type) for r in associate.associate(plates, vehicles).collect()}
    assert got == {
        (1, 1): ("unmatched", None, "unknown"), (2, 1): ("low_confidence", None, "unknown"), (3, 1): ("ambiguous", None, "unknown"), (4, 1): ("ambiguous", None, "unknown"),
        (4, 2): ("ambiguous", None, "unknown"), (5, 1): ("unmatched", None, "unknown"), (6, 1): ("unsupported", None, "unknown"), (7, 1): ("matched", 3, "car"),
    }
    first = {(r.image_id, r.plate_id): r.vehicle_id for r in associate.first_match(plates, vehicles).collect()}
    assert first[3, 1] == 1 and first[4, 2] == 1 and (1, 1) not in first


def test_suppression_keeps_the_surest(spark):
    rows = [(1, 1, 0, 0, 20, 20, 0.9), (1, 2, 1, 1, 21, 21, 0.8), (1, 3, 40, 40, 60, 60, 0.7), (2, 4, 0, 0, 9, 9, 0.5), (2, 5, 0, 0, 9, 9, 0.5)]
    df = spark.createDataFrame(rows, BOX.format("plate", ", confidence double"))
    assert {(r.image_id, r.plate_id) for r in matching.suppress(df).collect()} == {(1, 1), (1, 3), (2, 4)}


def test_matching_is_of_greatest_size():
    rng = random.Random(2)
    for _ in range(200):
        n, m = rng.randrange(1, 6), rng.randrange(1, 6)
        edges = [(t, p, round(rng.random(), 2)) for t in range(n) for p in range(m) if rng.random() < 0.4]
        got = matching.maximum_matching(list(range(n)), edges)
        allowed = {(t, p) for t, p, _ in edges}
        assert set(got.items()) <= allowed and len(set(got.values())) == len(got)
        best = max(k for k in range(min(n, m) + 1) if k == 0 or any(all((t, p) in allowed for t, p in zip(ts, ps, strict=True)) for ts in itertools.combinations(range(n), k) for ps in itertools.permutations(range(m), k)))
        assert len(got) == best
    long = [(t, p, 0.9) for t in range(3000) for p in (t, t - 1) if p >= 0]  # a long augmenting path
    assert len(matching.maximum_matching(list(range(3000)), long)) == 3000


def test_greedy_matching_by_class(spark):
    p = [("car", 0.9, (0, 0, 10, 10)), ("car", 0.8, (1, 0, 11, 10)), ("bus", 0.7, (0, 0, 10, 10))]
    box = "image_id bigint, ord int, label string{}, x1 double, y1 double, x2 double, y2 double"
    pred = spark.createDataFrame([(1, i, label, c, *map(float, b)) for i, (label, c, b) in enumerate(p)], box.format(", confidence double"))
    truth = spark.createDataFrame([(1, 0, "car", 0.0, 0.0, 10.0, 10.0), (2, 0, "bus", 0.0, 0.0, 1.0, 1.0)], box.format(""))
    got = {(r.image_id, r.label): (r.tp, r.fp, r.fn) for r in matching.match_by_class(pred, truth).collect()}
    assert got == {(1, "car"): (1, 1, 0), (1, "bus"): (0, 1, 0), (2, "bus"): (0, 0, 1)}


def test_geometry(spark):
    b = tuple(F.lit(x) for x in (10, 10, 60, 35))
    row = spark.range(1).select(
        F.array(*G.padded(b, F.lit(100), F.lit(36))).alias("padded"), F.array(*G.crop(tuple(F.lit(x) for x in (10.4, 10.0, 20.2, 19.5)), F.lit(100), F.lit(100))).alias("crop"),
        F.array(*G.from_normalised(G.normalised(b, F.lit(100), F.lit(50)), F.lit(100), F.lit(50))).alias("back"), G.normalised(tuple(F.lit(x) for x in (99, 0, 120, 50)), F.lit(100), F.lit(50))[0].alias("thin"),
        G.valid(tuple(F.lit(float(x)) for x in ("0", "0", "nan", "5")), F.lit(10), F.lit(10)).alias("nan"), G.valid(b, F.lit(100), F.lit(50)).alias("ok"),
        G.scaled(F.array(F.struct(F.lit(10.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(20.0).alias("x2"), F.lit(8.0).alias("y2"))), F.lit(0.5))[0]["x2"].alias("half"),
    ).first()
    assert row.padded == [8, 8, 62, 36] and row.crop == [8, 8, 23, 22] and [round(x, 9) for x in row.back] == [10, 10, 60, 35]
    assert row.thin is None and row.nan is False and row.ok is True and row.half == 10.0


def test_text_and_values(spark):
    row = spark.range(1).select(
        T.char_accuracy(F.lit("ABCD"), F.lit("ABXD")).alias("acc"), T.char_accuracy(F.lit(""), F.lit("A")).alias("none"), T.hamming(F.lit("AB"), F.lit("ABC")).alias("uneven"),
        T.naive_join(F.array(F.struct(F.lit("A").alias("text"), F.lit(0.5).alias("conf")), F.struct(F.lit("B").alias("text"), F.lit(1.0).alias("conf")))).alias("joined"),
        V.unit(F.lit(float("nan"))).alias("nan"), V.softmax_top(F.array(F.lit("a"), F.lit("b")), F.array(F.lit(0.0), F.lit(2.0))).alias("top"), V.digest(F.lit(1).alias("a")).alias("sha"),
        T.stem(F.lit("x/.hidden")).alias("hidden"), T.base_name(T.portable_path(F.lit("a\\b.c"))).alias("base"),
    ).first()
    assert (row.acc, row.none, row.uneven, row.nan) == (0.75, 0.0, None, 0.0)
    assert tuple(row.joined) == ("AB", 0.75) and row.top.label == "b" and row.top.confidence == pytest.approx(0.880797)
    assert len(row.sha) == 64 and row.hidden == ".hidden" and row.base == "b.c"
