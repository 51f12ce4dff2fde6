"""Passages over a stream: any order within the delay, late frames, restarts, closing order."""

from __future__ import annotations

import datetime
import random
import time

import pytest

from passagekit.streaming import tracks

GAP, LATE = 10_000, 5_000
SCHEMA = "ts timestamp, track_id bigint, frame_idx bigint, sharpness double"
ZERO = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
ZERO_MS = int(ZERO.timestamp() * 1000)


def frame(ms, track, idx, sharpness=1.0):
    return (ZERO + datetime.timedelta(milliseconds=ms), track, idx, sharpness)


def put(spark, folder, rows):
    """One more file for the stream, newer than those before."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    time.sleep(1.1)


def stream(spark, folder, k=5):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    return tracks.passages(source, GAP, LATE, k)


def read(spark, folder):
    return sorted(tuple(r) for r in spark.read.schema(tracks.PASSAGE).parquet(folder).collect())


def plain(frames, k=5, until=None):
    """Closed passages of the frames by plain means: sorted, cut at silences."""
    by_track: dict = {}
    for ts, track, idx, sharp in frames:
        by_track.setdefault(track, []).append((round((ts - ZERO).total_seconds() * 1000), idx, sharp))
    out = []
    for track, rows in by_track.items():
        runs: list = []
        for row in sorted(rows):
            runs.append([row]) if not runs or row[0] - runs[-1][-1][0] > GAP else runs[-1].append(row)
        for run in runs:
            if until is None or run[-1][0] + GAP < until:
                best = sorted(run, key=lambda r: (-r[2], r[1]))[:k]
                out += [(track, ZERO_MS + run[0][0], ZERO_MS + run[-1][0], len(run), i, r[1], r[2]) for i, r in enumerate(best, 1)]
    return sorted(out)


def test_any_order_within_the_delay_and_restarts(spark, tmp_path):
    rng = random.Random(2)
    frames = [frame(rng.randrange(200_000), rng.randrange(6), i, rng.randrange(40) / 8) for i in range(300)]
    # Sent in the order of time, but for up to the delay.
    frames.sort(key=lambda f: f[0] + datetime.timedelta(milliseconds=rng.randrange(LATE)))
    latest, source = 0, f"{tmp_path}/in"
    for i in range(4):
        part = frames[75 * i : 75 * (i + 1)]
        put(spark, source, part)
        latest = max(latest, *(round((f[0] - ZERO).total_seconds() * 1000) for f in part))
        # Every call is a query of its own that goes on from the checkpoint.
        tracks.run_available(stream(spark, source), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        assert read(spark, f"{tmp_path}/out") == plain(frames, until=latest - LATE)


def test_late_frames_and_bridges(spark, tmp_path):
    source, out, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    # Two open passages of track 1, 12 s apart; a frame between them is in time and joins them.
    put(spark, source, [frame(0, 1, 0), frame(12_000, 1, 1), frame(1_000, 2, 2)])
    put(spark, source, [frame(8_000, 1, 3, 9.0), frame(30_000, 3, 4)])
    # By now the watermark is at 25 s: a frame of 9 s is late and changes nothing.
    put(spark, source, [frame(9_000, 2, 5), frame(60_000, 3, 6)])
    tracks.run_available(stream(spark, source, k=2), out, checkpoint)
    got = [(t, a - ZERO_MS, b - ZERO_MS, n, i, f) for t, a, b, n, i, f, _ in read(spark, out)]
    assert got == [(1, 0, 12_000, 3, 1, 3), (1, 0, 12_000, 3, 2, 0), (2, 1_000, 1_000, 1, 1, 2), (3, 30_000, 30_000, 1, 1, 4)]


def test_passages_of_a_track_are_closed_in_order(spark, tmp_path):
    """One batch with many passages of one track: several timers, fired from the earliest on."""
    frames = [frame(15_000 * i + j, 1, 10 * i + j) for i in range(20) for j in (0, 1)]
    put(spark, f"{tmp_path}/in", frames)
    tracks.run_available(stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    rows = spark.read.schema(tracks.PASSAGE).parquet(f"{tmp_path}/out").collect()
    assert [r.first_ms for r in rows] == sorted(r.first_ms for r in rows)
    assert sorted(map(tuple, rows)) == plain(frames, until=15_000 * 19 + 1 - LATE)


@pytest.mark.parametrize("n", [0, 200])
def test_replay_equals_batch(spark, n):
    rng = random.Random(n)
    frames = [frame(rng.randrange(500_000), rng.randrange(9), i, rng.random()) for i in range(n)] + [(None, 1, 1, 1.0), (ZERO, None, 1, 1.0), (ZERO, 1, 1, None)][: 3 * bool(n)]
    df = spark.createDataFrame(frames, SCHEMA)
    got = sorted(map(tuple, tracks.closed_passages(df, GAP, LATE, slices=2).collect()))
    whole = sorted(map(tuple, tracks.batch_passages(df, GAP).collect()))
    assert whole == plain([f for f in frames if None not in f])
    end = max((r[2] for r in whole), default=0) - LATE
    assert got == [r for r in whole if r[2] + GAP < end]


def test_state_and_timers_do_not_grow_with_tracks(spark, tmp_path):
    """A row of state and a timer for each of many tracks or passages made big streams endless."""
    n = 3000
    frames = [frame(2 * t % 7 + 15_000 * i, t, 2 * t + i, float("nan") if t == 5 else float(t)) for t in range(n) for i in (0, 1)]
    for part in (frames, [frame(100_000, n, 2 * n)]):
        put(spark, f"{tmp_path}/in", part)
    query = tracks.run_available(stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    rows = [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
    assert 0 < max(rows) < n
    got = read(spark, f"{tmp_path}/out")
    assert len(got) == 2 * n and sorted(r[5] for r in got) == list(range(2 * n)) and all(r[3:5] == (1, 1) for r in got)


def test_no_number_is_the_sharpest_as_in_batches(spark):
    frames = [frame(i, 1, i, s) for i, s in enumerate((2.0, float("nan"), 3.0))] + [frame(900_000, 2, 9)]
    df = spark.createDataFrame(frames, SCHEMA)
    got, whole = (sorted((r.sharpest, r.frame_idx) for r in d.where("track_id = 1").collect()) for d in (tracks.closed_passages(df, GAP, LATE, slices=2), tracks.batch_passages(df, GAP)))
    assert got == whole == [(1, 1), (2, 2), (3, 0)]
