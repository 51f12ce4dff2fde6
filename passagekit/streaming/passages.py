"""Passages over a stream of frames: per track the sharpest frames, given out once the
track has not been seen for a while. On tracks that are closed it equals the batch form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from passagekit import constants as C

_OUT = "track_id bigint, first_frame bigint, last_frame bigint, frames bigint, frame_idx bigint, sharpness double, proposed_text string, ocr_confidence double, format_score double"
_STATE = "first bigint, last bigint, n bigint, frame array<bigint>, sharp array<double>, text array<string>, conf array<double>, fmt array<double>"
_KEPT = ("frame_idx", "sharpness", "proposed_text", "ocr_confidence", "format_score")


def track_state(k: int = C.FRAMES_PER_TRACK, silence_ms: int = 60_000):
    """The update of one track: counts and at most k frames, whatever the track's length."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, n, *kept = state.get if state.exists else (None, None, 0, [], [], [], [], [])
        best = pd.DataFrame(dict(zip(_KEPT, kept, strict=True)))
        if state.hasTimedOut:
            state.remove()
            yield best.assign(track_id=key[0], first_frame=first, last_frame=last, frames=n)[[c.split()[0] for c in _OUT.split(", ")]]
            return
        latest = 0
        for pdf in batches:
            n += len(pdf)
            lo, hi = int(pdf["frame_idx"].min()), int(pdf["frame_idx"].max())
            first, last = (lo, hi) if first is None else (min(first, lo), max(last, hi))
            latest = max(latest, int(pdf["ts"].max().timestamp() * 1000))
            best = pd.concat([best, pdf[list(_KEPT)]]) if len(best) else pdf[list(_KEPT)]
            best = best.sort_values(["sharpness", "frame_idx"], ascending=[False, True]).head(k)
        state.update((first, last, n, *(best[c].tolist() for c in _KEPT)))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + silence_ms)
        yield from ()

    return update


def stream_passages(frames: DataFrame, lateness: str = "10 minutes", silence_ms: int = 60_000, k: int = C.FRAMES_PER_TRACK) -> DataFrame:
    """Closed tracks of a stream ``(ts, track_id, frame_idx, sharpness, proposed_text,
    ocr_confidence, format_score)``: their sharpest frames, with the span and number of all.
    What has been given out is then fused as a batch is."""
    timed = frames.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return timed.groupBy("track_id").applyInPandasWithState(track_state(k, silence_ms), _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def sessions(frames: DataFrame, gap: str = "30 minutes", key: str = "track_id") -> DataFrame:
    """Runs of a track's frames without a gap of more than ``gap``: batch or stream (with a
    watermark on ``ts``)."""
    return (
        frames.withColumn("ts", F.col("ts").cast("timestamp"))
        .groupBy(key, F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("frames"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.round(F.avg("value"), 9).alias("mean_value"))
        .drop("w")
    )


def hourly(frames: DataFrame) -> DataFrame:
    """Frames and mean value per hour and type (tumbling windows)."""
    timed = frames.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 9).alias("mean_value")).select(F.col("w.start").alias("hour"), "event_type", "n", "mean_value")


def score_with(df: DataFrame, scorer, schema: str) -> DataFrame:
    """Runs a model over batches: ``scorer()`` gives, once a task, a function from a pandas
    frame to a frame of as many rows; a result of another length, or not finite, is refused."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = scorer()
        for pdf in batches:
            out = model(pdf)
            if len(out) != len(pdf):
                raise ValueError(f"the scorer gave {len(out)} rows for {len(pdf)}")
            numbers = out.select_dtypes("number")
            if not numbers.map(lambda x: x == x and abs(x) != float("inf")).all(axis=None):
                raise ValueError("the scorer gave a number that is not finite")
            yield out

    return df.mapInPandas(run, schema)
