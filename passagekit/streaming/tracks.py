"""Passages over a stream of frames with keyed state and event-time timers.

A passage is a run of a track's frames without a silence longer than ``gap``. Tracks are dealt
into shares; a share's state is a list of blocks of the open passages of its tracks, each
passage with its span, its number of frames and at most ``k`` sharpest frames, however many it
has seen. Frames may come in any order within the watermark's delay: one that lies between two
open passages joins them. A timer is set for the moment at which no frame can join a share's
earliest passage any more; when the watermark has passed it, all passages that the watermark
has passed are given out, the earliest of a track first, and forgotten, and the timer is set
anew for those left. What has been given out equals the batch form (`batch_passages`) over the
frames that were not late, so a restart from the checkpoint between any two batches changes
nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from passagekit import constants as C
from passagekit.plans.shared import shared_dir

#: Rows given out: a sharpest frame of a closed passage.
PASSAGE = "track_id bigint, first_ms bigint, last_ms bigint, frames bigint, sharpest int, frame_idx bigint, sharpness double"
_OPEN = "block binary"
#: State with lists and timers needs this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Shares of the tracks, each a key of the state, and rows in one element of a share's list.
SHARES, BLOCK = 256, 4096
#: Kept frames of open passages; ``frames`` counts a passage's frames in its first row alone.
_KEPT = [("track_id", "i8"), ("first_ms", "i8"), ("last_ms", "i8"), ("frames", "i8"), ("frame_idx", "i8"), ("sharpness", "f8")]


def _joined(rows: np.ndarray, gap: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Passages of all tracks of ``rows``, joined where no silence parts them: their ``k``
    sharpest frames each, by track and time, and every frame's place."""
    rows = rows[np.lexsort((rows["first_ms"], rows["track_id"]))]
    if not len(rows):
        return rows, np.zeros(0, "i4")
    reached = pd.Series(rows["last_ms"]).groupby(rows["track_id"]).cummax().to_numpy()
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows["track_id"][1:] != rows["track_id"][:-1]) | (rows["first_ms"][1:] - reached[:-1] > gap)
    starts, no = np.flatnonzero(fresh), np.cumsum(fresh) - 1
    first, last, frames = rows["first_ms"][starts], np.maximum.reduceat(rows["last_ms"], starts), np.add.reduceat(rows["frames"], starts)
    # The sharpest first; what is no number comes before all numbers, as in SQL.
    rows = rows[np.lexsort((rows["frame_idx"], -rows["sharpness"], ~np.isnan(rows["sharpness"]), no))]
    place = np.arange(len(rows)) - starts[no]
    kept = place < k
    rows, no, place = rows[kept], no[kept], place[kept]
    rows["first_ms"], rows["last_ms"], rows["frames"] = first[no], last[no], np.where(place == 0, frames[no], 0)
    return rows, place


class Passages(StatefulProcessor):
    """The open passages of a share of the tracks: a list state of blocks of rows, and one
    timer for the end of the earliest.

    Every call of the state and every key passes a socket, so many tracks take these together
    and their frames are sorted as arrays."""

    def __init__(self, gap_ms: int, k: int = C.FRAMES_PER_TRACK):
        self.gap, self.k = gap_ms, k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", _OPEN)

    def _held(self) -> np.ndarray:
        return np.frombuffer(b"".join(bytes(r[0]) for r in self.open.get()), _KEPT)

    def _hold(self, rows: np.ndarray) -> None:
        if len(rows):
            self.open.put([(rows[i : i + BLOCK].tobytes(),) for i in range(0, len(rows), BLOCK)])
        else:
            self.open.clear()

    def _end(self, rows: np.ndarray) -> int:
        """The moment at which no frame can join the earliest any more."""
        return int(rows["last_ms"].min()) + self.gap + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        late, before = timerValues.getCurrentWatermarkInMs(), self._held()
        held = before
        for pdf in rows:
            pdf = pdf[pdf["ms"] >= late]
            some = np.empty(len(pdf), _KEPT)
            some["track_id"], some["first_ms"], some["last_ms"], some["frames"] = pdf["track_id"], pdf["ms"], pdf["ms"], 1
            some["frame_idx"], some["sharpness"] = pdf["frame_idx"], pdf["sharpness"]
            held, _ = _joined(np.concatenate((held, some)), self.gap, self.k)
        if len(held):
            # A timer that is set stays, also if its passage has grown: when it fires the next is set.
            if not len(before) or self._end(held) < self._end(before):
                self.handle.registerTimer(self._end(held))
            self._hold(held)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows, place = _joined(self._held(), self.gap, self.k)
        over = rows["last_ms"] + self.gap < timerValues.getCurrentWatermarkInMs()
        if over.any():
            self._hold(rows[~over])
        if not over.all():
            self.handle.registerTimer(self._end(rows[~over]))
        if over.any():
            out = pd.DataFrame(rows[over]).assign(sharpest=place[over].astype("i4") + 1)
            # The number of a passage's frames stands in the row of its sharpest.
            out["frames"] = out["frames"].where(out["sharpest"] == 1).ffill().astype("i8")
            yield out[[c.split()[0] for c in PASSAGE.split(", ")]]

    def close(self) -> None:
        pass


def passages(frames: DataFrame, gap_ms: int, lateness_ms: int, k: int = C.FRAMES_PER_TRACK) -> DataFrame:
    """Closed passages of a stream ``(ts, track_id, frame_idx, sharpness)``, a row per sharpest
    frame. Frames without a time, a track or a sharpness are left out."""
    known = frames.where("ts IS NOT NULL AND track_id IS NOT NULL AND sharpness IS NOT NULL")
    timed = known.withWatermark("ts", f"{lateness_ms} milliseconds")
    rows = timed.select(F.col("track_id").cast("bigint").alias("track_id"), "ts", F.unix_millis("ts").alias("ms"), F.col("frame_idx").cast("bigint").alias("frame_idx"), F.col("sharpness").cast("double").alias("sharpness"))
    share = F.pmod(F.xxhash64("track_id"), F.lit(SHARES)).alias("share")
    return rows.select("*", share).groupBy("share").transformWithStateInPandas(Passages(gap_ms, k), PASSAGE, "append", "eventtime")


def batch_passages(frames: DataFrame, gap_ms: int, k: int = C.FRAMES_PER_TRACK) -> DataFrame:
    """The same rows for all passages of a table, open ones too."""
    known = frames.where("ts IS NOT NULL AND track_id IS NOT NULL AND sharpness IS NOT NULL").withColumn("ms", F.unix_millis("ts"))
    track = Window.partitionBy("track_id").orderBy("ms", "frame_idx")
    fresh = F.coalesce(F.col("ms") - F.lag("ms").over(track) > gap_ms, F.lit(True))
    rows = known.withColumn("fresh", fresh.cast("int")).withColumn("no", F.sum("fresh").over(track))
    one = Window.partitionBy("track_id", "no")
    rows = rows.withColumns({"first_ms": F.min("ms").over(one), "last_ms": F.max("ms").over(one), "frames": F.count("*").over(one), "sharpest": F.row_number().over(one.orderBy(F.desc("sharpness"), "frame_idx"))})
    return rows.where(F.col("sharpest") <= k).select("track_id", "first_ms", "last_ms", "frames", "sharpest", "frame_idx", "sharpness")


def run_available(out: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Works off what the stream's source has now, then stops; a later call with the same
    ``checkpoint`` goes on from there. ``folder`` gets Parquet files, each row once."""
    spark = out.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, STORE)
    try:
        query = out.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return query


def replay(frames: DataFrame, folder: str, slices: int) -> DataFrame:
    """The table as a stream in the order of ``ts``: written as ``slices`` files or more, a
    slice of time after the other, and read one trigger per slice."""
    spark = frames.sparkSession
    ends = frames.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(F.unix_micros("a").alias("a"), F.unix_micros("b").alias("b")).first()
    at = F.unix_micros("ts")
    for i in range(slices if ends["a"] is not None else 0):
        low, high = (ends["a"] + (ends["b"] - ends["a"] + 1) * j // slices for j in (i, i + 1))
        frames.where((at >= low) & (at < high)).write.parquet(f"{folder}/slice={i:04d}")
    if ends["a"] is None:
        frames.write.parquet(f"{folder}/slice=0000")
    files = max(1, -(-len(spark.read.parquet(folder).inputFiles()) // slices))
    return spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(folder)


def closed_passages(frames: DataFrame, gap_ms: int, lateness_ms: int, slices: int = 4, k: int = C.FRAMES_PER_TRACK) -> DataFrame:
    """A table's passages by way of the stream: those closed when its last frame has come."""
    spark: SparkSession = frames.sparkSession
    folder = shared_dir(spark)
    stream = replay(frames.select(F.col("ts").cast("timestamp").alias("ts"), "track_id", "frame_idx", "sharpness"), f"{folder}/in", slices)
    run_available(passages(stream, gap_ms, lateness_ms, k), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(PASSAGE).parquet(f"{folder}/out")
