"""From a track's frames to one passage: weighted votes, consensus, abstention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagekit import constants as C
from passagekit.functions import text as T
from passagekit.functions import values as V


def sharpest(observations: DataFrame, k: int = C.FRAMES_PER_TRACK, key: str = "track_id") -> DataFrame:
    """The k sharpest frames of each track, before anything costly is done with them."""
    order = Window.partitionBy(key).orderBy(F.desc("sharpness"), "frame_idx")
    return observations.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def weight() -> Column:
    sharp = F.log1p(F.greatest(F.lit(0.0), F.coalesce("sharpness", F.lit(0.0))))
    full = F.col("ocr_confidence") * (1 + C.FUSE_FORMAT_WEIGHT * F.col("format_score")) * (1 + C.FUSE_SHARP_WEIGHT * sharp)
    return F.greatest(F.lit(C.FUSE_FLOOR), full)


def vote_tally(observations: DataFrame, key: str = "track_id", by: str = "frame_idx") -> DataFrame:
    """``(key, text, score, frames, max_conf, mean_conf, first)`` per text of a track.

    Weights and confidences are added up in the order of ``by`` (of frames): the last bits of a
    sum, which decide where its mean lies half-way between two rounded values or at a bound, do
    not depend on how the table is cut."""
    seen = observations.where(T.missing(F.col("proposed_text")).isNotNull()).select(
        key, F.col("proposed_text").alias("text"), "frame_idx", F.col(by).alias("by"), weight().alias("w"), F.col("ocr_confidence").alias("conf")
    )
    order = Window.partitionBy(key, "text").orderBy("by", "w", "conf")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = seen.select(key, "text", "frame_idx", "conf", F.row_number().over(order).alias("i"), F.sum("w").over(so_far).alias("score"), F.sum("conf").over(so_far).alias("total"))
    return (
        added.groupBy(key, "text")
        .agg(
            F.max_by(F.struct("score", "total"), "i").alias("sums"),
            F.count("*").alias("frames"),
            F.max("conf").alias("max_conf"),
            F.count("conf").alias("read"),
            F.min("frame_idx").alias("first"),
        )
        .select(key, "text", "sums.score", "frames", "max_conf", V.ratio(F.col("sums.total"), F.col("read")).alias("mean_conf"), "first")
    )


def char_consensus(observations: DataFrame, key: str = "track_id", by: str = "frame_idx") -> DataFrame:
    """``(key, text, confidence)``: of the texts of the heaviest length the heaviest
    character at each place, and the mean of those characters' mean confidences. Ties go
    to what came first."""
    tally = vote_tally(observations, key, by).withColumn("n", F.length("text"))
    lengths = tally.groupBy(key, "n").agg(F.sum("score").alias("w"), F.min("first").alias("f"))
    best = lengths.groupBy(key).agg(F.max_by("n", F.struct("w", -F.col("f"))).alias("n"))
    chars = F.posexplode(F.filter(F.split("text", ""), lambda c: c != "")).alias("pos", "char")
    each = tally.join(best, [key, "n"]).select(key, "score", "frames", "first", "mean_conf", chars)
    votes = each.groupBy(key, "pos", "char").agg(
        F.sum("score").alias("w"), F.min("first").alias("f"), (F.sum(F.col("mean_conf") * F.col("frames")) / F.sum("frames")).alias("conf")
    )
    places = votes.groupBy(key, "pos").agg(F.max_by(F.struct("char", "conf"), F.struct("w", -F.col("f"))).alias("c"))
    return places.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "c.char"))), lambda x: x["char"]), "").alias("text"),
        F.avg("c.conf").alias("confidence"),
    )


def fuse(observations: DataFrame, tracks: DataFrame | None = None, key: str = "track_id", by: str = "frame_idx") -> DataFrame:
    """One row per track: consensus text, status and why.

    ``observations (key, frame_idx, sharpness, proposed_text, ocr_confidence,
    format_score)``. Tracks of ``tracks`` without observations are unreadable, as are
    those whose frames all lack a text. The best text by votes gains confidence with each
    agreeing frame; it conflicts with a runner-up nearly as heavy that two frames or more
    support, unless a consensus by characters between two close texts fits a template
    better. Votes are added up in the order of ``by``.
    """
    tally = vote_tally(observations, key, by)
    ranked = tally.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "first", "text", "frames", "max_conf", "mean_conf"))).alias("all")
    )
    seen = observations.groupBy(key).agg(F.count("*").alias("total_observations"), F.max_by("frame_idx", F.struct("sharpness", -F.col("frame_idx"))).alias("sharpest_frame_idx"))
    every = seen if tracks is None else tracks.select(key).distinct().join(seen, key, "left")
    df = every.join(ranked, key, "left").join(char_consensus(observations, key, by).withColumnRenamed("text", "chars"), key, "left")
    df = df.withColumns({"b": F.get("all", F.lit(0)), "n": F.get("all", F.lit(1))})
    gap = (F.col("n.s") - F.col("b.s")) / F.greatest(F.lit(1e-6), -F.col("b.s"))
    conflict = F.col("n").isNotNull() & (gap < C.AMBIGUITY_MARGIN) & (F.col("n.frames") >= 2)
    df = df.withColumns({"conflict": F.coalesce(conflict, F.lit(False)), "own_clean": T.clean(F.col("b.text")), "chars_clean": T.clean(F.col("chars"))})
    fit = lambda c: F.coalesce(T.best_fit(F.col(c))["score"], F.lit(0.0))
    df = df.withColumns({"own_fit": fit("own_clean"), "chars_fit": fit("chars_clean")})
    near = F.coalesce(T.hamming(F.col("b.text"), F.col("n.text")) <= C.RESCUE_DIFFERENCES, F.lit(False))
    df = df.withColumn("rescued", F.col("conflict") & near & (F.col("chars_fit") > F.col("own_fit")))
    agree = F.col("b.frames")
    bonus = F.when(agree >= C.FUSE_AGREEMENT, C.FUSE_BONUS * F.least(F.lit(C.FUSE_BONUS_FRAMES), agree - 1)).otherwise(F.lit(0.0))
    df = df.withColumns(
        {
            "text": F.when(F.col("rescued"), F.col("chars")).otherwise(F.col("b.text")),
            "format": F.when(F.col("rescued"), F.col("chars_fit")).otherwise(F.col("own_fit")),
            "fused": F.least(F.lit(C.FUSE_CAP), F.col("b.mean_conf") + bonus),
            "open": F.col("conflict") & ~F.col("rescued"),
        }
    )
    read = F.col("b").isNotNull()
    reason = (
        F.when(F.col("total_observations").isNull(), "no_observations")
        .when(~read, "unreadable_in_all_frames")
        .when(F.col("open"), "conflicting_temporal_readings")
        .when(F.col("format") < C.FUSE_FORMAT, "unsupported_layout")
        .when(F.col("fused") < C.FUSE_ACCEPT, "low_temporal_confidence")
        .when((agree < C.FUSE_AGREEMENT) & (F.col("fused") < C.FUSE_SINGLE), "insufficient_frame_agreement")
    )
    status = F.when(~read, "unreadable").when(reason.isNull(), "accepted").otherwise("uncertain")
    option = lambda x: F.struct(x["text"].alias("text"), F.round(-x["s"], 2).alias("votes"), x["frames"].alias("frame_count"), F.round(x["max_conf"], 4).alias("max_confidence"))
    return df.select(
        key,
        F.when(status == "accepted", F.col("text")).otherwise("").alias("plate_text"),
        F.coalesce("text", F.lit("")).alias("proposed_text"),
        status.alias("status"),
        reason.alias("review_reason"),
        F.coalesce(V.rounded(F.col("fused"), 4), F.lit(0.0)).alias("fused_confidence"),
        F.coalesce(F.round("format", 4), F.lit(0.0)).alias("format_score"),
        F.coalesce(agree, F.lit(0)).cast("bigint").alias("agreement_count"),
        F.coalesce("total_observations", F.lit(0)).cast("bigint").alias("total_observations"),
        "sharpest_frame_idx",
        F.when(F.col("open"), F.array("n.text")).otherwise(F.expr("cast(array() as array<string>)")).alias("conflicting_texts"),
        F.when(read, F.transform(F.slice("all", 1, 5), option)).alias("alternatives"),
    )


def passages(observations: DataFrame, fps: float = 25.0, key: str = "track_id") -> DataFrame:
    """One row per track: when it was seen, how often, its type, mean confidence, and its
    consensus over its sharpest frames. ``observations`` also has ``vehicle_type``.

    Confidences of all frames are added up in the order of frames, votes of the sharpest ones
    from the sharpest on."""
    order = Window.partitionBy(key).orderBy("frame_idx", "ocr_confidence")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = observations.select(key, "frame_idx", "vehicle_type", "ocr_confidence", F.row_number().over(order).alias("i"), F.sum("ocr_confidence").over(so_far).alias("total"))
    span = added.groupBy(key).agg(
        F.min("frame_idx").alias("first_frame"),
        F.max("frame_idx").alias("last_frame"),
        F.count("*").alias("frames"),
        V.rounded(V.ratio(F.max_by("total", "i"), F.count("ocr_confidence")), 9).alias("mean_conf"),
        F.min_by("vehicle_type", "frame_idx").alias("vehicle_type"),
    )
    seconds = lambda c: F.round(F.col(c) / fps, 2)
    read = fuse(sharpest(observations, key=key), key=key, by="rank").select(key, "plate_text", "proposed_text", "status", "review_reason", "fused_confidence")
    return span.join(read, key).withColumns({"first_sec": seconds("first_frame"), "last_sec": seconds("last_frame")})
