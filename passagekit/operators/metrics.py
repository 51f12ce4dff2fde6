"""Reports: counts, ratios, sweeps, and paired comparisons of readings with the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagekit import constants as C
from passagekit.functions.text import clean
from passagekit.functions.values import ratio
from passagekit.operators.quantiles import nearest_rank


def count_where(condition: Column) -> Column:
    return F.count_if(condition).cast("bigint")


def score_images(truth: DataFrame, plates: DataFrame, matches: DataFrame, key: str = "image_id") -> DataFrame:
    """Counters per image from its truth, its plates ``(status, plate_text)`` and matches."""
    t = truth.groupBy(key).agg(F.count("*").alias("ground_truth_plates"))
    p = plates.groupBy(key).agg(F.count("*").alias("detections"), count_where(F.col("status") == "accepted").alias("accepted_readings"))
    pair = matches.join(truth.select(key, "target_id", "text"), [key, "target_id"]).join(plates.select(key, "plate_id", "status", "plate_text"), [key, "plate_id"])
    exact = (F.col("status") == "accepted") & (clean(F.col("plate_text")) == clean(F.col("text")))
    m = pair.groupBy(key).agg(F.count("*").alias("matched_detections"), count_where(exact).alias("exact_readings"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    df = t.join(p, key, "full_outer").join(m, key, "left")
    df = df.select(key, *(n(F.col(c)).alias(c) for c in ("ground_truth_plates", "detections", "matched_detections", "accepted_readings", "exact_readings")))
    return df.withColumns(
        {
            "missed_plates": F.col("ground_truth_plates") - F.col("matched_detections"),
            "extra_detections": F.col("detections") - F.col("matched_detections"),
            "incorrect_accepted_readings": F.col("accepted_readings") - F.col("exact_readings"),
            "abstentions": F.col("detections") - F.col("accepted_readings"),
        }
    )


def summarize(scores: DataFrame, *by: str) -> DataFrame:
    """Sums of the counters and their safe ratios, over all or by columns."""
    counters = ("ground_truth_plates", "detections", "matched_detections", "accepted_readings", "exact_readings", "missed_plates", "extra_detections", "incorrect_accepted_readings", "abstentions")
    df = scores.groupBy(*by).agg(F.count("*").alias("images"), *(F.sum(c).cast("bigint").alias(c) for c in counters))
    pairs = {
        "detection_recall": ("matched_detections", "ground_truth_plates"),
        "detection_precision": ("matched_detections", "detections"),
        "end_to_end_exact_recall": ("exact_readings", "ground_truth_plates"),
        "accepted_reading_precision": ("exact_readings", "accepted_readings"),
    }
    return df.withColumns({name: F.round(ratio(F.col(a), F.col(b)), 9) for name, (a, b) in pairs.items()})


def outcomes(truth: DataFrame, plates: DataFrame, matches: DataFrame, key: str = "image_id") -> DataFrame:
    """``(key, target_id, outcome)`` of every target: missed, or by status and text."""
    df = truth.select(key, "target_id", "text").join(matches.select(key, "target_id", "plate_id"), [key, "target_id"], "left")
    df = df.join(plates.select(key, "plate_id", "status", "plate_text", "proposed_text"), [key, "plate_id"], "left")
    exact, proposed = (clean(F.col(c)) == clean(F.col("text")) for c in ("plate_text", "proposed_text"))
    outcome = (
        F.when(F.col("plate_id").isNull(), "missed")
        .when(F.col("status") == "accepted", F.when(exact, "correct_accepted").otherwise("wrong_accepted"))
        .when(F.col("status") == "unreadable", "unreadable")
        .otherwise(F.when(proposed, "correct_uncertain").otherwise("wrong_uncertain"))
    )
    return df.select(key, "target_id", outcome.alias("outcome"))


def outcome_summary(outcomes_: DataFrame, *by: str) -> DataFrame:
    """Zero-filled counts of outcomes and fractions, over all or by columns."""
    n = lambda o: count_where(F.col("outcome") == o)
    df = outcomes_.groupBy(*by).agg(F.count("*").alias("targets"), *(n(o).alias(o) for o in ("missed", *C.OUTCOMES)))
    accepted = F.col("correct_accepted") + F.col("wrong_accepted")
    return df.withColumns(
        {
            "exact_accepted_fraction": F.round(ratio(F.col("correct_accepted"), F.col("targets")), 9),
            "accepted_target_precision": F.round(ratio(F.col("correct_accepted"), accepted), 9),
        }
    )


def by_grouping_sets(df: DataFrame, value: str) -> DataFrame:
    """Count and mean of ``value`` over all rows, by condition, and by condition and
    severity; ``level`` tells the total from an unspecified value."""
    filled = df.select(*(F.coalesce(c, F.lit("unspecified")).alias(c) for c in ("condition", "severity")), value)
    c, s = F.col("condition"), F.col("severity")
    grouped = filled.groupingSets([[], [c], [c, s]], c, s)
    return grouped.agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.round(F.avg(value), 9).alias("mean"))


def macro_mean(df: DataFrame, group: str, hit: Column) -> DataFrame:
    """Mean over groups of each group's share of hits."""
    each = df.groupBy(group).agg(F.avg(hit.cast("double")).alias("share"))
    return each.agg(F.count("*").alias("groups"), F.round(F.avg("share"), 9).alias("macro_mean"))


def latency(df: DataFrame, seconds: str, order: str, *by: str) -> DataFrame:
    """First, mean, mean without the first, and nearest-rank 95th percentile."""
    first = F.min_by(seconds, order)
    total, n = F.sum(seconds), F.count(seconds)
    means = df.groupBy(*by).agg(
        n.alias("n"),
        F.round(first, 9).alias("first"),
        F.round(total / n, 9).alias("mean"),
        F.round(F.try_divide(total - first, (n - 1).cast("double")), 9).alias("warm_mean"),
    )
    p95 = nearest_rank(df, seconds, "0.95", *by)
    same = F.lit(True)
    for c in by:
        same &= means[c].eqNullSafe(p95[c])
    return means.join(p95, same, "left").select(*(means[c] for c in by), "n", "first", "mean", "warm_mean", F.col("quantile").alias("p95"))


def transitions(before: DataFrame, after: DataFrame, on: list[str], value: str = "status") -> DataFrame:
    """How often each value became each: ``(before, after, n)``."""
    df = before.select(*on, F.col(value).alias("before")).join(after.select(*on, F.col(value).alias("after")), on)
    return df.groupBy("before", "after").agg(F.count("*").alias("n"))


def status_counts(readings: DataFrame, *by: str) -> DataFrame:
    """How many readings have each status, over all or by columns; a null or other status
    counts in none."""
    return readings.groupBy(*by).agg(*(count_where(F.col("status") == s).alias(s) for s in ("accepted", "uncertain", "unreadable")))


def map_sum(df: DataFrame, column: str) -> DataFrame:
    """Sums a map of counters key by key: ``(key, total)``."""
    return df.select(F.explode(column).alias("key", "value")).groupBy("key").agg(F.sum("value").cast("bigint").alias("total"))


def frequency(df: DataFrame, column: str, absent: str = "none") -> DataFrame:
    return df.groupBy(F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(absent)).alias(column)).agg(F.count("*").alias("n"))


def sweep(readings: DataFrame, thresholds: list[float], correct: Column) -> DataFrame:
    """The gate replayed at several thresholds: ``(threshold, correct, wrong, review)``."""
    each = readings.withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))))
    passed = (F.col("status") == "accepted") & F.coalesce(~F.isnan("ocr_confidence") & F.col("ocr_confidence").between(0, 1) & (F.col("ocr_confidence") >= F.col("threshold")), F.lit(False))
    return each.groupBy("threshold").agg(count_where(passed & correct).alias("correct"), count_where(passed & ~correct).alias("wrong"), count_where(~passed).alias("review"))


def per_class(counts: DataFrame, label: str = "label") -> DataFrame:
    """Precision, recall and F1 per class from tp, fp and fn; 0 rather than null."""
    df = counts.groupBy(label).agg(*(F.sum(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn")))
    share = lambda n, d: F.round(n / F.greatest(F.lit(1), d), 9)
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return df.withColumns({"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn)})


def class_weights(df: DataFrame, label: str, classes: list[str]) -> DataFrame:
    """Rows / (classes * rows of the class), for each class named, present or not."""
    counted = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    named = df.sparkSession.createDataFrame([(c,) for c in classes], "label string")
    total = df.agg(F.count("*").alias("total"))
    joined = named.join(counted, "label", "left").crossJoin(F.broadcast(total))
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    return joined.select("label", n.alias("n"), F.round(F.col("total") / (len(classes) * F.greatest(n, F.lit(1))), 9).alias("weight"))


def profile(df: DataFrame, value: str) -> DataFrame:
    """Count, least, largest, mean."""
    return df.agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("largest"), F.round(F.avg(value), 9).alias("mean"))


def most_frequent(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    """The k most frequent values, equals in order of value."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def histogram(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """``(bin, n)``: equal bins between the least and the largest value, empty ones left out."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    place = F.least(F.lit(bins), F.floor((F.col(value) - F.col("lo")) * bins / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))) + 1)
    return df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(F.coalesce(place, F.lit(1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def split_by_class(df: DataFrame, classes: list[str], label: str = "label") -> DataFrame:
    """Rows per split (rows) and class (columns), zero-filled."""
    return df.groupBy("split").agg(*(count_where(F.col(label) == c).alias(c) for c in classes))


def weighted_mean(df: DataFrame, value: str, weight: str, *by: str) -> DataFrame:
    """Running means of an epoch at its end: sum of value times weight by sum of weights."""
    total = F.sum(F.col(weight).cast("double"))
    return df.groupBy(*by).agg(F.round(F.try_divide(F.sum(F.col(value) * F.col(weight)), total), 9).alias("mean"))


def build_report(df: DataFrame) -> DataFrame:
    """Rows and distinct groups of each split."""
    return df.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("leakage_group").alias("groups"))
