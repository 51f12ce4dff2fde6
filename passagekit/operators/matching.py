"""Matching of boxes within an image: overlaps, suppression, one-to-one assignments.

The assignments are sequential within an image and independent between images.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagekit import constants as C
from passagekit.functions import geometry as G

_XY = ("x1", "y1", "x2", "y2")


def iou_edges(truth: DataFrame, predictions: DataFrame, key: str = "image_id", threshold: float = C.IOU) -> DataFrame:
    """``(key, target_id, plate_id, iou)`` of all pairs of an image that overlap enough."""
    t = truth.select(key, "target_id", *(F.col(c).alias(f"t_{c}") for c in _XY))
    p = predictions.select(key, "plate_id", *(F.col(c).alias(f"p_{c}") for c in _XY))
    overlap = G.iou(G.box("t_"), G.box("p_"))
    return t.join(p, key).withColumn("iou", overlap).where(F.col("iou") >= threshold).select(key, "target_id", "plate_id", "iou")


def suppress(boxes: DataFrame, key: str = "image_id", id_col: str = "plate_id", threshold: float = C.IOU) -> DataFrame:
    """Greedy suppression: by falling confidence, ids breaking ties, a box stays unless it
    overlaps one that stays. A fold over the image's sorted boxes, in the JVM."""
    item = F.struct((-F.col("confidence")).alias("s"), F.col(id_col).alias("id"), *_XY)
    sorted_ = boxes.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("all"))
    corners = lambda b: tuple(b[c] for c in _XY)
    kept = F.aggregate(
        "all",
        F.slice("all", 1, 0),
        lambda kept, b: F.when(F.exists(kept, lambda k: G.iou(corners(k), corners(b)) >= threshold), kept).otherwise(F.array_append(kept, b)),
    )
    return sorted_.select(key, F.explode(kept).alias("b")).select(key, F.col("b.id").alias(id_col))


def maximum_matching(targets: list[int], edges: list[tuple[int, int, float]]) -> dict[int, int]:
    """Prediction per target, as many as possible: targets in order try their predictions
    by falling overlap, and may move earlier ones to another (augmenting paths)."""
    near: dict[int, list[int]] = {t: [] for t in targets}
    for t, p, _ in sorted(edges, key=lambda e: (-e[2], e[1])):
        near[t].append(p)
    owner: dict[int, int] = {}
    for start in targets:
        # A path of (target, its predictions still to try), kept as a stack.
        seen: set[int] = set()
        path, chosen = [(start, iter(near[start]))], []
        while path:
            p = next((p for p in path[-1][1] if p not in seen), None)
            if p is None:
                path.pop()
                if chosen:
                    chosen.pop()
                continue
            seen.add(p)
            chosen.append(p)
            if p not in owner:
                for (t, _), q in zip(path, chosen, strict=True):
                    owner[q] = t
                break
            path.append((owner[p], iter(near[owner[p]])))
    return {t: p for p, t in owner.items()}


def match_boxes(truth: DataFrame, predictions: DataFrame, key: str = "image_id", threshold: float = C.IOU) -> DataFrame:
    """``(key, target_id, plate_id, iou)``: a maximum one-to-one matching per image."""
    edges = iou_edges(truth, predictions, key, threshold)
    images = edges.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("target_id", "plate_id", "iou"))).alias("e"))

    def run(batches):  # many images in one batch
        for batch in batches:
            kept = []
            for items in batch.column(1).to_pylist():
                match = maximum_matching(sorted({x["target_id"] for x in items}), [(x["target_id"], x["plate_id"], x["iou"]) for x in items])
                kept.append([x for x in items if match.get(x["target_id"]) == x["plate_id"]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, batch.column(1).type)], names=[key, "e"])

    return images.mapInArrow(run, images.schema).select(key, F.explode("e").alias("x")).select(key, "x.*")


def match_by_class(predictions: DataFrame, truth: DataFrame, key: str = "image_id", threshold: float = C.IOU) -> DataFrame:
    """``(key, label, tp, fp, fn)``; inputs ``(key, ord, label, x1..y2)`` and, for
    predictions, ``confidence``. By falling confidence (then order) a prediction takes what
    is left of its class that overlaps it most and enough; of equal overlaps the later.

    Only overlaps that count are joined. A prediction keeps its choices in order, and a fold
    over a class's predictions gathers what is taken, all in the JVM.
    """
    p = predictions.select(key, "label", F.col("ord").alias("p_ord"), "confidence", *(F.col(c).alias(f"p_{c}") for c in _XY))
    t = truth.select(key, "label", F.col("ord").alias("t_ord"), *(F.col(c).alias(f"t_{c}") for c in _XY))
    near = p.join(t, [key, "label"]).withColumn("iou", G.iou(G.box("p_"), G.box("t_"))).where(F.col("iou") >= threshold)
    choice = F.struct((-F.col("iou")).alias("far"), (-F.col("t_ord")).alias("t"))
    choices = near.groupBy(key, "label", "p_ord", "confidence").agg(F.array_sort(F.collect_list(choice)).alias("c"))
    turn = F.struct((-F.col("confidence")).alias("s"), "p_ord", F.transform("c", lambda x: x["t"]).alias("c"))
    turns = choices.groupBy(key, "label").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def take(taken, one):
        return F.concat(taken, F.slice(F.filter(one["c"], lambda x: ~F.array_contains(taken, x)), 1, 1))

    nothing = F.slice(F.transform("turns", lambda x: x["c"][0]), 1, 0)
    hits = turns.select(key, "label", F.size(F.aggregate("turns", nothing, take)).cast("bigint").alias("tp"))
    both = predictions.select(key, "label", F.lit(1).alias("p"), F.lit(0).alias("t")).unionByName(truth.select(key, "label", F.lit(0).alias("p"), F.lit(1).alias("t")))
    sums = both.groupBy(key, "label").agg(F.sum("p").alias("p"), F.sum("t").alias("t")).join(hits, [key, "label"], "left")
    tp = F.coalesce("tp", F.lit(0).cast("bigint"))
    return sums.select(key, "label", tp.alias("tp"), (F.col("p") - tp).alias("fp"), (F.col("t") - tp).alias("fn"))
