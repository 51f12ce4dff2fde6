"""Writers of labels, annotations, manifests and content-addressed builds.

Tables go through Spark's commit protocol; builds and their pointer become visible by a
rename (`store`).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagekit.functions import geometry as G
from passagekit.operators.provenance import as_record, seen
from passagekit.sources import store


def label_line(box: G.Box, width: Column, height: Column, digits: int = 6, label: int = 0) -> Column:
    """``class xc yc w h``, cut at the image's borders; null for boxes of a pixel or less."""
    b = G.normalised(box, width, height)
    return F.when(b[0].isNotNull(), F.format_string(" ".join([str(label), *[f"%.{digits}f"] * 4]), *b))


def label_line_uncut(box: G.Box, width: Column, height: Column, digits: int = 9, label: int = 0) -> Column:
    """The same without cutting."""
    b = ((box[0] + box[2]) / 2 / width, (box[1] + box[3]) / 2 / height, (box[2] - box[0]) / width, (box[3] - box[1]) / height)
    return F.format_string(" ".join([str(label), *[f"%.{digits}f"] * 4]), *(x.cast("double") for x in b))


def label_files(boxes: DataFrame, key: str = "image_id", digits: int = 6) -> DataFrame:
    """``(key, content)``: the lines of each image, in order of ``ord``."""
    line = label_line(G.box(), F.col("width"), F.col("height"), digits)
    lines = boxes.select(key, "ord", line.alias("line"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("ord", "line")))), lambda x: x["line"]), "\n")
    return lines.groupBy(key).agg(joined.alias("content"))


def write_voc(entries: DataFrame, path: str) -> None:
    """Records ``(filename, width, height, boxes)`` as VOC annotations; texts become
    attributes, absent ones are left out."""
    attributes = lambda b: F.struct(F.array(F.struct(F.lit("number_plate_text").alias("name"), b["text"].alias("value"))).alias("attribute"))
    objects = F.transform(
        "boxes",
        lambda b: F.struct(F.coalesce(b["name"], F.lit("plate")).alias("name"), F.when(b["text"].isNotNull(), attributes(b)).alias("attributes"), F.struct(*(b[c].alias(c) for c in ("xmin", "ymin", "xmax", "ymax"))).alias("bndbox")),
    )
    rows = entries.select("filename", F.struct("width", "height").alias("size"), objects.alias("object"))
    rows.write.format("xml").option("rowTag", "annotation").option("rootTag", "annotations").mode("errorifexists").save(path)


def write_manifest(entries: DataFrame, violations: DataFrame, path: str) -> None:
    """JSON lines partitioned by split, unless any rule is violated."""
    bad = violations.limit(20).collect()
    if bad:
        raise ValueError(f"not written, rules are violated: {[tuple(r) for r in bad]}")
    entries.write.partitionBy("split").json(path)


def subsets(entries: DataFrame) -> dict[str, DataFrame]:
    """The manifests of a build: one per split, and of images whose boxes all have a text
    (an image without boxes has them all)."""
    readable = entries.where(F.forall("boxes", lambda b: b["text"].isNotNull()))
    return {**{s: entries.where(F.col("split") == s) for s in ("train", "val", "test")}, "ocr": readable}


def write_provenance(entries: DataFrame, path: str) -> None:
    """What a checkpoint has seen, beside it: one row of sorted sets."""
    as_record(seen(entries)).write.json(path)


def inventory(files: DataFrame) -> DataFrame:
    """``(path, digest)`` of files read with their content."""
    return files.select("path", F.sha2("content", 256).alias("digest"))


def inventory_problems(found: DataFrame, expected: DataFrame) -> DataFrame:
    """``(path, problem)`` where an inventory is not met exactly."""
    e = expected.select("path", F.col("digest").alias("want"))
    problem = F.when(F.col("want").isNull(), "unexpected").when(F.col("digest").isNull(), "missing").when(F.col("digest") != F.col("want"), "changed")
    return found.join(e, "path", "full_outer").select("path", problem.alias("problem")).where("problem IS NOT NULL")


def build_id(entries: DataFrame, config: dict) -> str:
    """Names a build by its content, whatever the order of its rows, and the configuration.

    The rows' digests are added up in eight lanes of 32 bits, so that repeated rows count
    and no task holds more than a sum; the name is a digest of the sums and the number of
    rows. It tells builds apart, but is no proof against rows made to collide.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(entries.columns)), {"ignoreNullFields": "false"}), 256)
    lane = lambda i: F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(10,0)").cast("decimal(28,0)")
    sums = [F.coalesce(F.sum(lane(i)), F.lit(0)).cast("string") for i in range(8)]
    whole = F.concat_ws(",", F.count("*").cast("string"), *sums)
    text = json.dumps(config, sort_keys=True, allow_nan=False)
    return entries.select(row.alias("h")).agg(F.sha2(F.concat(F.lit(text + "\n"), whole), 256)).first()[0]


def publish(entries: DataFrame, violations: DataFrame, root: str, config: dict) -> str:
    """Writes a build under its id unless it is there, and points ``current.json`` at it;
    returns the build's folder.

    A build is written aside and renamed when whole, so readers never see half of one; of
    writers of the same build the first stands and the others' folders are dropped. What a
    writer leaves that is lost midway is a hidden folder ``.staged-...`` that nobody reads.
    """
    spark, name = entries.sparkSession, build_id(entries, config)
    folder = f"{root}/{name}"
    if not store.exists(spark, folder):
        staged = f"{root}/.staged-{uuid.uuid4().hex}"
        write_manifest(entries, violations, staged)
        store.commit(spark, staged, folder)
    store.write_json(spark, f"{root}/current.json", {"build": name, "config": config})
    return folder


def current(spark: SparkSession, root: str) -> DataFrame | None:
    """The rows of the build that ``current.json`` points at; None before the first."""
    pointer = store.read_json(spark, f"{root}/current.json")
    return spark.read.json(f"{root}/{pointer['build']}") if pointer else None
