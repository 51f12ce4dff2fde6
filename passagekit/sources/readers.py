"""Readers of manifests, annotations, labels, listings and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagekit.functions import text as T

BOX = "struct<xmin: double, ymin: double, xmax: double, ymax: double, text: string, raw_text: string, text_status: string, leakage_identity: string>"
MANIFEST = (
    "image_path string, source_id string, source_sha256 string, width int, height int, source string, orig_source string, split string, "
    "leakage_group string, image_sha256 string, pixel_sha256 string, source_pixel_sha256 string, duplicate_source_sha256 array<string>, "
    f"condition string, severity string, full_image_labels_verified boolean, boxes array<{BOX}>"
)
_ATTRIBUTES = "attributes struct<attribute: array<struct<name: string, value: string>>>"
VOC = (
    "filename string, size struct<width: int, height: int>, "
    f"object array<struct<name: string, bndbox: struct<xmin: double, ymin: double, xmax: double, ymax: double>, {_ATTRIBUTES.replace(' struct', ': struct', 1)}>>"
)
KINDS = {"image": (".jpg", ".jpeg", ".png", ".bmp", ".webp"), "annotation": (".xml", ".json", ".txt", ".csv")}


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of image records; an empty one is refused."""
    df = spark.read.schema(MANIFEST).json(path, multiLine=True).withColumn("image_path", T.portable_path(F.col("image_path")))
    if df.isEmpty():
        raise ValueError(f"no records in {path}")
    return df


def voc(spark: SparkSession, path: str) -> DataFrame:
    """VOC annotations as records ``(file, filename, width, height, boxes)``. Objects without
    a box are skipped; the text is the attribute ``number_plate_text``, else the name's."""
    df = spark.read.format("xml").option("rowTag", "annotation").schema(VOC).load(path)
    named = lambda o: F.get(F.filter(o["attributes"]["attribute"], lambda a: a["name"] == "number_plate_text"), F.lit(0))["value"]
    boxed = F.filter(F.coalesce("object", F.array()), lambda o: o["bndbox"].isNotNull())
    boxes = F.transform(boxed, lambda o: F.struct(*(o["bndbox"][c].alias(c) for c in ("xmin", "ymin", "xmax", "ymax")), o["name"].alias("name"), T.missing(named(o)).alias("text")))
    return df.select("filename", F.col("size.width").alias("width"), F.col("size.height").alias("height"), boxes.alias("boxes"), F.size(F.coalesce("object", F.array())).alias("objects"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """All files below a folder: ``(path, modificationTime, length, kind)``; contents are
    not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")
    kind = F.lit("other")
    for name, suffixes in KINDS.items():
        kind = F.when(T.suffix(F.col("path")).isin(*suffixes), name).otherwise(kind)
    return df.withColumn("kind", kind)


def preview(files: DataFrame, n: int = 3, chars: int = 500) -> DataFrame:
    """``(suffix, files, samples)`` of ``files (path, text)``: per suffix how many, and the
    first few paths with the beginning of their text."""
    df = files.withColumn("suffix", T.suffix(F.col("path")))
    counts = df.groupBy("suffix").agg(F.count("*").alias("files"))
    first = df.withColumn("rank", F.row_number().over(Window.partitionBy("suffix").orderBy("path"))).where(F.col("rank") <= n)
    samples = first.groupBy("suffix").agg(F.array_sort(F.collect_list(F.struct("path", F.substring("text", 1, chars).alias("text")))).alias("samples"))
    return counts.join(samples, "suffix")


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Lines of label files ``class xc yc w h``: ``(path, class, xc, yc, w, h, valid)``."""
    df = spark.read.text(path).where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("path"), F.split(F.trim("value"), r"\s+").alias("f"))
    number = lambda i: F.get("f", F.lit(i)).try_cast("double")
    fields = [F.get("f", F.lit(0)).try_cast("int").alias("class"), *(number(i).alias(c) for i, c in enumerate(("xc", "yc", "w", "h"), 1))]
    out = df.select("path", F.size("f").alias("n"), *fields)
    share = lambda c: F.col(c).between(0.0, 1.0)
    valid = (F.col("n") == 5) & (F.col("class") == 0) & share("xc") & share("yc") & share("w") & share("h")
    return out.withColumn("valid", F.coalesce(valid, F.lit(False))).drop("n")


def frames(files: DataFrame, prefix: str, first: int, last: int) -> DataFrame:
    """Numbered frames of a sequence, by number: ``(path, frame_idx)``."""
    number = F.regexp_extract(T.stem(F.col("path")), f"^{prefix}([0-9]+)$", 1)
    return files.select("path", number.try_cast("bigint").alias("frame_idx")).where(F.col("frame_idx").between(first, last)).orderBy("frame_idx")


def stride(frames_: DataFrame, every: int, column: str = "frame_idx") -> DataFrame:
    if every < 1:
        raise ValueError("the stride must be positive")
    return frames_.where(F.col(column) % every == 0)


def policy(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A small JSON list of decisions or reviews, with a schema of its own."""
    return spark.read.schema(schema).json(path, multiLine=True)


def resumable(spark: SparkSession, path: str, schema: str, fingerprint: str) -> DataFrame:
    """A saved report's rows, to go on from; refused if made for another input."""
    df = spark.read.schema(schema).json(path)
    other = df.where(~F.col("fingerprint").eqNullSafe(F.lit(fingerprint)))
    if not other.isEmpty():
        raise ValueError("the saved report belongs to another input")
    return df


def newest(files: DataFrame) -> DataFrame:
    """The file changed last, of equals the one of the greatest path."""
    return files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def pair_images(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """Annotations ``(path, filename)`` with the image of their folder of the same name, else
    of the same stem whatever its case; ``image`` is the least such path, ``candidates`` how
    many there are."""
    folder = lambda c: F.regexp_replace(F.col(c), "/[^/]*$", "")
    named = images.select(F.col("path").alias("image"), folder("path").alias("folder"), T.base_name(F.col("path")).alias("name"), F.lower(T.stem(F.col("path"))).alias("stem"))
    by = lambda k: named.groupBy("folder", k).agg(F.min("image").alias(f"by_{k}"), F.count("*").alias(f"n_{k}"))
    wanted = annotations.withColumns({"folder": folder("path"), "name": T.base_name(F.col("filename")), "stem": F.lower(T.stem(F.col("filename")))})
    df = wanted.join(by("name"), ["folder", "name"], "left").join(by("stem"), ["folder", "stem"], "left")
    return df.select(*annotations.columns, F.coalesce("by_name", "by_stem").alias("image"), F.coalesce("n_name", "n_stem", F.lit(0)).cast("bigint").alias("candidates"))


def pair_by_position(images: DataFrame, annotations: DataFrame, moved: dict[int, int]) -> DataFrame:
    """Images ``(number, ...)`` with annotations ``(number, ...)`` of the same number, or of
    the number ``moved`` gives for it."""
    target = F.col("number")
    for a, b in moved.items():
        target = F.when(F.col("number") == a, F.lit(b)).otherwise(target)
    right = annotations.select(*(F.col(c).alias("annotation_" + c) for c in annotations.columns))
    return images.withColumn("annotation_number", target.cast("int")).join(right.withColumn("annotation_number", F.col("annotation_number").cast("int")), "annotation_number", "left")
