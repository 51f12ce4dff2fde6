"""Strict acceptance of annotations: every finding is either covered by a reviewed decision
or a violation, and nothing is written while there are violations.

``annotations (annotation, filename, width, height, objects array<struct<name,
bndbox struct<xmin, ymin, xmax, ymax>>>)`` as declared, ``images (image, width, height)`` as
they are, ``policy (rule, key, value)`` with the decisions:

    missing_image        key: annotation                its image is known to be absent
    filename_repair      key: annotation                value: the true base name
    dimension_repair     key: annotation                value: ``declared>actual``, as ``10x20>20x10``
    unannotated_image    key: image                     needs no annotation
    exclude_label        key: cleaned text              value: reason; its annotation is left out
    detection_only       key: cleaned text              value: reason; the box stays, without text
    identity_alias       key: cleaned text              value: the identity it stands for

The policy is the one side that is broadcast, and only below `MAX_POLICY` rows; beyond, the
lookups are left to the planner. Decisions of one rule and key that disagree are violations.

Defined cases: a null file name is an empty one; null sizes or corners break their rule; no
objects at all break ``empty_annotation``; an object without a box breaks ``missing_box``. Of
several images that fit, the exact base name wins, else a stem (whatever its case) that only
one image of the folder has; several are ``ambiguous_image``. Repeated annotations are
reported as ``repeated_annotation``, repeated images as ``repeated_image``. Empty tables give
empty ones; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagekit.functions import geometry as G
from passagekit.functions import text as T

MAX_POLICY = 200_000
_CORNERS = ("xmin", "ymin", "xmax", "ymax")


def _decisions(policy: DataFrame) -> DataFrame:
    """One value per rule and key; those that disagree are in `_disagreeing`."""
    one = policy.groupBy("rule", "key").agg(F.min("value").alias("value"))
    return F.broadcast(one) if policy.limit(MAX_POLICY + 1).count() <= MAX_POLICY else one


def _disagreeing(policy: DataFrame) -> DataFrame:
    n = F.count_distinct(F.coalesce("value", F.lit("")))
    return policy.groupBy("rule", "key").agg(n.alias("n")).where("n > 1").select(F.lit("policy").alias("rule"), F.concat_ws(":", "rule", "key").alias("key"))


def _decided(df: DataFrame, decisions: DataFrame, rule: str, by: str, name: str) -> DataFrame:
    """Adds ``name``, the decision's value, and ``has_<name>``, whether there is one."""
    d = decisions.where(F.col("rule") == rule).select(F.col("key").alias(by), F.lit(True).alias(f"has_{name}"), F.col("value").alias(name))
    return df.join(d, by, "left").withColumn(f"has_{name}", F.coalesce(f"has_{name}", F.lit(False)))


def _broken(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``(rule, key)`` of all rules that hold, in one pass over the rows."""
    names = F.array_compact(F.array(*(F.when(holds, F.lit(name)) for name, holds in rules.items())))
    return df.select(F.explode(names).alias("rule"), F.col("annotation").alias("key"))


def _folder(path: str) -> Column:
    return F.regexp_replace(F.col(path), "/?[^/]*$", "")


def resolved(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """Annotations with ``image, actual_width, actual_height`` and ``candidates``: how many
    images fit (1 where the exact name does)."""
    known = images.select(F.col("image"), F.struct("image", "width", "height").alias("found"), _folder("image").alias("folder"), T.base_name(F.col("image")).alias("name"), F.lower(T.stem(F.col("image"))).alias("stem"))
    by = lambda k: known.groupBy("folder", k).agg(F.min("found").alias(f"by_{k}"), F.count_distinct("image").alias(f"n_{k}"))
    base = T.base_name(T.portable_path(F.coalesce("filename", F.lit(""))))
    df = annotations.withColumns({"folder": _folder("annotation"), "name": base, "stem": F.lower(T.stem(F.col("annotation")))})
    df = df.join(by("name"), ["folder", "name"], "left").join(by("stem"), ["folder", "stem"], "left")
    found = F.coalesce("by_name", F.when(F.col("n_stem") == 1, F.col("by_stem")))
    return df.select(
        *annotations.columns, F.col("name").alias("declared_name"), found["image"].alias("image"), found["width"].alias("actual_width"), found["height"].alias("actual_height"),
        F.when(F.col("by_name").isNotNull(), 1).otherwise(F.coalesce("n_stem", F.lit(0))).alias("candidates"),
    )


def inspect(annotations: DataFrame, images: DataFrame, policy: DataFrame) -> dict[str, DataFrame]:
    """What a source comes to under its policy, as tables:

    ``boxes (annotation, image, ord, xmin..ymax, raw_text, text, text_status, reason,
    leakage_identity)`` of accepted annotations, ``exclusions (kind, key, reason)``,
    ``repairs (annotation, kind, original, corrected)`` and ``violations (rule, key)``.
    """
    annotations, images = annotations.select("annotation", "filename", "width", "height", "objects"), images.select("image", "width", "height")
    policy = policy.select("rule", "key", "value").where("key IS NOT NULL")
    decisions = _decisions(policy)
    whole = resolved(annotations, images)
    for rule, name in (("missing_image", "absent"), ("filename_repair", "true_name"), ("dimension_repair", "true_size")):
        whole = _decided(whole, decisions, rule, "annotation", name)
    size = lambda a, b: F.concat_ws("x", F.coalesce(F.col(a).cast("string"), F.lit("?")), F.coalesce(F.col(b).cast("string"), F.lit("?")))
    declared, actual = size("width", "height"), size("actual_width", "actual_height")
    other_name = F.lower("declared_name") != F.lower(T.base_name(F.col("image")))
    whole = whole.withColumns(
        {
            "found": F.col("image").isNotNull(),
            "other_name": F.coalesce(other_name, F.lit(False)),
            "other_size": F.col("image").isNotNull() & (declared != actual),
            "sizes": F.concat_ws(">", declared, actual),
            "true_base": T.base_name(F.col("image")),
        }
    )
    named_well = F.col("has_true_name") & F.col("true_name").eqNullSafe(F.col("true_base"))
    sized_well = F.col("has_true_size") & F.col("true_size").eqNullSafe(F.col("sizes"))

    objects = whole.where("found").select("annotation", "image", "actual_width", "actual_height", F.posexplode_outer("objects").alias("ord", "o"))
    boxes = objects.where("o IS NOT NULL").select(
        "annotation", "image", "ord", F.col("actual_width").alias("width"), F.col("actual_height").alias("height"), F.col("o.bndbox").isNull().alias("unboxed"),
        *(F.col(f"o.bndbox.{c}").alias(c) for c in _CORNERS), F.coalesce("o.name", F.lit("")).alias("raw_text"),
    ).withColumn("cleaned", T.clean(F.col("raw_text")))
    for rule, name in (("exclude_label", "excluded"), ("detection_only", "untexted"), ("identity_alias", "alias")):
        boxes = _decided(boxes, decisions, rule, "cleaned", name)
    status = F.when(F.col("has_excluded"), "excluded").when(F.col("has_untexted"), "detection_only").when(T.is_plausible(F.col("cleaned")), "transcribed")
    corners = tuple(F.col(c) for c in _CORNERS)
    inside = F.coalesce(G.valid(corners, F.col("width"), F.col("height")), F.lit(False))
    boxes = boxes.withColumns({"text_status": status, "inside": inside, "reason": F.when(F.col("has_excluded"), F.col("excluded")).when(F.col("has_untexted"), F.col("untexted"))})

    pictures = _decided(images.join(whole.select("image").where("image IS NOT NULL").distinct(), "image", "left_anti").select("image").distinct(), decisions, "unannotated_image", "image", "lone")
    unannotated = pictures.where("has_lone")
    of_notes = {
        "ambiguous_image": F.expr("NOT found AND candidates > 1"),
        "missing_image": F.expr("NOT found AND candidates = 0 AND NOT has_absent"),
        "filename": F.col("other_name") & ~named_well,
        "dimensions": F.col("other_size") & ~sized_well,
        "empty_annotation": F.col("found") & (F.coalesce(F.size("objects"), F.lit(0)) <= 0),
    }
    of_boxes = {"missing_box": F.col("unboxed"), "box": F.expr("NOT unboxed AND NOT inside"), "label": F.col("text_status").isNull()}
    repeats = lambda df, name, key: df.groupBy(key).count().where("count > 1").select(F.lit(name).alias("rule"), F.col(key).alias("key"))
    violations = (
        _broken(whole, of_notes)
        .unionByName(_broken(boxes, of_boxes))
        .unionByName(pictures.where("NOT has_lone").select(F.lit("unannotated_image").alias("rule"), F.col("image").alias("key")))
        .unionByName(repeats(annotations, "repeated_annotation", "annotation"))
        .unionByName(repeats(images, "repeated_image", "image"))
        .unionByName(_disagreeing(policy))
    )

    out = boxes.where("text_status = 'excluded'").groupBy("annotation").agg(F.max_by("reason", "ord").alias("reason"))
    exclusions = (
        whole.where("NOT found AND candidates = 0 AND has_absent").select(F.lit("annotation").alias("kind"), F.col("annotation").alias("key"), F.lit("missing_source_image").alias("reason"))
        .unionByName(out.select(F.lit("annotation").alias("kind"), F.col("annotation").alias("key"), "reason"))
        .unionByName(unannotated.select(F.lit("image").alias("kind"), F.col("image").alias("key"), F.lit("alternate_encoding_without_separate_annotation").alias("reason")))
    )
    repairs = whole.where(F.col("other_name") & named_well).select("annotation", F.lit("filename").alias("kind"), F.coalesce("filename", F.lit("")).alias("original"), F.col("true_base").alias("corrected"))
    repairs = repairs.unionByName(whole.where(F.col("other_size") & sized_well).select("annotation", F.lit("dimensions").alias("kind"), declared.alias("original"), actual.alias("corrected")))
    kept = boxes.join(out, "annotation", "left_anti").select(
        "annotation", "image", "ord", *_CORNERS, "raw_text", F.when(F.col("text_status") == "transcribed", F.col("cleaned")).alias("text"), "text_status", "reason",
        F.coalesce("alias", "cleaned").alias("leakage_identity"),
    )
    return {"boxes": kept, "exclusions": exclusions, "repairs": repairs, "violations": violations.distinct()}
