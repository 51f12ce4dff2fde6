"""Boxes (x1, y1, x2, y2) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from passagekit import constants as C

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def _positive(x: Column) -> Column:
    return F.greatest(F.lit(0), x)


def area(b: Box) -> Column:
    return _positive(b[2] - b[0]) * _positive(b[3] - b[1])


def intersection(a: Box, b: Box) -> Column:
    return _positive(F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * _positive(F.least(a[3], b[3]) - F.greatest(a[1], b[1]))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 for boxes without area."""
    both = intersection(a, b)
    return both / F.greatest((area(a) + area(b) - both).cast("double"), F.lit(1e-12))


def contained(inner: Box, outer: Box) -> Column:
    """Share of the inner box's area that lies in the outer; null without area."""
    return intersection(inner, outer) / F.nullif(area(inner).cast("double"), F.lit(0.0))


def centre_in(inner: Box, outer: Box) -> Column:
    cx, cy = (inner[0] + inner[2]) / 2, (inner[1] + inner[3]) / 2
    return cx.between(outer[0], outer[2]) & cy.between(outer[1], outer[3])


def valid(b: Box, width: Column, height: Column) -> Column:
    """Finite, inside the image and of positive area; false where anything is null."""
    inside = (b[0] >= 0) & (b[1] >= 0) & (b[2] <= width) & (b[3] <= height) & (b[0] < b[2]) & (b[1] < b[3])
    for x in b:
        inside &= ~F.isnan(x.cast("double")) & (F.abs(x) < float("inf"))
    return F.coalesce(inside, F.lit(False))


def padded(b: Box, width: Column, height: Column, share: float = C.PAD_SHARE) -> Box:
    """Grown on each side by a share of its size, two pixels at least (half rounds to
    even), cut at the image's borders."""
    dx, dy = (F.greatest(F.lit(C.PAD_LEAST), F.bround((b[i + 2] - b[i]) * F.lit(share)).cast("int")) for i in (0, 1))
    return F.greatest(F.lit(0), b[0] - dx), F.greatest(F.lit(0), b[1] - dy), F.least(width, b[2] + dx), F.least(height, b[3] + dy)


def crop(b: Box, width: Column, height: Column) -> Box:
    """Whole pixels that hold the box, padded."""
    whole = (F.floor(b[0]), F.floor(b[1]), F.ceil(b[2]), F.ceil(b[3]))
    return padded(tuple(x.cast("int") for x in whole), width, height)


def normalised(b: Box, width: Column, height: Column) -> Box:
    """Centre and size as shares of the image, after cutting at its borders; null where at
    most a pixel of either side is left."""
    x1, y1 = F.greatest(F.lit(0.0), b[0].cast("double")), F.greatest(F.lit(0.0), b[1].cast("double"))
    x2, y2 = F.least(width.cast("double"), b[2].cast("double")), F.least(height.cast("double"), b[3].cast("double"))
    ok = (x2 - x1 > 1) & (y2 - y1 > 1)
    return tuple(F.when(ok, v) for v in ((x1 + x2) / 2 / width, (y1 + y2) / 2 / height, (x2 - x1) / width, (y2 - y1) / height))


def from_normalised(b: Box, width: Column, height: Column) -> Box:
    """Corners from centre and size as shares."""
    cx, cy, w, h = b
    return (cx - w / 2) * width, (cy - h / 2) * height, (cx + w / 2) * width, (cy + h / 2) * height


def scaled(boxes: Column, factor: Column) -> Column:
    """An array of box structs after the image was resized by a factor of at most 1."""
    f = F.least(F.lit(1.0), factor)
    return F.transform(boxes, lambda b: F.struct(*((b[c] * f).alias(c) for c in ("x1", "y1", "x2", "y2"))))


def tile_starts(length: Column, tile: int, overlap: int) -> Column:
    """Where tiles of one axis start; the last one ends with the axis."""
    last = length - tile
    regular = F.sequence(F.lit(0), F.greatest(F.lit(0), last), F.lit(tile - overlap))
    whole = F.when(F.element_at(regular, -1) != last, F.array_append(regular, last)).otherwise(regular)
    return F.when(length <= tile, F.array(F.lit(0))).otherwise(whole)
