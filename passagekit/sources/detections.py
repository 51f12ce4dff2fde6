"""Detections in label shards, as a source of its own: what a scan asks for decides which
files and lines are read at all.

A shard is a plain text file below ``class=<number>/``; its lines are ``image box xc yc w h
confidence``, separated by blanks. Wanted classes leave out whole folders when the scan is
planned; a least confidence and a range of images are decided on a line before its box is
parsed. Filters put on the DataFrame later stay with Spark.

What is wanted are options of the scan, not filters that Spark hands down: Spark 4.1 keeps
what one query handed to a Python source for the next one over the same loaded DataFrame, so
that an unfiltered count after a filtered one lacks rows, as do self-joins of two filters.

Files are read through pyarrow's file systems (local, mounted, HDFS, object stores), cut into
ranges of ``split_bytes``; small ones share a task. A task holds a block of 1 MB and a batch.

A line belongs to the range in which it begins. Blank lines are passed by; an empty or absent
folder gives no rows. A line of another number of fields, or whose deciding numbers cannot be
read or are not finite, is an error that names the file, whether or not it would be kept.
Repeated lines are repeated rows. Nothing is ever null.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import datasource as D

from passagekit.functions import geometry as G

SCHEMA = "image bigint, box bigint, class int, xc double, yc double, w double, h double, confidence double"
_ARROW = pa.schema([(n, {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}[k]) for n, k in (c.split() for c in SCHEMA.split(", "))])
BLOCK, ROWS = 1 << 20, 8192


@dataclass
class Ranges(D.InputPartition):
    """``(path, class, first byte, end)`` of what a task reads."""

    parts: list[tuple[str, int, int, int]]


class Detections(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "detections"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        o = self.options
        classes = None if "classes" not in o else frozenset(map(int, filter(None, o["classes"].split(","))))
        return Reader(o["path"], int(o.get("split_bytes", 32 << 20)), classes, float(o.get("confidence", "-inf")), int(o.get("first", -(1 << 63))), int(o.get("last", (1 << 63) - 1)))


class Reader(D.DataSourceReader):
    def __init__(self, path: str, split_bytes: int = 32 << 20, classes: frozenset[int] | None = None, confidence: float = -math.inf, first: int = -(1 << 63), last: int = (1 << 63) - 1):
        if split_bytes < 1:
            raise ValueError("split_bytes must be positive")
        if math.isnan(confidence):
            raise ValueError("the least confidence must be a number")
        self.path, self.split_bytes, self.classes, self.confidence, self.first, self.last = path, split_bytes, classes, confidence, first, last

    def partitions(self) -> list[Ranges]:
        fs, root = pa.fs.FileSystem.from_uri(self.path)
        found = fs.get_file_info(pa.fs.FileSelector(root, recursive=True, allow_not_found=True))
        tasks, open_, size = [], [], 0
        for info in sorted(found, key=lambda i: i.path):
            folder = re.search(r"/class=(-?[0-9]+)/[^/]+$", info.path)
            if info.type != pa.fs.FileType.File or not folder or info.base_name[0] in "._":
                continue
            label = int(folder[1])
            if self.classes is not None and label not in self.classes:
                continue
            for start in range(0, info.size, self.split_bytes):
                end = min(start + self.split_bytes, info.size)
                if open_ and size + end - start > self.split_bytes:
                    tasks.append(Ranges(open_))
                    open_, size = [], 0
                open_.append((info.path, label, start, end))
                size += end - start
        return [*tasks, Ranges(open_)]  # a task without ranges where there is nothing to read

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        fs, _ = pa.fs.FileSystem.from_uri(self.path)
        rows: list[tuple] = []
        for path, label, start, end in partition.parts:
            with fs.open_input_file(path) as file:
                for line in _lines(file, start, end, path):
                    row = self._row(line, label, path)
                    if row:
                        rows.append(row)
                    if len(rows) == ROWS:
                        yield _batch(rows)
                        rows = []
        if rows:
            yield _batch(rows)

    def _row(self, line: bytes, label: int, path: str) -> tuple | None:
        fields = line.split()
        if not fields:
            return None
        try:
            if len(fields) != 7:
                raise ValueError
            image, confidence = int(fields[0]), float(fields[6])
            if not math.isfinite(confidence):
                raise ValueError
            if confidence < self.confidence or not self.first <= image <= self.last:
                return None
            return image, int(fields[1]), label, *map(float, fields[2:6]), confidence
        except ValueError:
            raise ValueError(f"not a line of labels in {path}: {line[:200]!r}") from None


def _lines(file: pa.NativeFile, start: int, end: int, path: str) -> Iterator[bytes]:
    """The lines that begin in ``[start, end)``."""
    at = max(start - 1, 0)  # the byte before tells whether a line begins at start
    file.seek(at)
    rest, inside = b"", start > 0
    while block := file.read(BLOCK):
        *whole, rest = (rest + block).split(b"\n")
        for line in whole:
            begin, at = at, at + len(line) + 1
            if inside:
                inside = False
            elif begin >= end:
                return
            else:
                yield line
        if len(rest) > BLOCK:
            raise ValueError(f"not a line of labels in {path}: over {BLOCK} bytes long")
        if at >= end and not inside:
            return
    if not inside and at < end:
        yield rest


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


def scan(spark: SparkSession, path: str, classes: Iterable[int] | None = None, confidence: float | None = None, images: tuple[int, int] | None = None, split_bytes: int = 32 << 20) -> DataFrame:
    """Rows of `SCHEMA` of the shards below ``path``: of ``classes``, of ``confidence`` or
    more, of images from the first to the last of ``images``; all, where not given."""
    spark.dataSource.register(Detections)
    wanted = {"classes": None if classes is None else ",".join(map(str, classes)), "confidence": confidence, "first": images and images[0], "last": images and images[1]}
    given = {k: str(v) for k, v in wanted.items() if v is not None}
    return spark.read.format("detections").options(split_bytes=split_bytes, **given).load(path)


def write(boxes: DataFrame, path: str, width, height) -> None:
    """Boxes ``(image, box, class, x1..y2, confidence)`` as shards, cut at the borders of
    ``width`` by ``height`` (columns); boxes of a pixel or less are left out, as in label
    files. A null in any other column is an error of the write."""
    b = G.normalised(G.box(), width, height)
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.raise_error(F.lit(f"null in {c}")).cast("string"))
    places = F.format_string(" ".join(["%.9f"] * 4), *b)
    line = F.concat_ws(" ", number("image"), number("box"), places, number("confidence"))
    boxes.where(b[0].isNotNull()).select(line.alias("value"), F.col("class").cast("int").alias("class")).write.partitionBy("class").text(path)
