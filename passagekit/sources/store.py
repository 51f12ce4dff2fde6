"""Files and folders published on the cluster's file system, through Hadoop's `FileContext`:
what is written becomes visible by one rename.

On HDFS and local or mounted disks a rename is atomic. Object stores that copy instead need
their own committer for tables; a single small object is put whole there, so pointers hold.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _context(spark: SparkSession, path: str):
    """``(file context, Hadoop path, its parent)``; a bare path is one of the default file
    system."""
    hadoop = spark._jvm.org.apache.hadoop
    place = hadoop.fs.Path(path)
    context = hadoop.fs.FileContext.getFileContext(place.toUri() if place.toUri().getScheme() else hadoop.fs.FileSystem.getDefaultUri(spark._jsc.hadoopConfiguration()), spark._jsc.hadoopConfiguration())
    return context, place


def _options(spark: SparkSession, kind: str, *names: str):
    enum = getattr(spark._jvm.org.apache.hadoop.fs, kind)
    array = spark.sparkContext._gateway.new_array(enum, len(names))
    for i, name in enumerate(names):
        array[i] = enum.valueOf(name)
    return array


def exists(spark: SparkSession, path: str) -> bool:
    context, place = _context(spark, path)
    return context.util().exists(place)


def read_json(spark: SparkSession, path: str):
    """The value of a small JSON file; None if there is none."""
    if not exists(spark, path):
        return None
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def write_json(spark: SparkSession, path: str, value) -> None:
    """A small JSON file in place of whatever was there: readers see the old or the new one
    whole. Of writers that race the last rename stands. NaN is refused."""
    text = json.dumps(value, indent=1, sort_keys=True, allow_nan=False)
    context, place = _context(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{place.getName()}.{uuid.uuid4().hex}")
    context.mkdir(place.getParent(), None, True)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(part, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    context.rename(part, place, _options(spark, "Options$Rename", "OVERWRITE"))


def commit(spark: SparkSession, staged: str, path: str) -> bool:
    """Makes the finished folder ``staged`` visible as ``path``. False, and ``staged`` is
    dropped, where another writer came first: a published folder is never replaced."""
    context, place = _context(spark, path)
    source = spark._jvm.org.apache.hadoop.fs.Path(staged)
    context.mkdir(place.getParent(), None, True)
    try:
        context.rename(source, place, _options(spark, "Options$Rename"))
        return True
    except Py4JJavaError as failed:
        if "FileAlreadyExists" not in failed.java_exception.getClass().getName() and not context.util().exists(place):
            raise
        context.delete(source, True)
        return False
