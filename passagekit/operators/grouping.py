"""Which images belong together: equal pixels, near duplicates, one plate, one sequence."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagekit import constants as C
from passagekit.functions import text as T
from passagekit.functions.values import differing_bits
from passagekit.operators.components import components, split

#: Masks of the bands: of five, four differing bits leave one as it is. Each takes every fifth
#: bit, so that a run of bits that are the same everywhere does not make a band of its own.
BANDS = tuple(sum(1 << b for b in range(i, 64, 5)) for i in range(5))


def exact_dedupe(records: DataFrame, hash_col: str = "pixel_sha256", path_col: str = "path") -> DataFrame:
    """One row per hash: the least path and how many rows have the hash."""
    return records.groupBy(hash_col).agg(F.min(path_col).alias("kept"), F.count("*").alias("copies"))


def aliases(records: DataFrame, hash_col: str = "pixel_sha256", path_col: str = "path") -> DataFrame:
    """``(path, hash, kept)`` of every distinct path that was dropped for another of its
    hash: a row each, so that no group of copies has to be held together."""
    kept = exact_dedupe(records, hash_col, path_col).where("copies > 1").select(hash_col, "kept")
    return records.select(path_col, hash_col).distinct().join(split(kept, hash_col), hash_col).where(F.col(path_col) != F.col("kept"))


def near_duplicates(records: DataFrame, id_col: str = "id", hash_col: str = "dhash", bits: int = C.NEAR_BITS) -> DataFrame:
    """``(a, b, distance)`` of all pairs of different hashes within ``bits`` of 64.

    Pairs are between hashes, each once with the least id that has it, so groups of copies
    cost one row. Hashes that share a band of bits are compared in full; a bound above the
    number of bands less one would lose pairs and is refused.
    """
    if bits >= len(BANDS):
        raise ValueError("five bands find pairs of up to four differing bits")
    distinct = records.where(F.col(hash_col).isNotNull()).groupBy(F.col(hash_col).alias("h")).agg(F.min(id_col).alias("id"))
    signed = [m - (1 << 64) if m >> 63 else m for m in BANDS]
    bands = [F.struct(F.lit(i).alias("band"), F.col("h").bitwiseAND(F.lit(m).cast("bigint")).alias("value")) for i, m in enumerate(signed)]
    banded = distinct.select("id", "h", F.explode(F.array(*bands)).alias("key"))
    other = banded.select(F.col("id").alias("id2"), F.col("h").alias("h2"), "key")
    distance = differing_bits(F.col("h"), F.col("h2"))
    pairs = banded.join(other, "key").where((F.col("id") < F.col("id2")) & (distance <= bits))
    return pairs.select(F.col("id").alias("a"), F.col("id2").alias("b"), distance.cast("int").alias("distance")).distinct()


def stars(records: DataFrame, id_col: str, by: Column) -> DataFrame:
    """Edges ``(a, b)`` from each record to the least record of the same value of ``by``."""
    valued = records.select(F.col(id_col).alias("b"), by.alias("v")).where("v IS NOT NULL")
    least = valued.groupBy("v").agg(F.min("b").alias("a"))
    return valued.join(split(least, "v"), "v").where("a <> b").select("a", "b")


def members(records: DataFrame, id_col: str = "id", hash_col: str = "dhash", pixels: str | None = None) -> DataFrame:
    """``(id, hash, kept)`` of every record with a hash: ``kept`` is the least id of its
    hash, by which `near_duplicates` names it. With ``pixels`` also ``other_pixels``:
    whether the record's picture is not that of ``kept``, though the hash is."""
    valued = records.where(F.col(hash_col).isNotNull())
    item = F.struct(F.col(id_col).alias("kept"), *([F.col(pixels).alias("pixels")] if pixels else []))
    least = valued.groupBy(hash_col).agg(F.min(item).alias("least"))
    df = valued.join(split(least, hash_col), hash_col)
    more = [(~F.col(pixels).eqNullSafe(F.col("least.pixels"))).alias("other_pixels")] if pixels else []
    return df.select(id_col, hash_col, F.col("least.kept").alias("kept"), *more)


def same_date(records: DataFrame, id_col: str = "id", folder: str = "folder") -> DataFrame:
    """Edges ``(a, b)`` to the least record of the same folder, where that is named by a date
    of eight digits."""
    return stars(records, id_col, F.when(F.col(folder).rlike("^[0-9]{8}$"), F.col(folder)))


def leakage_groups(records: DataFrame, id_col: str = "id") -> DataFrame:
    """``(id, root, leakage_group)`` of records ``(id, pixel_sha256, dhash, identities,
    sequence)``: what shares pixels, a plausible plate, a sequence or nearly a picture is
    one group, named by the SHA-256 of its members' sorted distinct hashes.

    Copies hang on their least id, so that near duplicates need only one of them.
    """
    plates = records.select(id_col, F.explode("identities").alias("plate")).where(T.is_plausible(F.col("plate")))
    edges = stars(records, id_col, F.col("pixel_sha256")).unionByName(stars(records, id_col, F.col("sequence"))).unionByName(stars(plates, id_col, F.col("plate")))
    by_hash = stars(records, id_col, F.col("dhash"))
    near = near_duplicates(records, id_col).select("a", "b")
    roots = components(edges.unionByName(by_hash).unionByName(near))
    whole = records.join(roots, records[id_col] == roots["node"], "left").select(id_col, "pixel_sha256", F.coalesce("root", id_col).alias("root"))
    return whole.join(_names(whole), "root").select(id_col, "root", "leakage_group")


def _names(members: DataFrame) -> DataFrame:
    """``(root, leakage_group)``: SHA-256 of a group's sorted distinct hashes, a line each.
    The hashes pass the digest one by one in their order, so that no task holds a group whole."""
    distinct = members.select("root", "pixel_sha256").where("root IS NOT NULL").distinct()
    kind = members.schema["root"].dataType.simpleString()

    def fold(batches):
        root, digest, lines = None, None, 0
        for batch in batches:
            names, roots = [], []
            for r, h in zip(batch["root"].to_pylist(), batch["pixel_sha256"].to_pylist(), strict=True):
                if digest is None or r != root:
                    if digest is not None:
                        roots.append(root)
                        names.append(digest.hexdigest())
                    root, digest, lines = r, hashlib.sha256(), 0
                if h is not None:
                    digest.update(h.encode() if not lines else b"\n" + h.encode())
                    lines += 1
            yield pa.RecordBatch.from_arrays([pa.array(roots, batch.schema.field("root").type), pa.array(names, pa.string())], names=["root", "leakage_group"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([root], batch.schema.field("root").type), pa.array([digest.hexdigest()])], names=["root", "leakage_group"])

    ordered = distinct.repartition("root").sortWithinPartitions("root", "pixel_sha256")
    return ordered.mapInArrow(fold, f"root {kind}, leakage_group string")


def conflicting_copies(records: DataFrame, hash_col: str = "pixel_sha256", value: str = "text") -> DataFrame:
    """Hashes whose copies carry different values: each is a violation."""
    return records.groupBy(hash_col).agg(F.count_distinct(F.coalesce(value, F.lit("\0"))).alias("versions")).where("versions > 1")


def fingerprint(files: DataFrame, path_col: str = "path", digest_col: str = "digest") -> DataFrame:
    """``(sha256)`` of a set of files: their sorted paths and digests, folded in order.

    The fold hashes at most a row per file name's first byte pair at once: files are hashed
    in buckets of a digest prefix first, then the sorted bucket hashes.
    """
    row = F.concat(F.col(path_col), F.lit("\0"), F.col(digest_col))
    bucketed = files.select(F.substring(F.sha2(F.col(path_col), 256), 1, 3).alias("bucket"), row.alias("row"))
    each = bucketed.groupBy("bucket").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("row")), "\n"), 256).alias("h"))
    return each.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat("bucket", "h"))), "\n"), 256).alias("sha256"))
