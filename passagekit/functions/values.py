"""Numbers, maps and digests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit(x: Column) -> Column:
    """Cut to 0..1; null, NaN and infinite numbers are 0."""
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(finite, F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))).otherwise(F.lit(0.0))


def ratio(n: Column, d: Column) -> Column:
    """n / d, null where d is 0."""
    return F.try_divide(n.cast("double"), d.cast("double"))


def harmonic(a: Column, b: Column) -> Column:
    return 2 * a * b / F.greatest(a + b, F.lit(1e-12))


def differing_bits(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def rounded(x: Column, places: int) -> Column:
    """Rounded half away from zero as most engines do: the scaled number, not its shortest
    decimal form, decides what is half-way."""
    return F.round(x * 10.0**places) / 10.0**places


def softmax_top(labels: Column, logits: Column) -> Column:
    """(label, confidence, probabilities by label) of an array of scores."""
    peak = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - peak))
    total = F.aggregate(powers, F.lit(0.0), lambda s, x: s + x)
    p = F.transform(powers, lambda x: x / total)
    best = F.array_position(p, F.array_max(p)).cast("int")
    return F.struct(F.element_at(labels, best).alias("label"), F.array_max(p).alias("confidence"), F.map_from_arrays(labels, p).alias("probs"))


def seeded(seed, key: Column) -> Column:
    """A fixed pseudo-random order of keys: SHA-256 of seed and key, comparable as text."""
    return F.sha2(F.concat(F.lit(str(seed)), F.lit(":"), key.cast("string")), 256)


def frame_seconds(frame: Column, fps: Column) -> Column:
    return ratio(frame, fps)


def digest(*parts: Column) -> Column:
    """SHA-256 of the values as JSON, in the order given."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)
