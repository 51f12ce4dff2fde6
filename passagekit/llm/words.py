"""Words of many texts at once, as 64-bit numbers, with numpy.

Texts are joined into one byte array; a table of 256 entries tells each byte's lower
case, or zero for bytes that separate words. A word's number is a polynomial over its
bytes modulo 2**64 with random coefficients per byte, mixed with its length; numbers of
different words differ but for a chance of about 2**-64 a pair.
"""

from __future__ import annotations

import numpy as np

#: Bytes whose sums are held at once.
SLAB = 1 << 20
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = int(_RNG.integers(1, 1 << 62)) * 2 + 1
_powers: list[np.ndarray] = []


def lower_ascii() -> np.ndarray:
    """Each byte, with A-Z in lower case."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def spaces_apart() -> np.ndarray:
    """Words of anything but ASCII white space."""
    table = lower_ascii()
    table[[0x20, *range(0x09, 0x0E)]] = 0
    return table


def alphanumeric() -> np.ndarray:
    """Words of ASCII digits and letters and all that is not ASCII."""
    table = lower_ascii()
    keep = np.zeros(256, bool)
    keep[0x30:0x3A] = keep[0x41:0x5B] = keep[0x61:0x7B] = keep[0x80:] = True
    table[~keep] = 0
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLAB + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [
            np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size - 1, b, np.uint64)))) for b in (_BASE, inverse)
        ]
    return _powers[0], _powers[1]


def split(texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(numbers, counts)``: the numbers of all words in order, and words per text.

    Bytes 0 inside a text separate words only where the table maps them to 0; where it
    should keep them (`spaces_apart`), they are kept as the otherwise unused byte 0xFF.
    """
    parts = [(t or "").encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    low = table[data]
    if table[1]:
        low = np.where(data == 0, np.uint8(0xFF), low)
    word = low != 0
    edges = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    numbers = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + SLAB, "right")))
        first, last = int(starts[at]), int(ends[stop - 1])
        up, down = _power(last - first + 1)
        sums = np.zeros(last - first + 1, np.uint64)
        np.cumsum(_BYTE[low[first:last]] * up[: last - first], out=sums[1:])
        a, b = starts[at:stop] - first, ends[at:stop] - first
        numbers[at:stop] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        at = stop
    bounds = np.cumsum([len(p) + 1 for p in parts])
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, bounds)))) if parts else np.zeros(0, np.int64)
    return numbers, counts


def grams(numbers: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k-grams that begin at each position that has k words from it on."""
    n = len(numbers) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + numbers[j : j + n]
    return mix(out)
