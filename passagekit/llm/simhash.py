"""SimHash near-duplicates: a forest of vantage-point trees over Hamming distance.

Fingerprints that differ in at most ``BITS`` bits are linked, exactly. Equal
fingerprints are one node from the start (a grouped minimum), so a group of copies of
any size costs one row. Distinct ones are then dealt to the leaves of vantage-point
trees. Over all 64 bits a vantage point separates random fingerprints poorly (their
distances crowd around 32, within the radius of the bound), so each tree measures
distance on its own share of the bits. Two fingerprints within four bits of each other
are, for radii r_i with sum(r_i + 1) = 5, within r_i on the bits of at least one tree i:
otherwise they would differ in at least five. Hence it is enough that tree i finds every
pair within r_i on its bits:

* an inner node splits by masked distance to its vantage point at a threshold;
* a fingerprint has one home leaf, where it is indexed;
* as a query it also enters each leaf beyond a boundary that is within r_i of it (the
  triangle bound), and no other: those are the overlapping shards;
* within a leaf, homes are compared with all its rows on all 64 bits.

A leaf whose rows cannot be told apart by masked distance and that is larger than
``LEAF_MOST`` is dealt to several tasks as pairs of blocks: no pair is lost, no task
is unbounded. A task returns a star per linked set it has seen (never all pairs), and
`components` joins the stars. The masks follow the number of fingerprints: the more there
are, the fewer and wider, so that leaves can go on shrinking.

`later_of_groups` links by similarity instead of bits: texts whose sets of shingles have a
Jaccard similarity of ``SIMILARITY`` or more. At 0.8 two fingerprints differ in about 15 % of
their bits, far beyond a radius that prunes, so there the trees stand on random masks with
radius 0 (their shards don't overlap), as many of them as let a pair at the bound share a
leaf of some tree with a probability of ``1 - MISS``. A leaf's rows are compared on all bits
of a wider fingerprint; what that joins is a group of candidates, and within a group all
pairs are decided on the shingles themselves, each text being sent there once.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagekit.llm.common import add_columns, small_batches, stored
from passagekit.operators.components import components

#: Words in a shingle; seed of the hash; most differing bits of a link.
WORDS, SEED, BITS = 4, 42, 4
#: Forests (bits of each tree's mask and its radius; sum(radius + 1) must be BITS + 1), each
#: for up to so many distinct fingerprints. A mask of radius 0 tells no more than 2 ** bits
#: values apart, and boundaries of a larger radius cost more rows, so the next begins where
#: the leaves of the one before could no longer be small.
FORESTS = (
    (1 << 24, ((22, 1), (14, 0), (14, 0), (14, 0))),
    (1 << 31, ((22, 1), (21, 1), (21, 0))),
    (1 << 63, ((32, 2), (32, 1))),
)
#: Rows a leaf is meant to hold, and beyond which it is dealt out as pairs of blocks.
LEAF, LEAF_MOST = 2048, 16384
#: About how many distinct fingerprints the trees are built of (every one is indexed).
SAMPLE = 1 << 16
#: Shingles hashed at once, which bounds memory for very long texts.
PIECE = 1 << 15
#: Least similarity of shingles of a link; words of a wide fingerprint (columns of its table);
#: share of pairs at the bound that no tree brings together, at most.
SIMILARITY, WIDE, MISS = Fraction(4, 5), 4, 0.01
WORDS_WIDE = tuple(f"w{w}" for w in range(WIDE))
#: Texts and bytes of shingles that are compared in one task; texts of a larger group of
#: candidates that every one of its tasks gets at first; rows that are broadcast at most.
CELL, CELL_BYTES, PIVOTS, FEW = 1024, 16 << 20, 32, 200_000


def simhash(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The unsigned 64-bit SimHash of a text; 0 where it has no word."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[min(words, len(tokens)) - 1 :]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, PIECE):
        cut = slice(at, min(n, at + PIECE))
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts[cut].tolist(), last[cut].tolist(), strict=False)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str] | None = None, text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``docs`` with ``fp``, the SimHash of the text as a signed 64-bit number.
    ``keep``: the columns to return beside it."""
    small_batches(docs.sparkSession)

    def step(texts):
        return [pa.array(np.array([simhash(t, words) for t in texts], np.uint64).view(np.int64))]

    return add_columns(docs, text_col, lambda: step, "fp bigint", keep)


class Tree:
    """A vantage-point tree over masked Hamming distance, as arrays."""

    def __init__(self, points: np.ndarray, mask: int, radius: int, weight: float, leaf: int, rng):
        """``points``: a sample, each standing for ``weight`` fingerprints."""
        self.mask, self.radius = np.uint64(mask), radius
        self.vantage, self.cut, self.near, self.far, self.leaves = [], [], [], [], 0
        self._grow(points & self.mask, weight, leaf, rng)
        self.vantage = np.array(self.vantage, np.uint64)

    def _grow(self, points, weight, leaf, rng) -> int:
        if len(points) * weight > leaf and len(points) > 1:
            for v in rng.choice(points, 4):
                d = np.bitwise_count(points ^ v)
                cut = int(np.median(d))
                if d.max() <= cut:
                    cut -= 1
                if d.min() > cut:
                    continue
                at = len(self.cut)
                self.vantage.append(int(v))
                self.cut.append(cut)
                self.near.append(0)
                self.far.append(0)
                inside = d <= cut
                self.near[at] = self._grow(points[inside], weight, leaf, rng)
                self.far[at] = self._grow(points[~inside], weight, leaf, rng)
                return at
        self.leaves += 1
        return -self.leaves  # leaf number, negative

    def route(self, values: np.ndarray):
        """(row, leaf, home) of every leaf a value has to be in.

        A value crosses to the far side as a query if its distance is within the radius
        below the boundary. A query goes wherever the triangle bound lets a partner be,
        so a pair is found in the leaf of the one that was on the far side where the two
        parted.
        """
        rows, leaves, homes = [], [], []
        masked, r = values & self.mask, self.radius
        root = 0 if self.cut else -1
        stack = [(root, np.arange(len(values)), np.ones(len(values), bool))]
        while stack:
            node, at, home = stack.pop()
            if not len(at):
                continue
            if node < 0:
                rows.append(at)
                leaves.append(np.full(len(at), -node))
                homes.append(home)
                continue
            d = np.bitwise_count(masked[at] ^ self.vantage[node]).astype(np.int64)
            cut = self.cut[node]
            inside = d <= cut
            near = np.where(home, inside, d <= cut + r)
            far = np.where(home, d > cut - r, d > cut - r)
            stack.append((self.near[node], at[near], home[near]))
            stack.append((self.far[node], at[far], (home & ~inside)[far]))
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, leaves, homes))


def forest_for(total: int):
    """Masks and radii for ``total`` distinct fingerprints."""
    return next(forest for most, forest in FORESTS if total <= most)


def plant(sample: np.ndarray, total: int, forest=None, leaf: int = LEAF) -> list[Tree]:
    """The trees for ``total`` distinct fingerprints, built of a sample of them."""
    forest = forest or forest_for(total)
    if sum(bits for bits, _ in forest) != 64 or sum(r + 1 for _, r in forest) != BITS + 1:
        raise ValueError("masks must share out 64 bits, and radii + 1 sum to the bits of a link + 1")
    rng, at, trees = np.random.default_rng(1), 0, []
    for bits, radius in forest:
        mask = ((1 << bits) - 1) << at
        at += bits
        trees.append(Tree(sample, mask, radius, max(1.0, total / max(1, len(sample))), leaf, rng))
    return trees


def _roots(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Least member of each of n nodes' components, by repeated minima over pairs."""
    root = np.arange(n)
    if not pairs:
        return root
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while not np.array_equal(new, hop := new[new]):
            new = hop
        if np.array_equal(new, root):
            return root
        root = new


def _joined_rows(words: list[np.ndarray], home: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars (least, other) of row numbers over the rows within ``most`` bits of each other.

    ``words``: the fingerprints' 64-bit words, a column each. Memory: blocks of about four
    million comparisons; of the links found, only what still joins two sets is kept.
    """
    queries = np.flatnonzero(home)
    n, step = len(home), max(1, (1 << 22) // max(1, len(home)))
    root, pairs, held = np.arange(n), [], 0

    def fold():
        return _roots(n, [*pairs, (np.arange(n), root)])

    for at in range(0, len(queries), step):
        q = queries[at : at + step]
        near = np.bitwise_count(words[0][q][:, None] ^ words[0][None, :])
        if len(words) > 1:
            near = near.astype(np.uint16)
            for w in words[1:]:
                near += np.bitwise_count(w[q][:, None] ^ w[None, :])
        i, j = np.nonzero(near <= most)
        i = q[i]
        keep = root[i] != root[j]
        if keep.any():
            pairs.append((i[keep], j[keep]))
            held += int(keep.sum())
        if held > 1 << 20:
            root, pairs, held = fold(), [], 0
    root = fold()
    other = np.flatnonzero(root != np.arange(n))
    return root[other], other


def leaf_links(fp: np.ndarray, home: np.ndarray, most: int = BITS):
    """Stars (least, other) over the fingerprints of a leaf that are linked there."""
    order = np.argsort(fp, kind="stable")
    fp = fp[order]
    a, b = _joined_rows([fp.view(np.uint64)], home[order], most)
    return fp[a], fp[b]


def _pairs_of_blocks(placed: DataFrame, leaf_most: int, id_col: str = "fp") -> DataFrame:
    """``placed`` with ``lo`` and ``hi``: leaves too large for one task are dealt to blocks by
    a hash, and each row goes to all pairs of blocks that its own is in."""
    large = placed.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / leaf_most).cast("int").alias("blocks")).where("blocks > 1")
    dealt = placed.join(large, ["tree", "leaf"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(id_col), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select(*placed.columns, F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi"))


def links(distinct: DataFrame, forest=None, leaf: int = LEAF, leaf_most: int = LEAF_MOST) -> DataFrame:
    """Edges ``(a, b)`` whose components are those of all pairs within ``BITS`` bits.

    ``distinct(fp)`` holds distinct signed fingerprints.
    """
    spark = distinct.sparkSession
    total = distinct.count()
    share = -(-total // SAMPLE)  # one in so many, by a hash of the fingerprint
    sample = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(max(1, share))) == 0)
    sample = sample.toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    trees = plant(sample, total, forest, leaf)

    def place(batches):
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for t, tree in enumerate(trees):
                row, at, home = tree.route(values.view(np.uint64))
                if len(row):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(row), t, np.int32)),
                            pa.array(at.astype(np.int32)),
                            pa.array(values[row]),
                            pa.array(home.astype(bool)),
                        ],
                        names=["tree", "leaf", "fp", "home"],
                    )

    placed = distinct.select("fp").mapInArrow(place, "tree int, leaf int, fp bigint, home boolean")
    dealt = _pairs_of_blocks(placed, leaf_most)

    def in_leaf(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = leaf_links(pdf["fp"].to_numpy(np.int64), pdf["home"].to_numpy(bool))
        return pd.DataFrame({"a": a, "b": b})

    return dealt.groupBy("tree", "leaf", "lo", "hi").applyInPandas(in_leaf, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS
) -> DataFrame:
    """One row per document: ``(id, fp, component_id)``.

    ``component_id`` is the least id reachable over links of at most ``BITS`` bits, its
    own included; ids may be of any type that has an order, structs too. Null and wordless
    texts have fingerprint zero, linked like any other; long texts count whole.
    Repeated rows stay repeated; rows with a null id take part and get the least non-null
    id of their component (null if there is none). An empty table gives an empty result.
    Columns beyond the two named are ignored.
    """
    marked = stored(fingerprints(docs, [id_col], text_col, words))
    first = stored(marked.groupBy("fp").agg(F.min(id_col).alias("first")))
    rooted = stored(components(links(first)))
    of = first.join(rooted, first.fp == rooted.node, "left").select("fp", "first", F.col("root").isNotNull().alias("linked"), F.coalesce("root", "fp").alias("root"))
    least = _counted(stored(of.where("linked").groupBy("root").agg(F.min("first").alias("least"))))
    label = of.join(least, "root", "left").select("fp", F.when(F.col("linked"), F.col("least")).otherwise(F.col("first")).alias("component_id"))
    return marked.join(label, "fp").select(id_col, "fp", "component_id")


def _counted(df: DataFrame) -> DataFrame:
    """``df``, stored, as a broadcast where it has few rows, so that a group that most rows
    belong to is not dealt to one task; beyond that joins are shuffled."""
    return F.broadcast(df) if df.count() <= FEW else df


# --- Links by similarity -----------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def shingles(tokens: list[bytes], words: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words; a shorter text is one run."""
    if not tokens:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    width, n = min(words, len(tokens)), max(1, len(tokens) - words + 1)
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + each[i : i + n]
    return np.unique(_mixed(out))


def wide(of: np.ndarray) -> list[int]:
    """The SimHash of a set of shingles in ``WIDE`` words of 64 bits."""
    out = []
    for word in range(WIDE):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(of), PIECE):
            h = _mixed(of[at : at + PIECE] + np.uint64((word + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(ones * 2 > len(of), bitorder="little").view("<i8")[0]))
    return out


def differing(similarity: Fraction) -> float:
    """The share of bits in which fingerprints of sets of this similarity differ."""
    return math.acos(float(2 * similarity / (1 + similarity))) / math.pi


def plant_wide(sample: np.ndarray, total: int, similarity: Fraction, leaf: int = LEAF, miss: float = MISS) -> list[tuple[int, Tree]]:
    """Trees, each with the word it looks at, of ``sample`` (rows of ``WIDE`` words)."""
    rng, weight = np.random.default_rng(2), max(1.0, total / max(1, len(sample)))
    bits = min(64, math.ceil(math.log2(total / leaf)) + 1) if total > leaf else 0
    together = (1 - differing(similarity)) ** bits
    count = math.ceil(math.log(miss) / math.log(1 - together)) if together < 1 else 1
    trees = []
    for t in range(count):
        mask = sum(1 << int(b) for b in rng.choice(64, bits, replace=False))
        trees.append((t % WIDE, Tree(np.unique(sample[:, t % WIDE]), mask, 0, weight, leaf, rng)))
    return trees


def _candidates(nodes: DataFrame, similarity: Fraction, leaf: int, leaf_most: int, miss: float) -> DataFrame:
    """``(node, root)``: groups of ``nodes (n, w0, ...)`` that trees and bits leave together."""
    spark, total = nodes.sparkSession, nodes.count()
    part = nodes.where(F.pmod(F.xxhash64("n"), F.lit(max(1, -(-total // SAMPLE)))) == 0)
    sample = part.select(*WORDS_WIDE).toPandas().to_numpy(np.int64).reshape(-1, WIDE).view(np.uint64)
    trees = spark.sparkContext.broadcast(plant_wide(sample, total, similarity, leaf, miss))
    bits, p = 64 * WIDE, differing(similarity)
    most = math.ceil(bits * p + 2.5 * math.sqrt(bits * p * (1 - p)))

    def place(batches):
        for batch in batches:
            values = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n", *WORDS_WIDE)]
            for t, (word, tree) in enumerate(trees.value):
                row, at, _ = tree.route(values[1 + word].view(np.uint64))
                if len(row):
                    cells = [np.full(len(row), t, np.int32), at.astype(np.int32), *(v[row] for v in values)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], names=["tree", "leaf", "n", *WORDS_WIDE])

    def in_leaf(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["n"].to_numpy(np.int64)
        order = np.argsort(n, kind="stable")
        words = [pdf[w].to_numpy(np.int64).view(np.uint64)[order] for w in WORDS_WIDE]
        a, b = _joined_rows(words, np.ones(len(n), bool), most)
        return pd.DataFrame({"a": n[order[a]], "b": n[order[b]]})

    placed = nodes.mapInArrow(place, "tree int, leaf int, n bigint, " + ", ".join(f"{w} bigint" for w in WORDS_WIDE))
    dealt = _pairs_of_blocks(placed, leaf_most, "n")
    return stored(components(dealt.groupBy("tree", "leaf", "lo", "hi").applyInPandas(in_leaf, "a bigint, b bigint")))


def similar(a: bytes, b: bytes, similarity: Fraction = SIMILARITY) -> bool:
    """Whether two sorted sets of hashes are linked."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return similarity.denominator * both >= similarity.numerator * (len(x) + len(y) - both)


def similar_rows(sets: list[np.ndarray], root: np.ndarray, similarity: Fraction = SIMILARITY) -> np.ndarray:
    """Roots of rows that are linked by similarity, directly or over others.

    ``sets``: sorted distinct hashes per row; ``root``: roots known before. All pairs of
    different roots are decided, a row against all later ones at a time: with a mark on each
    of its hashes, what it shares with others is a sum of marks.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    root = root.copy()
    if not len(sets) or not sizes.sum():
        return root
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    marks = np.zeros(int(codes.max()) + 1, np.int32)
    sums = np.zeros(len(codes) + 1, np.int64)
    for i in range(len(sets) - 1):
        if not sizes[i] or (root[i + 1 :] == root[i]).all():
            continue
        own = codes[ends[i] - sizes[i] : ends[i]]
        marks[own] = 1
        rest = sums[: len(codes) - ends[i] + 1]
        np.cumsum(marks[codes[ends[i] :]], out=rest[1:])
        marks[own] = 0
        both = np.diff(rest[np.concatenate(([ends[i]], ends[i + 1 :])) - ends[i]])
        alike = similarity.denominator * both >= similarity.numerator * (sizes[i] + sizes[i + 1 :] - both)
        alike &= sizes[i + 1 :] > 0
        if alike.any():
            met = np.unique(np.concatenate(([root[i]], root[i + 1 :][alike])))
            if len(met) > 1:
                root[np.isin(root, met)] = met[0]
    return root


def _links_in(cells: DataFrame, similarity: Fraction) -> DataFrame:
    """Stars of ``cells (c, lo, hi, n, root, s)``: links of each cell's rows beyond their roots."""

    def in_cell(pdf: pd.DataFrame) -> pd.DataFrame:
        # Rows of the most frequent root last: they need not be compared with each other.
        known = pdf["root"].to_numpy(np.int64)
        values, place, count = np.unique(known, return_inverse=True, return_counts=True)
        order = np.lexsort((pdf["n"].to_numpy(np.int64), values[place], count[place]))
        known = known[order]
        sets = [np.frombuffer(pdf["s"].iloc[i], np.uint64) for i in order]
        root = similar_rows(sets, known, similarity)
        stars = np.unique(np.stack([root, known], axis=1)[root != known], axis=0)
        return pd.DataFrame({"a": stars[:, 0], "b": stars[:, 1]})

    return cells.groupBy("c", "lo", "hi").applyInPandas(in_cell, "a bigint, b bigint")


def _links_by_similarity(members: DataFrame, similarity: Fraction, cell: int) -> DataFrame | None:
    """``(node, root)`` over the links of ``members (c, n, s)``, the texts of groups ``c``.

    A group of up to ``cell`` texts is one task. A larger one is dealt to blocks, each of which
    also gets some of the group's texts as pivots that join the blocks' parts. What is still
    apart then meets: texts of the group's largest part stay in a block each, as they need not
    meet each other, and all others go to each of those blocks and to all pairs of blocks of
    their own. So a large group of copies costs in proportion to its size, not its square.
    """
    sizes = members.groupBy("c").agg(F.count("*").alias("m"), F.sum(F.length("s")).alias("bytes"))
    blocks = lambda rows, size: F.ceil(F.greatest(rows / cell, size / CELL_BYTES)).cast("int")
    large = sizes.select("c", "m", "bytes", blocks(F.col("m"), F.col("bytes")).alias("blocks")).where("blocks > 1")
    large = _counted(stored(large))
    dealt = members.join(large, "c", "left").withColumns({"root": F.col("n"), "blocks": F.coalesce("blocks", F.lit(1))})
    own = F.pmod(F.xxhash64("n"), "blocks").cast("int")
    pivot = F.pmod(F.xxhash64("n", F.lit(1)), F.greatest(F.lit(1), F.floor(F.col("m") / PIVOTS))) == 0
    at = F.when(pivot, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    first = stored(_links_in(dealt.select("c", "n", "root", "s", F.explode(at).alias("lo")).withColumn("hi", F.col("lo")), similarity))
    if first.isEmpty() and large.isEmpty():
        return None
    roots = stored(components(first))
    if large.isEmpty():
        return roots

    apart = members.join(large, "c").join(_counted(roots), F.col("n") == F.col("node"), "left")
    apart = apart.select("c", "n", "s", "m", "bytes", F.coalesce("root", "n").alias("root"))
    parts = apart.groupBy("c", "m", "bytes", "root").agg(F.count("*").alias("k"), F.sum(F.length("s")).alias("size"))
    top = parts.groupBy("c", "m", "bytes").agg(F.max(F.struct("k", "size", "root")).alias("top"))
    top = top.select("c", F.col("top.root").alias("main"), blocks(F.col("top.k"), F.col("top.size")).alias("mains"), blocks(F.col("m") - F.col("top.k"), F.col("bytes") - F.col("top.size")).alias("others"))
    apart = apart.select("c", "n", "s", "root").join(_counted(stored(top)), "c").where("others > 0")
    h = F.xxhash64("n", F.lit(2))
    cells = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    mine = F.pmod(h, F.greatest("others", F.lit(1)))
    pairs = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda w: cells(F.least(mine, w), F.greatest(mine, w)))
    mains = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda w: cells(F.lit(-1), w))
    at = F.when(F.col("root") == F.col("main"), F.array(cells(F.lit(-1), F.pmod(h, F.col("mains"))))).otherwise(F.concat(pairs, mains))
    second = stored(_links_in(apart.select("c", "n", "root", "s", F.explode(at).alias("at")).select("c", "n", "root", "s", "at.*"), similarity))
    return stored(components(first.unionByName(second)))


def later_of_groups(docs: DataFrame, row: str, words: int = 5, similarity: Fraction = SIMILARITY, leaf: int = LEAF, leaf_most: int = LEAF_MOST, miss: float = MISS, cell: int = CELL) -> DataFrame:
    """``(row)`` of all rows of ``docs (doc_id, row, text)`` that go as near copies of others: of
    each group of linked texts all but the one of least ``(doc_id, row)``.

    ``row`` names a column that tells rows apart, the same whenever the table is read. Linked
    are texts whose sets of ``words``-word shingles have a Jaccard similarity of ``similarity``
    or more; groups are what links reach. Texts of equal words are one node from the start,
    so a group of copies of any size costs one row; texts without words are copies of each
    other. Whole texts count, however long. Null ids count as least, repeated rows are copies;
    an empty table gives an empty result; extra columns are ignored.

    Every link is exact. A pair at the bound is found with a probability of about ``1 - miss``,
    more similar ones more surely; among up to ``leaf`` texts only the bits of the wide
    fingerprint decide what is compared.
    """
    small_batches(docs.sparkSession)

    def sign(texts):
        tokens = [words_of(t) for t in texts]
        keys = [xxhash.xxh128_digest(b" ".join(t)) for t in tokens]
        prints = np.array([wide(shingles(t, words)) for t in tokens], np.int64).reshape(-1, WIDE)
        return [pa.array(keys, pa.binary()), *(pa.array(prints[:, w]) for w in range(WIDE))]

    def shingled(texts):
        return [pa.array([shingles(words_of(t), words).tobytes() for t in texts], pa.binary())]

    docs = docs.select("doc_id", F.col(row).alias("row"), "text")
    signed = stored(add_columns(docs, "text", lambda: sign, "key binary, " + ", ".join(f"{w} bigint" for w in WORDS_WIDE), ["doc_id", "row"]))
    nodes = signed.groupBy("key").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("m"), *(F.first(w).alias(w) for w in WORDS_WIDE))
    nodes = stored(nodes.select(F.monotonically_increasing_id().alias("n"), "*"))
    copied = _counted(stored(nodes.where("m > 1").select("key", F.col("first.row").alias("kept"))))
    copies = signed.select("key", "row").join(copied, "key").where("row <> kept").select(F.col("row").alias(row))

    groups = _candidates(nodes.select("n", *WORDS_WIDE), similarity, leaf, leaf_most, miss)
    ends = stored(nodes.select("n", "first").join(_counted(groups), F.col("n") == F.col("node")).select("n", F.col("root").alias("c"), "first"))
    texts = docs.select("row", "text").join(_counted(ends.select(F.col("first.row").alias("row"), "c", "n")), "row")
    members = stored(add_columns(texts, "text", lambda: shingled, "s binary", ["c", "n"]))
    roots = _links_by_similarity(members, similarity, cell)
    if roots is None:
        return copies
    linked = stored(ends.select("n", "first").join(_counted(roots), F.col("n") == F.col("node")).select("root", "first"))
    least = _counted(stored(linked.groupBy("root").agg(F.min("first").alias("least"))))
    return copies.unionByName(linked.join(least, "root").where("first <> least").select(F.col("first.row").alias(row)))
