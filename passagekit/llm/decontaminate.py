"""Benchmark decontamination by winnowing.

Of the hashes of all runs of ``K`` words, the least in every window of ``SPAN - K + 1``
runs is kept (the last of equal ones). A span of ``SPAN`` words fills one such window
wherever it stands, so two texts that share a span keep the same hash inside it, and a
join of kept hashes misses no shared span. Each match is then extended word by word to
both sides; matches that grow to ``SPAN`` words are hits. Test items of fewer words are
one window of their own length each (winnowing with windows of one run). A match is
extended by at most ``SPAN - K`` words to either side: every window of a longer run
keeps a hash of its own, so the union of hits is the whole run.

The join of kept hashes has two forms with the same result. A test set of at most
``block_chars`` characters goes as a broadcast index over all documents, in one pass
without a shuffle. A larger one is joined by hash in a shuffle (`_by_join`): documents
send only the kept hashes that a bit table of bounded size may hold, once per distinct
text, each with the words around it, which is all that extending a match needs; the
corpus itself is never rewritten.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagekit.llm import words
from passagekit.llm.common import small_batches, stored

#: Words of a window, and of a hashed run.
SPAN, K = 10, 5
#: Characters of a test set that goes as one broadcast index.
BLOCK_CHARS = 4 << 20
#: Pairs of a kept hash's places extended at once.
PAIRS = 1 << 19
#: Bits of the table that tells which hashes the test set may hold (16 MB).
BITS = 1 << 27
#: Rows of kept hashes in one batch.
ROWS = 1 << 15
#: Marks between documents and between items, so that no match reaches across.
_DOC, _ITEM = np.uint64(1), np.uint64(2)
_KEPT = "kind int, hash bigint, around array<bigint>"


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions kept: of each window's least hashes the last."""
    if len(hashes) < window:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(hashes[::-1], window)
    first = np.argmin(view, axis=1) + np.arange(len(view))
    return np.unique(len(hashes) - 1 - first)


def _spread(numbers: np.ndarray, counts: np.ndarray, mark: np.uint64):
    """Words with a mark before each text and ``SPAN`` at the end; owner of each place."""
    owner = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(numbers)) + owner + 1
    out = np.full(len(numbers) + len(counts) + SPAN, mark, np.uint64)
    out[at] = numbers
    return out, at, owner


def _item_places(spread: np.ndarray, counts: np.ndarray) -> dict[int, np.ndarray]:
    """Kept places of test items by kind: words of a hashed run, negative for whole short items."""
    first = np.cumsum(counts) - counts + np.arange(len(counts)) + 1
    kinds = {-n: first[counts == n] for n in sorted({int(n) for n in counts if 0 < n < SPAN})}
    long = [a + winnow(words.grams(spread[a : a + n], K), SPAN - K + 1) for a, n in zip(first, counts, strict=False) if n >= SPAN]
    return {K: np.concatenate(long)} | kinds if long else kinds


class Index:
    """Kept hashes of a test set, and its words."""

    def __init__(self, ids: list[str], texts: list[str | None]):
        self.ids = ids
        numbers, counts = words.split(texts, words.alphanumeric())
        self.words, at, owner = _spread(numbers, counts, _ITEM)
        self.item = np.zeros(len(self.words), np.int64)
        self.item[at] = owner
        self.tables = {}
        for kind, places in _item_places(self.words, counts).items():
            self._add(kind, places)

    def _add(self, kind: int, places: np.ndarray) -> None:
        hashes = words.grams(self.words, abs(kind))[places]
        order = np.argsort(hashes, kind="stable")
        seen = np.zeros(1 << 20, bool)
        seen[hashes & np.uint64(len(seen) - 1)] = True
        self.tables[kind] = hashes[order], places[order], seen

    def _matches(self, kind: int, hashes: np.ndarray, places: np.ndarray):
        """Pairs (document place, item place) of equal hashes, a bounded number at a time."""
        keys, where, seen = self.tables[kind]
        may = seen[hashes & np.uint64(len(seen) - 1)]
        hashes, places = hashes[may], places[may]
        lo, hi = np.searchsorted(keys, hashes, "left"), np.searchsorted(keys, hashes, "right")
        lo, hi, places = lo[hi > lo], hi[hi > lo], places[hi > lo]
        at = 0
        while at < len(lo):
            total = np.cumsum(hi[at:] - lo[at:])
            stop = at + max(1, int(np.searchsorted(total, PAIRS, "right")))
            n = hi[at:stop] - lo[at:stop]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(places[at:stop], n), where[np.repeat(lo[at:stop], n) + inner]
            at = stop

    def hits(self, numbers: np.ndarray, counts: np.ndarray):
        """``(hit, pairs)``: a flag per word, and distinct (text, item) numbers."""
        text, at, owner = _spread(numbers, counts, _DOC)
        whose = np.zeros(len(text), np.int64)
        whose[at] = owner
        cover, pairs = np.zeros(len(text) + 1, np.int64), [np.zeros(0, np.int64)]
        for kind in self.tables:
            k = abs(kind)
            hashes = words.grams(text, k)
            places = winnow(hashes, SPAN - K + 1) if kind > 0 else np.arange(len(hashes))
            for p, q in self._matches(kind, hashes[places], places):
                left, right = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
                same = np.all([text[p + j] == self.words[q + j] for j in range(k)], axis=0)
                p, q, left, right = p[same], q[same], left[same], right[same]
                if kind > 0:
                    for grown, step, from_ in ((left, -1, 0), (right, 1, k - 1)):
                        on = np.arange(len(p))
                        for j in range(1, SPAN - K + 1):
                            i, o = p[on] + from_ + step * j, q[on] + from_ + step * j
                            on = on[(i >= 0) & (o >= 0) & (text[i] == self.words[o])]
                            grown[on] = j
                    full = left + right + k >= SPAN
                    p, q, left, right = p[full], q[full], left[full], right[full]
                np.add.at(cover, p - left, 1)
                np.add.at(cover, p + k + right, -1)
                pairs.append(np.unique(whose[p] * len(self.ids) + self.item[q]))
        hit = np.cumsum(cover)[at] > 0
        return hit, np.unique(np.concatenate(pairs))


def _spans(hit: np.ndarray, counts: np.ndarray) -> list[list[dict]]:
    """Runs of hit words of each text, as word positions (start, stop)."""
    out, at = [], 0
    for n in counts:
        edges = np.flatnonzero(np.diff(np.concatenate(([False], hit[at : at + n], [False])).view(np.int8)))
        out.append([{"start": a, "stop": b} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)])
        at += n
    return out


def _kept(spread: np.ndarray, kind: int, places: np.ndarray, hashes: np.ndarray):
    """Arrow columns kind, hash and the words around each place: of a hashed run with as many
    on either side as a match may grow, of a short item its own ones."""
    more = SPAN - K if kind > 0 else 0
    ends = np.full(SPAN, spread[-1])
    width = abs(kind) + 2 * more
    around = np.concatenate((ends, spread, ends))[(places + SPAN - more)[:, None] + np.arange(width)]
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(places) + 1, dtype=np.int32) * width), pa.array(around.ravel().view(np.int64)))
    return [pa.array(np.full(len(places), kind, np.int32)), pa.array(hashes.view(np.int64)), lists]


def _item_rows(items: DataFrame) -> DataFrame:
    """``(item, kind, hash, around)`` of the kept hashes of test items."""

    def run(batches):
        for batch in batches:
            numbers, counts = words.split(batch.column(1).to_pylist(), words.alphanumeric())
            spread, at, owner = _spread(numbers, counts, _ITEM)
            whose = np.zeros(len(spread), np.int64)
            whose[at] = owner
            for kind, all_places in _item_places(spread, counts).items():
                hashes = words.grams(spread, abs(kind))
                for i in range(0, len(all_places), ROWS):
                    places = all_places[i : i + ROWS]
                    item = batch.column(0).take(pa.array(whose[places]))
                    yield pa.RecordBatch.from_arrays([item, *_kept(spread, kind, places, hashes[places])], names=["item", "kind", "hash", "around"])

    return items.mapInArrow(run, f"item string, {_KEPT}").distinct()


def _bits(tests: DataFrame) -> np.ndarray:
    """Table of the hashes that occur, by their last bits; at most ``BITS`` bits come back."""
    slot, bit = F.expr(f"shiftright(hash & {BITS - 1}L, 6)"), F.expr("shiftleft(1L, cast(hash & 63L as int))")
    found = tests.groupBy(slot.alias("slot")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(BITS >> 6, np.uint64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy().view(np.uint64)
    return out


def _text_rows(texts: DataFrame, kinds: list[int], bits: np.ndarray) -> DataFrame:
    """``(key, at, kind, hash, around)`` of the kept hashes of texts that the test set may hold."""
    sent = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        table, bits = words.alphanumeric(), sent.value
        for batch in batches:
            numbers, counts = words.split(batch.column(1).to_pylist(), table)
            spread, at, owner = _spread(numbers, counts, _DOC)
            whose, place = np.full(len(spread), -1), np.zeros(len(spread), np.int64)
            whose[at], place[at] = owner, np.arange(len(at)) - (np.cumsum(counts) - counts)[owner]
            for kind in kinds:
                hashes = words.grams(spread, abs(kind))
                may = winnow(hashes, SPAN - K + 1) if kind > 0 else np.arange(len(hashes))
                low = hashes[may] & np.uint64(BITS - 1)
                may = may[((bits[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1) == 1) & (whose[may] >= 0)]
                for i in range(0, len(may), ROWS):
                    p = may[i : i + ROWS]
                    key = batch.column(0).take(pa.array(whose[p]))
                    yield pa.RecordBatch.from_arrays([key, pa.array(place[p]), *_kept(spread, kind, p, hashes[p])], names=["key", "at", "kind", "hash", "around"])

    return texts.mapInArrow(run, f"key binary, at bigint, {_KEPT}").distinct()


def _grown(text: str, item: str) -> tuple[Column, Column]:
    """By how many words a match of hashed runs extends to the left and to the right."""
    more, end = SPAN - K, 2 * SPAN - K
    differ = f"i -> get({text}, i - 1) <> get({item}, i - 1)"
    left = F.expr(f"{more} - coalesce(array_max(filter(sequence(1, {more}), {differ})), 0)")
    right = F.expr(f"coalesce(array_min(filter(sequence({SPAN + 1}, {end}), {differ})), {end + 1}) - {SPAN + 1}")
    return left, right


def _by_join(texts: DataFrame, items: DataFrame) -> DataFrame:
    """``(key, spans, items)`` of the texts ``(key, text)`` that share a window with an item.

    The distinct surroundings of a hash are matched first, so that a passage that stands in
    very many documents or items is extended once; what is found goes back to the texts by
    the same key. Both joins are by equal keys, with skew left to the runtime.
    """
    tests = stored(_item_rows(items))
    kinds = sorted(r.kind for r in tests.select("kind").distinct().collect())
    rows = stored(_text_rows(texts, kinds, _bits(tests)))
    left, right = _grown("around", "other")
    mine, other = rows.select("kind", "hash", "around").distinct(), tests.select("kind", "hash", F.col("around").alias("other")).distinct()
    core = F.expr(f"slice(around, {SPAN - K + 1}, {K}) = slice(other, {SPAN - K + 1}, {K})")
    short = F.col("kind") < 0
    grown = mine.join(other, ["kind", "hash"]).select(
        "kind", "hash", "around", "other",
        F.when(short, 0).otherwise(left).alias("left"), F.when(short, F.abs("kind")).otherwise(K + right).alias("right"),
    )
    same = F.when(short, F.col("around") == F.col("other")).otherwise(core & (F.col("left") + F.col("right") >= SPAN))
    found = stored(grown.where(same))
    on = ["kind", "hash", "around"]
    spans = rows.join(found.select(*on, "left", "right").distinct(), on).select("key", (F.col("at") - F.col("left")).alias("start"), (F.col("at") + F.col("right")).alias("stop"))
    named = found.join(tests.withColumnRenamed("around", "other"), ["kind", "hash", "other"]).select(*on, "item").distinct()
    named = rows.select("key", *on).distinct().join(named, on).select("key", "item").distinct()
    spans = spans.distinct().groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return spans.join(named.groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items")), "key")


def contamination(
    docs: DataFrame,
    tests: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``docs`` with ``n_words``, ``hits`` (runs of word positions) and ``items``.

    All columns of ``docs`` are kept except ones named like the new ones, which are
    replaced. ``items`` are the distinct ids, as strings in order, of test items of which
    some window occurs. Null or wordless texts have no hits; null or wordless items none
    either; a null item id counts as an empty string. Rows are independent, so repeated
    rows and null ids are answered row by row. With an empty test set nothing is hit.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = tests.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    new = "n_words bigint, hits array<struct<start bigint, stop bigint>>, items array<string>"
    names = ("n_words", "hits", "items")
    old = [c for c in docs.columns if c not in names]
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in old)
    struct = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def columns(batch, counts, hit, found):
        added = [pa.array(counts, pa.int64()), pa.array(_spans(hit, counts), struct), pa.array(found, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(old)], *added], names=[*old, *names])

    if chars <= block_chars:
        rows = items.where("text IS NOT NULL").toArrow()
        sent = spark.sparkContext.broadcast(Index(rows.column(0).to_pylist(), rows.column(1).to_pylist()))

        def look_up(batches):
            index, table = sent.value, words.alphanumeric()
            for batch in batches:
                numbers, counts = words.split(batch.column(old.index(text_col)).to_pylist(), table)
                hit, pairs = index.hits(numbers, counts)
                found = [set() for _ in counts]
                for pair in pairs.tolist():
                    found[pair // len(index.ids)].add(index.ids[pair % len(index.ids)])
                yield columns(batch, counts, hit, [sorted(f) for f in found])

        return docs.select(*old).mapInArrow(look_up, f"{kept}, {new}")

    key = F.unhex(F.sha2(F.col(text_col), 256))
    hits = stored(_by_join(docs.select(key.alias("key"), F.col(text_col).alias("text")).where("text IS NOT NULL"), items))

    def mark(batches):
        table = words.alphanumeric()
        for batch in batches:
            _, counts = words.split(batch.column(old.index(text_col)).to_pylist(), table)
            hit, begins = np.zeros(counts.sum(), bool), np.cumsum(counts) - counts
            for first, spans in zip(begins.tolist(), batch.column(len(old)).to_pylist(), strict=True):
                for span in spans or ():
                    hit[first + span["start"] : first + span["stop"]] = True
            yield columns(batch, counts, hit, [f or [] for f in batch.column(len(old) + 1).to_pylist()])

    left = docs.select(F.struct(*old).alias("_doc"), key.alias("key"))
    marked = left.join(hits, "key", "left").select(*(F.col("_doc").getField(c).alias(c) for c in old), F.col("spans").alias("_spans"), F.col("items").alias("_items"))
    return marked.mapInArrow(mark, f"{kept}, {new}")
