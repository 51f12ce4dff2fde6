"""Language-model scores by deleted interpolation of bigrams, unigrams and a uniform.

    P(w | h) = l2[b] c(h w) / c(h) + l1[b] c(w) / N + l0[b] / (V + 1),   b: bucket of c(h)

Counts come from all training texts. A part of them is deleted from the counts while the
mixture weights of each bucket of context frequency (powers of two) are learned on it by
expectation-maximisation; then scores use the counts of the whole.

No text and no count is shuffled row by row. Texts are packed, where they are read, into
blocks of bounded size. A block's distinct n-grams, uni- and bigrams together, are one sorted
array of 64-bit numbers; it is cut at fixed ranges, and each range gets one slice of it, so an
n-gram that every text holds costs one number a block, and ranges are even whatever the words
are. A range answers each slice with totals in the slice's order, so answers need no keys.

A range never takes the slices of more than ``FAN`` blocks. Where there are more blocks they
are dealt to groups of that many; a group's slices of a range are merged, and the merged array
is in turn a block that is cut at finer ranges, and so on: what a task holds is bounded by
``FAN`` slices, and slices stay as large at any size of the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagekit.llm import words
from passagekit.llm.common import small_batches, stored

#: Bytes of text in a block (one longer text is a block of its own); tokens a range is meant
#: to count where the corpus is small.
BLOCK_BYTES, SHARD_TOKENS = 4 << 20, 1 << 19
#: Bits by which ranges are cut at each level (at most); blocks whose slices meet in a range.
CUT_BITS, FAN = 8, 512
#: Kinds of texts: scored only, deleted from the counts while weights are learned, counted;
#: and of slices merged from several.
HELD, DELETED, COUNTED, MERGED = 0, 1, 2, 3
#: Buckets of context frequency; steps per unit of log ratio in the learning histogram.
BUCKETS, STEPS = 48, 8
ROUNDS, FLOOR = 60, 1e-6
#: Numbers of the marks at a text's start (a context only) and end (a token).
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)


def tokens(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(numbers, contexts, sizes)``: each text's words and its end, what precedes each."""
    numbers, counts = words.split(texts, words.spaces_apart())
    sizes = counts + 1
    out = np.full(len(numbers) + len(sizes), END, np.uint64)
    out[np.arange(len(numbers)) + np.repeat(np.arange(len(counts)), counts)] = numbers
    before = np.concatenate(([START], out[:-1]))
    before[np.cumsum(sizes) - sizes] = START
    return out, before, sizes


def pair(before: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    return words.mix(words.mix(before) * np.uint64(0x9E3779B97F4A7C15) + numbers)


def _pack(values: np.ndarray) -> bytes:
    """Integers as byte planes, compressed: high bytes of small numbers cost nothing."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = pa.decompress(data[8:], n * 8, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T).view("<u8").ravel()


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data), dtype=np.uint64)


def _blocks(docs: DataFrame, id_col: str, text_col: str, kind: Column, block_bytes: int) -> DataFrame:
    """Texts packed by kind: ``(kind, ids, sizes, tokens, payload)``."""
    types = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        held: dict[int, list] = {}

        def out(which):
            ids, parts = zip(*held.pop(which), strict=True)
            whole = b"".join(parts)
            _, _, sizes = tokens([p.decode("utf-8", "replace") for p in parts])
            row = {
                "kind": which,
                "ids": list(ids),
                "sizes": [len(p) for p in parts],
                "tokens": int(sizes.sum()),
                "payload": pa.compress(whole, "zstd", asbytes=True),
            }
            return pa.RecordBatch.from_pylist([row], schema=schema)

        schema = pa.schema(
            [
                ("kind", pa.int32()),
                ("ids", pa.list_(pa.string() if types == "string" else pa.int64())),
                ("sizes", pa.list_(pa.int64())),
                ("tokens", pa.int64()),
                ("payload", pa.binary()),
            ]
        )
        size: dict[int, int] = {}
        for batch in batches:
            for i, text, which in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = (text or "").encode("utf-8", "replace")
                if which in held and size[which] + len(data) > block_bytes:
                    yield out(which)
                if which not in held:
                    held[which], size[which] = [], 0
                held[which].append((i, data))
                size[which] += len(data)
        for which in list(held):
            yield out(which)

    schema = f"kind int, ids array<{types}>, sizes array<bigint>, tokens bigint, payload binary"
    return docs.select(id_col, text_col, kind.cast("int").alias("kind")).mapInArrow(run, schema)


def _texts(row: dict) -> list[str]:
    whole = pa.decompress(row["payload"], sum(row["sizes"]), "zstd", asbytes=True) if sum(row["sizes"]) else b""
    ends = np.cumsum(row["sizes"])
    return [whole[e - n : e].decode() for e, n in zip(ends.tolist(), row["sizes"], strict=True)]


def _grams(row: dict):
    """Of a block: tokens per text; the block's sorted distinct n-grams and their counts; the
    places among them of each token, of its context, and of both together.

    Numbers of unigrams (the start mark is one) are even, those of bigrams odd.
    """
    numbers, before, sizes = tokens(_texts(row))
    n = len(numbers)
    low = np.uint64(1)
    every = np.concatenate((numbers & ~low, np.full(len(sizes), START & ~low, np.uint64), pair(before, numbers) | low))
    keys, place, counts = np.unique(every, return_inverse=True, return_counts=True)
    context = np.concatenate(([0], place[: n - 1]))
    context[np.cumsum(sizes) - sizes] = place[n]
    return sizes, keys, counts, place[:n], context, place[n + len(sizes) :]


_SLICES = "shard bigint, block bigint, kind int, keys binary, n binary, kept binary"
_TOTALS = "block bigint, shard bigint, kind int, types bigint, n binary, kept binary"
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


def _cuts(keys: np.ndarray, bits: int, shard: int = 0, level: int = 0):
    """``(range, start, stop)`` of the ranges that hold some of the sorted ``keys``, which
    all agree with ``shard`` in their first ``level`` bits; ranges differ in ``bits`` more."""
    if not bits:
        return [(shard, 0, len(keys))] if len(keys) else []
    edges = (np.uint64(shard) << np.uint64(bits)) + np.arange(1 << bits, dtype=np.uint64)
    starts = np.searchsorted(keys, edges << np.uint64(64 - level - bits)).tolist() + [len(keys)]
    return [(int(e), a, b) for e, a, b in zip(edges.tolist(), starts, starts[1:], strict=False) if b > a]


def _slices(blocks: DataFrame, bits: int) -> DataFrame:
    """A row per block and range that the block's n-grams reach."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                _, keys, counts, *_ = _grams(row)
                n = counts if row["kind"] != HELD else counts[:0]
                rows = [(r, row["block"], row["kind"], _pack_sorted(keys[a:b]), _pack(n[a:b]), b"") for r, a, b in _cuts(keys, bits)]
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    schema = _arrow(_SLICES)
    return blocks.mapInArrow(run, _SLICES)


def _merge(table: pa.Table):
    """Of the slices of one range: ``(keys, n, kept, parts)``; the sorted distinct n-grams,
    their counts in training texts and in those not deleted, and each slice's places."""
    keys = [_unpack_sorted(k.as_py()) for k in table.column("keys")]
    sizes = [len(k) for k in keys]
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    n, kept = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
    ends = np.cumsum(sizes)
    parts = [place[e - size : e] for e, size in zip(ends.tolist(), sizes, strict=True)]
    for part, kind, own, stays in zip(parts, table.column("kind").to_pylist(), table.column("n"), table.column("kept"), strict=True):
        if kind != HELD:  # a slice names an n-gram once, so plain indexing adds right
            counts = _unpack(own.as_py()).astype(np.int64)
            n[part] += counts
            if kind == COUNTED:
                kept[part] += counts
            elif kind == MERGED:
                kept[part] += _unpack(stays.as_py()).astype(np.int64)
    return distinct, n, kept, parts


def _answers(table: pa.Table, n: np.ndarray, kept: np.ndarray, parts: list, types: int) -> pa.Table:
    kinds = table.column("kind").to_pylist()
    cells = {
        "block": table.column("block"),
        "shard": table.column("shard"),
        "kind": table.column("kind"),
        "types": [types] + [0] * (len(kinds) - 1),
        "n": [_pack(n[p]) for p in parts],
        "kept": [_pack(kept[p]) if kind in (DELETED, MERGED) else b"" for p, kind in zip(parts, kinds, strict=True)],
    }
    return pa.table(cells, schema=_arrow(_TOTALS))


def _answer(table: pa.Table) -> pa.Table:
    """Totals of a range's n-grams, for each slice in the slice's own order."""
    keys, n, kept, parts = _merge(table)
    types = int(((n > 0) & (keys & np.uint64(1) == 0) & (keys != START & ~np.uint64(1))).sum())
    return _answers(table, n, kept, parts, types)


def _totals(slices: DataFrame, blocks: int, level: int, fan: int, bits: int) -> DataFrame:
    """Totals for every slice of ``blocks`` blocks, whose ranges are ``level`` bits long."""
    if blocks <= fan or level + bits > 60:
        return stored(slices.groupBy("shard").applyInArrow(_answer, _TOTALS))
    groups = -(-blocks // max(1, fan // 2))  # dealt by a hash, so some are larger than half
    dealt = stored(slices.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups))))
    schema = _arrow(_SLICES)

    def merged(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        shard, g = (k.as_py() for k in key)
        keys, n, kept, _ = _merge(table)
        rows = [(r, g, MERGED, _pack_sorted(keys[a:b]), _pack(n[a:b]), _pack(kept[a:b])) for r, a, b in _cuts(keys, bits, shard, level)]
        return pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    def back(table: pa.Table, deeper: pa.Table) -> pa.Table:
        _, _, _, parts = _merge(table)
        return _answers(table, _aligned(deeper, "n"), _aligned(deeper, "kept"), parts, sum(deeper.column("types").to_pylist()))

    finer = _totals(dealt.groupBy("shard", "g").applyInArrow(merged, _SLICES), groups, level + bits, fan, bits)
    finer = finer.select(F.shiftright("shard", bits).alias("of"), F.col("block").alias("g"), "shard", "types", "n", "kept")
    return stored(dealt.groupBy("shard", "g").cogroup(finer.groupBy("of", "g")).applyInArrow(back, _TOTALS))


def _bucket(c: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 + the power of two of its frequency."""
    return np.where(c > 0, 1 + np.floor(np.log2(np.maximum(c, 1))), 0).astype(np.int64).clip(0, BUCKETS - 1)


def _aligned(totals: pa.Table, name: str) -> np.ndarray:
    return np.concatenate([_unpack(v.as_py()) for v in totals.sort_by("shard").column(name)]).astype(np.int64)


def _evidence(n: float, types: int):
    """For deleted blocks: how often each (bucket, log ratios) occurs, in whole steps."""
    uniform = 1.0 / (types + 1)

    def run(block: pa.Table, totals: pa.Table) -> pa.Table:
        rows = []
        for row in block.to_pylist():
            _, _, _, place, context, two = _grams(row)
            kept = _aligned(totals, "kept").astype(np.float64)
            c = kept[context]
            step = lambda f: np.where(f > 0, np.rint(STEPS * np.log(np.maximum(f, 1e-300) / uniform)), -(1 << 20)).astype(np.int64)
            q2, q1 = step(kept[two] / np.maximum(c, 1)), step(kept[place] / max(n, 1.0))
            cells, count = np.unique(np.stack([_bucket(c), q2, q1]), axis=1, return_counts=True)
            rows.append((*cells, count))
        cols = [np.concatenate(x) for x in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64)] * 4
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["bucket", "q2", "q1", "n"])

    return run


def interpolate(bucket, q2, q1, n, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (bigram, unigram, uniform) per bucket, by EM on the evidence.

    Starts from weights learned over all buckets together; each bucket has one further
    observation of those, so a bucket without evidence keeps them. Contexts never seen
    give the bigram no weight.
    """
    bucket, n = np.asarray(bucket, np.int64), np.asarray(n, float)
    p = np.stack([np.where(np.asarray(q) > -(1 << 20), np.exp(np.asarray(q, float) / STEPS), 0.0) for q in (q2, q1)] + [np.ones(len(n))])

    def em(start, which, prior):
        w = start.copy()
        for _ in range(rounds):
            share = w.T[:, which] * p
            share *= n / np.maximum(share.sum(0), 1e-300)
            new = np.stack([np.bincount(which, s, len(w)) for s in share], axis=1) + prior
            w = np.maximum(new / np.maximum(new.sum(1, keepdims=True), 1e-300), FLOOR)
            w /= w.sum(1, keepdims=True)
        return w

    whole = em(np.array([[0.3, 0.6, 0.1]]), np.zeros(len(n), np.int64), 1e-3 * np.array([[0.3, 0.6, 0.1]]))
    w = em(np.repeat(whole, BUCKETS, 0), bucket, whole)
    w[0] = [0.0, *(w[0, 1:] / w[0, 1:].sum())]
    return w


@dataclass
class Model:
    """What scoring needs besides counts: weights per bucket, training tokens and types."""

    weights: np.ndarray
    n: int
    types: int

    def log10(self, both, context, one) -> np.ndarray:
        w = self.weights[_bucket(context)]
        p = w[:, 0] * both / np.maximum(context, 1) + w[:, 1] * one / max(self.n, 1) + w[:, 2] / (self.types + 1)
        return np.log10(p)

    def base(self, one) -> np.ndarray:
        return np.log10((one + 0.1) / (self.n + 0.1 * (self.types + 1)))


def _scores(model: Model, id_col: str, id_type: pa.DataType):
    def run(block: pa.Table, totals: pa.Table) -> pa.Table:
        parts = []
        for row in block.to_pylist():
            sizes, _, _, place, context, two = _grams(row)
            n = _aligned(totals, "n").astype(np.float64)
            at = np.cumsum(sizes) - sizes
            c = n[place]
            sums = [np.add.reduceat(x, at) for x in (c > 0, model.base(c), model.log10(n[two], n[context], c))]
            parts.append((row["ids"], np.full(len(sizes), row["kind"]), sizes, sums[0].astype(np.int64), *sums[1:]))
        cols = list(zip(*parts, strict=True)) or [[[]]] * 6
        ids = pa.array([i for p in cols[0] for i in p], id_type)
        rest = [np.concatenate(c) for c in cols[1:]] if parts else [np.zeros(0)] * 5
        types = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        names = [id_col, "kind", "n_tokens", "n_known", "base_score", "score"]
        return pa.table([ids, *(pa.array(c, t) for c, t in zip(rest, types, strict=True))], names=names)

    return run


def score(
    docs: DataFrame,
    kind: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    shard_tokens: int = SHARD_TOKENS,
    fan: int = FAN,
    cut_bits: int = CUT_BITS,
) -> tuple[DataFrame, Model]:
    """Scores of every text, and the model they come from.

    ``kind`` tells of each row whether it is scored only (`HELD`), learned from for the
    weights (`DELETED`) or only counted (`COUNTED`); the last two make up the training
    texts. Returns ``(id, kind, n_tokens, n_known, train_tokens, base_score, score)`` per
    row. Null and empty texts have one token, their end. Repeated rows count and are
    scored as often as they stand; extra columns are ignored; an empty table gives an
    empty result; without training texts every weight rests on the uniform part.
    """
    spark = docs.sparkSession
    small_batches(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    packed = _blocks(docs, id_col, text_col, kind, block_bytes)
    blocks = stored(packed.select(F.monotonically_increasing_id().alias("block"), "*"))
    kinds = blocks.groupBy("kind").agg(F.sum("tokens").alias("n"), F.count("*").alias("blocks")).collect()
    sums = {r.kind: r.n or 0 for r in kinds}
    n = sums.get(DELETED, 0) + sums.get(COUNTED, 0)
    bits = min(cut_bits, max(0, int(np.ceil(np.log2(max(1, sum(sums.values()) / shard_tokens))))))
    sliced = _slices(blocks.select("block", "kind", "sizes", "payload"), bits)
    totals = _totals(sliced, sum(r.blocks for r in kinds), bits, fan, cut_bits)
    types = totals.agg(F.sum("types")).first()[0] or 0

    deleted = [d.where(F.col("kind") == DELETED) for d in (blocks.select("block", "kind", "sizes", "payload"), totals.select("block", "kind", "shard", "kept"))]
    evidence = deleted[0].groupBy("block").cogroup(deleted[1].groupBy("block"))
    evidence = evidence.applyInArrow(_evidence(float(sums.get(COUNTED, 0)), types), "bucket bigint, q2 bigint, q1 bigint, n bigint")
    seen = evidence.groupBy("bucket", "q2", "q1").agg(F.sum("n").alias("n")).toArrow()
    model = Model(interpolate(*(seen.column(c).to_numpy() for c in ("bucket", "q2", "q1", "n"))), n, types)

    run = _scores(model, id_col, pa.string() if id_type == "string" else pa.int64())
    scored = blocks.drop("tokens").groupBy("block").cogroup(totals.select("block", "shard", "n").groupBy("block"))
    out = scored.applyInArrow(run, f"{id_col} {id_type}, kind int, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(n).cast("bigint")), model
