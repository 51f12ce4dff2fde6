"""Alignment of two tokenizers over the same bytes, with corpus-wide counts of linked ids.

Both tokenizers spell a blank and the text. Where a token of either ends at the same byte the
text is cut into groups, and the two tokens are linked. How often a pair of ids is linked in
the whole corpus, and which partner an id has most often, takes a cogroup of postings:

* a task aligns blocks of documents and deals the multiplicities of their pairs, by document,
  to shares of the ids of side B: a packed row per block and share, however often an id occurs;
* the pairs' counts over all blocks are summed by a grouped aggregation with map-side sums;
* a share's counts, sorted by pair, meet its postings block after block in a stream that Spark
  sorted and spilled. The highest count of each B id is found there, as a share has all
  partners of its ids; each document's sums over the share are sent on, packed by block;
* a block's sums are added up and its documents are unpacked again.

Shares of many blocks are split by block, each part with the share's counts, so a task has a
bounded number of blocks and an id in a third of all links makes no task larger. Alignment is
computed once per distinct stretch of text: from one white space that both tokenizers begin
anew at to the next.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagekit.llm.common import small_batches, stored

#: Shares of the ids of side B, and blocks that meet a share in one task.
SHARES, BLOCKS = 16, 256
#: Characters and rows of a block of documents.
CHARACTERS, ROWS = 6 << 20, 4096
#: Stretches of a usual length that a worker remembers, and that length in characters.
MEMO, LONGEST = 500_000, 64
MARK = "▁"

RESULT = "doc_id {}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def byte_characters() -> dict[str, int]:
    """The character that a byte-level vocabulary writes for each byte: itself if it prints,
    else the next one from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """The two tokenizers, and what they make of stretches of text."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings are plain text
        letters = byte_characters()
        self.bytes_a = [bytes(letters[c] for c in self.a.id_to_token(i)) if all(c in letters for c in self.a.id_to_token(i)) else self.a.id_to_token(i).encode() for i in range(self.a.get_vocab_size())]
        model = sentencepiece_model_pb2.ModelProto()
        with open(path_b, "rb") as f:
            model.ParseFromString(f.read())
        spec, kinds = model.normalizer_spec, model.trainer_spec
        plain = not spec.precompiled_charsmap and spec.escape_whitespaces and not spec.remove_extra_whitespaces and spec.add_dummy_prefix
        if kinds.model_type != kinds.BPE or not plain or not kinds.byte_fallback:
            raise ValueError("stretches are exact for BPE models with byte fallback, a dummy prefix and no normalisation only")
        normal = [p.piece for p in model.pieces if p.type == p.NORMAL]
        if any(MARK in p.lstrip(MARK) for p in normal) or any(p.type == p.USER_DEFINED for p in model.pieces):
            raise ValueError("a piece has a word mark behind other characters")
        self.bytes_b = [
            bytes([int(p.piece[3:5], 16)]) if p.type == p.BYTE else p.piece.replace(MARK, " ").encode() for p in model.pieces
        ]
        self.size_a, self.size_b = (np.array([len(x) for x in every]) for every in (self.bytes_a, self.bytes_b))
        inner = {c for p in normal if len(p) > 1 for c in p}
        white = " " + "".join(c for c in "\n\t\r\x0b\x0c" if c not in inner)
        # White space after anything else starts a match of A's pattern, and no piece of B has it
        # behind another character: from there on both begin anew.
        self.stretches = re.compile(rf"[{white}]\s*\S*(?:[^\S{white}]\s*\S*)*").findall
        spec.add_dummy_prefix = False
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.forget()

    def forget(self) -> None:
        """Nothing is known: no stretch has a number, no number has its facts."""
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        #: By number: A tokens, B tokens, groups; where its links begin; and all links.
        self.sizes, self.begin, self.links = np.empty((0, 3), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.held = 0

    def _flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of either side, one text after the other, with the bytes at which they end."""
        every_a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        a, b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (every_a, self.b.encode(texts, num_threads=1)))
        return a, np.cumsum(self.size_a[a]), b, np.cumsum(self.size_b[b])

    def _spells(self, text: str, a: np.ndarray, b: np.ndarray) -> bool:
        data = text.encode("utf-8", "replace")
        return b"".join(map(self.bytes_a.__getitem__, a.tolist())) == data == b"".join(map(self.bytes_b.__getitem__, b.tolist()))

    def learn(self, new: list[str]) -> None:
        """Numbers the stretches ``new``; -1 stands for one whose sides spell other bytes.

        Stretches that do not end in white space are joined for the libraries, as both begin
        anew at the next one."""
        sizes, links = [self.sizes], [self.links]
        joined, single = [s for s in new if not s[-1].isspace()], [s for s in new if s[-1].isspace()]
        work = [(joined[at : at + 4096], 128) for at in range(0, len(joined), 4096)] + [(single[at : at + 4096], 1) for at in range(0, len(single), 4096)]
        while work:
            some, n = work.pop()
            a, ends_a, b, ends_b = self._flat(["".join(some[at : at + n]) for at in range(0, len(some), n)])
            bounds = np.cumsum([len(s.encode("utf-8", "replace")) for s in some])
            stop_a, stop_b = np.searchsorted(ends_a, bounds), np.searchsorted(ends_b, bounds)
            met = stop_a[-1] + 1 == len(a) and stop_b[-1] + 1 == len(b) and (ends_a[stop_a] == bounds).all() and (ends_b[stop_b] == bounds).all()
            if not met or not self._spells("".join(some), a, b):
                if len(some) > 1:
                    work += [(some[: len(some) // 2], 1), (some[len(some) // 2 :], 1)]
                else:
                    self.number[some[0]] = -1
                continue
            self.number.update(zip(some, range(len(self.groups), len(self.groups) + len(some)), strict=True))
            self.held += sum(map(len, some)) + LONGEST * len(some)
            at_a = np.flatnonzero(np.isin(ends_a, ends_b, assume_unique=True))
            at_b = np.searchsorted(ends_b, ends_a[at_a])
            links.append(b[at_b] << 32 | a[at_a])
            stops = np.searchsorted(at_a, stop_a) + 1
            sizes.append(np.stack([np.diff(x, prepend=0) for x in (stop_a + 1, stop_b + 1, stops)], axis=1))
            sides = []
            for ids, last in ((a, (at_a + 1).tolist()), (b, (at_b + 1).tolist())):
                said = list(map(str, ids.tolist()))
                sides.append([said[i] if j - i == 1 else ",".join(said[i:j]) for i, j in zip([0, *last[:-1]], last, strict=True)])
            groups = [f"{x}|{y}" for x, y in zip(*sides, strict=True)]
            self.groups += [";".join(groups[i:j]) for i, j in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]
        self.sizes, self.links = np.concatenate(sizes), np.concatenate(links)
        self.begin = np.cumsum(self.sizes[:, 2]) - self.sizes[:, 2]


@lru_cache(maxsize=2)
def pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length each, one after the other, with their types and lengths."""
    head = ";".join(f"{a.dtype.str}{len(a)}" for a in arrays).encode()
    return len(head).to_bytes(4, "little") + head + zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in arrays))


def _unpack(data: bytes) -> list[np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    kinds = [(np.dtype(k[:3]), int(k[3:])) for k in data[4 : 4 + n].decode().split(";")]
    size, at, out = sum(k.itemsize * m for k, m in kinds), 0, []
    plain = zstandard.ZstdDecompressor().decompress(data[4 + n :], max_output_size=size) if size else b""
    for kind, m in kinds:
        out.append(np.frombuffer(plain, kind, m, at))
        at += kind.itemsize * m
    return out


def _narrow(values: np.ndarray) -> np.ndarray:
    """Non-negative numbers in the least type that holds them."""
    top = int(values.max()) if len(values) else 0
    return values.astype(next(t for t in ("<u1", "<u2", "<u4", "<u8") if top < 1 << 8 * int(t[2:])))


def block(tokens: Pair, texts: list[str | None]) -> tuple[list[np.ndarray], list[str], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A block of documents: their numbers of A and B tokens and groups; the digests of their
    groups; and ``(pair, document, multiplicity)`` of their links, sorted."""
    usable = [t if t and MARK not in t else None for t in texts]
    runs = [tokens.stretches(" " + t) if t else [] for t in usable]
    known = tokens.number
    new = [s for s in set(chain.from_iterable(runs)) if s not in known]
    if new:
        tokens.learn(new)
    numbers = [list(map(known.__getitem__, r)) for r in runs]
    numbers = [[] if -1 in n else n for n in numbers]
    groups = tokens.groups
    digests = [hashlib.sha256(";".join(map(groups.__getitem__, n)).encode()).hexdigest() if n else "" for n in numbers]
    lengths = np.array([len(n) for n in numbers], np.int64)
    document = np.repeat(np.arange(len(numbers)), lengths)
    stretch = np.fromiter(chain.from_iterable(numbers), np.int64, int(lengths.sum()))
    sums = [np.bincount(document, tokens.sizes[stretch, k], len(numbers)).astype(np.int64) for k in range(3)]
    # Every stretch of a document once, with its multiplicity; then its links.
    keys, times = np.unique(document * max(1, len(groups)) + stretch, return_counts=True)
    document, stretch = np.divmod(keys, max(1, len(groups)))
    n, begin, flat = tokens.sizes[:, 2], tokens.begin, tokens.links
    spread = n[stretch]
    place = np.repeat(begin[stretch] - (np.cumsum(spread) - spread), spread) + np.arange(spread.sum())
    ids, which = np.unique(flat[place], return_inverse=True)
    keys, back = np.unique(which * max(1, len(numbers)) + np.repeat(document, spread), return_inverse=True)
    total = np.bincount(back, np.repeat(times, spread), len(keys)).astype(np.int64)
    which, document = np.divmod(keys, max(1, len(numbers)))
    if tokens.held > MEMO * LONGEST:
        tokens.forget()
    return sums, digests, (ids[which], document, total)


def _blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str, shares: int) -> DataFrame:
    """Rows ``(block, share, data, pairs, counts)``: share -1 has the documents themselves."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        tokens, ids, texts, held = pair(path_a, path_b), [], [], 0

        def out():
            name = uuid.uuid4().hex
            sums, digests, (pairs, document, n) = block(tokens, texts)
            rows = [(name, -1, _pack(*map(_narrow, sums)), ids, digests, [], [])]
            share = (pairs >> 32) % shares
            for s in range(shares):
                mine = share == s
                p, d, m = pairs[mine], document[mine], n[mine]
                if len(p):
                    # Per distinct pair: how many documents follow, and how often it is linked.
                    first = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
                    size, links = np.diff(np.append(first, len(p))), np.add.reduceat(m, first)
                    step = np.diff(p[first], prepend=0)
                    rows.append((name, s, _pack(_narrow(step), _narrow(size), _narrow(d), _narrow(m)), [], [], p[first], links))
            for at in range(0, len(rows), 4):
                columns = zip(*rows[at : at + 4], strict=True)
                types = (pa.string(), pa.int32(), pa.binary(), pa.list_(id_type), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["block", "share", "data", "ids", "digests", "pairs", "links"])

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(key)
                texts.append(text)
                held += len(text or "")
                if held >= CHARACTERS or len(ids) >= ROWS:
                    yield from out()
                    ids, texts, held = [], [], 0
        if ids:
            yield from out()

    schema = f"block string, share int, data binary, ids array<{kind}>, digests array<string>, pairs array<bigint>, links array<bigint>"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def best(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether each pair, sorted, has the highest count of its B id."""
    if not len(pairs):
        return np.empty(0, bool)
    side = pairs >> 32
    first = np.flatnonzero(np.concatenate(([True], side[1:] != side[:-1])))
    top = np.maximum.reduceat(counts, first)
    return counts == np.repeat(top, np.diff(np.append(first, len(pairs))))


def _contributions(batches):
    """From a stream of a share's counts and then its postings: each block's sums."""
    at, pairs, counts, high, parts = None, None, None, None, []
    for batch in batches:
        out = []
        for share, part, block_name, data, p, n in zip(*(batch.column(c).to_pylist() for c in ("share", "part", "block", "data", "pair", "count")), strict=True):
            if (share, part) != at:
                at, parts, pairs = (share, part), [], None
            if block_name is None:
                parts.append((p, n))
                continue
            if pairs is None:
                both = np.array(parts, np.int64).reshape(-1, 2)
                pairs, counts = both[:, 0], both[:, 1]
                high, parts = best(pairs, counts), []
            step, size, document, times = _unpack(data)
            found = np.searchsorted(pairs, np.cumsum(step.astype(np.int64)))
            n, top = np.repeat(counts[found], size), np.repeat(high[found], size)
            times = times.astype(np.int64)
            seen, back = np.unique(document, return_inverse=True)
            sums = np.zeros((2, len(seen)), np.int64)
            np.add.at(sums[0], back, times * top)
            np.add.at(sums[1], back, times * n)
            out.append({"block": block_name, "data": _pack(_narrow(seen), _narrow(sums[0]), _narrow(sums[1]))})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("block", pa.string()), ("data", pa.binary())]))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", shares: int = SHARES, blocks: int = BLOCKS) -> DataFrame:
    """Per row: numbers of A and B tokens, groups and links; links whose pair is the most
    frequent of its B id; the sum of the pairs' counts over links; a digest of the groups.

    ``path_a``: a byte-level tokenizer of the tokenizers library, which gets a blank and the
    text; ``path_b``: a sentencepiece model that adds the blank itself. Special tokens are
    unknown to both. Texts that are null or empty, or that one side does not spell byte by byte
    (as with U+2581), have no tokens: zeros and an empty digest. Texts of any length are taken
    whole; repeated rows, equal or null ids count row by row, also in the corpus-wide counts;
    ties for the most frequent all count; extra columns are ignored; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    table = stored(_blocks(docs, path_a, path_b, id_col, text_col, shares))
    postings = table.where("share >= 0").select("block", "share", "data")
    counts = (
        table.where("share >= 0")
        .select("share", F.explode(F.arrays_zip("pairs", "links")).alias("x"))
        .groupBy("share", F.col("x.pairs").alias("pair"))
        .agg(F.sum("x.links").alias("count"))
    )
    # Parts of a share: as many as keep a task's blocks within bounds; the counts go to each.
    parts = max(1, -(-table.where("share = -1").count() // blocks))
    met = (
        postings.select("share", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("part"), "block", "data", F.lit(None).cast("bigint").alias("pair"), F.lit(None).cast("bigint").alias("count"))
        .unionByName(
            counts.select("share", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(None).cast("string").alias("block"), F.lit(None).cast("binary").alias("data"), "pair", "count")
        )
        .repartition(shares * parts, "share", "part")
        .sortWithinPartitions("share", "part", F.asc_nulls_first("block"), "pair")
    )
    sums = met.mapInArrow(_contributions, "block string, data binary")
    documents = table.where("share = -1").select("block", F.lit(0).alias("order"), "data", "ids", "digests")
    whole = documents.unionByName(sums.select("block", F.lit(1).alias("order"), "data"), allowMissingColumns=True)

    def unpack(batches):
        held = None

        def out():
            ids, digests, (a, b, groups), total = held
            for at in range(0, len(ids), ROWS):
                part = slice(at, at + ROWS)
                columns = [pa.array(ids[part], id_type), *(pa.array(c[part].astype(np.int64)) for c in (a, b, groups, groups, *total)), pa.array(digests[part], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

        for batch in batches:
            id_type = batch.schema.field("ids").type.value_type
            for order, data, ids, digests in zip(*(batch.column(c).to_pylist() for c in ("order", "data", "ids", "digests")), strict=True):
                if order == 0:
                    if held:
                        yield from out()
                    held = ids, digests, _unpack(data), np.zeros((2, len(ids)), np.int64)
                else:
                    seen, *some = _unpack(data)
                    for total, x in zip(held[3], some, strict=True):
                        total[seen] += x.astype(np.int64)
        if held:
            yield from out()

    return whole.repartition("block").sortWithinPartitions("block", "order").mapInArrow(unpack, RESULT.format(kind).replace("doc_id", f"`{id_col}`", 1))
