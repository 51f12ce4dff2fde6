"""Token ids in files of independent zstandard frames with a trailing seek table.

Texts are dealt by ranges of their id, so files hold documents in ascending order and follow
each other in the order of the ranges; no task has more than its share of the characters and
nothing but a row per file is ever gathered. A file is

* data frames: ids of consecutive documents, ``width`` bytes each, little-endian. A frame ends
  with the document that fills it; one that is longer than a frame takes several;
* a skippable frame with the documents: ids, whether they are null, numbers of token ids;
* a skippable frame with the seek table of the seekable format of zstandard: compressed and
  plain size of every frame before it and the low half of the XXH64 of its plain bytes.

Any zstandard tool unpacks such a file. A reader starts at its end, finds the documents it was
asked for, and unpacks and verifies only the frames these lie in.

Files get their final names only when complete and are listed in a manifest, a Parquet table;
what a lost or repeated task leaves behind is in no manifest and is never read.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagekit.llm.common import shared_dir, small_batches, stored

#: Ids that fill a frame; ids after which a new file begins; characters that go to one task.
FRAME, FILE, SHARE = 1 << 16, 1 << 27, 32 << 20
#: Runs of text that an encoder remembers, and the longest that it does.
MEMO, LONGEST = 500_000, 64
#: Bytes of ids in one batch of rows on the way back, and the most tasks that read files.
BATCH, READERS = 4 << 20, 20_000
LEVEL = 1

# Fixed values of the seekable format: two kinds of skippable frames, the number at the very
# end, and the bit that tells that checksums are there.
DOCUMENTS, SEEK_TABLE, SEEKABLE, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80

_MANIFEST = pa.schema(
    [("part", pa.int32()), ("no", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("ids", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64())]
)
_ROWS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
ROWS = "doc_id bigint, start bigint, n_tokens bigint, ids binary"


class Encoder:
    """A tokenizer of the tokenizers library, which sees each run between white space once.

    Where the tokenizer drops white space, no token crosses it and a text's ids are those of
    its runs, and those of a run are those of its letters and of the marks behind them. A
    tokenizer that is not like that is found out by probes and gets whole texts.
    """

    PROBES = ("a b", " a", "a\t\tb \n", "Don't\nstop.!\r\ré é", "x\x0b'S \x0c12  <|endoftext|>a", "Wörter,.b \x1cc?!", "a\x85b\xa0c\u2003d\u2028e\u3000f", "É$$$ a%&*. b#+=~ C~!")
    MARKS = ".,;:!?$%&*#+=~"
    #: A line of letters, composed and of one case pair each, and marks; of another line nothing.
    LATIN = re.compile(rf"^(?:([A-Za-zÀ-ÖØ-öø-ÿ]+)([{re.escape(MARKS)}]*)|.*)$", re.MULTILINE)
    CASES = "".join(c for c in map(chr, range(0x41, 0xDF)) if c.isupper())

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        size = self.library.get_vocab_size()
        self.width = 2 if size <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.ends = np.array([(self.library.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.apart, self.known, self.older = True, {}, {}
        cases = [self.CASES, *self.CASES]
        self.caseless = self._library(cases) == self._library([c.lower() for c in cases])
        whole = self._library(list(self.PROBES))
        if whole != self.packed(self.PROBES) or whole != self._library([" ".join(self.runs(p)) for p in self.PROBES]):
            self.apart, self.known = False, {}

    def runs(self, text: str) -> list[str]:
        """What the library sees at a time: what stands between white space, or the text."""
        return re.findall(r"[^ \t\n\r\x0b\x0c]+", text) if self.apart else [text]

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Runs of letters, joined for the library; each ends with a token that ends a word."""
        out: list[bytes] = []
        for at in range(0, len(words), 512):
            some = words[at : at + 512]
            ids = np.array(self.library.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.kind)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some):
                data, w = ids.tobytes(), self.width
                out += [data[a * w : b * w] for a, b in zip([0, *stops[:-1]], stops, strict=True)]
            else:  # a letter to Python alone
                out += self._library(some)
        return out

    def _learn(self, new: Iterable[str]) -> None:
        """Letters without case where the tokenizer has none, and marks, each once. Runs of
        Latin letters are told by one search over all lines, others one by one."""
        known, new, letters, others, parts = self.known, [*new], set(), set(), []
        if not new:
            return
        text = "\n".join(new) if self.apart else ""
        lines = self.LATIN.findall(text.lower() if self.caseless else text) if self.apart else [("", "")] * len(new)
        for run, (word, marks) in zip(new, lines, strict=True):
            if not word and len(run) <= LONGEST:
                word = run.rstrip(self.MARKS)
                marks = run[len(word) :]
                if not word.isalpha() or not (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha()):
                    word = ""
            if not word or len(run) > LONGEST:
                others.add(run)
                continue
            letters.add(word)
            if marks:
                others.add(marks)
            if marks or word != run:
                parts.append((run, word, marks))
        for get, found in ((self._words, letters), (self._library, others)):
            missing = found.difference(known)
            again = missing.intersection(self.older)
            known.update(zip(again, map(self.older.__getitem__, again), strict=True))
            missing = [*missing.difference(again)]
            known.update(zip(missing, get(missing), strict=True))
        for run, word, marks in parts:
            known[run] = known[word] + known[marks] if marks else known[word]

    def packed(self, texts: Iterable[str | None] | pa.Array) -> list[bytes]:
        """The ids of each text, ``width`` bytes each; none for a null. Arrow splits the texts
        and tells their distinct runs, so that a batch's runs are looked up once each."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        runs = pc.ascii_split_whitespace(texts) if self.apart else None
        ends = np.asarray(runs.offsets) - runs.offsets[0].as_py() if self.apart else np.arange(len(texts) + 1)
        coded = (runs.flatten() if self.apart else texts).dictionary_encode()
        distinct, known, older = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self.known, self.older
        new = set(distinct).difference(known)
        again = new.intersection(older)
        known.update(zip(again, map(older.__getitem__, again), strict=True))
        self._learn(new.difference(again))
        ids = pa.array(list(map(known.__getitem__, distinct)), pa.large_binary()).take(coded.indices)
        bounds = (np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1) if len(ids) else np.zeros(1, np.int64))[ends].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        out = [bytes(data[x:y]) for x, y in pairwise(bounds)]
        for w in new:
            if len(w) > LONGEST:
                del known[w]
        if len(known) > MEMO:
            self.known, self.older = {}, known
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """A worker's one encoder of a path, with what it remembers from task to task."""
    return Encoder(path)


class Writer:
    """Writes one file to a byte stream."""

    def __init__(self, stream, width: int, frame: int = FRAME):
        self.stream, self.width, self.frame = stream, width, frame * width
        self.pack, self.table, self.held = zstandard.ZstdCompressor(level=LEVEL), [], bytearray()
        self.documents: list[int | None] = []
        self.lengths: list[int] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.documents.append(doc_id)
        self.lengths.append(len(ids) // self.width)
        self.size += len(ids) // self.width
        if len(ids) <= self.frame:
            self.held += ids
        else:  # the document begins and ends a frame of its own
            self._end_frame()
            for at in range(0, len(ids), self.frame):
                self.held += ids[at : at + self.frame]
                self._end_frame()
        if len(self.held) >= self.frame:
            self._end_frame()

    def _end_frame(self) -> None:
        if self.held:
            plain = bytes(self.held)
            packed = self.pack.compress(plain)
            self.stream.write(packed)
            self.table.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
            self.held.clear()

    def _skippable(self, magic: int, payload: bytes) -> int:
        self.stream.write(struct.pack("<II", magic, len(payload)) + payload)
        return len(payload) + 8

    def close(self) -> None:
        self._end_frame()
        nulls = np.array([d is None for d in self.documents], np.uint8)
        ids = np.array([d or 0 for d in self.documents], "<i8")
        plain = nulls.tobytes() + ids.tobytes() + np.array(self.lengths, "<i8").tobytes()
        size = self._skippable(DOCUMENTS, struct.pack("<BQ", self.width, len(ids)) + self.pack.compress(plain))
        self.table.append((size, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        rows = b"".join(struct.pack("<III", *row) for row in self.table)
        self._skippable(SEEK_TABLE, rows + struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE))
        self.stream.close()


class Reader:
    """Reads one file that can be read from any place; the end first."""

    def __init__(self, file, size: int):
        self.file, self.unpack = file, zstandard.ZstdDecompressor()
        frames, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or flags != CHECKSUMS:
            raise ValueError("the file has no seek table with checksums at its end")
        begin = size - 9 - 12 * frames - 8
        head = self._at(begin, 8 + 12 * frames)
        if struct.unpack("<II", head[:8]) != (SEEK_TABLE, 12 * frames + 9):
            raise ValueError("the seek table does not have the size it tells")
        table = np.frombuffer(head[8:], "<u4").reshape(frames, 3).astype(np.int64)
        self.packed, self.plain, self.sums = table.T
        self.places = np.concatenate(([0], np.cumsum(self.packed)))
        if self.places[-1] != begin or not frames:
            raise ValueError("the frames and the seek table do not fit")
        index = self._at(int(self.places[-2]), int(self.packed[-1]))
        self.width, n = struct.unpack("<BQ", index[8:17])
        plain = self.unpack.decompress(index[17:], max_output_size=17 * n) if n else b""
        self.null = np.frombuffer(plain, np.uint8, n).astype(bool)
        self.ids = np.frombuffer(plain, "<i8", n, n)
        self.lengths = np.frombuffer(plain, "<i8", n, 9 * n)
        #: Where documents start, in ids of this file, and frames, in bytes of plain text.
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))
        self.bounds = np.concatenate(([0], np.cumsum(self.plain)))
        self.unpacked = 0

    def _at(self, place: int, size: int) -> bytes:
        if place < 0:
            raise ValueError("the file is too short")
        self.file.seek(place)
        data = self.file.read(size)
        if len(data) != size:
            raise ValueError("the file is cut off")
        return data

    def frame(self, i: int) -> bytes:
        plain = self.unpack.decompress(self._at(int(self.places[i]), int(self.packed[i])), max_output_size=int(self.plain[i]))
        if len(plain) != self.plain[i] or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.sums[i]:
            raise ValueError(f"frame {i} does not have its checksum")
        self.unpacked += 1
        return plain

    def documents(self, rows: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
        """``(row, ids)`` of the documents at ``rows``, ascending; other frames stay packed."""
        at, plain = -1, b""
        for row in rows:
            begin, end = int(self.starts[row]) * self.width, int(self.starts[row + 1]) * self.width
            pieces, i = [], int(np.searchsorted(self.bounds, begin, "right")) - 1
            while begin < end:
                if i != at:
                    at, plain = i, self.frame(i)
                piece = plain[begin - int(self.bounds[i]) : end - int(self.bounds[i])]
                pieces.append(piece)
                begin += len(piece)
                i += 1
            yield row, np.frombuffer(pieces[0] if len(pieces) == 1 else b"".join(pieces), f"<u{self.width}")

    def rows(self, start: int, wanted: Iterable[int] | None = None) -> Iterator[pa.RecordBatch]:
        """Rows ``(doc_id, start, n_tokens, ids)``, ids of 4 bytes, in bounded batches."""
        out, held = [], 0
        for row, ids in self.documents(range(len(self.ids)) if wanted is None else wanted):
            data = ids.astype("<u4").tobytes()
            out.append((None if self.null[row] else int(self.ids[row]), start + int(self.starts[row]), len(ids), data))
            held += len(data)
            if held >= BATCH or len(out) >= 4096:
                yield _batch(out)
                out, held = [], 0
        if out:
            yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ROWS.types, strict=True)], schema=_ROWS)


def write(docs: DataFrame, path: str, folder: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text", share: int = SHARE) -> DataFrame:
    """Writes the ids of all texts, each with ``end`` behind it; the manifest, stored.

    ``path`` is a tokenizer that every executor has. Documents follow each other by id, nulls
    first; rows of one id by a hash of the text, equal ones as the table has them. Null texts
    are empty. Ids are integers. ``folder`` is a location that drivers and executors share, of
    a file system that Arrow knows. The table is read once for its size, once for the bounds
    of the ranges and once to be dealt.
    """
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{id_col} must be of an integer type")
    size = docs.agg(F.coalesce(F.sum(F.coalesce(F.length(text_col), F.lit(0)) + 16), F.lit(0)).alias("n")).first()["n"]
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"), F.monotonically_increasing_id().alias("row"))
    order = [F.asc_nulls_first("doc_id"), "h", "row"]
    dealt = rows.repartitionByRange(max(1, -(-size // share)), *order).sortWithinPartitions(*order)

    def run(batches):
        model, out = encoder(path), None
        fs, base = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        tail, no, name = np.array([end], model.kind).tobytes(), 0, ""

        def done(part):
            out.close()
            fs.move(f"{base}/{name}.open", f"{base}/{name}.ids.zst")
            row = {"part": part, "no": no, "path": f"{name}.ids.zst", "documents": len(out.lengths), "ids": out.size}
            return pa.RecordBatch.from_pylist([row | {"first_id": out.documents[0], "last_id": out.documents[-1]}], schema=_MANIFEST)

        part = None
        for batch in batches:
            part = batch.column(0)[0].as_py() if batch.num_rows else part
            for doc_id, ids in zip(batch.column(1).to_pylist(), model.packed(batch.column(2)), strict=True):
                if out and out.size >= FILE:
                    yield done(part)
                    out, no = None, no + 1
                if not out:
                    name = uuid.uuid4().hex
                    out = Writer(fs.open_output_stream(f"{base}/{name}.open", compression=None), model.width)
                out.add(doc_id, ids + tail)
        if out:
            yield done(part)

    small_batches(docs.sparkSession)
    schema = "part int, no int, path string, documents bigint, ids bigint, first_id bigint, last_id bigint"
    return stored(dealt.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(run, schema))


def placed(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``, the ids of all files before. A row per file, one task."""
    before = Window.orderBy("part", "no").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """All documents: ``(doc_id, start, n_tokens, ids)``, ids as little-endian unsigned 32-bit
    integers. ``start``: ids of all documents before it."""
    files = max(1, min(READERS, manifest.count()))

    def run(batches):
        fs, base = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(f"{base}/{path}") as file:
                    yield from Reader(file, file.size()).rows(start)

    small_batches(spark)
    return placed(manifest).select("path", "start").repartition(files).mapInArrow(run, ROWS)


def fetch(manifest: DataFrame, folder: str, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents of ``wanted``, as `read` gives them; only their frames are unpacked.

    Every row of the files with such an id is returned, once however often it is asked for;
    ids in no file give no row, a null asks for documents without an id. The bounds of the
    files, two numbers each, go to all tasks.
    """
    rows = placed(manifest).orderBy("part", "no").select("path", "start", "first_id", "last_id").toArrow()
    spark, least = manifest.sparkSession, -(1 << 63)
    low, high = (np.array([least if x is None else x for x in rows.column(c).to_pylist()], np.int64) for c in ("first_id", "last_id"))
    bounds = spark.sparkContext.broadcast((low, high))

    def find(batches):
        low, high = bounds.value
        for batch in batches:
            asked = batch.column(0)
            keys = np.array([least if x is None else x for x in asked.to_pylist()], np.int64)
            a, b = np.searchsorted(high, keys, "left"), np.searchsorted(low, keys, "right")
            n = np.maximum(b - a, 0)
            file = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([pa.array(file, pa.int64()), asked.take(pa.array(np.repeat(np.arange(len(keys)), n)))], names=["file", "doc_id"])

    paths = spark.createDataFrame(pa.table({"file": pa.array(range(len(rows)), pa.int64()), "path": rows.column("path"), "start": rows.column("start")})) if len(rows) else None
    if paths is None:
        return spark.createDataFrame([], ROWS)
    asked = wanted.select(F.col(id_col).cast("bigint").alias("doc_id")).distinct().mapInArrow(find, "file bigint, doc_id bigint")
    asked = asked.groupBy("file").agg(F.collect_list(F.struct("doc_id")).alias("ids")).join(paths, "file").select("path", "start", "ids")

    def run(batches):
        fs, base = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(f"{base}/{path}") as file:
                    reader = Reader(file, file.size())
                    hit = np.isin(reader.ids, [x["doc_id"] for x in ids if x["doc_id"] is not None]) & ~reader.null
                    if any(x["doc_id"] is None for x in ids):
                        hit |= reader.null
                    yield from reader.rows(start, np.flatnonzero(hit).tolist())

    small_batches(spark)
    return asked.mapInArrow(run, ROWS)


def write_and_read(docs: DataFrame, path: str, folder: str | None = None, end: int = 2) -> DataFrame:
    """Writes the ids of ``docs (doc_id, text)`` and reads them back, as `read` gives them.

    Null and empty texts give the end id alone; texts of any length are encoded whole; repeated
    rows give repeated documents, null ids come first; extra columns are ignored; an empty
    table gives no file and no row.
    """
    folder = folder or shared_dir(docs.sparkSession)
    return read(docs.sparkSession, write(docs, path, folder, end), folder)
