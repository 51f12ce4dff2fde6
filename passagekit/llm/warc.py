"""WARC archives by way of a table of record chunks.

Payloads travel as rows of record, chunk number and at most ``CHUNK`` bytes (compressed on the
way). They are cut before anything else is done with them, so that beyond the page's own cell
no row, writer or reader ever holds a whole record. Chunks carry the number of payload bytes
and the SHA-1 digest of the payload so far, so the last chunk's are those of the record.

Of records with equal payloads one is kept as a response, the others become revisits
without payload. Which one is decided on narrow rows (digest and id); chunks are dealt by
record, which no group of copies makes uneven. Writers give their archives their final name
only when complete and report them in a manifest, a Parquet table; what a lost or repeated
task leaves behind is in no manifest and is never read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagekit.llm.common import shared_dir, small_batches, stored

#: Payload bytes in a row; payload bytes after which a new archive begins.
CHUNK, ARCHIVE = 1 << 20, 256 << 20
#: Compression of the archives; each record is a gzip member of its own.
LEVEL = 1
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Rows of the chunk table.
CHUNKS = (
    "record_id string, page_id bigint, url string, record_type string, refers_to bigint, chunk_no bigint, "
    "last boolean, payload_bytes bigint, payload_digest string, payload binary"
)


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _cut(pages: DataFrame, chunk: int, id_col: str, url_col: str, text_col: str) -> DataFrame:
    """Rows ``(record, page_id, url, chunk_no, chunks, size, sha1, packed)``, in order.

    A payload becomes an array of pieces before rows are made of it, so that no row but the
    page's has more than one. ``size`` and ``sha1`` are of the payload up to the chunk's end.
    """
    payload = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    last = F.greatest(F.ceil(F.length(payload) / chunk), F.lit(1)) - 1
    pieces = F.transform(F.sequence(F.lit(0).cast("bigint"), last), lambda i: F.substring(payload, (i * chunk + 1).cast("int"), F.lit(chunk)))
    rows = pages.select(F.monotonically_increasing_id().alias("record"), F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), pieces.alias("pieces"))
    rows = rows.select("record", "page_id", "url", F.size("pieces").cast("bigint").alias("chunks"), F.posexplode("pieces").alias("chunk_no", "payload"))

    def run(batches):
        digest, size = None, 0
        for batch in batches:
            sizes, sums, packed = [], [], []
            for no, payload in zip(batch.column(4).to_pylist(), batch.column(5), strict=True):
                if no == 0:
                    digest, size = hashlib.sha1(), 0
                data = payload.as_py()
                digest.update(data)
                size += len(data)
                sizes.append(size)
                sums.append(digest.hexdigest())
                packed.append(_pack(data))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], batch.column(4).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.string()), pa.array(packed, pa.binary())],
                names=["record", "page_id", "url", "chunks", "chunk_no", "size", "sha1", "packed"],
            )

    small_batches(pages.sparkSession)
    return rows.mapInArrow(run, "record bigint, page_id bigint, url string, chunks bigint, chunk_no bigint, size bigint, sha1 string, packed binary")


def _pack(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _unpack(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], size, "zstd", asbytes=True) if size else b""


def chunked(pages: DataFrame, least: int = 0, chunk: int = CHUNK, id_col="page_id", url_col="url", text_col="html") -> DataFrame:
    """Rows ``(record, page_id, url, sha1, size, record_type, refers_to, chunk_no, chunks,
    packed)``, the chunks of a record in one partition and in order.

    Payloads are the texts in UTF-8, null as empty. Of records with equal payloads of at
    least ``least`` bytes, that with the largest id is the response (all of them, if rows
    are repeated), the others revisit it; records of null ids revisit any other there is.
    """
    cut = stored(_cut(pages, chunk, id_col, url_col, text_col))
    whole = cut.where(F.col("chunk_no") == F.col("chunks") - 1).select("record", "page_id", "sha1", "size")
    kept = whole.where(F.col("size") >= least).groupBy("sha1", "size").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1")
    again = F.col("n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))
    decided = whole.join(kept, ["sha1", "size"], "left").select("record", "sha1", "size", again.alias("again"), F.when(again, F.col("keep")).alias("refers_to"))
    rows = cut.drop("sha1", "size").join(decided.hint("shuffle_hash"), "record").where(~F.col("again") | (F.col("chunk_no") == 0))
    rows = rows.select(
        "record", "page_id", "url", "sha1", "size", F.when(F.col("again"), F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"), "refers_to",
        "chunk_no", F.when(F.col("again"), F.lit(1)).otherwise(F.col("chunks")).alias("chunks"), F.when(~F.col("again"), F.col("packed")).alias("packed"),
    )
    return rows.sortWithinPartitions("record", "chunk_no")


def head(row: dict) -> bytes:
    """A record's header, up to where its payload begins."""
    digest = base32(bytes.fromhex(row["sha1"]))
    http = _HTTP.format(row["size"]).encode()
    block = len(http) + (row["size"] if row["record_type"] == "response" else 0)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: {record_id(row['page_id'], digest)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {block}",
        f"X-Payload-Length: {row['size']}",
    ]
    if row["url"] is not None:
        lines.append("WARC-Target-URI: " + " ".join(row["url"].split()))
    if row["page_id"] is not None:
        lines.append(f"X-Page-ID: {row['page_id']}")
    if row["record_type"] == "revisit":
        lines += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {record_id(row['refers_to'], digest)}"]
        if row["refers_to"] is not None:
            lines.append(f"X-Refers-To-Page-ID: {row['refers_to']}")
    return "\r\n".join([*lines, "", ""]).encode() + http


def write(chunks: DataFrame, folder: str, archive: int = ARCHIVE) -> DataFrame:
    """Writes the archives; the manifest ``(path, records, payload_bytes)``, stored.

    ``chunks`` as `chunked` gives them, the chunks of a record in order. ``folder`` is a
    location that drivers and executors share, of a file system that Arrow knows.
    """

    def run(batches):
        fs, base = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        out, name, records, size, digest, member = None, "", 0, 0, None, None

        def done():
            out.close()
            fs.move(f"{base}/{name}.open", f"{base}/{name}.warc.gz")
            return pa.RecordBatch.from_pylist([{"path": f"{name}.warc.gz", "records": records, "payload_bytes": size}], schema=manifest)

        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                payload = _unpack(row["packed"]) if row["packed"] else b""
                if row["chunk_no"] == 0:
                    if out and size >= archive:
                        yield done()
                        out = None
                    if not out:
                        name, records, size = uuid.uuid4().hex, 0, 0
                        out = fs.open_output_stream(f"{base}/{name}.open", compression=None)
                    member, digest = zlib.compressobj(LEVEL, wbits=31), hashlib.sha1()
                    out.write(member.compress(head(row)))
                digest.update(payload)
                out.write(member.compress(payload))
                size += len(payload)
                if row["chunk_no"] == row["chunks"] - 1:
                    if row["record_type"] == "response" and digest.hexdigest() != row["sha1"]:
                        raise ValueError(f"chunks of page {row['page_id']} are out of order")
                    out.write(member.compress(b"\r\n\r\n") + member.flush())
                    records += 1
        if out:
            yield done()

    manifest = pa.schema([("path", pa.string()), ("records", pa.int64()), ("payload_bytes", pa.int64())])
    small_batches(chunks.sparkSession)
    return stored(chunks.mapInArrow(run, "path string, records bigint, payload_bytes bigint"))


def parse(stream, chunk: int = CHUNK) -> Iterator[dict]:
    """Rows of the chunk table from an archive's byte stream, one chunk in memory."""
    data = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 16)
    while line := data.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError("not at the beginning of a record")
        header = {}
        while (line := data.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise ValueError("the archive ends within a header")
            key, _, value = line.decode().rstrip("\r\n").partition(": ")
            header[key.lower()] = value
        left, number = int(header["content-length"]), header.get
        while left and (line := data.readline()):
            left -= len(line)
            if line in (b"\r\n", b"\n"):
                break
        revisit = header["warc-type"] == "revisit"
        page, refers = number("x-page-id"), number("x-refers-to-page-id")
        row = {"record_id": header["warc-record-id"], "page_id": None if page is None else int(page), "url": number("warc-target-uri"), "record_type": header["warc-type"], "refers_to": None if refers is None else int(refers)}
        digest, size, no = hashlib.sha1(), 0, 0
        while True:
            piece = data.read(min(chunk, left))
            left -= len(piece)
            if left and not piece:
                raise ValueError("the archive ends within a payload")
            digest.update(piece)
            size += len(piece)
            so_far = base32(digest.digest())
            if revisit:
                size, so_far = int(header["x-payload-length"]), header["warc-payload-digest"].removeprefix("sha1:")
            elif not left and so_far != header["warc-payload-digest"].removeprefix("sha1:"):
                raise ValueError(f"the payload of {row['record_id']} does not have its digest")
            yield row | {"chunk_no": no, "last": not left, "payload_bytes": size, "payload_digest": so_far, "payload": piece}
            no += 1
            if not left:
                break


def read(spark: SparkSession, manifest: DataFrame, folder: str, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of the manifest's archives, an archive a task."""
    n = max(1, manifest.count())

    def run(batches):
        fs, base = pa.fs.FileSystem.from_uri(folder)
        schema = pa.schema(
            [("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int64()), ("last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
        )
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{base}/{path}", compression=None) as stream:
                    for row in parse(stream, chunk):
                        rows.append(row)
                        held += len(row["payload"])
                        if len(rows) >= 1000 or held >= 4 * CHUNK:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    small_batches(spark)
    return manifest.select("path").repartition(n).mapInArrow(run, CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """A row per record: its last chunk, which has the size and digest of the whole."""
    return chunks.where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def archive(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Writes a WARC record per row of ``pages (page_id, url, html)`` and reads all back.

    Returns the chunk table. ``folder``: by default a new one under the shared folder.
    Null urls and ids are left out of the records' headers; white space inside a url is
    written as one space; repeated rows give repeated records; extra columns are ignored;
    an empty table gives an empty chunk table.
    """
    spark = pages.sparkSession
    folder = folder or shared_dir(spark)
    return read(spark, write(chunked(pages, least), folder), folder)
