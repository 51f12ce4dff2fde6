from __future__ import annotations

import base64
import gzip
import hashlib
import io
import random

import pytest

from passagekit.llm import warc as W

PAGES = "page_id bigint, url string, html string"


def rows(n=60):
    rng = random.Random(1)
    out = [(i, f"http://a.example/{i}\r\nX: {i}", rng.choice(["<p>é</p>", "", None, "x" * i, f"<b>{i}\r\n\r\nWARC/1.1\r\n</b>"])) for i in range(n)]
    return out + [(500, None, "漢" * 3001), (501, "u", "漢" * 3001), (None, "u", "漢" * 3001), (None, "u", "alone"), out[7], (7, "other", "another payload")]


def want(pages, least=0):
    keep = {}
    for i, _, h in pages:
        data = (h or "").encode()
        if i is not None and len(data) >= least:
            keep[data] = max(keep.get(data, i), i)
    out = []
    for i, _, h in pages:
        data = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        k = keep.get(data, i)
        out.append((i, len(data), digest, "response" if k == i else "revisit", None if k == i else k))
    return sorted(out, key=str)


@pytest.mark.parametrize(("chunk", "size", "least"), [(1 << 20, 1 << 28, 0), (7, 500, 0), (64, 1, 9)])
def test_round_trip(spark, tmp_path, chunk, size, least):
    pages = rows()
    df = spark.createDataFrame([(*p, "x") for p in pages], PAGES + ", payload string").repartition(3)
    folder = f"file://{tmp_path}/archives"
    manifest = W.write(W.chunked(df, least, chunk), folder, size)
    table = W.read(spark, manifest, folder, chunk).collect()
    got = sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in table if r.last], key=str)
    assert got == want(pages, least)
    assert all(len(r.payload) <= chunk for r in table)
    assert manifest.count() == len(list((tmp_path / "archives").iterdir()))
    payload, running = {}, {}
    for r in sorted(table, key=lambda r: r.chunk_no):
        if r.record_type == "response" and r.page_id is not None and r.page_id != 7 and r.page_id not in (pages[7][0],):
            payload[r.page_id] = payload.get(r.page_id, b"") + bytes(r.payload)
            running[r.page_id] = r
            assert r.payload_bytes == len(payload[r.page_id])
            assert r.payload_digest == W.base32(hashlib.sha1(payload[r.page_id]).digest())
    texts = {i: (h or "").encode() for i, _, h in pages}
    assert payload == {i: texts[i] for i in payload} and len(payload) > 10


def test_archives_are_well_formed(spark, tmp_path):
    """Read one by hand: a gzip member a record, lengths that fit, required headers."""
    folder = f"file://{tmp_path}/a"
    W.write(W.chunked(spark.createDataFrame(rows(12), PAGES).coalesce(1)), folder).collect()
    for path in (tmp_path / "a").iterdir():
        data = gzip.decompress(path.read_bytes())
        while data:
            header, _, data = data.partition(b"\r\n\r\n")
            lines = header.decode().split("\r\n")
            assert lines[0] == "WARC/1.1" and all(": " in line for line in lines[1:])
            fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
            assert {"warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"} <= fields.keys()
            n = int(fields["content-length"])
            assert data[n : n + 4] == b"\r\n\r\n"
            data = data[n + 4 :]


def test_damaged_archives_are_refused(spark, tmp_path):
    row = {"page_id": 1, "url": "u", "sha1": hashlib.sha1(b"abc").hexdigest(), "size": 3, "record_type": "response", "refers_to": None}
    good = W.head(row) + b"abc\r\n\r\n"
    assert [r["payload_bytes"] for r in W.parse(io.BytesIO(gzip.compress(good)), 2)] == [2, 3]
    for bad in (good.replace(b"abc", b"abd"), good[:-6], b"junk\r\n" + good):
        with pytest.raises(ValueError):
            list(W.parse(io.BytesIO(gzip.compress(bad))))


def test_empty_table(spark):
    assert W.archive(spark.createDataFrame([], PAGES)).collect() == []


def test_no_row_holds_a_whole_payload(spark):
    """A payload of many chunks: rows hold one each, and only the cut reads the page's cell."""
    pages = spark.createDataFrame([(1, "u", "0123456789" * 5000), (2, "u", "0123456789" * 5000), (3, None, None)], PAGES)
    chunks = W.chunked(pages, chunk=1000).collect()
    assert [(r.page_id, r.chunk_no) for r in chunks if r.page_id == 2] == [(2, i) for i in range(50)]
    assert all(len(W._unpack(r.packed)) == 1000 for r in chunks if r.page_id == 2)
    assert [(r.page_id, r.record_type, r.refers_to, r.packed) for r in chunks if r.page_id == 1] == [(1, "revisit", 2, None)]
    assert sum(r.page_id == 3 for r in chunks) == 1
