from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow.fs
import public_tokenizers as P
import pytest
import zstandard
from tokenizers import Tokenizer

from passagekit.llm import token_files as T

PATH = P.path("word_bpe_49k.json")
ALPHABET = [
    "a", "B", "é", "é", "́", " ", "  ", "\n", "\x1c", "\x85", "\xa0", "'s", "'LL", ".", ",", "!?", "1", "²", "漢", "ſ", "Σ", "İ", "יִ",
    "<|endoftext|>", "<|startoftext|>", "᠎", "😀", "_", "-", "\x00", "ǅ", "\U0001e900", "the", "words",
]


def texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(30))) for _ in range(n)]


def library(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def unpacked(encoder, texts):
    return [np.frombuffer(p, encoder.kind).tolist() for p in encoder.packed(texts)]


def test_runs_give_the_ids_of_the_library(monkeypatch):
    encoder = T.Encoder(PATH)
    assert encoder.runs("a b") == ["a", "b"] and encoder.width == 2
    odd = texts(1, 3000)
    assert unpacked(encoder, odd) == library(odd)
    monkeypatch.setattr(T, "MEMO", 50)  # the memory starts anew all the time
    for at in range(0, 600, 20):
        assert unpacked(encoder, odd[at : at + 20]) == library(odd[at : at + 20])


def test_a_tokenizer_that_keeps_white_space_gets_whole_texts():
    path = P.path("byte_bpe_50k.json")
    encoder, tokenizer = T.Encoder(path), Tokenizer.from_file(path)
    assert encoder.runs("a b") == ["a b"]
    assert unpacked(encoder, texts(2, 300)) == [e.ids for e in tokenizer.encode_batch(texts(2, 300), add_special_tokens=False)]


def file_of(tmp_path, documents, frame=50, width=2):
    path = str(tmp_path / "x.ids.zst")
    writer = T.Writer(open(path, "wb"), width, frame)
    for doc_id, ids in documents:
        writer.add(doc_id, np.array(ids, f"<u{width}").tobytes())
    writer.close()
    return path, pyarrow.fs.LocalFileSystem().open_input_file(path)


@pytest.mark.parametrize("width", [2, 4])
def test_round_trip_and_frames(tmp_path, width):
    rng = random.Random(3)
    documents = [(i if i % 9 else None, [rng.randrange(60_000) for _ in range(rng.choice([0, 1, 7, 49, 50, 51, 400]))]) for i in range(80)]
    path, file = file_of(tmp_path, documents, width=width)
    reader = T.Reader(file, file.size())
    back = [(None if reader.null[i] else int(reader.ids[i]), ids.tolist()) for i, ids in reader.documents(range(80))]
    assert back == documents
    # Any zstandard tool sees the data frames; the others are skippable.
    plain = zstandard.ZstdDecompressor().stream_reader(open(path, "rb"), read_across_frames=True).read()
    assert np.frombuffer(plain, f"<u{width}").tolist() == [i for _, ids in documents for i in ids]
    # Asking for one short document unpacks one frame; for one of 400 ids its eight.
    for want, frames in ((1, 1), (400, 8)):
        one = T.Reader(file, file.size())
        row = next(i for i, (_, ids) in enumerate(documents) if len(ids) == want)
        assert [(r, ids.tolist()) for r, ids in one.documents([row])] == [(row, documents[row][1])]
        assert one.unpacked == frames


def test_damage_is_found(tmp_path):
    path, file = file_of(tmp_path, [(1, [5] * 60), (2, [6, 7] * 40)])
    data = bytearray(open(path, "rb").read())
    first = int(T.Reader(file, file.size()).packed[0])
    bad = zstandard.ZstdCompressor().compress(np.array([6] * 60, "<u2").tobytes())
    for change in (data[:-1], data[:40], b"", bytes(data[:5]) + b"\xff" * 4 + bytes(data[9:])):
        open(path, "wb").write(change)
        with pytest.raises((ValueError, zstandard.ZstdError)), pyarrow.fs.LocalFileSystem().open_input_file(path) as broken:
            list(T.Reader(broken, broken.size()).documents([0, 1]))
    if len(bad) == first:  # a whole frame with other ids: only the checksum tells
        open(path, "wb").write(bad + bytes(data[first:]))
        with pytest.raises(ValueError, match="checksum"), pyarrow.fs.LocalFileSystem().open_input_file(path) as broken:
            list(T.Reader(broken, broken.size()).documents([0]))


def plain(rows, end=2):
    """What the query returns, by plain means; rows in the order of the files."""
    out, start = [], 0
    for doc_id, ids in rows:
        ids = [*ids, end]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def digests(df):
    return sorted(((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in df.collect()), key=lambda r: r[1])


def test_files_hold_documents_in_order(spark, tmp_path, monkeypatch):
    odd = [*texts(5, 300), None, "", "word " * 30_000]
    order = list(range(len(odd)))
    random.Random(6).shuffle(order)
    docs = spark.createDataFrame([(i, odd[i], 1) for i in order], "doc_id bigint, text string, start int").repartition(7)
    manifest = T.write(docs, PATH, f"file://{tmp_path}/a", share=20_000)
    assert manifest.count() > 3
    assert digests(T.read(spark, manifest, f"file://{tmp_path}/a")) == plain(enumerate(library(odd)))
    # Requested documents alone, of several files, one of them twice and one that is not there.
    wanted = spark.createDataFrame([(3,), (3,), (302,), (150,), (999_999,), (None,)], "doc_id bigint")
    got = digests(T.fetch(manifest, f"file://{tmp_path}/a", wanted))
    assert got == [r for r in plain(enumerate(library(odd))) if r[0] in (3, 150, 302)]


def test_repeated_and_null_ids(spark, tmp_path):
    docs = spark.createDataFrame([(7, "a b"), (None, "c"), (7, "a b"), (None, None), (7, "d"), (1, "")], "doc_id int, text string")
    manifest = T.write(docs, PATH, f"file://{tmp_path}/b", share=20)
    assert manifest.count() > 1
    rows = T.read(spark, manifest, f"file://{tmp_path}/b").orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, None, 1, 7, 7, 7]
    assert sorted(r.n_tokens for r in rows) == [1, 1, 2, 2, 3, 3] and [r.start for r in rows][0] == 0
    assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:], strict=False))
    again = T.fetch(manifest, f"file://{tmp_path}/b", spark.createDataFrame([(7,), (None,)], "doc_id bigint"))
    assert sorted(map(str, again.collect())) == sorted(str(r) for r in rows if r.doc_id != 1)


def test_empty_table_and_other_ids(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    manifest = T.write(empty, PATH, f"file://{tmp_path}/c")
    assert T.read(spark, manifest, f"file://{tmp_path}/c").collect() == []
    assert T.fetch(manifest, f"file://{tmp_path}/c", empty).collect() == []
    with pytest.raises(ValueError, match="integer"):
        T.write(empty.selectExpr("'x' AS doc_id", "text"), PATH, f"file://{tmp_path}/d")


def test_words_of_one_spelling_reach_the_library_once():
    """Cases that the tokenizer does not tell apart, and marks behind a word, cost no further call."""
    encoder, seen = T.Encoder(PATH), []
    words = encoder._words
    encoder._words = lambda new: seen.extend(new) or words(new)
    texts = ["Vörtgrumpf vörtgrumpf$$$ VÖRTGRUMPF.", None, "", " \n", "K k\xa0K Σας \x1cvörtgrumpf%%%"]
    want = encoder._library([t or "" for t in texts])
    assert encoder.packed(texts) == want == encoder.packed(texts)
    assert [w for w in seen if "grumpf" in w] == ["vörtgrumpf"]
    assert encoder.packed([]) == []
