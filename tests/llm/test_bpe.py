from __future__ import annotations

import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from passagekit.llm import bpe, queries

PATH = P.path("byte_bpe_50k.tiktoken")
ALPHABET = ["a", "e", "the", "The", "'", "'s", "'re", " ", "  ", "\n", "\t", "é", "ß", "漢", "1", "23", "!", "--", " ", "x" * 9, "<|endoftext|>", "😀"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.vocabulary(PATH).rank, special_tokens={})


def some(rng, n):
    return "".join(rng.choice(ALPHABET) for _ in range(n))


def test_encoding_and_round_trip(library):
    rng, encoder = random.Random(5), bpe.Encoder(PATH, P.PATTERN)
    for text in [None, "", " ", "a" * 3000, "ab" * 700, *(some(rng, rng.randrange(60)) for _ in range(300))]:
        ids = encoder.encode(text)
        assert ids.tolist() == library.encode_ordinary(text or "")
        assert encoder.decode(ids) == (text or "").encode()


def test_prefixes_are_the_encodings_of_prefixes():
    vocab, data = bpe.vocabulary(PATH), "unbelievablyéé" .encode()
    prefixes = bpe.Prefixes(vocab)
    for i in range(len(data)):
        prefixes.append(data[i : i + 1])
        assert prefixes.tokens() == vocab.merged(data[: i + 1])


def test_pairs_that_fit_are_those_that_bpe_keeps(tmp_path):
    rng, vocab = random.Random(4), bpe.vocabulary(PATH)
    tokens = sorted(vocab.token)
    short = [t for t in tokens if vocab.size[t] <= 3]
    pairs = [(-1, t) for t in rng.sample(tokens, 2000)] + [(rng.choice(short), rng.choice(short)) for _ in range(20000)]
    for data in (vocab.token[rng.choice(tokens)] + vocab.token[rng.choice(tokens)] for _ in range(20000)):
        i = rng.randrange(1, len(data))
        if data[:i] in vocab.rank and data[i:] in vocab.rank:
            pairs.append((vocab.rank[data[:i]], vocab.rank[data[i:]]))
    pairs += [(vocab.rank[b"a" * i], vocab.rank[b"a" * j]) for i in range(1, 5) for j in range(1, 5) if {b"a" * i, b"a" * j} <= vocab.rank.keys()]
    for before, after in pairs:
        kept = vocab.merged((vocab.token[before] if before >= 0 else b"") + vocab.token[after]) == [t for t in (before, after) if t >= 0]
        assert vocab.fits(before, after) == kept, (before, after)
    # Ranks in no order of merges: "abc" before its halves, "xyz" with none.
    odd = [bytes([i]) for i in range(256)] + [b"abc", b"ab", b"bc", b"xyz", b"cab", b"aa", b"aaa", b"aaaa"]
    (tmp_path / "odd").write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(odd)))
    vocab = bpe.Vocabulary(str(tmp_path / "odd"))
    for before in range(-1, len(odd)):
        for after in (*range(97, 123), *range(256, len(odd))):
            kept = vocab.merged((odd[before] if before >= 0 else b"") + odd[after]) == [t for t in (before, after) if t >= 0]
            assert vocab.fits(before, after) == kept, (before, after)


def test_a_full_memory_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    rng, encoder = random.Random(6), bpe.Encoder(PATH, P.PATTERN)
    for text in (some(rng, 40) for _ in range(50)):
        assert encoder.encode(text).tolist() == library.encode_ordinary(text)
        assert len(encoder.known) <= 3


def test_edit_of_a_pre_token_computes_little():
    rng, vocab = random.Random(2), bpe.vocabulary(PATH)
    data = bytes(rng.choice(b"etaoinshr") for _ in range(900))
    for _ in range(20):
        start = rng.randrange(len(data) - 5)
        stop, new = start + rng.randrange(4), bytes(rng.choice(b"xyz") for _ in range(rng.randrange(4)))
        prefixes = bpe.Prefixes(vocab, data)
        done = prefixes.edit(start, stop, new)
        assert prefixes.data == data[:start] + new + data[stop:]
        assert prefixes.last == bpe.Prefixes(vocab, prefixes.data).last
        assert done <= min(len(prefixes.data) - start, 2 * vocab.longest)


def test_documents_follow_appends_and_edits(library):
    rng, encoder = random.Random(8), bpe.Encoder(PATH, P.PATTERN)
    document, text = bpe.Document(encoder, ""), ""
    for _ in range(400):
        new = some(rng, rng.randrange(4))
        if rng.random() < 0.4:
            document.append(new)
            text += new
        else:
            start = rng.randrange(len(text) + 1)
            stop = min(len(text), start + rng.randrange(6))
            document.edit(start, stop, new)
            text = text[:start] + new + text[stop:]
        assert document.text == text
        assert document.tokens() == library.encode_ordinary(text)


def test_query_over_a_table(spark, tmp_path, library):
    rng = random.Random(1)
    rows = [(i % 9 if i else None, t) for i, t in enumerate([None, "", *(some(rng, 40) for _ in range(20))] * 2)]
    spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, ids string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for d, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((d, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    got = [tuple(r) for r in queries.op6_bpe(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    ids = spark.createDataFrame([(1, None), (2, []), (3, [464, 3797])], "i int, ids array<int>")
    assert [r.bytes for r in bpe.decode(ids, PATH).orderBy("i").collect()] == [None, b"", b"The cat"]
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert bpe.decode(bpe.encode(empty, PATH, P.PATTERN), PATH).collect() == []
