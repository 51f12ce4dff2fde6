from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers as P
import sentencepiece
from tokenizers import Tokenizer

from passagekit.llm import alignment as A

PATH_A, PATH_B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ALPHABET = [
    "a", "the", "ing", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "é", "漢字", "7", "123", "!", "...", "'s", "<s>", "</s>",
    "<0x41>", "<|endoftext|>", "\x00", "😀", "x" * 9, "᠎", "ing the ",
]


def texts(seed, n):
    rng = random.Random(seed)
    some = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(40))) for _ in range(n)]
    return [None, "", " ", "▁", "a ▁b", "\n", "the " * 300, *some]


def plain(texts):
    """The contract by definition, whole texts through both libraries."""
    a, b = Tokenizer.from_file(PATH_A), sentencepiece.SentencePieceProcessor(model_file=PATH_B)
    a.encode_special_tokens = True
    letters, documents, counts = A.byte_characters(), [], Counter()
    for text in texts:
        whole, groups, links = (" " + (text or "")).encode(), [], []
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, map(b.id_to_piece, ids_b), strict=True)]
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            ids_a, ids_b = [], []
        end_a, end_b, at, ends = 0, 0, {}, {}
        for i, x in zip(ids_b, bytes_b, strict=False):
            end_b += len(x)
            at[end_b] = i
        for i, x in zip(ids_a, bytes_a, strict=False):
            end_a += len(x)
            ends[end_a] = i
        if ids_a:
            last, common = 0, sorted(set(at) & set(ends))
            for end in common:
                links.append((ends[end], at[end]))
                left = ",".join(str(ends[e]) for e in sorted(ends) if last < e <= end)
                groups.append(left + "|" + ",".join(str(at[e]) for e in sorted(at) if last < e <= end))
                last = end
        counts.update(links)
        documents.append((len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if ids_a else ""))
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return [(x, y, g, len(k), sum(counts[p] == top[p[1]] for p in k), sum(counts[p] for p in k), sha) for x, y, g, k, sha in documents]


def test_against_whole_texts(spark):
    odd = texts(1, 400)
    docs = spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(odd)], "doc_id bigint, text string, n_a int").repartition(3)
    want = sorted(((i if i else None, *r) for i, r in enumerate(plain(odd))), key=str)
    assert sorted(map(tuple, A.align(docs, PATH_A, PATH_B).collect()), key=str) == want


def test_many_blocks_and_parts(spark, monkeypatch):
    """Small blocks, and shares that are split by block, give the same counts."""
    monkeypatch.setattr(A, "ROWS", 16)
    odd = texts(2, 150) * 2
    docs = spark.createDataFrame([(i % 90, t) for i, t in enumerate(odd)], "doc_id int, text string").repartition(2)
    want = sorted(((i % 90, *r) for i, r in enumerate(plain(odd))), key=str)
    assert sorted(map(tuple, A.align(docs, PATH_A, PATH_B, shares=3, blocks=4).collect()), key=str) == want


def test_a_memory_that_starts_anew(monkeypatch):
    monkeypatch.setattr(A, "MEMO", 2)
    odd, tokens = texts(3, 60), A.Pair(PATH_A, PATH_B)
    want = plain(odd)
    for at in range(0, len(odd), 7):
        (a, b, groups), digests, _ = A.block(tokens, odd[at : at + 7])
        assert list(zip(a, b, groups, digests, strict=True)) == [(r[0], r[1], r[2], r[6]) for r in want[at : at + 7]]


def test_stretches_end_where_both_begin_anew():
    tokens = A.pair(PATH_A, PATH_B)
    assert tokens.stretches(" a b  c\nd\xa0e  ") == [" a", " b", "  c", "\nd\xa0e", "  "]
    long = " " + "漢" * 3000 + " x"
    assert "".join(tokens.stretches(long)) == long


def test_empty_table(spark):
    assert A.align(spark.createDataFrame([], "doc_id bigint, text string"), PATH_A, PATH_B).collect() == []
