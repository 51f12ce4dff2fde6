from __future__ import annotations

import random

import public_tokenizers as P
import sentencepiece

from passagekit.llm import token_counts as T

PATH = P.path("piece_bpe_32k.model")
ALPHABET = ["a", "the", "ing", " ", "  ", "▁", "\n", "\t", "\r", "é", "漢", "7", "!", "<s>", "</s>", "<0x41>", "\x00", "x" * 9, "😀", ".", " "]


def texts(seed, n=300):
    rng = random.Random(seed)
    return [None, "", " ", "▁", "\n", "a" * 5000, *("".join(rng.choice(ALPHABET) for _ in range(rng.randrange(50))) for _ in range(n))]


def test_pre_tokens_add_up_to_the_library():
    model, library = T.pieces(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    for text in texts(4, 1500):
        assert sum(model.counts(model.pre_tokens(text))) == len(library.encode(text or ""))


def test_counts_with_and_without_a_shuffled_rest(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = [(i % 50 if i else None, t) for i, t in enumerate(texts(6))] * 2
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id bigint, text string, n int")
    want = sorted([(d, len((t or "").encode()), len(library.encode(t or ""))) for d, t in rows], key=str)
    for head in (0, 20, 1 << 20):
        got = T.count_tokens(docs, PATH, head=head).collect()
        assert sorted(map(tuple, got), key=str) == want


def test_empty_table(spark):
    assert T.count_tokens(spark.createDataFrame([], "doc_id bigint, text string"), PATH).collect() == []
