from __future__ import annotations

import random
import re

import numpy as np

from passagekit.llm import decontaminate as D
from passagekit.llm import words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(text):
    return WORD.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))


def brute(text, items):
    """(words, hit positions, item ids) by comparing every window with every place."""
    w, hit, ids = tokens(text), set(), set()
    for item, t in items:
        v = tokens(t)
        k = min(10, len(v))
        for q in range(len(v) - k + 1 if v else 0):
            for p in range(len(w) - k + 1):
                if w[p : p + k] == v[q : q + k]:
                    hit |= {*range(p, p + k)}
                    ids.add("" if item is None else str(item))
    return len(w), sorted(hit), sorted(ids)


def case(seed, n=60):
    """Texts over few words, so that windows repeat and nearly match."""
    rng = random.Random(seed)
    vocab = ["a", "B", "é", "9", "zz", "Ünder", "x1"]
    say = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    items = [(i if i else None, say(rng.choice([1, 4, 9, 10, 11, 25, 60]) if i % 5 else 40)) for i in range(8)] + [(3, None), (90, "...")]
    items = [(i, t) for i, t in items if t is None or len(tokens(t)) != 1 or i == 90]
    docs = [None, "", "!!", "Ab, cD"]
    for _ in range(n):
        words_ = []
        for _ in range(rng.randrange(1, 4)):
            words_ += say(rng.randrange(20)).split()
            v = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(v) + 1)
            words_ += v[a : a + rng.choice([8, 9, 10, 12, 40])]
        docs.append("-- ".join(words_))
    return items, docs


def test_windows_of_few_words_against_brute_force():
    for seed in range(6):
        items, docs = case(seed)
        index = D.Index(["" if i is None else str(i) for i, _ in items], [t for _, t in items])
        numbers, counts = words.split(docs, words.alphanumeric())
        hit, pairs = index.hits(numbers, counts)
        ends = np.cumsum(counts)
        for d, text in enumerate(docs):
            n, want, ids = brute(text, items)
            assert counts[d] == n
            assert np.flatnonzero(hit[ends[d] - n : ends[d]]).tolist() == want
            assert sorted({index.ids[p % len(index.ids)] for p in pairs if p // len(index.ids) == d}) == ids


def test_winnowing_keeps_a_hash_in_every_window():
    rng = np.random.default_rng(0)
    hashes = rng.integers(0, 20, 500).astype(np.uint64)
    kept = D.winnow(hashes, 6)
    for at in range(len(hashes) - 5):
        window = hashes[at : at + 6]
        assert at + 5 - int(np.argmin(window[::-1])) in kept


def test_words_match_the_pattern():
    texts = ["Ab\x00c d", "É x", "a" * 5000 + " b", "", None, "0:9@Z[`a{z", "漢字 kanji"]
    numbers, counts = words.split(texts, words.alphanumeric())
    assert counts.tolist() == [len(tokens(t)) for t in texts]
    flat = [w for t in texts for w in tokens(t)]
    assert len(set(numbers.tolist())) == len(set(flat))
    spaced = words.split(texts, words.spaces_apart())[1].tolist()
    assert spaced == [len((t or "").encode().split()) for t in texts]


def test_operator_by_index_and_by_join(spark):
    items, docs = case(11, 40)
    rows = [(i if i else None, t, 7) for i, t in enumerate(docs)] * 2
    table = spark.createDataFrame(rows, "doc_id bigint, text string, items int")
    tests = spark.createDataFrame(items, "item_id bigint, text string")
    for size in (D.BLOCK_CHARS, 60):
        got = D.contamination(table, tests, block_chars=size).collect()
        assert len(got) == len(rows)
        for r in got:
            n, want, ids = brute(r.text, items)
            assert (r.n_words, [p for h in r.hits for p in range(h.start, h.stop)], r.items) == (n, want, ids)
    for size in (D.BLOCK_CHARS, -1):
        none = D.contamination(table, tests.where("item_id = -1"), block_chars=size).collect()
        assert len(none) == len(rows) and all(r.hits == [] and r.items == [] for r in none)
        assert D.contamination(table.where("doc_id < -1"), tests, block_chars=size).collect() == []


def test_join_sends_a_share_of_the_kept_hashes(spark):
    """Of texts that share nothing with the test set hardly a hash gets past the bit table."""
    rng = random.Random(5)
    say = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    tests = spark.createDataFrame([(str(i), say(30)) for i in range(50)], "item string, text string")
    texts = spark.createDataFrame([(bytes([i]), say(500)) for i in range(40)], "key binary, text string")
    kept = D._item_rows(tests)
    assert {r.kind for r in kept.collect()} == {D.K}
    assert D._text_rows(texts, [D.K], D._bits(kept)).count() < 10
