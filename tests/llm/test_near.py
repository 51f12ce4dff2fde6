from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline as C
from passagekit.llm import simhash as S

COLUMNS = "doc_id bigint, text string, lang string"


def grams(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def brute(texts):
    """Least position reachable, over all pairs of five-word similarity 0.8 or more."""
    sets, root = [grams(t or "") for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and alike(sets[i], sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def case(seed, groups):
    rng = random.Random(seed)
    vocab, texts = [f"w{i}" for i in range(500)], []
    for _ in range(groups):
        words = [rng.choice(vocab) for _ in range(rng.choice([4, 60, 100, 300]))]
        texts.append(" ".join(words))
        for _ in range(6):
            words = list(words)
            for _ in range(rng.choice([1, 1, 2, 8])):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            texts.append(" ".join(words))
    return texts + [texts[3], texts[9].upper(), "one", "one", "one two"]


def test_stage_keeps_the_least_of_each_group(spark):
    texts = case(5, 40)
    rows = [(i * 2, t, "x") for i, t in enumerate(texts)] + [(None, texts[0], "y"), (2, texts[1], "z")]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    root = brute([t for _, t, _ in order])
    want = [r for i, r in enumerate(order) if root[i] == i]
    docs = spark.createDataFrame(rows, COLUMNS).coalesce(1)
    got = [tuple(r) for r in C.near_dedup(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert 60 < len(want) < len(rows) - 60


def test_similarity_is_exact_at_the_bound():
    words = [f"w{i}" for i in range(60)]
    sets = [S.shingles([w.encode() for w in words[:n]], 5) for n in (60, 49, 48)]
    assert [len(s) for s in sets] == [56, 45, 44]
    alike = lambda a, b: S.similar(a.tobytes(), b.tobytes(), S.SIMILARITY)
    assert alike(sets[0], sets[1]) and not alike(sets[0], sets[2])


def test_wide_fingerprint_matches_plain():
    for n in (1, 4, 60, 3 * S.PIECE // 2):
        of = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64))
        for w, got in enumerate(S.wide(of)):
            hashes = S._mixed(of + np.uint64((w + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            want = sum(1 << b for b in range(64) if 2 * int((hashes >> np.uint64(b) & np.uint64(1)).sum()) > n)
            assert got & (1 << 64) - 1 == want


@pytest.mark.parametrize("leaf_most, cell", [(1 << 14, 1024), (40, 20)])
def test_recall_of_small_leaves(spark, leaf_most, cell):
    """Pairs just above the bound among many other texts, with leaves far smaller than the
    table; a group of copies larger than a leaf may hold."""
    rng = random.Random(1)
    rows, pairs = [], 300
    for i in range(pairs):
        words = [f"w{rng.randrange(1 << 40)}" for _ in range(64)]
        rows += [" ".join(words), " ".join(words[:53])]
    base = [f"w{rng.randrange(1 << 40)}" for _ in range(200)]
    for i in range(150):
        rows.append(" ".join([*base[: i + 1], "x", *base[i + 2 :]]))
    rows += [" ".join(f"w{rng.randrange(1 << 40)}" for _ in range(30)) for _ in range(1500)]
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(rows)], "doc_id bigint, n bigint, text string")
    gone = [r.n for r in S.later_of_groups(docs, "n", leaf=24, leaf_most=leaf_most, cell=cell).collect()]
    kept = set(range(len(rows))) - set(gone)
    assert len(gone) == len(set(gone))
    assert all(2 * i in kept for i in range(pairs))
    assert sum(2 * i + 1 not in kept for i in range(pairs)) >= 0.98 * pairs
    assert kept & set(range(2 * pairs, 2 * pairs + 150)) == {2 * pairs}
    assert len(kept) <= 1.02 * pairs + 1 + 1500 and set(range(2 * pairs + 150, len(rows))) <= kept


def test_rows_against_all_pairs():
    rng = np.random.default_rng(4)
    sets = [np.zeros(0, np.uint64)]
    for _ in range(20):
        own = rng.integers(0, 1 << 63, int(rng.integers(1, 40)), dtype=np.uint64)
        for _ in range(4):
            sets.append(np.unique(np.where(rng.random(len(own)) < 0.05, rng.integers(0, 1 << 63, len(own), dtype=np.uint64), own)))
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i]) and len(sets[j]) and S.similar(sets[i].tobytes(), sets[j].tobytes(), S.SIMILARITY):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert S.similar_rows(sets, np.arange(len(sets))).tolist() == root and len(set(root)) < len(root) - 15
