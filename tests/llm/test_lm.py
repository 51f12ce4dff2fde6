from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from passagekit.llm import lm, queries

KIND = "CASE WHEN k = 0 THEN 0 WHEN k = 1 THEN 1 ELSE 2 END"


def split(text):
    low = "".join(c.lower() if c < "\x80" else c for c in text or "")
    return [w.decode() for w in low.encode().split()] + [None]


def brute(rows, model):
    """Scores from dictionaries of counts, with the model's weights."""
    one, two = Counter(), Counter()
    for _, text, k in rows:
        if k:
            ws = split(text)
            one.update(ws)
            two.update(zip(["<start>", *ws[:-1]], ws, strict=True))
            one["<start>"] += 1
    n, v = sum(c for w, c in one.items() if w != "<start>"), len(one) - ("<start>" in one)
    out = []
    for d, text, _ in rows:
        ws, base, score = split(text), 0.0, 0.0
        for h, w in zip(["<start>", *ws[:-1]], ws, strict=True):
            c = one[h]
            b = 1 + int(math.log2(c)) if c else 0
            l2, l1, l0 = model.weights[b]
            score += math.log10(l2 * two[h, w] / max(c, 1) + l1 * one[w] / max(n, 1) + l0 / (v + 1))
            base += math.log10((one[w] + 0.1) / (n + 0.1 * (v + 1)))
        out.append((d, len(ws), sum(one[w] > 0 for w in ws), n, base, score))
    return out


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    vocab = ["a", "B", "é", "the", "\x00x", "q\x0bz", *(f"w{i}" for i in range(60))]
    rows = [(None, None, 2), (1, "", 0), (1, "  ", 1), (2, "a " * 900, 2)]
    for i in range(n):
        words = [rng.choice(vocab)]
        while len(words) < rng.randrange(1, 60):
            words.append(words[-1] + "x" if rng.random() < 0.4 else rng.choice(vocab))
        rows.append((i % 80, " ".join(words), rng.randrange(5)))
    return rows


@pytest.mark.parametrize("sizes", [(1 << 20, 1 << 20, 512, 8), (700, 300, 512, 8), (300, 300, 4, 2), (300, 1 << 20, 6, 3)])
def test_scores_match_counting_by_hand(spark, sizes):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, k int, score string").repartition(3)
    from pyspark.sql import functions as F

    out, model = lm.score(docs, F.expr(KIND), block_bytes=sizes[0], shard_tokens=sizes[1], fan=sizes[2], cut_bits=sizes[3])
    got = sorted([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in out.collect()], key=str)
    want = sorted(brute(rows, model), key=str)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    np.testing.assert_allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-9)


def test_weights_follow_the_evidence():
    """Contexts of one bucket foretell the next word, those of the other don't."""
    w = lm.interpolate([3, 4], [80, -(1 << 20)], [8, 8], [1000, 1000])
    assert w[3, 0] > 0.95 and w[4, 0] < 0.01 and w[0, 0] == 0
    assert np.allclose(w.sum(1), 1)
    assert np.allclose(lm.interpolate([], [], [], []).sum(1), 1)


def test_interpolation_beats_the_base_on_held_out_text(spark, tmp_path):
    rng = random.Random(4)
    follow = {f"w{i}": [f"w{rng.randrange(300)}" for _ in range(3)] for i in range(300)}
    rows = []
    for i in range(400):
        words = [f"w{rng.randrange(300)}"]
        while len(words) < 60:
            words.append(rng.choice(follow[words[-1]]))
        rows.append((i, " ".join(words)))
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    held = [r for r in queries.op10_interpolation(spark, str(tmp_path)).collect() if r.held_out]
    assert held and np.mean([r.score / r.n_tokens for r in held]) > np.mean([r.base_score / r.n_tokens for r in held]) + 0.8


def test_empty_and_untrained(spark):
    from pyspark.sql import functions as F

    none = spark.createDataFrame([], "doc_id bigint, text string, k int")
    assert lm.score(none, F.expr(KIND))[0].collect() == []
    only = spark.createDataFrame([(1, "a b", 0)], "doc_id bigint, text string, k int")
    r = lm.score(only, F.expr(KIND))[0].first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and r.score <= 0


def test_packing_round_trip():
    for values in (np.array([], np.uint64), np.array([0, 5, 2**63, 2**64 - 1], np.uint64)):
        assert lm._unpack(lm._pack(values)).tolist() == values.tolist()
        assert lm._unpack_sorted(lm._pack_sorted(values)).tolist() == values.tolist()
