from __future__ import annotations

import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from passagekit.llm import queries
from passagekit.llm import toxicity as T
from passagekit.llm.common import remainder


def posterior(m, row):
    """Bayes by hand, a voter at a time."""
    odds = np.log(m.prior / (1 - m.prior))
    for (p0, p1), share, vote in zip(m.rate, m.share, row, strict=True):
        odds += share * (np.log(p1 / p0) if vote else np.log((1 - p1) / (1 - p0)))
    return 1 / (1 + np.exp(-odds))


def plain(m, text):
    """A text's score from the model's weights, word by word and stem by stem."""
    ws, x, seen = re.findall(r"[^\W\d_]+", (text or "").lower()), m.bias, set()
    for w in ws:
        seen |= {w + "$", *(w[:n] for n in T.STEMS if n < len(w))}
    for t in seen:
        x += m.weights.get(t, 0.0)
    for w, (_, fires) in zip(m.patterns, T.PATTERNS, strict=True):
        x += w * bool(fires(text or "", ws))
    return 1 / (1 + np.exp(-x))


def test_label_model_finds_rates_and_dependence_without_labels():
    rng = np.random.default_rng(1)
    y = rng.random(6000) < 0.2
    truth = np.array([[0.02, 0.5], [0.05, 0.6], [0.01, 0.4], [0.03, 0.5], [0.9, 0.1]])
    votes = (rng.random((len(y), 5)) < truth[:, y.astype(int)].T).astype(np.uint8)
    votes = np.concatenate((votes, votes[:, :1], rng.random((len(y), 1)) < 0.1), axis=1)  # a copy and a coin
    starts = np.array([[0.05, 0.3]] * 4 + [[0.8, 0.3], [0.05, 0.3], [0.1, 0.1]])
    m = T.label_model(votes, starts, 0.1)
    np.testing.assert_allclose(m.rate[:5], truth, atol=0.06)
    assert abs(m.prior - 0.2) < 0.04
    assert max(m.share[0], m.share[5]) < 0.75 < min(m.share[[1, 2, 3, 6]])
    assert np.mean((m.posterior(votes) > 0.5) == y) > 0.9
    np.testing.assert_allclose(m.posterior(votes[:50].astype(float)), [posterior(m, v) for v in votes[:50]], rtol=1e-6)
    assert m.accuracy[0] > 0.75 > m.accuracy[6]


def test_terms():
    assert T.terms({"abc", "abcdefgh"}) == {"abc$", "abcdefgh$", "abcd", "abcde", "abcdef"}


def test_query_learns_words_and_stems_and_generalises(spark, tmp_path):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("aeiourstlnmdk") for _ in range(rng.randrange(2, 9)))
    docs, labels, truth = [], [], {}
    for i in range(900):
        bad, words = rng.random() < 0.25, [word() for _ in range(rng.randrange(5, 120))]
        if bad:
            for _ in range(rng.randrange(1, 3)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(["Grubwort", "FLUGZ", "quibbo" + word()]))
        docs.append((i, " ".join(words), "x"))
        truth[i] = int(bad)
        if i % 3:
            labels.append((i, 1, int(bad)))
    docs += [(2000, None, "x"), (2001, "", "x"), (2002, "!?", "x"), (None, "grubwort grubwort", "x"), docs[3], (2003, "grubwort " + "word " * 50_000, "x")]
    labels += [labels[0], (7777, 1, 1), (8888, 1, None)]
    spark.createDataFrame(docs, "doc_id bigint, text string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op2_supervision(spark, str(tmp_path)).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    m = T.learn(*(spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels")), ~held_out)
    text = {i: t for i, t, _ in docs}
    np.testing.assert_allclose([r.score for r in got], [plain(m, text[r.doc_id]) for r in got], rtol=1e-6, atol=1e-9)
    by = {r.doc_id: r.predicted for r in got}
    assert (by[2000], by[2001], by[None], by[2003]) == (0, 0, 1, 1)


def test_no_labels_and_no_rows(spark):
    m = T.fit([], [])
    assert m.score("a") == 0.5 and T.fit(["a", "b"], [0, 0]).score(None) < 0.5
    assert T.score(spark.createDataFrame([], "doc_id bigint, text string"), m).collect() == []
