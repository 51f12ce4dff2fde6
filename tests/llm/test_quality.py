from __future__ import annotations

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from passagekit.llm import quality as Q
from passagekit.llm import queries
from passagekit.llm.common import remainder


def plain(net, text):
    """Every window of every chunk, one at a time."""
    data = text.encode()
    chunks = max(1, -(-len(data) // Q.STRIDE))
    data = data + b"\0" * (chunks * Q.STRIDE + Q.WIDTH - len(data))
    z = []
    for c in range(chunks):
        best = np.full(Q.FILTERS, -np.inf)
        for at in range(c * Q.STRIDE, (c + 1) * Q.STRIDE):
            window = np.concatenate([net.embed[b] for b in data[at : at + Q.WIDTH]])
            best = np.maximum(best, window @ net.filters)
        z.append(np.maximum(best + net.shift, 0))
    z = np.array(z)
    x = np.concatenate((z.mean(0), z.max(0), z.min(0)))
    return 1 / (1 + np.exp(-(x @ net.head + net.bias[0])))


def test_scores_cover_the_whole_text(monkeypatch):
    monkeypatch.setattr(Q, "SLAB", 2)
    net, rng = Q.Network.new(3), random.Random(1)
    texts = ["", "a", "é" * Q.STRIDE, *("".join(rng.choice("abé !X") for _ in range(n)) for n in (1, Q.STRIDE - 1, Q.STRIDE, Q.STRIDE + 1, 5 * Q.STRIDE + 9))]
    np.testing.assert_allclose(Q.score(net, [None, *texts]), [plain(net, t) for t in ["", *texts]], rtol=1e-4)


def test_gradients_are_those_of_the_loss():
    net, rng = Q.Network.new(5), np.random.default_rng(0)
    for p in net.params():
        p[...] = rng.normal(0, 0.4, p.shape)
    texts, y = [bytes(rng.integers(97, 122, n).astype(np.uint8)) for n in (30, 300, 700)], np.array([1.0, 0.0, 1.0], np.float32)
    _, grads = Q.gradients(net, texts, y)
    for p, g in zip(net.params(), grads, strict=True):
        for i in rng.choice(p.size, min(p.size, 12), replace=False):
            i = np.unravel_index(i, p.shape)
            was, step = p[i], np.float32(2e-3)
            p[i] = was + step
            up = Q.gradients(net, texts, y)[0]
            p[i] = was - step
            down = Q.gradients(net, texts, y)[0]
            p[i] = was
            assert abs((up - down) / (2 * step) - g[i]) < 5e-3


def test_query_learns_and_generalises(spark, tmp_path):
    rng = random.Random(2)
    say = lambda n: " ".join("".join(rng.choice("aeiorstln") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    docs, labels = [], []
    for i in range(400):
        good, text = rng.random() < 0.6, say(rng.randrange(10, 200))
        if not good:
            words = text.split()
            at = rng.randrange(len(words))
            text = " ".join([*words[:at], *(w + "***" for w in words[at:])])
        docs.append((i, text, "x"))
        if i % 4:
            labels.append((i, int(good), 0))
    docs += [(1000, None, "x"), (1001, "", "x"), (None, "aa bb", "x"), docs[7]]
    labels += [labels[3], (5000, 1, 0), (6000, None, 0)]
    spark.createDataFrame(docs, "doc_id bigint, text string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op9_bytes(spark, str(tmp_path)).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    net = Q.learn(*(spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels")), ~held_out)
    text = {i: t for i, t, _ in docs}
    some = got[::40] + [r for r in got if r.doc_id is None or r.doc_id >= 1000]
    np.testing.assert_allclose([r.score for r in some], [plain(net, text[r.doc_id] or "") for r in some], atol=2e-4)
    good = {i: "***" not in t for i, t, _ in docs if i is not None and t}
    assert np.mean([r.predicted == good[r.doc_id] for r in held]) > 0.95
    assert Q.classify(spark.createDataFrame([], "doc_id bigint, text string"), Q.train([], [])).collect() == []
    assert Q.score(Q.train(["a", "b"], [1, 1]), ["zz", None]).min() > 0.5
