from __future__ import annotations

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline as C
from passagekit.llm import bpe, langid, quality
from passagekit.llm.common import remainder, stored
from tests.llm.test_decontaminate import brute as windows
from tests.llm.test_near import brute as linked

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, items string, fp string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, path = random.Random(9), str(tmp_path_factory.mktemp("sf"))
    rules = {"aa": ["ka", "to", "ri", "mo"], "bb": ["schu", "eng", "ber", "pfl"]}
    say = lambda lang, n: [("".join(rng.choice(rules[lang]) for _ in range(rng.randrange(1, 5)))) for _ in range(n)]
    items = [(i, " ".join(say("aa", 30))) for i in range(5)]
    docs, labels = [], []
    for i in range(260):
        lang = rng.choice(list(rules))
        words = say(lang, rng.randrange(30, 90))
        good = rng.random() < 0.7
        if i % 13 == 0:
            words[5:5] = items[i % 5][1].split()[4 : 4 + rng.choice([9, 14])]
        if not good:
            words = [w + "***" for w in words]
        docs.append((i, " ".join(words), lang))
        labels.append((i, int(good), 0))
        if i % 10 == 0:
            docs.append((1000 + i, " ".join(words), lang))
            docs.append((2000 + i, " ".join([*words[:-1], "other"]), lang))
    docs += [(5000, None, "aa"), (5001, "", "bb"), (5002, "12 ***", None), (None, docs[3][1], "aa"), docs[8], (5003, "kato " * 30_000, None)]
    rows = [(d, t, lang, "s", None if t is None else len(t), 0.5, "x", None) for d, t, lang in docs]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, items


def test_stages_against_plain_versions(spark, folder):
    path, items = folder
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert 4 <= len(C.STAGES) <= 5
    for name, stage in C.STAGES[:-1]:
        before = [tuple(r) for r in docs.collect()]
        out = stored(stage(spark, docs, path))
        assert out.columns == docs.columns
        got = sorted((tuple(r) for r in out.collect()), key=str)
        if name == "language_id":
            want = [r for r in before if langid.words_of(r[1])]
        elif name == "quality":
            net = quality.learn(docs, spark.read.parquet(f"{path}/labels.parquet"), F.coalesce(remainder("doc_id", 5) != 0, F.lit(True)))
            want = [r for r, s in zip(before, quality.score(net, [r[1] for r in before]), strict=True) if s >= C.QUALITY]
            assert not any("***" in r[1] for r in got) and len(got) > 150
        elif name == "near_dedup":
            order = sorted(range(len(before)), key=lambda i: (before[i][0] is not None, before[i][0] or 0))
            rows = [before[i] for i in order]
            root = linked([r[1] for r in rows])
            want = [r for i, r in enumerate(rows) if root[i] == i]
            assert len(want) < len(rows)
        else:
            want = [r for r in before if not windows(r[1], items)[1]]
            assert 0 < len(before) - len(want) < len(before) / 4
        assert got == sorted(want, key=str), name
        docs = out
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.vocabulary(P.path("byte_bpe_50k.tiktoken")).rank, special_tokens={})
    want = []
    for r in docs.collect():
        ids = library.encode_ordinary(r.text)
        want.append((r.doc_id, len(ids), ids, hashlib.sha256(r.text.encode()).hexdigest()))
    got = [tuple(r) for r in C.STAGES[-1][1](spark, docs, path).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sorted((tuple(r) for r in C.run(spark, path).collect()), key=str) == sorted(want, key=str)


def test_stages_on_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").where("doc_id < -5")
    for _, stage in C.STAGES:
        assert stage(spark, docs, folder[0]).collect() == []
