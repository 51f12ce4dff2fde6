from __future__ import annotations

import itertools
import math
import random

import numpy as np
import public_tokenizers as P
import pytest

from passagekit.llm import langid as L
from passagekit.llm import queries

PIECES = ["▁", "a", "b", "ab", "ba", "▁a", "▁ab", "bb", "aba"]


def cuts(word):
    """Every way to cut the marked word."""
    s = L.MARK + word
    for bars in itertools.product([0, 1], repeat=len(s) - 1):
        out, last = [], 0
        for i, bar in enumerate(bars, 1):
            if bar:
                out.append(s[last:i])
                last = i
        yield [*out, s[last:]]


def probability(cut, p):
    """A one-character piece may also be the character as such."""
    return math.prod(p.get(x, 0.0) + (L.FLOOR if len(x) == 1 else 0.0) for x in cut)


def test_forward_sums_all_segmentations_and_backward_their_uses():
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.ones(len(PIECES)), 2).T
    matcher, found = L.Matcher(PIECES), ["", "a", "abab", "bbaab", "xaby", "zz"]
    match = matcher.find(found)
    a = L.forward(*match, matcher.size, p)
    uses = L.expectation(*match, matcher.size, p[:, 0], np.arange(1.0, len(found) + 1))
    want = np.zeros(len(PIECES))
    for i, w in enumerate(found):
        for lang in range(2):
            table = dict(zip(PIECES, p[:, lang], strict=True))
            assert a[i, len(w) + 1, lang] == pytest.approx(sum(probability(c, table) for c in cuts(w)), rel=1e-12)
        table = dict(zip(PIECES, p[:, 0], strict=True))
        total = sum(probability(c, table) for c in cuts(w))
        for c in cuts(w):
            for j, x in enumerate(c):
                if x in table:
                    rest = probability(c[:j], table) * table[x] * probability(c[j + 1 :], table)
                    want[PIECES.index(x)] += (i + 1) * rest / total
    np.testing.assert_allclose(uses, want, rtol=1e-9)


def test_learning_raises_the_likelihood():
    words = {"abab": 5, "ba": 9, "bbb": 2, "aba": 4}
    matcher, last = L.Matcher(PIECES), -1e9
    for rounds in range(1, 6):
        m = L.fit({"x": words}, PIECES, {}, rounds)
        p = np.array([m.p[m.pieces.index(q), 0] if q in m.pieces else 0.0 for q in PIECES])[:, None]
        match = matcher.find(list(words))
        a = L.forward(*match, matcher.size, p)[np.arange(len(words)), match[0], 0]
        now = float(np.log(a) @ np.array(list(words.values())))
        assert now > last - 0.05
        last = now


def test_words():
    assert L.words_of(None) == L.words_of("12 -- ² _") == []
    assert L.words_of("Ab1c É\n" + "x" * 70) == ["ab", "c", "é", "x" * 70]
    assert L.words_of("हिन्दी भाषा 12 é") == ["हिन्दी", "भाषा", "é"] and L.words_of("\u0301 12") == []


def test_whole_words_of_any_length(monkeypatch):
    """The scaled sums agree with the plain ones, and go on from slab to slab."""
    rng = np.random.default_rng(2)
    p = rng.dirichlet(np.ones(len(PIECES)), 2).T
    matcher = L.Matcher(PIECES)
    found = ["", "a", "abab", "zz", "".join(rng.choice(list("abx"), 90)), "".join(rng.choice(list("ab"), 61)), "ba"]
    match = matcher.find(found)
    want = np.log(L.forward(*match, matcher.size, p)[np.arange(len(found)), match[0]])
    for slab in (1 << 16, 7, 200):
        monkeypatch.setattr(L, "SLAB", slab)
        np.testing.assert_allclose(L.log_sums(matcher, found, p), want, rtol=1e-9)
    long = L.log_sums(matcher, ["ab" * 4000], p)
    assert np.isfinite(long).all() and (long < -300).all()


def test_query_against_a_plain_scorer(spark):
    """Every score again, from the fitted model by a dictionary of pieces and a sum over cuts."""
    rng = random.Random(8)
    say = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 9)))
    texts = [say("ab") for _ in range(20)] + [say("bxy") for _ in range(20)] + [None, "12", "ab" * 40]
    model = L.fit({"l": {"ab": 4, "bab": 2}, "m": {"bxy": 3, "xb": 4}}, PIECES, {"l": 3.0, "m": 1.0})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(docs, model).collect()}

    def total(word, k):
        s, sums = L.MARK + word, [1.0]
        table = {q: model.p[i, k] for i, q in enumerate(model.pieces)}
        for i in range(1, len(s) + 1):
            sums.append(sums[-1] * L.FLOOR + sum(sums[j] * table.get(s[j:i], 0.0) for j in range(i)))
        return math.log(sums[-1])

    for i, text in enumerate(texts):
        ws = L.words_of(text)
        logs = [model.prior[k] + sum(total(w, k) for w in ws) for k in range(2)]
        best = 0 if logs[0] >= logs[1] else 1
        assert got[i][0] == (model.languages[best] if ws else "und")
        assert got[i][1] == pytest.approx(1 / sum(math.exp(x - logs[best]) for x in logs) if ws else 0.0, abs=1e-4)


def test_query_on_invented_languages(spark, tmp_path):
    rng = random.Random(3)
    rules = {"aa": ["ka", "to", "ri"], "bb": ["schu", "eng", "ber"], "cc": ["eau", "oui", "tré"]}
    say = lambda lang, n: " ".join("".join(rng.choice(rules[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = []
    for i in range(300):
        lang = rng.choice(list(rules))
        rows.append((i, say(lang, rng.randrange(3, 40)), lang if i % 11 else None, lang))
    rows += [(900, None, "aa", "und"), (901, "", None, "und"), (902, "12 !?", "bb", "und"), (None, "kato rika tori", "aa", "aa"), (5, rows[5][1], rows[5][2], rows[5][3])]
    rows.append((903, "schueng " * 20000, None, "bb"))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, truth string").write.parquet(f"{tmp_path}/documents.parquet")
    truth = {}
    for d, _, _, t in rows:
        truth.setdefault(d, t)
    got = queries.op1_segmentation(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    import zlib

    for r in got:
        assert r.lang_pred == truth[r.doc_id] and 0 <= r.score <= 1
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string")
    assert L.identify(empty, L.fit({}, [], {})).collect() == []


def test_public_vocabulary():
    pieces = L.public_pieces(P.path("piece_bpe_32k.model"))
    assert len(pieces) > 10_000 and "▁the" in pieces and all(p == p.lower() for p in pieces)
