from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest

from passagekit.llm import imatch as M

DOCS = "doc_id bigint, text string"


def terms(text):
    return {t for t in re.split(M.SEPARATORS, text.lower()) if t}


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def signature(text, lexicon):
    kept = sorted(terms(text) & lexicon, key=lambda t: t.encode())
    out = [md5(" ".join(kept))[:6] if kept else md5("=" + text)[:6]]
    for seed in range(M.SEEDS):
        for bound in M.BOUNDS:
            part = [t for t in kept if md5(t)[3 * seed : 3 * seed + 3] < bound]
            out.append(md5(" ".join(part))[:6] if part else "-")
    return out


def likeness(a, b):
    used = [(x, y) for x, y in zip(a, b, strict=True) if (x, y) != ("-", "-")]
    return sum(x == y for x, y in used) / len(used)


def brute(rows, low, high):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    df, once = {}, {t for _, t in rows}
    for t in once:
        for x in terms(t):
            df[x] = df.get(x, 0) + 1
    lexicon = {t for t, n in df.items() if low * len(once) <= n <= high * len(once)}
    out = []
    for (d, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        m = len(t) // 2
        edited = t[: len(t) - m] + after[:m]
        a, b, c = (signature(x, lexicon) for x in (t, edited, after))
        out.append((d, len(t), edited, ":".join(a), ":".join(b), round(likeness(a, b), 9), round(likeness(a, c), 9)))
    return sorted(out, key=str)


def case(seed, n=60):
    rng = random.Random(seed)
    vocab = [f"t{i}" for i in range(80)] + ["É", "über", "漢字", "😀"]
    ids = rng.sample(range(-50, 5000), n)
    rows = [(i, " ".join(rng.choice(vocab).upper() + rng.choice(["", ",", "\n"]) for _ in range(rng.randrange(40)))) for i in ids]
    return rows + [(None, "null id"), (None, "another null"), (ids[3], rows[3][1]), (ids[4], "same id"), (9000, None), (9001, ""), (9002, "?!"), (9003, "long " * 4000)]


@pytest.mark.parametrize(("chars", "outer"), [(1 << 20, 1024), (300, 1024), (300, 3), (40, 1)])
def test_against_brute_force(spark, chars, outer):
    rows = case(chars)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS + ", edited string, range int").repartition(3)
    got = M.fingerprints(docs, low=0.05, high=0.6, range_chars=chars, outer=outer).collect()
    got = sorted(((*r[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in got), key=str)
    assert got == brute(rows, 0.05, 0.6)


def test_one_row_and_none(spark):
    for text in (None, "", "x y z w"):
        r = M.fingerprints(spark.createDataFrame([(7, text)], DOCS)).first()
        assert (r.n_chars, r.near_next) == (len(text or ""), 1.0)
    assert M.fingerprints(spark.createDataFrame([], DOCS)).collect() == []
    many = spark.createDataFrame([(1, "a b c d")] * 40, DOCS)
    assert {(r.edited, r.near_next) for r in M.fingerprints(many).collect()} == {("a b a b", 1.0)}


def test_copies_do_not_push_terms_out_of_band(spark):
    """A text that fills a third of the rows still finds its edited copy."""
    rng = random.Random(4)
    texts = [" ".join(f"t{rng.randrange(60)}" for _ in range(12)) for _ in range(60)]
    hot = texts[0]
    near = " ".join(hot.split()[:-1])
    rows = [(i, t) for i, t in enumerate([*texts[1:], *[hot] * 30, near, None, ""])]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    n = len({t or "" for _, t in rows})
    df = Counter(x for t in {t or "" for _, t in rows} for x in terms(t))
    lexicon = {t for t, m in df.items() if 0.02 * n <= m <= 0.25 * n}
    got = {r.doc_id: r for r in M.fingerprints(docs, low=0.02).collect()}
    for i, text in rows:
        assert got[i].fingerprint == ":".join(signature(text or "", lexicon))
    last = got[len(texts) - 1 + 29]
    assert last.near_next == likeness(signature(hot, lexicon), signature(near, lexicon)) > 0.5
