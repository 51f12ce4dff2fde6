from __future__ import annotations

import numpy as np
import xxhash

from passagekit.llm import simhash as S

DOCS = "doc_id bigint, text string"


def plain(text, k=4):
    """Bit counts one shingle and one bit at a time."""
    words = [w for w in "".join(c.lower() if c < "\x80" else c for c in text or "").encode().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(fps):
    """Least position reachable, over all pairs."""
    root = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 4 and root[j] < root[i]:
                    root[i], changed = root[j], True
    return root


def test_fingerprint_matches_plain():
    for text in [None, "", " \t", "One", "a B c", "a b c d", "É é\x0bx  y z w v", "the cat sat on the mat " * 30]:
        assert S.simhash(text) == plain(text)
    long = " ".join(str(i % 977) for i in range(3 * S.PIECE // 2))
    assert S.simhash(long) == plain(long)


def points(seed, n=400):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 64, n // 4, dtype=np.uint64)
    out = list(base)
    for _ in range(n - len(base)):
        v = int(rng.choice(out))
        for b in rng.choice(64, rng.integers(1, 7), replace=False):
            v ^= 1 << int(b)
        out.append(np.uint64(v))
    return np.unique(np.array(out, np.uint64))


def joined(fps, stars):
    at = {int(f): i for i, f in enumerate(fps)}
    root = S._roots(len(fps), [(np.array([at[int(a)] for a, _ in stars]), np.array([at[int(b)] for _, b in stars]))])
    return root.tolist()


def test_forest_is_exact_for_any_radii():
    for forest in (*(f for _, f in S.FORESTS), ((64, 4),), ((13, 0), (13, 0), (13, 0), (13, 0), (12, 0)), ((22, 1), (22, 1), (20, 0))):
        for seed in range(3):
            fps = points(seed)
            stars = []
            for tree in S.plant(fps[::2], len(fps), forest, leaf=8):
                row, leaf, home = tree.route(fps)
                assert np.bincount(row[home], minlength=len(fps)).tolist() == [1] * len(fps)
                for k in np.unique(leaf):
                    here = leaf == k
                    a, b = S.leaf_links(fps[row[here]].view(np.int64), home[here])
                    stars += zip(a.view(np.uint64), b.view(np.uint64), strict=True)
            assert joined(fps, stars) == brute([int(f) for f in fps])


def test_near_duplicates_end_to_end(spark, tmp_path):
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(300)]
    texts = [None, "", " "]
    for _ in range(40):
        words = list(rng.choice(vocab, rng.integers(1, 400)))
        texts += [" ".join(words)] * int(rng.integers(1, 3))
        for _ in range(2):
            words = list(words)
            words[int(rng.integers(len(words)))] = "changed"
            texts.append(" ".join(words))
    rows = [(int(i * 3), t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS + ", component_id int, fp string")
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in S.near_duplicates(docs).collect()}
    fps = [plain(t) for _, t in rows]
    assert got == {d: (f, 3 * c) for (d, _), f, c in zip(rows, fps, brute(fps), strict=True)}


def test_large_leaf_is_dealt_in_blocks(spark):
    """A cluster that no mask separates, dealt to pairs of blocks, loses no link."""
    fps = points(9, 300)
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp bigint")
    stars = S.links(df, leaf=100, leaf_most=30).collect()
    stars = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in stars]
    assert joined(fps, stars) == brute([int(f) for f in fps])


def test_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (None, "q r s t u v")], DOCS)
    got = sorted(((r.doc_id, r.component_id) for r in S.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 5), (5, 5), (5, 5), (None, None)], key=str)
    assert S.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
