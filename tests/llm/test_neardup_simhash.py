import random

import numpy as np

from huskwatch.llm import neardup, simhash
from tests.llm.test_neardup import SCHEMA, brute


def bits(words):
    return np.unpackbits(np.array(words, np.int64).view(np.uint8))


def test_fingerprints_follow_the_angle():
    """Bits differ as often as the angle of two sets says: a sketch of minima has no such law."""
    rng = np.random.default_rng(3)
    for common, other in ((800, 100), (400, 400), (0, 500)):
        found = []
        for _ in range(20):
            x = rng.integers(1 << 63, size=common + 2 * other, dtype=np.uint64)
            found.append((bits(neardup.bands(x[:common + other])) != bits(neardup.bands(np.r_[x[:common], x[common + other:]]))).mean())
        assert abs(np.mean(found) - np.arccos(common / (common + other)) / np.pi) < 0.015


def test_pairs_are_all_near_rows_of_other_labels():
    rng = np.random.default_rng(7)
    base = rng.integers(1 << 63, size=(4, 2), dtype=np.uint64)
    key = np.sort(rng.integers(5, size=700))
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(64, size=(3, 700, 2)).astype(np.uint64), axis=0)
    fp, label = base[rng.integers(4, size=700)] ^ flips, rng.integers(3, size=700)
    got = {(int(i), int(j)) for a, b in simhash.Pairs(key, fp, list(range(128)), 9, label) for i, j in zip(np.minimum(a, b), np.maximum(a, b))}
    want = {(i, j) for i in range(700) for j in range(i + 1, 700) if key[i] == key[j] and label[i] != label[j] and np.bitwise_count(fp[i] ^ fp[j]).sum() <= 9}
    assert got == want and len(want) > 300


def test_links_between_sets_that_miss_the_first_one(spark, monkeypatch):
    """Of each three texts two are near, the third is near by fingerprint only; which comes first is a matter of hashes."""
    monkeypatch.setattr(neardup, "SMALL", 8)
    monkeypatch.setattr(neardup, "STRETCH", 16)
    rng, rows = random.Random(5), []
    for _ in range(60):
        w = [f"w{rng.randrange(10 ** 6)}" for _ in range(120)]
        far = list(w)
        for i in (20, 45, 70, 95):
            far[i] = f"x{rng.randrange(10 ** 6)}"
        near = [*w[:60], "new", *w[61:]]
        rows += [(len(rows) + k, " ".join(t)) for k, t in enumerate((w, near, far))]
    got = {r["doc_id"] for r in neardup.deduplicate(spark.createDataFrame(rows, SCHEMA).repartition(5)).select("doc_id").collect()}
    assert got == brute(rows) and len(got) == 120


def test_large_group_of_unlike_sets_makes_no_table_of_pairs(spark, monkeypatch):
    """Most pairs of the 300 texts are near by fingerprint, few by similarity; nothing written grows with the pairs."""
    monkeypatch.setattr(neardup, "MEET", 64)
    made = []
    monkeypatch.setattr(neardup, "cut", lambda df, f=neardup.cut: (made.append((out := f(df)).count()), out)[1])
    rng = random.Random(6)
    words = [f"w{i}" for i in range(150)]
    rows = []
    for d in range(300):
        own = list(words)
        for i in rng.sample(range(2, 148, 5), rng.choice((2, 5))):
            own[i] = f"x{rng.randrange(10 ** 6)}"
        rows.append((d, " ".join(own)))
    sets = [set(neardup.shingles(t.encode()).tolist()) for _, t in rows]
    fp = np.array([neardup.bands(np.array(sorted(s), np.uint64)) for s in sets]).view(np.uint64)
    rows += [(300 + d, " ".join(f"y{rng.randrange(10 ** 6)}" for _ in range(20))) for d in range(20)]
    got = {r["doc_id"] for r in neardup.deduplicate(spark.createDataFrame(rows, SCHEMA).repartition(5)).select("doc_id").collect()}
    assert got == brute(rows) and 100 < len(got) < 300
    pairs = int((np.bitwise_count(fp[:, None] ^ fp[None]).sum(axis=2) <= neardup.WIDE_RADIUS).sum() - 300) // 2
    assert max(made) <= 3 * len(rows) < pairs / 30
