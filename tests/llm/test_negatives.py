import math
import random
from collections import Counter

import numpy as np

from huskwatch.llm import negatives


def plain(rows):
    """Brute force over Python integers: every row against every anchor."""
    clean = []
    for vec_id, vec, label in rows:
        if vec_id is None or vec is None or label is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        clean.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * float(x)) for x in vec]))
    out = []
    for i, (anchor, label, vec) in enumerate(clean):
        if anchor % 100:
            continue
        score = [max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(vec, v)))) for _, _, v in clean]
        near = sorted((-score[j], clean[j][0]) for j in range(len(clean)) if j != i and clean[j][1] == label)[:5]
        for p, positive in near:
            p = -p
            found = sorted((-s, c[0]) for s, c in zip(score, clean) if c[1] != label and 80 * p <= 100 * s <= 100 * p)[:5]
            out += [(anchor, positive, n, b, p, -s) for n, (s, b) in enumerate(found, 1)]
    return Counter(out)


def found(spark, rows, parts=3):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, key string, stripe int").repartition(parts)
    return Counter(tuple(r) for r in negatives.mined(frame).collect())


def single(values):
    return [float(np.float32(v)) for v in values]


def test_hilbert_steps_to_a_neighbour():
    for dims, bits in ((2, 3), (3, 2), (5, 1)):
        cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij")).reshape(dims, -1).T
        keys = [k.tobytes() for k in negatives.hilbert(cells, bits)]
        order = sorted(range(len(keys)), key=keys.__getitem__)
        assert len(set(keys)) == len(keys)
        assert all(np.abs(cells[a] - cells[b]).sum() == 1 for a, b in zip(order, order[1:]))


def test_bounds_hold():
    rng = np.random.default_rng(1)
    a, points = rng.integers(-99, 99, (20, 6)).astype(float), rng.integers(-99, 99, (50, 6)).astype(float)
    least, most = negatives.bounds(a, points.min(axis=0, keepdims=True), points.max(axis=0, keepdims=True))
    scores = negatives.products(a, points)
    assert (least <= scores.min(axis=1, keepdims=True)).all() and (scores.max(axis=1, keepdims=True) <= most).all()


def test_equals_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        vec = [rng.gauss(0, 0.3) for _ in range(8)]
        if i % 3 == 0:  # a third of all rows are near copies of one vector
            vec = [0.4 + rng.choice([0, 0.01]), 0.1, -0.3, 0.2, 0.5, 0.1, 0.0, 0.3]
        rows.append((i, single(vec), rng.choice([1, 2, 2, 2, 9])))
    assert found(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i, single(rng.choice([-0.5, 0.25, 0.5]) for _ in range(rng.choice([3, 4, 4]))), rng.randint(0, 2)) for i in range(0, 900, 5)]
    rows += rows[:30] + [(100, single([0.1, 0.2, 0.3]), 1), (-100, single([0.5, 0.5, 0.5]), 0)]
    rows += [(None, [0.5], 1), (1100, None, 1), (1200, [0.5, None], 1), (1300, [float("nan")], 2), (1400, [float("inf")], 2), (1500, [0.5], None), (1600, [], 1), (1700, [3e18, 2e10], 1), (1701, [2e19, 1.0], 2), (1703, [1e18, 1e12], 1)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], n) for i, v, n in rows]
    assert found(spark, rows) == plain(rows)


def test_few_rows(spark):
    assert found(spark, []) == Counter()
    assert found(spark, [(100, [0.5], 1)]) == Counter()
    rows = [(100, [0.5], 1), (101, [0.5], 1), (103, [0.4375], 2), (104, [0.5], 2)]
    assert found(spark, rows, 1) == plain(rows) and sum(plain(rows).values()) == 2


def test_zones_spare_blocks():
    """A far block is not wanted by a window that its bounds cannot meet."""
    group = {"n": 1, "labels": np.array([1], np.int32).tobytes(), "of": np.array([0], np.int32).tobytes(), "vecs": np.array([[100.0, 0.0]]).tobytes(), "low": np.array([9000]).tobytes(), "high": np.array([11000]).tobytes()}
    zones = [{"label_lo": 2, "label_hi": 2, "lo": np.array(lo).tobytes(), "hi": np.array(hi).tobytes()} for lo, hi in (([95.0, -5.0], [105.0, 5.0]), ([0.0, 0.0], [50.0, 9.0]), ([200.0, 0.0], [250.0, 9.0]))]
    assert negatives._wanted(group, zones, False).tolist() == [[True, False, False]]
    assert not negatives._wanted(group, zones, True).any()
