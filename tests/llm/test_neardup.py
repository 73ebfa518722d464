import random

import numpy as np
import pytest

import corpus_pipeline
from huskwatch.llm import neardup

SCHEMA = "doc_id long, text string"


def brute(rows):
    """Smallest id of each chain of pairs with exact five-word Jaccard similarity of 0.8 or more."""
    sets = []
    for _, text in rows:
        w = text.lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    least = {}
    for r, (d, _) in zip(root, rows):
        least[r] = min(d, least.get(r, d))
    return set(least.values())


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10 ** 9)}"
    return " ".join(words)


@pytest.mark.parametrize(("small", "stretch"), [(64, 500), (3, 4)])
def test_stage_joins_all_near_copies(spark, monkeypatch, small, stretch):
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "STRETCH", stretch)
    rng = random.Random(8)
    rows = []
    for g in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(20, 300))]
        rows += [(len(rows) + k, edited(rng, words, rng.randint(0, max(1, len(words) // 35)))) for k in range(2 + 20 * (g == 0))]
    rows += [(len(rows) + k, t) for k, t in enumerate(["", " \n", "two words", "Two  words", "two other"])]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert got == brute(rows) and len(got) < len(rows) - 30


def test_shingles_and_bands():
    assert len(neardup.shingles(b"a b c d e f")) == 2 and len(neardup.shingles(b"a b")) == 1 and not len(neardup.shingles(b" "))
    assert neardup.bands(neardup.shingles(None)) == [] and len(neardup.bands(np.arange(9000, dtype=np.uint64))) == neardup.BANDS
