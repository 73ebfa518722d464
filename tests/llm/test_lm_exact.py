import random

import numpy as np
import pytest

from huskwatch.llm import lm
from tests.llm.test_lm import plain


def test_query_counts_exactly(spark):
    """More distinct words and bigrams than any class table of the sketch keeps apart."""
    rng = random.Random(4)
    rows = [(d, " ".join(f"w{rng.randrange(600_000)}" if rng.random() < 0.9 else "The" for _ in range(2000))) for d in range(150)]
    rows += [(150, None), (151, " \n"), (None, "w1 w2 the the"), (3, "w3 W4"), (3, "w3 W4"), (None, None)]
    good = {1, 3, 7, 40, 150}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(d, 1) for d in good] + [(2, 0), (None, 1), (7, 1)], "doc_id long, quality int")
    size = len({w for _, t in rows for w in (t or "").lower().split()})
    got = sorted(map(tuple, lm.digest(docs, labels).collect()), key=str)
    for g, w in zip(got, sorted(plain(rows, good, size), key=str), strict=True):
        assert g[:2] == w[:2]
        assert g[2:] == (None,) * 3 if w[2] is None else g[2:] == pytest.approx(w[2:], rel=1e-9, abs=1e-9)


def test_blocks_ask_once_for_a_bigram(spark, monkeypatch):
    """Many blocks, hot words, documents without words: the figures of plain counting, and each block sends a bigram once."""
    monkeypatch.setattr(lm, "_HELD", 20_000)
    monkeypatch.setattr(lm, "_asked", lambda *a, f=lm._asked: sent.append(f(*a)) or sent[-1])
    sent, rng = [], random.Random(9)
    rows = [(d, " ".join(f"w{rng.randrange(30_000)}" if rng.random() < 0.8 else "the" for _ in range(rng.randint(0, 600)))) for d in range(400)]
    rows += [(d, None) for d in range(400, 420)] + [(None, "the The the"), (7, ""), (1, "the " * 30_000)]
    good = set(range(0, 420, 3))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(d, int(d in good)) for d in range(420)], "doc_id long, quality int")
    got = sorted(map(tuple, lm.digest(docs, labels).collect()), key=str)
    size = len({w for _, t in rows for w in (t or "").lower().split()})
    for g, w in zip(got, sorted(plain(rows, good, size), key=str), strict=True):
        assert g[:2] == w[:2]
        assert g[2:] == (None,) * 3 if w[2] is None else g[2:] == pytest.approx(w[2:], rel=1e-9, abs=1e-9)
    table = [(r["block"], h) for r in sent[0].collect() for h in np.cumsum(lm._unpack(r["pairs"]), dtype=np.uint64).tolist()]
    distinct = {p for _, t in rows for p in zip(["", *(t or "").lower().split()], (t or "").lower().split())}
    assert len(table) == len(set(table)) and len({h for _, h in table}) == len(distinct) and len({b for b, _ in table}) > 4
