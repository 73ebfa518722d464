import hashlib
import random

import pytest

from huskwatch.llm import substring


def brute(rows, window):
    words = [(t or "").split() for _, t in rows]
    places = {}
    for d, w in enumerate(words):
        for i in range(len(w) - window + 1):
            places.setdefault(tuple(w[i:i + window]), []).append((d, i))
    gone = [set() for _ in rows]
    for found in places.values():
        if len(found) > 1:
            for d, i in found:
                gone[d].update(range(i, i + window))
    return sorted((str(doc), len(w), len(g), " ".join(x for i, x in enumerate(w) if i not in g)) for (doc, _), w, g in zip(rows, words, gone, strict=True))


def run(spark, rows, window, parts=3):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return sorted((str(r["doc_id"]), r["kept"]["n_words"], r["kept"]["n_removed"], r["kept"]["text"]) for r in substring.deduplicate(docs, window).collect())


def made(rng, n, window, letters):
    passages = [[rng.choice(letters) for _ in range(rng.randint(window // 2, window * 3))] for _ in range(4)]
    rows = []
    for d in range(n):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += rng.choice(passages) if rng.random() < 0.4 else [rng.choice(letters) + str(rng.randint(0, 9)) for _ in range(rng.randint(0, window * 2))]
        rows.append((d, rng.choice([" ", "\n", " \t"]).join(words)))
    return rows


@pytest.mark.parametrize("frequent", [20_000, 0])
@pytest.mark.parametrize("window", [7, 12])
def test_equals_brute_force(spark, monkeypatch, window, frequent):
    rng = random.Random(window)
    for name, value in (("FREQUENT", frequent), ("_SCOPE", 50), ("BUCKET", 40), ("_SLICE", 23)):
        monkeypatch.setattr(substring, name, value)
    rows = made(rng, 60, window, "abcdefgh") + [(7, "x"), (None, "q w e r t y u i o p a s d f"), (None, "q w e r t y u i o p a s d f"), (8, None), (9, "")]
    assert run(spark, rows, window) == brute(rows, window)


def test_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    rows = [(1, long), (1, long + " tail"), (2, " ".join(["same"] * 100)), (3, None), (4, "short")]
    assert run(spark, rows, 35) == brute(rows, 35)
    assert run(spark, [], 35) == []


def test_digest_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "k")], "doc_id long, text string, n_words int, kept string")
    r = substring.digest(docs).first()
    assert (r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) == (1, 2, 0, hashlib.sha256(b"a b").hexdigest())
