import math
import random
from collections import Counter

import pytest

from huskwatch.llm import lm

SCHEMA = "doc_id long, text string"


def plain(rows, target, classes):
    """Scores by dictionaries of words."""
    models = []
    for chosen in ([t for d, t in rows if d in target], [t for _, t in rows]):
        words, contexts, pairs = Counter(), Counter(), Counter()
        for text in chosen:
            w = ["<s>", *(text or "").lower().split()]
            words.update(w[1:])
            contexts.update(w[:-1])
            pairs.update(zip(w, w[1:]))
        models.append((words, contexts, pairs, sum(words.values())))
    out = []
    for doc, text in rows:
        w = ["<s>", *(text or "").lower().split()]
        losses = []
        for words, contexts, pairs, total in models:
            ls = []
            for a, b in zip(w, w[1:]):
                single = (words[b] + 0.5) / (total + 0.5 * classes)
                ls.append(-math.log(0.7 * pairs[a, b] / contexts[a] + 0.3 * single if contexts[a] else single))
            losses.append(sum(ls) / len(ls) if ls else None)
        out.append((doc, len(w) - 1, *losses, losses[0] - losses[1] if w[1:] else None))
    return out


def test_equals_counting_words(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = [(d, " ".join(rng.choice(vocabulary[: 12 if d % 3 else 40]) for _ in range(rng.randint(0, 60)))) for d in range(90)] + [(500, None), (501, " \n"), (None, "w1 w2"), (3, "w3 W4")]
    target = [1, 2, 4, 5, 7, 500, None, 9999, 4]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], SCHEMA + ", loss double").repartition(5)
    models = lm.fit(docs, spark.createDataFrame([(t,) for t in target], "doc_id long"), classes=1 << 20, cells=1 << 22)
    got = sorted(((r["doc_id"], *r["loss"]) for r in lm.scored(docs, *models).collect()), key=str)
    for g, w in zip(got, sorted(plain(rows, {t for t in target if t is not None}, 1 << 20), key=str), strict=True):
        assert g[:2] == w[:2]
        assert g[2:] == (None,) * 3 if w[2] is None else g[2:] == pytest.approx(w[2:], rel=1e-5, abs=1e-6)


def test_small_tables_are_exact_and_bounded(spark):
    docs = spark.createDataFrame([(1, "a b a b"), (2, "c d")], SCHEMA)
    target, background = lm.fit(docs, docs.where("doc_id = 1").select("doc_id"), classes=50, cells=51 * 51)
    assert target.total == 4 and background.total == 6 and background.pairs.sum() == 6 and target.contexts.sum() == 4


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some words " * 100_000), (2, None)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in lm.digest(docs, none).collect()}
    assert got[2]["score"] is None and got[1]["n_tokens"] == 200_000 and math.isfinite(got[1]["score"])
    assert lm.digest(docs.limit(0), none).collect() == []


def test_good_documents_score_lower(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    models = lm.fit(docs, labels.where("quality = 1 and doc_id % 2 = 0"))
    rows = lm.scored(docs.join(labels.where("doc_id % 2 = 1"), "doc_id"), *models).where("loss.n_tokens > 20").collect()
    good = [r["loss"]["difference"] for r in rows if r["quality"] == 1]
    bad = [r["loss"]["difference"] for r in rows if r["quality"] == 0]
    assert sum(g < b for g in good for b in bad) >= 0.8 * len(good) * len(bad)
