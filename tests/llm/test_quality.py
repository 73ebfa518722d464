import random
import re
from itertools import product

import numpy as np
import pytest

from huskwatch.llm import quality


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_counts_equal_plain_ones():
    rng = random.Random(4)
    for _ in range(400):
        text = "".join(rng.choice(["a", "b", "é", "😀", " ", "\n", "\t", "#", "a b c ", "x|", " \n", "\x0b"]) for _ in range(rng.randint(0, 60)))
        assert quality.counts(text.encode()) == plain(text)
    assert quality.counts(None) == (0,) * 5


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(1)
    for n in range(1, 9):
        field = quality.Field(rng.normal(size=(2, quality._FEATURES)), rng.normal(size=(2, 2)))
        x = rng.integers(0, 2, (n, quality._FEATURES)).astype(float)
        score = lambda p: sum(field.weights[k] @ f for k, f in zip(p, x)) + sum(field.moves[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
        assert tuple(field.viterbi(x)) == max(product((0, 1), repeat=n), key=score)
    assert field.viterbi(np.zeros((0, quality._FEATURES))) == []


def test_gradient_equals_differences():
    rng = np.random.default_rng(2)
    x, y, mask = rng.normal(size=(2, 4, quality._FEATURES)), rng.integers(0, 2, (2, 4)), np.array([[1, 1, 1, 1], [1, 1, 0, 0]], float)

    def likelihood(w, m):
        out = 0.0
        for i, n in enumerate((4, 2)):
            paths = [sum(w[k] @ f for k, f in zip(p, x[i])) + sum(m[a, b] for a, b in zip(p, p[1:])) for p in product((0, 1), repeat=n)]
            own = y[i, :n]
            out += sum(w[k] @ f for k, f in zip(own, x[i])) + sum(m[a, b] for a, b in zip(own, own[1:])) - np.logaddexp.reduce(paths)
        return out
    w, m = rng.normal(size=(2, quality._FEATURES)), rng.normal(size=(2, 2))
    gw, gm = quality._gradient(x, y, mask, w, m)
    for g, v in ((gw, w), (gm, m)):
        at = (1, 0)
        old = v[at]
        v[at] = old + 1e-5
        up = likelihood(w, m)
        v[at] = old - 1e-5
        down = likelihood(w, m)
        v[at] = old
        assert g[at] == pytest.approx((up - down) / 2e-5, abs=1e-5)


def test_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    field = quality.train(docs, labels.where("doc_id % 2 = 0"))
    rows = quality.judged(docs.join(labels.where("doc_id % 2 = 1 and quality is not null"), "doc_id"), field).select("quality", "rules").collect()
    good = [r for r in rows if not r["rules"]["base_failed"]]
    right = sum((r["rules"]["content_share"] >= 0.5) == bool(r["quality"]) for r in good)
    assert right >= 0.95 * len(good)
    assert sum(r["rules"]["kept"] for r in good if r["quality"] == 1) >= 0.99 * sum(r["quality"] == 1 for r in good)


def test_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (2, "word " * 100_000, "x"), (None, "some words", "x"), (None, "some words", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rules string")
    labels = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    got = quality.digest(docs, labels)
    assert sorted((str(r["doc_id"]), r["n_words"], r["base_failed"], r["kept"]) for r in got.collect()) == [
        ("1", 0, True, False), ("2", 0, True, False), ("2", 100_000, True, False), ("None", 2, True, False), ("None", 2, True, False)]
    assert quality.accepted(docs.limit(0), quality.train(docs, labels)).columns == docs.columns
