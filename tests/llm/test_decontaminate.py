import random

import pytest

from huskwatch.llm import decontaminate as d


@pytest.mark.parametrize("window", [2, 3, 10])
def test_automaton_equals_brute_force(window):
    rng = random.Random(window)
    for case in range(600):
        letters = "abc" if case % 2 else "abcdefg"
        items = [(i, " ".join(rng.choice(letters) for _ in range(rng.randint(0, window * 2)))) for i in range(rng.randint(1, 5))]
        doc = " ".join(rng.choice(letters + "z") for _ in range(rng.randint(0, 40)))
        ranges, found = d.Automaton([(k, d.words_of(t.encode())) for k, t in items], window).match(d.words_of(doc.encode()))
        assert (len(doc.split()), sum(b - a for a, b in ranges), len(found)) == d.brute([(0, doc)], items, window)[0][:3]


@pytest.mark.parametrize("shard_words", [5, 1000])
def test_digest_equals_brute_force(spark, monkeypatch, shard_words):
    monkeypatch.setattr(d.shards, "__defaults__", (d.WINDOW, shard_words))
    items = [(10, "One two three four five six seven eight nine ten eleven"), (9, "short Item"), (2, None), (3, " ,. "), (9, "short item"), (None, "éa b")]
    rows = [(1, "x one, TWO three-four five six seven eight nine ten! y"), (2, "short\nitem short item"), (3, None), (4, ""), (None, "éa B"), (5, "filler " * 200_000 + "short item")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, leak int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = d.brute(rows, [("" if k is None else k, t) for k, t in items])
    assert {r["doc_id"]: tuple(r)[1:] for r in d.digest(docs, bench).collect()} == want
    assert d.digest(docs, bench.limit(0)).where("contaminated").count() == 0
    assert d.digest(docs.limit(0), bench).count() == 0


def test_spans_go_and_the_rest_stays(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Keep this, A b-C! and more words here.", 7), (2, "a b c", 8), (3, None, 9), (4, "clean  text ", 1)], "doc_id long, text string, extra int")
    got = {r["doc_id"]: r["text"] for r in d.decontaminate(docs, bench).collect()}
    assert got == {1: "Keep this, ! and more words here.", 3: None, 4: "clean  text "}
    assert d.decontaminate(docs, bench).columns == docs.columns
