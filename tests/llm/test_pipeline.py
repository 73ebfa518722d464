import json
import re

import public_tokenizers

import corpus_pipeline
from huskwatch.llm import bpe, decontaminate, quality, simhash
from tests.llm.test_linededup import brute as plain_lines
from tests.llm.test_neardup import brute as plain_near

FOLDER = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    (_, s4), (_, s9), (_, s1), (_, s5), (_, s7) = corpus_pipeline.STAGES

    kept = s4(spark, docs, FOLDER)
    field = quality.train(docs, labels)
    want = {r["doc_id"] for r in quality.judged(docs, field).where("rules.kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == want and kept.columns == docs.columns

    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    lines = s9(spark, kept, FOLDER)
    assert sorted(((str(r["doc_id"]), r["text"]) for r in lines.collect()), key=str) == [x[:2] for x in plain_lines(rows, 3)]
    assert lines.columns == docs.columns and all(r["n_chars"] == len(r["text"]) for r in lines.collect())

    near = s1(spark, lines, FOLDER)
    assert {r["doc_id"] for r in near.collect()} == plain_near([(r["doc_id"], r["text"]) for r in lines.collect()]) and near.columns == docs.columns

    clean = s5(spark, near, FOLDER)
    found = decontaminate.brute([(r["doc_id"], r["text"]) for r in near.collect()], bench)
    left = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert set(left) == {d for d, x in found.items() if x[1] <= x[0] / 2} and clean.columns == docs.columns
    for r in near.collect():
        if r["doc_id"] in left and not found[r["doc_id"]][1]:
            assert left[r["doc_id"]] == r["text"]
        elif r["doc_id"] in left:
            count = lambda t: len(decontaminate.words_of(t.encode()))
            assert count(left[r["doc_id"]]) == found[r["doc_id"]][0] - found[r["doc_id"]][1]

    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        own = bpe.Codec(json.load(f))
    coded = {r["doc_id"]: r["ids"] for r in s7(spark, clean, FOLDER).collect()}
    assert coded == {d: own.encode(t) for d, t in left.items()}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, FOLDER).collect()} == set(left)


def test_stages_take_odd_rows(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, fp int, lines string, rules int, leak int, _id long, _own string"
    rows = [(None, None, None, None, None, 1, "l", 2, 3, 4, "o"), (1, "", "en", "s", 0, 1, "l", 2, 3, 4, "o"), (1, "", "en", "s", 0, 1, "l", 2, 3, 4, "o"), (2, "word " * 60, "en", "s", 300, 1, "l", 2, 3, 4, "o")]
    for docs in (spark.createDataFrame(rows, kind), spark.createDataFrame([], kind)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, FOLDER)
            assert out.collect() is not None
            if name != "bpe_coding":
                assert out.columns == docs.columns


def test_no_sql_for_models():
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
    assert all(re.fullmatch(r"[a-z_]+", n) for n, _ in corpus_pipeline.STAGES)


def test_kept_is_deterministic(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert rows_of(simhash.deduplicate(docs)) == rows_of(simhash.deduplicate(docs.repartition(7)))
