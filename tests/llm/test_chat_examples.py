import hashlib

import pytest
from pyspark.sql import functions as F

from huskwatch.llm import chat

ROWS = [(1, t, "assistant" if t % 2 else "user", f"text {t} <s>") for t in range(6)] + [(2, 0, "user", "alone"), (None, 0, "assistant", "b")]
SCHEMA = "conv_id long, turn long, role string, text string"


def test_query_reads_losses_from_examples(spark, monkeypatch):
    turns, own = spark.createDataFrame(ROWS, SCHEMA), chat.examples
    monkeypatch.setattr(chat, "examples", lambda formatted: own(formatted).where("example != 4"))
    got = {r["conv_id"]: r for r in chat.digest(turns).collect()}
    want = "text 1 <s>text 5 <s>"
    assert got[1]["n_turns"] == 6 and got[1]["loss_chars"] == len(want) and got[1]["loss_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert got[2]["loss_chars"] == 0 and got[None]["loss_chars"] == 1


def test_wrong_prefix_is_found(spark):
    formatted = chat.segments(spark.createDataFrame(ROWS, SCHEMA))
    with pytest.raises(Exception, match="does not end at"):
        chat.read_back(formatted, chat.examples(formatted).withColumn("length", F.col("length") - 1)).collect()
