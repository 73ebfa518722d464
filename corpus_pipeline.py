"""The corpus pipeline: quality rules, line dedup, near-dedup, benchmark decontamination and BPE coding of documents."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huskwatch.llm import bpe, decontaminate, linededup, neardup, quality
from huskwatch.llm.common import nested, restored, shared_folder, small_batches, table
from huskwatch.llm.queries import vocabulary


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars follows the text; null texts have none."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose lines are mostly content; the field is trained on a bounded sample of labels."""
    return quality.accepted(docs, quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without runs of lines that an earlier one has; a later exact copy is left without lines."""
    small_batches(spark)
    return _sized(restored(linededup.deduplicate(nested(docs)), docs.columns, text=F.col("text")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (0.8 or more of the five-word shingles in common); documents without words are one group."""
    small_batches(spark)
    return neardup.deduplicate(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their benchmark passages; those that are mostly benchmark text go."""
    return _sized(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def bpe_coding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and the digest of the decoded text."""
    small_batches(spark)
    found = bpe.coded(docs.select("doc_id", "text"), vocabulary(), whole=False)
    return found.select("doc_id", "bpe.n_tokens", "bpe.ids", "bpe.decoded_sha256")


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("benchmark_decontamination", benchmark_decontamination), ("bpe_coding", bpe_coding)]

#: The conditional random field and the tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again by the next."""
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark)
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{n}_{name}")
            docs = spark.read.parquet(f"{folder}/{n}_{name}")
    return docs
