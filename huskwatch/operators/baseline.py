"""Environment baseline: what is normal in this environment, and how far a block is from it."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huskwatch.catalog.lookups import UNIVERSAL_TERMS
from huskwatch.functions.text import normalise_path


@dataclass
class Baseline:
    """Five tables: vocab(term, n), hashes(content_hash), paths(norm_path),
    samples(ts, block_id, entropy), observed(n)."""
    vocab: DataFrame
    hashes: DataFrame
    paths: DataFrame
    samples: DataFrame
    observed: DataFrame


def build(features: DataFrame) -> Baseline:
    """Baseline from the features of known-benign blocks."""
    return Baseline(
        vocab=features.select(F.explode_outer("terms").alias("term")).filter(F.col("term").isNotNull())
        .groupBy("term").agg(F.count("*").alias("n")),
        hashes=features.select("content_hash").distinct(),
        paths=features.filter(F.length("path") > 0).select(normalise_path(F.col("path")).alias("norm_path")).distinct(),
        samples=features.select("ts", "block_id", "entropy"),
        observed=features.agg(F.count("*").alias("n")))


def extend(old: Baseline, new: Baseline) -> Baseline:
    return Baseline(
        vocab=old.vocab.unionByName(new.vocab).groupBy("term").agg(F.sum("n").alias("n")),
        hashes=old.hashes.unionByName(new.hashes).distinct(),
        paths=old.paths.unionByName(new.paths).distinct(),
        samples=old.samples.unionByName(new.samples),
        observed=old.observed.unionByName(new.observed).agg(F.sum("n").alias("n")))


def save(baseline: Baseline, folder: str, max_terms: int | None = None, max_samples: int | None = None) -> None:
    """Write the whole baseline; the two limits, where given, keep the most frequent terms and the latest entropy samples."""
    vocab = baseline.vocab if max_terms is None else baseline.vocab.orderBy(F.desc("n"), "term").limit(max_terms)
    samples = baseline.samples if max_samples is None else baseline.samples.orderBy(F.desc("ts"), F.desc("block_id")).limit(max_samples)
    vocab.write.mode("overwrite").parquet(f"{folder}/vocab")
    baseline.hashes.write.mode("overwrite").parquet(f"{folder}/hashes")
    baseline.paths.write.mode("overwrite").parquet(f"{folder}/paths")
    samples.write.mode("overwrite").parquet(f"{folder}/samples")
    baseline.observed.write.mode("overwrite").parquet(f"{folder}/observed")


def load(spark, folder: str) -> Baseline:
    return Baseline(*[spark.read.parquet(f"{folder}/{t}") for t in ("vocab", "hashes", "paths", "samples", "observed")])


def known_good(features: DataFrame, baseline: Baseline) -> DataFrame:
    """Blocks whose content is already known."""
    return features.join(baseline.hashes, "content_hash", "left_semi")


BLOCK_KEY = ("block_id", "block_number", "host_id", "process_id", "ts")


def _spread_null(key: Column) -> Column:
    """The key, or for rows without one a stand-in that matches nothing and is spread over 1024 values."""
    return F.coalesce(key, F.concat(F.lit("\0"), F.pmod(F.xxhash64("block_id"), F.lit(1024)).cast("string")))


def _entropy_stats(baseline: Baseline) -> Column:
    return baseline.samples.agg(F.struct(F.count("entropy").alias("n"), F.avg("entropy").alias("mean")).alias("s")).select("s").scalar()


def is_outlier(stats: Column, factor: float = 1.5, least: float = 4.5, samples: int = 50) -> Column:
    """Entropy above ``factor`` times the mean of more than ``samples`` samples, and above ``least``."""
    return (stats.getField("n") > samples) & (F.col("entropy") > stats.getField("mean") * factor) & (F.col("entropy") > least)


def entropy_outliers(features: DataFrame, baseline: Baseline, factor: float = 1.5, least: float = 4.5, samples: int = 50) -> DataFrame:
    """Blocks whose entropy is_outlier() marks, as anomaly() counts them."""
    return features.filter(is_outlier(_entropy_stats(baseline), factor, least, samples))


def anomaly(features: DataFrame, baseline: Baseline) -> DataFrame:
    """0-100 distance of every block from the baseline.

    Terms are counted inside their row; only those of not-yet-known blocks that are not universal are exploded
    and meet the vocabulary in one equi-join.  What else the score needs travels with them, so the blocks are
    not joined back.  Baseline-wide numbers come in as scalar subqueries.
    """
    universal = F.array(*[F.lit(t) for t in UNIVERSAL_TERMS])
    observed = baseline.observed.select("n").scalar()
    outlier = is_outlier(_entropy_stats(baseline))
    path = F.when(F.length("path") > 0, normalise_path(F.col("path")))
    flagged = (features.select(*BLOCK_KEY, "entropy", "terms", "content_hash", _spread_null(path).alias("norm_path"))
               .join(baseline.hashes.select("content_hash", F.lit(True).alias("known_hash")), "content_hash", "left")
               .join(baseline.paths.select("norm_path", F.lit(True).alias("known_path")), "norm_path", "left"))
    odd = F.when(F.col("known_hash").isNull(), F.filter("terms", lambda t: ~F.array_contains(universal, t)))
    kept = [*BLOCK_KEY, "entropy", "known_hash", "known_path"]
    size = F.size(F.coalesce("terms", F.array().cast("array<string>")))
    one = flagged.withColumn("size", size).select(*kept, "size", F.posexplode_outer(odd).alias("pos", "term"))
    counted = (one.groupBy(*kept, "term").agg(F.count("term").alias("k"), F.sum(F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("size"))).alias("size"))
               .withColumn("term", _spread_null(F.col("term")))
               .join(baseline.vocab, "term", "left").withColumn("seen", F.coalesce("n", F.lit(0)))
               .groupBy(*kept).agg(
                   F.sum("size").alias("terms_n"),
                   F.sum(F.when(F.col("seen") < 5, F.col("k")).otherwise(0)).alias("rare"),
                   F.sum(F.when(F.col("seen") == 0, F.col("k")).otherwise(0)).alias("never")))
    rarity = F.least(F.lit(100.0), (F.col("rare") + 1.5 * F.col("never")) / F.col("terms_n") * 80)
    raw = rarity + F.when(outlier, 15.0).otherwise(0.0)
    score = F.least(F.lit(100.0), F.when(F.col("known_path"), raw * 0.3).otherwise(raw))
    return counted.select(*BLOCK_KEY, F.when((observed < 100) | F.col("known_hash").isNotNull() | (F.col("terms_n") == 0), 0.0).otherwise(score).alias("anomaly"))


def session_anomaly(scored: DataFrame) -> DataFrame:
    """Anomaly of the first block of every session (rows carry session_id)."""
    return scored.groupBy("session_id").agg(
        F.min_by("anomaly", F.struct("ts", "block_id", "block_number")).alias("baseline_anomaly"))


def summary(baseline: Baseline) -> DataFrame:
    """One row: observation, term, hash and path counts and the ten most frequent terms."""
    top = baseline.vocab.orderBy(F.desc("n"), "term").limit(10).agg(F.transform(
        F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col("term")))),
        lambda x: x.getField("term")).alias("t"))
    return baseline.observed.select(
        F.col("n").alias("observations"),
        baseline.vocab.agg(F.count("*")).scalar().alias("unique_terms"),
        baseline.hashes.agg(F.count("*")).scalar().alias("known_hashes"),
        baseline.paths.agg(F.count("*")).scalar().alias("known_paths"),
        top.scalar().alias("top_terms"))
