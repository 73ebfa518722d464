"""A baseline packed for map-side scores: sorted 64-bit hashes of terms, contents and paths, of checked size."""
from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huskwatch.catalog.lookups import UNIVERSAL_TERMS
from huskwatch.functions.text import normalise_path
from huskwatch.operators.baseline import Baseline

#: Bytes that a packed baseline may have: it is broadcast, and every Python worker of an executor holds it.
LIMIT = 256 << 20
#: Terms seen at least so often are usual.
USUAL = 5


class TooLarge(ValueError):
    """The baseline does not fit a broadcast; score in batches against its tables instead."""


@dataclass
class Packed:
    """Sorted hashes of usual and of scarce terms, known contents and known paths, with the baseline-wide numbers.

    Two names with one 64-bit hash count as one: about one chance in 10^5 for a million terms met by a million others."""
    usual: np.ndarray
    scarce: np.ndarray
    contents: np.ndarray
    paths: np.ndarray
    observed: int
    samples: int
    mean_entropy: float
    version: str = ""

    @property
    def size(self) -> int:
        return sum(a.nbytes for a in (self.usual, self.scarce, self.contents, self.paths))


def pack(baseline: Baseline, limit: int = LIMIT) -> Packed:
    """The packed form of a baseline; TooLarge if its hashes need more than ``limit`` bytes, which is checked before they are read.

    ``version`` is a digest of all it holds: equal baselines have equal versions."""
    tables = {"usual": baseline.vocab.filter(F.col("n") >= USUAL).select(F.xxhash64("term").alias("h")),
              "scarce": baseline.vocab.filter(F.col("n").between(1, USUAL - 1)).select(F.xxhash64("term").alias("h")),
              "contents": baseline.hashes.select(F.xxhash64("content_hash").alias("h")),
              "paths": baseline.paths.select(F.xxhash64("norm_path").alias("h"))}
    size = 8 * sum(t.count() for t in tables.values())
    if size > limit:
        raise TooLarge(f"the baseline needs {size} bytes, the limit is {limit}")
    arrays = {k: np.unique(t.toArrow()["h"].to_numpy()) for k, t in tables.items()}
    seen = baseline.samples.agg(F.count("entropy").alias("n"), F.avg("entropy").alias("mean")).first()
    out = Packed(**arrays, observed=baseline.observed.first()["n"] or 0, samples=seen["n"], mean_entropy=seen["mean"] or 0.0)
    digest = xxhash.xxh3_128(repr((out.observed, out.samples, out.mean_entropy, [len(a) for a in arrays.values()])).encode())
    for a in arrays.values():
        digest.update(a.tobytes())
    return replace(out, version=digest.hexdigest())


def save(known: Packed, spark, folder: str) -> str:
    """Write the packed baseline under its version; a version that is already there is the same and stays. Returns the version."""
    row = (*(a.astype("<i8").tobytes() for a in (known.usual, known.scarce, known.contents, known.paths)), known.observed, known.samples, known.mean_entropy, known.version)
    kind = "usual binary, scarce binary, contents binary, paths binary, observed long, samples long, mean_entropy double, version string"
    spark.createDataFrame([row], kind).coalesce(1).write.mode("ignore").parquet(f"{folder}/version={known.version}")
    return known.version


def load(spark, folder: str, version: str) -> Packed:
    *arrays, observed, samples, mean, own = spark.read.parquet(f"{folder}/version={version}").select(
        "usual", "scarce", "contents", "paths", "observed", "samples", "mean_entropy", F.lit(version)).first()
    return Packed(*[np.frombuffer(a, "<i8") for a in arrays], observed, samples, mean, own)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def scored(features: DataFrame, known: Packed) -> DataFrame:
    """features (terms, content_hash, path, entropy) with a column ``anomaly`` of 0 to 100, row by row.

    Terms that are not universal count as rare below USUAL sightings and once and a half more if never seen; known contents,
    rows without terms and baselines of under 100 observations give 0; known paths weigh three tenths."""
    sent = features.sparkSession.sparkContext.broadcast(known)

    @F.pandas_udf("double")
    def score(terms: pd.Series, sizes: pd.Series, contents: pd.Series, there: pd.Series, paths: pd.Series, entropy: pd.Series) -> pd.Series:
        k = sent.value
        lists = [np.asarray(t, np.int64) if t is not None else np.zeros(0, np.int64) for t in terms]
        flat = np.concatenate([*lists, np.zeros(0, np.int64)])
        row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        usual, scarce = _among(flat, k.usual), _among(flat, k.scarce)
        rare = np.bincount(row[~usual], minlength=len(lists))
        never = np.bincount(row[~usual & ~scarce], minlength=len(lists))
        n, h = sizes.to_numpy(np.float64), entropy.to_numpy(np.float64, na_value=np.nan)
        rarity = np.minimum(100.0, (rare + 1.5 * never) / np.maximum(n, 1) * 80)
        raw = rarity + np.where((k.samples > 50) & (h > k.mean_entropy * 1.5) & (h > 4.5), 15.0, 0.0)
        raw = np.where(there.to_numpy(bool) & _among(paths.to_numpy(np.int64), k.paths), raw * 0.3, raw)
        none = (k.observed < 100) | _among(contents.to_numpy(np.int64), k.contents) | (n == 0)
        return pd.Series(np.where(none, 0.0, np.minimum(100.0, raw)))

    universal = F.array(*[F.lit(t) for t in UNIVERSAL_TERMS])
    terms = F.coalesce("terms", F.array().cast("array<string>"))
    odd = F.transform(F.filter(terms, lambda t: ~F.array_contains(universal, t)), lambda t: F.xxhash64(t))
    there = F.coalesce(F.length("path") > 0, F.lit(False))  # hashes with nulls would reach pandas as rounded doubles
    return features.withColumn("anomaly", score(odd, F.size(terms), F.xxhash64("content_hash"), there, F.xxhash64(normalise_path(F.col("path"))), F.col("entropy")))
