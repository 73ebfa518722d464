"""Periodic call-backs: interval lists, autocorrelation, period and infrastructure clusters."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from huskwatch.catalog.lookups import FRAMEWORK_INTERVALS
from huskwatch.functions.net import IPV4, subnet24
from huskwatch.session import checkpoint_dir

MIN_INTERVAL, MAX_INTERVAL, MIN_SAMPLES = 2.0, 3600.0, 5
DOMAIN = r"^[a-zA-Z0-9]([a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?(\.[a-zA-Z]{2,})+$"


def intervals(rows: DataFrame, low: float = MIN_INTERVAL, high: float = MAX_INTERVAL) -> DataFrame:
    """Ordered interval list per session (from stitched rows) with at least five values kept.

    A kept interval is at least ``low`` seconds long, so a list holds at most
    (log time span / low) numbers however many rows a session has.
    """
    keep = F.col("gap_seconds").between(low, high)
    return (rows.groupBy("session_id", "host_id").agg(
        F.count("ts").alias("times"),
        F.array_sort(F.collect_list(F.when(keep, F.struct("ts", "block_id", "gap_seconds")))).alias("g"))
        .filter((F.col("times") >= MIN_SAMPLES + 1) & (F.size("g") >= MIN_SAMPLES))
        .select("session_id", "host_id", F.transform("g", lambda x: x.getField("gap_seconds")).alias("intervals")))


def _best_lag(values: np.ndarray) -> tuple[int, float]:
    n = len(values)
    d = values - values.mean()
    var = float(d @ d) / (n - 1)
    if var == 0:
        return 0, 1.0
    # All lags at once by FFT, then exact sums for those that may be the best; its error is far below the margin.
    size = 1 << (2 * n - 1).bit_length()
    spec = np.fft.rfft(d, size)
    sums = np.fft.irfft(spec * np.conj(spec), size)[1:max(2, n // 2)]
    rough = sums / ((n - np.arange(1, len(sums) + 1)) * var)
    best, top = 1, -1.0
    for lag in (np.flatnonzero(rough >= rough.max() - 1e-6) + 1).tolist():
        corr = float(d[lag:] @ d[:-lag]) / ((n - lag) * var)
        if corr > top:
            best, top = lag, corr
    return best, top


@F.pandas_udf(T.StructType([T.StructField("lag", T.IntegerType()), T.StructField("corr", T.DoubleType())]))
def best_lag(series: pd.Series) -> pd.DataFrame:
    """Lag with the highest autocorrelation (first wins); lag 0 stands for constant intervals."""
    found = [_best_lag(np.asarray(v, dtype=float)) for v in series]
    return pd.DataFrame(found, columns=["lag", "corr"])


def guess_framework(period: Column) -> Column:
    """Framework whose default interval is nearest within 25 percent; first one wins ties."""
    known = [(no, fw, float(iv)) for no, (fw, iv) in enumerate(
        (fw, iv) for fw, ivs in FRAMEWORK_INTERVALS for iv in ivs)]
    best = F.array_min(F.array(*[F.struct(
        (F.abs(period - iv) / max(iv, 1.0)).alias("dist"), F.lit(no).alias("no"), F.lit(fw).alias("fw"))
        for no, fw, iv in known]))
    return F.when(best.getField("dist") < 0.25, best.getField("fw")).otherwise("")


def mean_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def regularity(values: Column) -> Column:
    """1 minus the coefficient of variation, floored at 0."""
    m = mean_of(values)
    sd = F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / (F.size(values) - 1))
    return F.when(m == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - sd / m))


def beacons(lists: DataFrame, min_confidence: float = 0.35) -> DataFrame:
    """Beacon profile per session; sessions below ``min_confidence`` are left out."""
    corr = (lists.withColumn("p", best_lag("intervals"))
            .withColumn("mean", mean_of(F.col("intervals")))
            .withColumn("regular", regularity(F.col("intervals"))))
    every = F.filter("intervals", lambda x, i: i % F.col("p.lag") == 0)
    scored = (corr.withColumn("period", F.when(F.col("p.lag") == 0, F.col("mean")).otherwise(mean_of(every)))
              .withColumn("conf", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p.corr"))) * 0.6
                          + F.col("regular") * 0.4))
    return (scored.filter(F.col("conf") >= min_confidence)
            .select("session_id", "host_id", F.round("period", 1).alias("period_seconds"),
                    F.round(1 - F.col("regular"), 3).alias("jitter_pct"), F.round("conf", 3).alias("confidence"),
                    F.size("intervals").alias("sample_count"), guess_framework(F.col("period")).alias("framework_hint"))
            .withColumn("is_beacon", F.col("confidence") >= 0.65))


def _next_starts(periods: DataFrame, tolerance: float) -> DataFrame:
    """(p, next): for each distinct period the least one beyond its tolerance, where there is one.

    Looked up in cells of equal ratio: the next value of the cell, or else the least of the next cell that holds one."""
    step = math.log1p(tolerance)
    base = F.greatest(F.col("p"), F.lit(0.001))
    value = F.when(F.col("kind") == 1, F.col("p"))
    # A question lies a rounding error below the border, so that the exact test below decides between two neighbours.
    asked = periods.select(((F.col("p") + base * tolerance) * (1 - 1e-12)).alias("key"), F.lit(0).alias("kind"), "p")
    rows = (periods.select(F.col("p").alias("key"), F.lit(1).alias("kind"), "p").unionByName(asked)
            .withColumn("cell", F.floor(F.log(F.greatest("key", F.lit(0.001))) / step)))
    later = Window.partitionBy("cell").orderBy(F.desc("key"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy("cell").agg(F.min(value).alias("least"))  # so many rows as the logarithm of the largest period has steps
    above = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    cells = F.broadcast(cells.select("cell", F.last("least", ignorenulls=True).over(above).alias("beyond")))
    found = rows.withColumn("inside", F.last(value, ignorenulls=True).over(later)).join(cells, "cell").withColumn("q", F.coalesce("inside", "beyond"))
    follow = found.filter("kind = 1").select(F.col("p").alias("q"), F.col("q").alias("second"))
    far = (F.col("q") - F.col("p")) / base > tolerance
    return found.filter("kind = 0 AND q IS NOT NULL").select("p", "q").join(follow, "q").select("p", F.when(far, F.col("q")).otherwise(F.col("second")).alias("next")).filter("next IS NOT NULL")


def cluster_starts(periods: DataFrame, tolerance: float = 0.10) -> DataFrame:
    """The periods (column ``p``, distinct) at which greedy clusters begin: the least one, then always the least beyond the
    tolerance of the one before.

    Pointers double: after k rounds the first 2^k starts are marked and a jump leads 2^k starts on. Starts grow by the tolerance
    each, so there are about a hundred, found in seven rounds. Rounds are written to the shared folder, which cuts the lineage."""
    spark, folder = periods.sparkSession, checkpoint_dir(periods.sparkSession)

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")
    jumps = written(_next_starts(periods, tolerance), "jumps0")
    starts = written(periods.agg(F.min("p").alias("p")).filter("p IS NOT NULL"), "starts0")
    count, round_ = starts.count(), 0
    while count:
        round_ += 1
        reached = jumps.join(F.broadcast(starts), "p").select(F.col("next").alias("p"))  # starts: a few rows, as said
        starts = written(starts.unionByName(reached).distinct(), f"starts{round_}")
        if (now := starts.count()) == count:
            break
        count = now
        jumps = written(jumps.join(jumps.select(F.col("p").alias("next"), F.col("next").alias("after")), "next").select("p", F.col("after").alias("next")), f"jumps{round_}")
    return starts


def period_clusters(found: DataFrame, tolerance: float = 0.10) -> DataFrame:
    """Sessions whose periods lie within ``tolerance`` of the first period of their cluster.

    Greedy over ascending periods; see cluster_starts(), whose few rows become one expression.
    """
    table = cluster_starts(found.select(F.col("period_seconds").alias("p")).filter("p IS NOT NULL").distinct(), tolerance)
    reached = [F.when(F.col("period_seconds") >= r["p"], F.lit(r["p"])) for r in table.collect()]  # a row a start
    none = F.lit(None).cast("double")
    placed = found.withColumn("cluster_period", F.greatest(none, none, *reached))
    sizes = placed.groupBy(F.col("cluster_period").alias("_start")).agg(F.count("*").alias("cluster_size")).filter("cluster_size >= 2")
    return placed.join(F.broadcast(sizes), F.col("cluster_period") == F.col("_start")).drop("_start")      # sizes: a row a start


def infra_members(session_values: DataFrame) -> DataFrame:
    """(cluster_type, key, session_id, value) for addresses by /24 and names by parent domain."""
    v = F.col("value")
    keyed = session_values.select(
        "session_id", "value",
        F.when(v.rlike(IPV4), F.struct(F.lit("IP /24").alias("cluster_type"), subnet24(v).alias("key")))
        .when(v.rlike(DOMAIN), F.struct(F.lit("Domain").alias("cluster_type"),
                                        F.concat(F.lit("*."), F.substring_index(v, ".", -2)).alias("key"))).alias("k"))
    return keyed.select("k.cluster_type", "k.key", "session_id", "value").filter(F.col("key").isNotNull())


def infra_clusters(session_values: DataFrame) -> DataFrame:
    """Clusters shared by two or more sessions."""
    per_session = infra_members(session_values).groupBy("cluster_type", "key", "session_id").agg(
        F.count("*").alias("n"))
    values = infra_members(session_values).select("cluster_type", "key", "value").distinct().groupBy(
        "cluster_type", "key").agg(F.count("*").alias("value_count"))
    sizes = per_session.groupBy("cluster_type", "key").agg(F.count("*").alias("session_count")).filter("session_count >= 2")
    return sizes.join(values, ["cluster_type", "key"])


def framework_groups(found: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif(F.col("framework_hint"), F.lit("")), F.lit("unknown"))
    return found.groupBy(name.alias("framework")).agg(F.count("*").alias("sessions"))


def first_seen_values(rows: DataFrame, order: list[str], value: str = "value") -> DataFrame:
    """Distinct values with the position of their first row (order-preserving distinct)."""
    return rows.groupBy(value).agg(F.min(F.struct(*order)).alias("first"))
