"""Gap sessions, tempo and session scores."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huskwatch.functions.scoring import alert_tier, chain_hits, chain_points

GAP_SECONDS = 120


def epoch(ts: Column) -> Column:
    """Seconds since 1970 as DOUBLE, microseconds kept."""
    return F.unix_micros(ts).cast("double") / 1e6


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def stitch(rows: DataFrame, gap_seconds: float = GAP_SECONDS, bucket_seconds: int = 3600,
           host: str = "host_id", pid: str = "process_id", ts: str = "ts",
           tie: tuple[str, ...] = ("block_id",)) -> DataFrame:
    """Add session_start, session_id and gap_seconds to rows.

    A new session starts when the gap to the previous row of the same (host, pid) is larger than
    ``gap_seconds``.  The work runs in two levels, so a (host, pid) that holds a large share of all
    rows is spread over tasks: gaps are found inside time buckets, then one narrow row per bucket
    carries the open session across buckets.  Rows without a time form one session per (host, pid).
    """
    gap = int(gap_seconds * 1_000_000)
    t = _micros(F.col(ts))
    bucketed = rows.withColumn("_bucket", F.when(
        F.col(ts).isNotNull(), F.floor(t / (bucket_seconds * 1_000_000))).otherwise(
        -1_000_000_000 - F.pmod(F.xxhash64(*tie), F.lit(256))))
    keys = [host, pid, "_bucket"]
    inside = Window.partitionBy(*keys).orderBy(ts, *tie)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = (bucketed.withColumn("_prev", F.lag(ts).over(inside))
             .withColumn("_jump", F.coalesce(t - _micros(F.col("_prev")) > gap, F.lit(False)))
             .withColumn("_local", F.last(F.when(F.col("_jump"), F.col(ts)), ignorenulls=True).over(upto)))
    ends = local.groupBy(*keys).agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"),
                                    F.max("_local").alias("_lastlocal"))
    across = Window.partitionBy(host, pid).orderBy("_bucket")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = (ends.withColumn("_prevlast", F.lag("_last").over(across))
               .withColumn("_opens", F.coalesce(
                   _micros(F.col("_first")) - _micros(F.col("_prevlast")) > gap, F.lit(True)))
               .withColumn("_openstart", F.coalesce("_lastlocal", F.when(F.col("_opens"), F.col("_first"))))
               .withColumn("_lead", F.when(F.col("_opens"), F.col("_first")).otherwise(
                   F.last("_openstart", ignorenulls=True).over(before)))
               .select(*keys, "_lead", F.when(~F.col("_opens"), F.col("_prevlast")).alias("_prevlast")))
    out = (local.join(carried, keys)
           .withColumn("session_start", F.coalesce("_local", "_lead"))
           .withColumn("gap_seconds", F.when(
               ~F.col("_jump"), (t - _micros(F.coalesce("_prev", "_prevlast"))) / 1e6)))
    return (out.withColumn("session_id", session_id(F.col(host), F.col(pid), F.col("session_start")))
            .drop("_bucket", "_prev", "_jump", "_local", "_lead", "_prevlast"))


def session_id(host: Column, pid: Column, start: Column) -> Column:
    return F.concat_ws("_", host, pid.cast("string"),
                       F.coalesce(F.date_format(start, "yyyyMMdd'T'HHmmss"), F.lit("unknown")))


def tempo(block_count: Column, mean_gap: Column, stdev_gap: Column) -> Column:
    cv = F.coalesce(F.try_divide(stdev_gap, mean_gap), F.lit(0.0))
    return (F.when(block_count < 2, "single_block")
            .when((mean_gap < 0.5) & (cv < 0.3), "automated_stager")
            .when((mean_gap > 2.0) & (cv > 0.8), "interactive_operator")
            .otherwise("mixed"))


def summarise(rows: DataFrame) -> DataFrame:
    """One row per session from stitched block rows (severity, techniques, changed, gap_seconds).

    First a partial result per (session, severity): severities are whole numbers from 0 to 100,
    so the top three scores come from a histogram of at most 101 rows per session and no block
    list is ever gathered.
    """
    keys = ["session_id", "host_id", "process_id", "session_start"]
    g = F.when(F.col("gap_seconds").isNotNull(), F.greatest(F.col("gap_seconds"), F.lit(0.001)))
    part = rows.groupBy(*keys, "severity").agg(
        F.count("*").alias("n"), F.min("ts").alias("t0"), F.max("ts").alias("t1"),
        F.count("gap_seconds").alias("gn"), F.sum(g).alias("gs"), F.sum(g * g).alias("gq"),
        F.sum(F.col("changed").cast("int")).alias("ch"),
        F.flatten(F.collect_set("techniques")).alias("tech"))
    whole = part.groupBy(*keys).agg(
        F.sum("n").alias("block_count"), F.min("t0").alias("start_time"), F.max("t1").alias("end_time"),
        F.sum("gn").alias("_gn"), F.sum("gs").alias("_gs"), F.sum("gq").alias("_gq"),
        F.sum("ch").alias("changed_blocks"), F.max("severity").alias("max_severity"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("tech")))).alias("technique_set"),
        F.sum(F.when(F.col("severity") > 0, F.col("n"))).alias("_pos"),
        F.sum(F.when(F.col("severity") > 0, F.col("n") * F.col("severity"))).alias("_sum"),
        F.sort_array(F.collect_list(F.when(F.col("severity") > 0, F.struct("severity", "n"))), asc=False).alias("_hist"))
    mean = F.try_divide("_gs", "_gn")
    stdev = F.when(F.col("_gn") > 1, F.sqrt(F.greatest(
        F.lit(0.0), (F.col("_gq") - F.col("_gs") * mean) / (F.col("_gn") - 1))))
    top = F.aggregate(
        "_hist", F.struct(F.lit(3).cast("bigint").alias("left"), F.lit(0).cast("bigint").alias("total")),
        lambda a, h: F.struct(
            (a.getField("left") - F.least(a.getField("left"), h.getField("n"))).alias("left"),
            (a.getField("total") + F.least(a.getField("left"), h.getField("n")) * h.getField("severity")).alias("total")),
        lambda a: a.getField("total"))
    return (whole.withColumn("mean_gap", mean).withColumn("stdev_gap", stdev)
            .withColumn("top3_sum", top)
            .withColumn("positive_blocks", F.coalesce("_pos", F.lit(0)))
            .withColumn("avg_positive", F.col("_sum") / F.col("_pos"))
            .withColumn("tempo", tempo(F.col("block_count"), F.col("mean_gap"), F.col("stdev_gap")))
            .withColumn("duration_seconds", F.coalesce(
                (_micros(F.col("end_time")) - _micros(F.col("start_time"))) / 1e6, F.lit(0.0)))
            .drop("_gn", "_gs", "_gq", "_pos", "_sum", "_hist", "session_start"))


def score(sessions: DataFrame, chains=None) -> DataFrame:
    """Add chain hits, bonuses, weighted_score and alert_tier to summarised sessions."""
    weighted = F.col("top3_sum") * 0.7 + F.col("avg_positive") * 0.3
    out = (sessions.withColumn("chains", chain_hits(F.col("technique_set"), chains))
           .withColumn("chain_bonus", chain_points(F.col("chains")))
           .withColumn("tempo_bonus", F.when(F.col("tempo") == "interactive_operator", 10).otherwise(0))
           .withColumn("base_part", F.col("max_severity") * 0.4)
           .withColumn("weighted_part", weighted * 0.6))
    return (out.withColumn("weighted_score", F.when(
        F.col("positive_blocks") > 0,
        F.least(F.lit(100.0), F.col("base_part") + F.col("weighted_part") + F.col("chain_bonus") + F.col("tempo_bonus"))
    ).otherwise(F.lit(0.0)))
        .withColumn("alert_tier", alert_tier(F.col("weighted_score"))))


def score_breakdown(sessions: DataFrame) -> DataFrame:
    """Rounded score parts and the fired chains of every session; zeros when nothing fired."""
    fired = F.col("positive_blocks") > 0

    def part(col: Column) -> Column:
        return F.when(fired, col).otherwise(F.lit(0.0))
    base, weighted = part(F.round(F.col("base_part"), 1)), part(F.round(F.col("weighted_part"), 1))
    chain = F.when(fired, F.col("chain_bonus")).otherwise(0)
    bonus = F.when(fired, F.col("tempo_bonus")).otherwise(0)
    return sessions.select(
        "session_id", F.when(fired, F.col("max_severity")).otherwise(0).alias("max_block_score"),
        base.alias("base"), weighted.alias("weighted"),
        F.when(fired, F.transform("chains", lambda c: c.getField("label"))).otherwise(
            F.array().cast("array<string>")).alias("chains"),
        chain.alias("chain_total"), bonus.alias("tempo"),
        F.round(F.least(F.lit(100.0), base + weighted + chain + bonus), 1).alias("total"))


def lateral_sweeps(blocks: DataFrame, hash_col: str = "content_hash", window_seconds: int = 600, min_hosts: int = 3) -> DataFrame:
    """Content seen on several hosts within a sliding window: (content, first_seen, hosts), the first time at which ``min_hosts``
    distinct hosts had it in the last ``window_seconds``, and the most hosts at any time.

    A host counts from each sighting until the window has passed, so its sightings merge to spans, and the hosts at a time are
    the spans open then: starts less ends up to it.  Sightings shrink to the first and last of each (content, host, window-wide
    bucket), and running counts are summed bucket by bucket first, so a content with very many copies is no single task."""
    width = window_seconds * 1_000_000
    seen = (blocks.filter(F.col("ts").isNotNull()).select(F.col(hash_col).alias("content"), "host_id", _micros(F.col("ts")).alias("at"))
            .groupBy("content", "host_id", F.floor(F.col("at") / width).alias("bucket")).agg(F.min("at").alias("low"), F.max("at").alias("high")))
    own = Window.partitionBy("content", "host_id").orderBy("bucket")
    before, after = F.lag("high").over(own), F.lead("low").over(own)
    edges = seen.select("content", F.when(before.isNull() | (F.col("low") - before > width), F.col("low")).alias("start"),
                        F.when(after.isNull() | (after - F.col("high") > width), F.col("high") + width).alias("end"))
    # Ends count after the starts of the same time: a span includes both.
    marks = edges.select("content", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(0).alias("kind"), F.lit(1).alias("step")),
                                                      F.struct(F.col("end").alias("at"), F.lit(1).alias("kind"), F.lit(-1).alias("step")))).alias("m"))
    marks = marks.select("content", "m.*").filter("at IS NOT NULL").withColumn("bucket", F.floor(F.col("at") / width))
    sums = marks.groupBy("content", "bucket").agg(F.sum("step").alias("net"))
    earlier = Window.partitionBy("content").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("content", "bucket", F.coalesce(F.sum("net").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("content", "bucket").orderBy("at", "kind").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = marks.withColumn("open", F.sum("step").over(inside)).filter("kind = 0").join(sums, ["content", "bucket"])
    return (counted.withColumn("hosts", F.col("base") + F.col("open")).filter(F.col("hosts") >= min_hosts)
            .groupBy(F.col("content").alias(hash_col)).agg(F.timestamp_micros(F.min("at")).alias("first_seen"), F.max("hosts").alias("hosts")))
