"""Analyst roll-ups over sessions, findings and indicators."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huskwatch.catalog.lookups import (DURATION_BUCKETS, KILL_CHAIN, SCORE_BUCKETS, SUMMARY_TACTICS,
                                       TACTIC_FOR, TACTIC_ORDER)
from huskwatch.functions.scoring import tier_of_rank, tier_rank

P1, P2, P3 = "P1_INCIDENT", "P2_ALERT", "P3_WARNING"


def _count(tier: str) -> Column:
    return F.count_if(F.col("alert_tier") == tier)


def headline(sessions: DataFrame, campaigns: DataFrame) -> DataFrame:
    return sessions.agg(_count(P1).alias("p1"), _count(P2).alias("p2"), _count(P3).alias("p3"),
                        F.count("*").alias("total")).withColumn(
        "campaigns", campaigns.agg(F.count("*")).scalar())


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def risk_level(sessions: DataFrame) -> DataFrame:
    worst = sessions.agg(F.max(tier_rank(F.col("alert_tier"))).alias("r"))
    return worst.select(F.when(F.col("r") == 4, "CRITICAL").when(F.col("r") == 3, "HIGH")
                        .when(F.col("r") == 2, "MEDIUM").otherwise("LOW").alias("risk_level"))


def mitre_counts(findings: DataFrame) -> DataFrame:
    return findings.filter(F.length("mitre_id") > 0).groupBy("mitre_id").agg(F.count("*").alias("n"))


def tactic_breakdown(spark, findings: DataFrame, groups=None) -> DataFrame:
    """Findings per summary tactic; a mitre id counts for the first tactic that lists its base."""
    groups = SUMMARY_TACTICS if groups is None else groups
    first: dict[str, tuple[int, str]] = {}
    for no, (name, prefixes) in enumerate(groups):
        for p in prefixes:
            first.setdefault(p, (no, name))
    table = spark.createDataFrame([(p, no) for p, (no, _) in first.items()], "base string, tactic_no int")
    dim = spark.createDataFrame(list(enumerate(n for n, _ in groups)), "tactic_no int, tactic string")
    counts = mitre_counts(findings).withColumn("base", F.substring_index("mitre_id", ".", 1)).join(
        F.broadcast(table), "base").groupBy("tactic_no").agg(
        F.count("*").alias("hits"), F.sum("n").alias("total"))
    return dim.join(counts, "tactic_no", "left").select(
        "tactic_no", "tactic", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("total", F.lit(0)).alias("total"),
        F.col("hits").isNotNull().alias("active"))


def tactic_rows(spark, findings: DataFrame, mapping=None, order=None) -> DataFrame:
    """Distinct sessions per tactic with the number of prefixes of each; empty tactics kept."""
    mapping, order = mapping or TACTIC_FOR, order or TACTIC_ORDER
    dim = spark.createDataFrame([(no, t, sum(1 for x in mapping.values() if x == t)) for no, t in enumerate(order)],
                                "tactic_no int, tactic string, total int")
    table = spark.createDataFrame(list(mapping.items()), "prefix string, tactic string")
    seen = (findings.select("session_id", F.substring("mitre_id", 1, 5).alias("prefix")).distinct()
            .join(F.broadcast(table), "prefix").select("tactic", "session_id").distinct()
            .groupBy("tactic").agg(F.count("*").alias("n")))
    return dim.join(seen, "tactic", "left").select(
        "tactic_no", "tactic", F.coalesce("n", F.lit(0)).alias("sessions"), "total", F.col("n").isNotNull().alias("active"))


def technique_counts(sessions: DataFrame) -> DataFrame:
    return sessions.select(F.explode("technique_set").alias("technique_id")).groupBy("technique_id").agg(
        F.count("*").alias("n"))


def host_rollup(sessions: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Per host: worst tier, session, technique and indicator counts, scores, first and last time."""
    base = sessions.groupBy("host_id").agg(
        F.max(tier_rank(F.col("alert_tier"))).alias("rank"), F.count("*").alias("session_count"),
        F.size(F.array_distinct(F.flatten(F.collect_set("technique_set")))).alias("technique_count"),
        _count(P1).alias("p1_count"), _count(P2).alias("p2_count"), _count(P3).alias("p3_count"),
        F.max("weighted_score").alias("max_score"), F.min("start_time").alias("first_seen"),
        F.max("end_time").alias("last_seen"))
    base = base.withColumn("max_tier", tier_of_rank(F.col("rank")))
    if members is None:
        return base
    iocs = members.select("host_id", "value").distinct().groupBy("host_id").agg(F.count("*").alias("ioc_count"))
    return base.join(iocs, "host_id", "left").withColumn("ioc_count", F.coalesce("ioc_count", F.lit(0)))


def host_order():
    return [F.desc("rank"), F.desc("max_score"), F.asc("host_id")]


def host_risk(sessions: DataFrame, n: int = 12) -> DataFrame:
    rows = sessions.groupBy("host_id").agg(_count(P1).alias("p1"), _count(P2).alias("p2"), _count(P3).alias("p3"),
                                           F.round(F.max("weighted_score"), 1).alias("max_score"))
    return rows.withColumn("risk", F.col("p1") * 3 + F.col("p2") * 2 + F.col("p3")).orderBy(
        F.desc("risk"), "host_id").limit(n)


def bucket_histogram(spark, rows: DataFrame, column: str, buckets) -> DataFrame:
    """Counts per upper-bound bucket, empty buckets kept."""
    no = F
    for i, (high, _) in enumerate(buckets[:-1]):
        no = no.when(F.col(column) < high, i)
    counts = rows.groupBy(no.otherwise(len(buckets) - 1).alias("bucket_no")).agg(F.count("*").alias("n"))
    dim = spark.createDataFrame([(i, label) for i, (_, label) in enumerate(buckets)], "bucket_no int, label string")
    return dim.join(counts, "bucket_no", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def duration_histogram(spark, sessions: DataFrame) -> DataFrame:
    return bucket_histogram(spark, sessions, "duration_seconds", DURATION_BUCKETS)


def score_histogram(spark, sessions: DataFrame) -> DataFrame:
    return bucket_histogram(spark, sessions.withColumn("s", F.round("weighted_score", 1)), "s", SCORE_BUCKETS)


def content_coverage(sessions: DataFrame, covered: DataFrame) -> DataFrame:
    seen = sessions.select(F.explode("technique_set").alias("technique_id")).distinct().join(
        F.broadcast(covered.select("technique_id", F.lit(1).alias("c"))), "technique_id", "left")
    return seen.agg(F.count("c").alias("covered"), F.count("*").alias("total")).withColumn(
        "pct", F.when(F.col("total") > 0, F.round(F.col("covered") / F.col("total") * 100, 1)).otherwise(0.0))


def heat_map(sessions: DataFrame) -> DataFrame:
    """Sessions per weekday (Monday 0) and hour with best score and worst tier."""
    timed = sessions.filter(F.col("start_time").isNotNull())
    return timed.groupBy(F.weekday("start_time").alias("dow"), F.hour("start_time").alias("hour")).agg(
        F.count("*").alias("n"), F.max("weighted_score").alias("max_score"),
        F.max(tier_rank(F.col("alert_tier"))).alias("r")).withColumn("max_tier", tier_of_rank(F.col("r"))).drop("r")


def day_groups(sessions: DataFrame) -> DataFrame:
    """Session rows with the label of their day, ordered by time by the caller."""
    return sessions.filter(F.col("start_time").isNotNull()).select(
        F.to_date("start_time").alias("day"), F.date_format("start_time", "EEEE, MMMM dd yyyy").alias("label"),
        "session_id", "start_time")


def host_timeline(sessions: DataFrame) -> DataFrame:
    """Position of every session on its host's time line in percent, kept within 3 and 97.

    Host bounds come from an aggregate joined back, not from a window over all sessions of a host.
    """
    timed = sessions.filter(F.col("start_time").isNotNull())
    t = F.unix_micros("start_time")
    bounds = timed.groupBy("host_id").agg(F.min(t).alias("t0"), F.max(t).alias("t1"), F.count("*").alias("n"))
    pct = F.when(F.col("n") == 1, 50.0).otherwise(F.greatest(F.lit(3.0), F.least(F.lit(97.0), F.round(
        F.when(F.col("t1") > F.col("t0"), (t - F.col("t0")) / (F.col("t1") - F.col("t0")) * 100).otherwise(50.0), 1))))
    return timed.join(bounds, "host_id").select("host_id", "session_id", pct.alias("pct"), "alert_tier",
                                                F.round("weighted_score").alias("score"), "start_time")


def kill_chain(spark, sessions: DataFrame, stages=None) -> DataFrame:
    """Technique hits per kill-chain stage over all sessions, empty stages kept."""
    stages = KILL_CHAIN if stages is None else stages
    dim = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(stages)], "stage_no int, stage string")
    table = spark.createDataFrame([(i, t) for i, (_, ts) in enumerate(stages) for t in ts],
                                  "stage_no int, technique_id string")
    hits = technique_counts(sessions).join(F.broadcast(table), "technique_id").groupBy("stage_no").agg(
        F.sum("n").alias("hits"))
    return dim.join(hits, "stage_no", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))


def session_stages(sessions: DataFrame, stages=None) -> DataFrame:
    """Kill-chain bar per session: the stages hit, in stage order."""
    stages = KILL_CHAIN if stages is None else stages
    marks = F.array(*[F.when(F.arrays_overlap("technique_set", F.array(*[F.lit(t) for t in ts])), F.lit(n))
                      for n, ts in stages])
    return sessions.select("session_id", F.array_compact(marks).alias("stages"))


def host_nodes(sessions: DataFrame) -> DataFrame:
    """Graph nodes: every host with the tier of its highest-scoring session."""
    return sessions.groupBy("host_id").agg(F.max_by(
        "alert_tier", F.struct(F.col("weighted_score"), tier_rank(F.col("alert_tier")))).alias("tier"))


def beacon_scalars(sessions: DataFrame, members: DataFrame, found: DataFrame) -> DataFrame:
    return sessions.agg(F.count_distinct("host_id").alias("unique_hosts")).withColumn(
        "unique_iocs", members.agg(F.count_distinct("value")).scalar()).withColumn(
        "beacon_count", found.agg(F.count_if("is_beacon")).scalar())


def rule_health(verdicts: DataFrame, now: Column) -> DataFrame:
    """Health of every rule from analyst verdicts (rule_name, ts, is_tp)."""
    recent = F.col("ts") >= now - F.make_dt_interval(days=F.lit(30))
    agg = verdicts.groupBy("rule_name").agg(
        F.count_if(F.col("is_tp") & recent).alias("tp_30d"), F.count_if(~F.col("is_tp") & recent).alias("fp_30d"),
        F.max(F.when(F.col("is_tp"), F.col("ts"))).alias("last_tp"))
    total = F.col("tp_30d") + F.col("fp_30d")
    precision = F.when(total > 0, F.col("tp_30d") / total).otherwise(0.0)
    age = F.coalesce(F.floor((F.unix_micros(now) - F.unix_micros("last_tp")) / 86_400_000_000), F.lit(9999))
    return (agg.withColumn("precision_30d", precision).withColumn("days_since_tp", age)
            .withColumn("health", F.when((F.col("days_since_tp") > 90) & (F.col("tp_30d") == 0), "stale")
                        .when((F.col("precision_30d") < 0.10) & (F.col("fp_30d") > 5), "noisy")
                        .when((F.col("tp_30d") >= 5) & (F.col("precision_30d") >= 0.70), "high_value")
                        .otherwise("nominal")))


def navigator_rows(findings: DataFrame) -> DataFrame:
    """Per mitre id: highest severity, sessions and sorted techniques (findings carry session_id)."""
    part = findings.filter(F.length("mitre_id") > 0).groupBy("mitre_id", "session_id").agg(
        F.max("severity").alias("sev"), F.collect_set("technique_id").alias("t"))
    return part.groupBy("mitre_id").agg(
        F.max("sev").alias("score"), F.count("*").alias("session_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("t")))).alias("rules"))


def rank_all(rows: DataFrame, order: list[Column], leading: list[Column]) -> DataFrame:
    """Every row with its place in the whole order.

    ``leading`` are the first sort keys, or coarser forms of them, with few distinct values: rows are ranked inside each such
    group and the sizes of the groups before are added, so no task sorts all rows."""
    keys = [f"_g{i}" for i in range(len(leading))]
    grouped = rows.withColumns({k: c for k, c in zip(keys, leading, strict=True)})
    sizes = grouped.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = sizes.select(*keys, F.coalesce(F.sum("_n").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = grouped.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return placed.join(before, keys).withColumn("rank", (F.col("_at") + F.col("_before")).cast("int")).drop(*keys, "_at", "_before")


def ranked(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """Top-k report: first ``n`` rows in order, with their rank."""
    return rows.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
