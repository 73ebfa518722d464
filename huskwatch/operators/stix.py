"""STIX object rows: ids, attack patterns, malware, notes, indicators and relationships."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huskwatch.operators.enrich import first_per

TOOL = "huskwatch"


def stix_id(kind: str, seed: Column) -> Column:
    """Repeatable id: the seed's digest laid out as a UUID."""
    def with_digest(h: Column) -> Column:
        return F.concat(F.lit(kind + "--"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in (
            (1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))
    return with_digest(F.sha2(seed, 256))


def ioc_pattern(value: Column) -> Column:
    """STIX pattern of an indicator; NULL when it has none."""
    v = F.trim(value)
    quoted = F.replace(v, F.lit("'"), F.lit("\\'"))

    def form(field: str, text: Column) -> Column:
        return F.concat(F.lit(f"[{field} = '"), text, F.lit("']"))
    return (F.when(v.startswith("http://") | v.startswith("https://"), form("url:value", quoted))
            .when(v.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$"), form("ipv4-addr:value", v))
            .when(v.rlike(r"^[0-9a-fA-F]{64}$"), form("file:hashes.SHA-256", F.lower(v)))
            .when(v.rlike(r"^[0-9a-fA-F]{32}$"), form("file:hashes.MD5", F.lower(v)))
            .when(v.startswith("C:\\") | v.startswith("c:\\"), form("file:name", F.replace(
                F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")))))


def identity(spark) -> DataFrame:
    return spark.range(1).select(F.lit("identity").alias("type"), stix_id("identity", F.lit(TOOL)).alias("id"),
                                 F.lit(TOOL).alias("name"), F.lit("system").alias("identity_class"))


def attack_patterns(findings: DataFrame) -> DataFrame:
    """One row per mitre id, named after the first technique that used it."""
    order = F.struct("host_id", "process_id", "ts", "block_id", "block_number", "rule_no", "pattern_no", "hit_no")
    named = findings.filter(F.length("mitre_id") > 0).groupBy("mitre_id").agg(F.min_by("technique_id", order).alias("technique_id"))
    return named.select(
        F.lit("attack-pattern").alias("type"), stix_id("attack-pattern", F.col("mitre_id")).alias("id"), "mitre_id",
        F.concat(F.lit("MITRE ATT&CK "), "mitre_id", F.lit(": "), "technique_id").alias("name"),
        F.concat(F.lit("https://attack.mitre.org/techniques/"), F.translate("mitre_id", ".", "/")).alias("url"))


def _active(sessions: DataFrame) -> DataFrame:
    return sessions.filter(F.col("alert_tier") != "CLEAN")


def malware(sessions: DataFrame) -> DataFrame:
    techs = F.array_join("technique_set", ", ")
    return _active(sessions).select(
        F.lit("malware").alias("type"), stix_id("malware", F.col("session_id")).alias("id"), "session_id",
        F.concat(F.lit("Session "), "session_id").alias("name"), F.lit(False).alias("is_family"),
        F.concat(F.lit("Tier: "), "alert_tier", F.format_string(" | Score: %.0f/100 | Host: ", F.col("weighted_score")), "host_id",
                 F.lit(" | Techniques: "), techs).alias("description"))


def notes(sessions: DataFrame, members: DataFrame, beacons: DataFrame | None = None) -> DataFrame:
    counts = members.groupBy("session_id").agg(F.count("*").alias("ioc_n"))
    rows = _active(sessions).join(counts, "session_id", "left")
    line = F.lit(None).cast("string")
    if beacons is not None:
        rows = rows.join(beacons.filter("is_beacon").select("session_id", "period_seconds", "jitter_pct", "confidence"), "session_id", "left")
        line = F.format_string("Beacon: period=%ss jitter=%.1f%% conf=%.0f%%", F.col("period_seconds").cast("string"),
                               F.col("jitter_pct") * 100, F.col("confidence") * 100)
        line = F.when(F.col("period_seconds").isNotNull(), line)
    content = F.concat_ws(
        "\n", F.concat(F.lit("Session ID: "), "session_id"), F.concat(F.lit("Host: "), "host_id"),
        F.concat(F.lit("Alert Tier: "), "alert_tier"), F.format_string("Score: %.1f/100", F.round(F.round("weighted_score", 6), 1)),
        F.concat(F.lit("Blocks: "), F.col("block_count").cast("string")),
        F.concat(F.lit("IOC count: "), F.coalesce("ioc_n", F.lit(0)).cast("string")),
        F.concat(F.lit("Techniques: "), F.when(F.size("technique_set") > 0, F.array_join("technique_set", ", ")).otherwise("none")), line)
    return rows.select(F.lit("note").alias("type"), stix_id("note", F.concat("session_id", F.lit("-note"))).alias("id"),
                       content.alias("content"), F.array(stix_id("malware", F.col("session_id"))).alias("object_refs"))


def session_indicators(sessions: DataFrame, members: DataFrame, n: int | None = None) -> DataFrame:
    """Indicators of every exported session that have a pattern: all, or the first ``n`` by value of each."""
    listed = members.select("session_id", "value")
    if n is not None:
        listed = first_per(listed, ["session_id"], [F.col("value")], n).drop("rank")
    return listed.join(_active(sessions).select("session_id"), "session_id", "left_semi").withColumn(
        "pattern", ioc_pattern(F.col("value"))).filter(F.col("pattern").isNotNull())


def indicators(listed: DataFrame) -> DataFrame:
    return listed.select("value", "pattern").distinct().select(
        F.lit("indicator").alias("type"), stix_id("indicator", F.col("value")).alias("id"), F.left("value", F.lit(120)).alias("name"), "pattern")


def relationships(findings: DataFrame, sessions: DataFrame, listed: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """uses, indicates and variant-of edges; the id derives from the triple."""
    active = _active(sessions).select("session_id")
    mal = stix_id("malware", F.col("session_id"))
    uses = findings.select("session_id", "mitre_id").filter(F.length("mitre_id") > 0).distinct().join(active, "session_id", "left_semi").select(
        mal.alias("source_ref"), F.lit("uses").alias("relationship_type"), stix_id("attack-pattern", F.col("mitre_id")).alias("target_ref"))
    indicates = listed.select(stix_id("indicator", F.col("value")).alias("source_ref"), F.lit("indicates").alias("relationship_type"), mal.alias("target_ref"))
    edges = uses.unionByName(indicates)
    if hits is not None:
        known = hits.filter(F.length("malware_name") > 0).join(active, "session_id", "left_semi").select(
            mal.alias("source_ref"), F.lit("variant-of").alias("relationship_type"), known_id().alias("target_ref")).distinct()
        edges = edges.unionByName(known)
    return edges.withColumn("type", F.lit("relationship")).withColumn(
        "id", stix_id("relationship", F.concat_ws("-", "source_ref", "relationship_type", "target_ref")))


def known_id() -> Column:
    return stix_id("malware", F.concat("malware_name", F.lit("-known")))


def known_malware(sessions: DataFrame, hits: DataFrame) -> DataFrame:
    """Known malware families named by feed hits, one row per id."""
    rows = hits.filter(F.length("malware_name") > 0).join(_active(sessions).select("session_id"), "session_id", "left_semi")
    return rows.groupBy("malware_name").agg(F.min("source").alias("source")).select(
        F.lit("malware").alias("type"), known_id().alias("id"), F.col("malware_name").alias("name"), F.lit(True).alias("is_family"),
        F.concat(F.lit("Source: "), "source").alias("description"))


def bundle(*objects: DataFrame) -> DataFrame:
    """All objects as JSON rows (one object per row)."""
    out = None
    for o in objects:
        rows = o.select("id", "type", F.to_json(F.struct(F.lit("2.1").alias("spec_version"), *[F.col(c) for c in o.columns if c not in (
            "session_id", "mitre_id")])).alias("object"))
        out = rows if out is None else out.unionByName(rows)
    return out
