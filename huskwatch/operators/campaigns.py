"""Style fingerprints and the campaigns they form."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huskwatch.functions.style import combine_profiles, join_style


def session_fingerprints(rows: DataFrame, slice_seconds: int = 60) -> DataFrame:
    """Fingerprint of every session from the style columns of its block rows.

    Two levels: time slices of a session first, then the slices, so that a session with very many
    blocks is never gathered in one list.  Undated blocks stand in the order of their ids and are sliced by
    the first characters of those.
    """
    head = F.when(F.col("ts").isNull(), F.substring("block_id", 1, 4)).otherwise("")
    ordered = F.array_sort(F.collect_list(F.struct("ts", "block_id", "block_number", "parens")))
    part = rows.groupBy("session_id", "host_id", F.floor(F.unix_seconds("ts") / slice_seconds).alias("slice"), head.alias("head")).agg(
        F.count("*").alias("n"), F.sum("raw_chars").alias("chars"), F.sum("ticks").alias("ticks"),
        F.sum("calls").alias("calls"), F.min("join_rank").alias("join_rank"), F.max("slots").alias("slots"),
        F.array_distinct(F.flatten(F.collect_set("char_codes"))).alias("codes"),
        F.array_distinct(F.flatten(F.collect_set("b64_runs"))).alias("runs"),
        combine_profiles(F.transform(ordered, lambda x: x.getField("parens"))).alias("profile"))
    whole = part.groupBy("session_id", "host_id").agg(
        (F.sum("chars") + F.sum("n") - 1).alias("chars"), F.sum("ticks").alias("ticks"),
        F.sum("calls").alias("calls"), F.min("join_rank").alias("join_rank"), F.max("slots").alias("slots"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("codes")))).alias("char_code_offsets"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("runs")))).alias("base64_chunk_sizes"),
        combine_profiles(F.transform(F.array_sort(F.collect_list(F.struct("slice", "head", "profile"))),
                                     lambda x: x.getField("profile"))).alias("p"))
    return whole.select(
        "session_id", "host_id", "base64_chunk_sizes", "char_code_offsets",
        F.least(F.col("calls"), F.col("p.rise")).cast("int").alias("iex_nesting_depth"),
        F.col("p.rise").alias("paren_depth"),
        join_style(F.col("join_rank")).alias("string_join_style"),
        F.when(F.col("chars") > 0, F.col("ticks") / F.col("chars") * 100).otherwise(0.0).alias("backtick_density"),
        F.col("slots").alias("format_string_slots")).withColumn("fingerprint", fingerprint_hash())


def fingerprint_hash():
    """16 hex digits over the canonical text of the style fields (run lengths are left out)."""
    text = F.concat_ws("|", F.array_join(F.transform("char_code_offsets", lambda c: c.cast("string")), ","),
                       F.col("iex_nesting_depth").cast("string"),
                       F.coalesce("string_join_style", F.lit("none")),
                       F.format_string("%.1f", F.round("backtick_density", 1)),
                       F.col("format_string_slots").cast("string"))
    return F.substring(F.sha2(text, 256), 1, 16)


def tag_sessions(sessions: DataFrame, prints: DataFrame, min_score: float = 20) -> DataFrame:
    """Add fingerprint and campaign_id to sessions scoring above ``min_score`` (NULL for others)."""
    joined = sessions.join(prints.select("session_id", F.col("fingerprint").alias("_print")), "session_id", "left")
    tagged = joined.withColumn("fingerprint", F.when(F.col("weighted_score") > min_score, F.col("_print"))).drop("_print")
    return tagged.withColumn("campaign_id", F.substring("fingerprint", 1, 8))


def campaigns(tagged: DataFrame) -> DataFrame:
    """One row per fingerprint: sizes, first and last start, peak severity, confirmation."""
    grouped = tagged.filter(F.col("fingerprint").isNotNull())
    per_host = grouped.groupBy("fingerprint", "campaign_id", "host_id").agg(
        F.count("*").alias("n"), F.min("start_time").alias("t0"), F.max("start_time").alias("t1"),
        F.max("max_severity").alias("peak"))
    return (per_host.groupBy("fingerprint", "campaign_id").agg(
        F.sum("n").alias("session_count"), F.count("*").alias("host_count"), F.min("t0").alias("first_seen"),
        F.max("t1").alias("last_seen"), F.max("peak").alias("peak_severity"))
        .withColumn("is_confirmed", (F.col("host_count") >= 2) & (F.col("session_count") >= 3)))


def campaign_order():
    return [F.desc("is_confirmed"), F.desc("peak_severity"), F.asc("campaign_id")]
