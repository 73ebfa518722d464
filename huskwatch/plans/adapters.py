"""Adapters from the given tables to the shapes the operators take."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huskwatch.catalog.rules import Rule
from huskwatch.functions.text import shannon_entropy

EPOCH = "2024-01-01 00:00:00"

# Rules for the prose and web-page texts of the given tables.  They borrow technique and mitre ids
# so that chains, tactics and stages have something to work on.
DOC_RULES = [
    Rule("doc_token", "AMSI_BYPASS_REFLECT", "T1562.001", 60, (r"PLAINTEXT_CRED:[0-9a-f]+", r"MIT License")),
    Rule("doc_url", "DOWNLOAD_CRADLE_WC", "T1105", 25, (r"https?://[a-z0-9.]+/", r"[0-9]+@mail[0-9]+\.example\.com")),
    Rule("doc_address", "LATERAL_PSREMOTING", "T1021.006", 35, (r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",)),
    Rule("doc_gpl", "COBALT_STRIKE", "T1059.001", 90, (r"GNU General",)),
    Rule("doc_shout", "IEX_EXEC", "T1059.001", 20, (r"[a-z]{6,}!!",)),
    Rule("doc_phone", "LOLBIN_CERTUTIL", "T1140", 75, (r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}",)),
    Rule("doc_card", "LOLBIN_MSHTA", "T1218.005", 40, (r"[0-9]{16}",)),
    Rule("doc_share", "WMIC_REMOTE_EXEC", "T1047", 80, (r"CC BY",)),
    Rule("doc_dollar", "CRED_HARVEST", "T1003.001", 45, (r"\$\$\$ [a-z]",)),
    Rule("doc_mark", "SCHTASK_CREATE", "T1053.005", 30, (r"### [a-z0-9]",)),
    Rule("doc_nav", "REG_PERSIST", "T1547.001", 15, (r"<nav>",)),
    Rule("doc_markup", "MARKUP_SCRIPT", "T1204.002", 10, (r"<script>",)),
    Rule("doc_phrase", "EXEC_POLICY_BYPASS", "T1059.001", 12, (r" that th[a-z]+",)),
]
DOC_BLOB_ENTROPY, DOC_BONUS_ENTROPY = 4.35, 4.45
DOC_GAP, DAY = 4000, 86400
ACTIVITY_GAP = 4 * 3600


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Give an input with fewer splits than cores one cheap round-robin shuffle, so that the text
    work is not stuck in one task.  Inputs with enough splits (any large one) stay as scanned."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def at(seconds):
    return F.timestamp_micros(F.unix_micros(F.lit(EPOCH).cast("timestamp")) + seconds.cast("bigint") * 1_000_000)


def doc_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and web pages as script blocks.  Every fourth document carries backticks in its raw
    text; the decoded text is without them and has secret tokens marked."""
    docs = table(spark, folder, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("block_id"), F.col("source").alias("host_id"),
        (F.floor(F.col("doc_id") / 20) % 6).cast("int").alias("process_id"),
        at(F.col("doc_id") * 37 + F.col("doc_id") * F.col("doc_id") % 4001).alias("ts"),
        F.concat(F.lit("C:\\data\\"), "lang", F.lit("\\"), "source", F.lit(".txt")).alias("path"),
        F.when(F.col("doc_id") % 4 == 0, F.replace("text", F.lit("y"), F.lit("`y"))).otherwise(F.col("text")).alias("raw_text"), "text")
    pages = table(spark, folder, "pages").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("block_id"),
        F.concat(F.lit("src"), (F.col("page_id") % 20).cast("string")).alias("host_id"),
        (F.floor(F.col("page_id") / 20) % 6).cast("int").alias("process_id"),
        at(F.col("page_id") * 149 + F.col("page_id") * F.col("page_id") % 4001).alias("ts"),
        F.lit("").alias("path"), F.concat("url", F.lit("\n"), "html").alias("raw_text"),
        F.concat("url", F.lit("\n"), "html").alias("text"))
    both = spread(docs).unionByName(spread(pages))
    return both.select(
        "block_id", F.lit(1).alias("block_number"), F.lit(1).alias("block_total"), "host_id", "process_id",
        F.lit(0).alias("thread_id"), "ts", "path", "raw_text",
        F.regexp_replace("text", 'token = "([0-9a-f]+)"', "[PLAINTEXT_CRED:$1]").alias("decoded_text"),
        shannon_entropy(F.col("raw_text")).alias("entropy"))


def turn_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as numbered parts; conversations divisible by three miss a part."""
    turns = table(spark, folder, "conversations")
    total = turns.groupBy("conv_id").agg((F.max("turn") + 1 + F.when(F.col("conv_id") % 3 == 0, 1).otherwise(0)).alias("total"))
    return turns.join(total, "conv_id").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("block_id"),
        (F.col("turn") + 1).cast("int").alias("block_number"), F.col("total").cast("int").alias("block_total"),
        F.concat(F.lit("h"), (F.col("conv_id") % 7).cast("string")).alias("host_id"), F.lit(0).alias("process_id"),
        F.lit(0).alias("thread_id"), at(F.col("conv_id") * 60 + F.col("turn")).alias("ts"), F.col("role").alias("path"),
        F.col("text").alias("raw_text"), F.replace("text", F.lit("e"), F.lit("E")).alias("decoded_text"), F.lit(0.0).alias("entropy"))


def activity(spark: SparkSession, folder: str) -> DataFrame:
    """Events as already classified rows: one technique and a severity each."""
    return table(spark, folder, "events").select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("block_id"), F.lit(1).alias("block_number"),
        F.col("user_id").cast("string").alias("host_id"), F.lit(0).alias("process_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.floor(F.least(F.lit(100.0), "value")).cast("int").alias("severity"),
        F.array("event_type").alias("techniques"), (F.col("event_type") == "error").alias("changed"))


def process_events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        (F.lit(4688) + F.col("event_id") % 3).alias("event_id"),
        F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("host_id"),
        F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 5).cast("int").alias("process_id"),
        F.concat("event_type", F.lit("_"), F.col("event_id").cast("string")).alias("process_name"))


def logon_events(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a logon: views as 4624, errors as 4625, all others as 4648."""
    return table(spark, folder, "events").select(
        F.when(F.col("event_type") == "view", 4624).when(F.col("event_type") == "error", 4625).otherwise(4648).cast("bigint").alias("event_id"),
        F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("host_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("src"), (F.col("event_id") % 23).cast("string")).alias("target_host"),
        F.concat(F.lit("u"), F.col("event_id").cast("string")).alias("username"))


def verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Analyst verdicts per rule from events: spread over several weeks."""
    return table(spark, folder, "events").select(
        F.concat("event_type", F.lit("_"), (F.col("user_id") % 9).cast("string")).alias("rule_name"),
        F.col("ts").cast("timestamp").alias("ts"), (F.col("value") > 3 * (F.col("user_id") % 9 + 1)).alias("is_tp"))


def ip_ranges(spark: SparkSession) -> DataFrame:
    """One row per /8 range."""
    return spark.range(256).select((F.col("id") * 16777216).alias("low"), ((F.col("id") + 1) * 16777216 - 1).alias("high"),
                                   F.concat(F.lit("zone"), (F.col("id") % 7).cast("string")).alias("country"))


def feed_from(values: DataFrame) -> DataFrame:
    """Threat feed made of indicator values: two of three are listed, source by type and length."""
    n = F.length("value")
    source = (F.when(n % 3 == 0, "threatfox").when(F.col("value").rlike("^https?://"), "urlhaus")
              .when(F.col("value").rlike("^[0-9a-f]{32,64}$"), "malwarebazaar").otherwise("threatfox"))
    base = values.select("value").distinct()
    second = base.filter(n % 2 == 0).select("value", F.lit("threatfox").alias("source"),
                                            F.lit("second").alias("malware_name"))
    return base.filter(n % 3 != 1).select("value", source.alias("source"), F.concat(
        F.lit("fam"), (n % 5).cast("string")).alias("malware_name")).unionByName(second)
