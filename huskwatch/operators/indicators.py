"""Indicator operators: per-session indicators, the hub, graph edges, credentials."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from huskwatch.functions.scoring import tier_of_rank, tier_rank
from huskwatch.functions.text import clean, ioc_type


def session_iocs(rows: DataFrame) -> DataFrame:
    """Distinct (session_id, host_id, value) from stitched block rows."""
    return (rows.select("session_id", "host_id", F.explode_outer("iocs").alias("value"))
            .withColumn("value", clean(F.col("value")))
            .filter(F.length("value") > 0).distinct())


def ioc_hub(members: DataFrame) -> DataFrame:
    """One row per indicator value: type and number of sessions."""
    return (members.groupBy("value").agg(F.count("*").alias("session_count"))
            .withColumn("ioc_type", ioc_type(F.col("value"))))


def hub_order():
    return [F.desc("session_count"), F.asc("ioc_type"), F.asc("value")]


def hub_members(members: DataFrame) -> DataFrame:
    """(value, ioc_type, session_count, session_id): the hub entry of every member, one row each at any size."""
    return members.select("value", "session_id").join(ioc_hub(members), "value").select("value", "ioc_type", "session_count", "session_id")


def hub_lists(members: DataFrame) -> DataFrame:
    """Hub rows with their sorted session ids in one list, for callers that know their values to be in few sessions."""
    return members.groupBy("value").agg(F.count("*").alias("session_count"), F.array_sort(F.collect_list("session_id")).alias("sessions")).withColumn(
        "ioc_type", ioc_type(F.col("value")))


def type_counts(hub: DataFrame) -> DataFrame:
    """Counts of the four exported types, zeros kept, as one row."""
    return hub.agg(*[F.count_if(F.col("ioc_type") == t).alias(t) for t in ("url", "ip", "hash", "path")])


def hub_nodes(members: DataFrame, sessions: DataFrame, top: int = 50) -> DataFrame:
    """First hub entries with the highest alert tier among their sessions."""
    head = ioc_hub(members).orderBy(*hub_order()).limit(top)
    ranked = (members.join(F.broadcast(head), "value")          # head: at most ``top`` rows
              .join(sessions.select("session_id", tier_rank(F.col("alert_tier")).alias("rank")), "session_id"))
    return (ranked.groupBy("value", "ioc_type", "session_count").agg(F.max("rank").alias("rank"))
            .withColumn("max_tier", tier_of_rank(F.col("rank"))).drop("rank"))


def cooccurrence(members: DataFrame, top: int = 35, max_nodes: int = 20) -> DataFrame:
    """Edges between hub entries that share a session: candidates are the first ``top`` entries,
    nodes the first ``max_nodes`` connected ones.  A session holds at most ``top`` candidates."""
    order = Window.orderBy(*hub_order())
    head = (ioc_hub(members).orderBy(*hub_order()).limit(top)
            .withColumn("no", F.row_number().over(order)).select("value", "no"))
    sets = members.join(F.broadcast(head), "value").groupBy("session_id").agg(
        F.array_sort(F.collect_set("no")).alias("nos"))
    pairs = (sets.select(F.explode(F.flatten(F.transform("nos", lambda a: F.transform(
        F.filter("nos", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("e"))
        .select("e.a", "e.b").distinct())
    nodes = (pairs.select(F.explode(F.array("a", "b")).alias("no")).distinct()
             .orderBy("no").limit(max_nodes).join(F.broadcast(head), "no"))
    left = nodes.select(F.col("no").alias("a"), F.col("value").alias("value_a"))
    right = nodes.select(F.col("no").alias("b"), F.col("value").alias("value_b"))
    return pairs.join(F.broadcast(left), "a").join(F.broadcast(right), "b").select("value_a", "value_b")


def shared_infrastructure(members: DataFrame, max_nodes: int = 30) -> DataFrame:
    """Edges between hub entries with an equal session count above one (first ``max_nodes``)."""
    order = Window.orderBy(*hub_order())
    nodes = (ioc_hub(members).filter(F.col("session_count") > 1).orderBy(*hub_order()).limit(max_nodes)
             .withColumn("no", F.row_number().over(order)))
    a = nodes.select("session_count", F.col("no").alias("a"), F.col("value").alias("value_a"))
    b = nodes.select("session_count", F.col("no").alias("b"), F.col("value").alias("value_b"))
    return a.join(b, "session_count").filter(F.col("a") < F.col("b")).select("value_a", "value_b", "session_count")


def first_credentials(rows: DataFrame) -> DataFrame:
    """First occurrence of every marked plaintext credential."""
    seen = (rows.select("session_id", "host_id", "process_id", "ts", "block_id",
                        F.posexplode_outer("creds").alias("pos", "value")).filter(F.col("value").isNotNull()))
    order = F.struct("host_id", "process_id", "ts", "block_id", "pos")
    return (seen.groupBy("value").agg(F.min_by(
        F.struct("session_id", "host_id", "block_id", "ts"), order).alias("f"))
        .select("value", "f.session_id", "f.host_id", "f.block_id", "f.ts"))
