"""Joins that enrich sessions: processes, logons, lateral moves, feeds, geography, triage."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huskwatch.catalog.lookups import LATERAL_TECHNIQUES, TACTIC_FOR
from huskwatch.functions.net import ip_to_long, is_public
from huskwatch.functions.text import feed_ioc_type


def process_names(sessions: DataFrame, processes: DataFrame) -> DataFrame:
    """parent_process of every session: name in the last process event of its (host, pid)."""
    last = processes.groupBy("host_id", "process_id").agg(
        F.max_by("process_name", F.struct("ts", "event_id", "process_name")).alias("parent_process"))
    return sessions.join(last, ["host_id", "process_id"], "left").withColumn(
        "parent_process", F.coalesce("parent_process", F.lit("")))


def host_event_ids(*tables: DataFrame) -> DataFrame:
    """Sorted distinct event ids seen per host over several event tables (a handful per host)."""
    rows = tables[0].select("host_id", "event_id")
    for t in tables[1:]:
        rows = rows.unionByName(t.select("host_id", "event_id"))
    return rows.groupBy("host_id").agg(F.array_sort(F.collect_set("event_id")).alias("event_ids_seen"))


def first_per(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows per key with their rank.  Spark cuts each task's rows to ``n`` per key
    before the shuffle, so hot keys stay small."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(
        F.col("rank") <= n)


def host_processes(processes: DataFrame, n: int = 50) -> DataFrame:
    return first_per(processes, ["host_id"], [F.col("ts"), F.col("process_id"), F.col("process_name")], n)


def session_logons(sessions: DataFrame, logons: DataFrame, margin_seconds: int = 300, n: int = 30,
                   bucket_seconds: int = 300) -> DataFrame:
    """Logons on the session's host within ``margin_seconds`` of the session, first ``n`` per session.

    Both sides meet on (host, time bucket), so a busy host spreads over many keys.  Of a bucket that
    a session enters at its start only the first ``n`` logons can be among the session's first
    ``n``; only the bucket in which the session's window begins is looked at whole.
    """
    order = [F.col("ts"), F.col("username"), F.col("target_host")]
    low = F.col("start_time") - F.make_dt_interval(secs=F.lit(margin_seconds))
    high = F.col("end_time") + F.make_dt_interval(secs=F.lit(margin_seconds))
    windows = (sessions.filter(F.col("start_time").isNotNull())
               .select("session_id", "host_id", low.alias("low"), high.alias("high"))
               .withColumn("first_bucket", F.floor(F.unix_seconds("low") / bucket_seconds))
               .withColumn("bucket", F.explode(F.sequence("first_bucket", F.floor(F.unix_seconds("high") / bucket_seconds)))))
    events = logons.withColumn("bucket", F.floor(F.unix_seconds("ts") / bucket_seconds)).withColumn(
        "place", F.row_number().over(Window.partitionBy("host_id", "bucket").orderBy(*order)))
    hits = windows.join(events, ["host_id", "bucket"]).filter(
        ((F.col("place") <= n) | (F.col("bucket") == F.col("first_bucket"))) & F.col("ts").between(F.col("low"), F.col("high")))
    return first_per(hits.drop("bucket", "first_bucket", "place", "low", "high"), ["session_id"], order, n)


def _sides(sessions: DataFrame, known: dict, before: int, after: int) -> tuple[DataFrame, DataFrame]:
    """Sources (one row per lateral technique) and targets of moves, times in microseconds, with the time buckets in which they
    can meet: a bucket is as wide as the window, so a target lies in one and a source covers at most three."""
    width = (before + after) * 1_000_000
    timed = sessions.filter(F.col("start_time").isNotNull()).select(
        "session_id", "host_id", F.unix_micros("start_time").alias("start"), F.unix_micros("end_time").alias("end"),
        F.array_intersect("technique_set", F.array(*[F.lit(k) for k in known])).alias("techs"))
    reach = F.sequence(F.floor((F.col("end") - before * 1_000_000) / width), F.floor((F.col("end") + after * 1_000_000) / width))
    sources = timed.filter(F.size("techs") > 0).withColumn("technique", F.explode("techs")).withColumn("bucket", F.explode(reach)).drop("techs")
    return sources, timed.select("session_id", "host_id", "start", F.floor(F.col("start") / width).alias("bucket"))


def _dealt(sources: DataFrame, targets: DataFrame, share: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with (bucket, i, j): part i of a bucket's sources meets part j of its targets, about ``share`` rows each, whatever
    hosts they belong to. A bucket that lacks one side goes."""
    sizes = (sources.select("bucket", F.lit(1).alias("s"), F.lit(0).alias("t")).unionByName(targets.select("bucket", F.lit(0).alias("s"), F.lit(1).alias("t")))
             .groupBy("bucket").agg(F.ceil(F.sum("s") / share).alias("n_i"), F.ceil(F.sum("t") / share).alias("n_j")).filter("n_i > 0 and n_j > 0"))

    def part(rows: DataFrame, own: str, other: str) -> DataFrame:
        mine, theirs = F.pmod(F.xxhash64("session_id"), F.col(f"n_{own}")), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"n_{other}") - 1))
        return rows.join(sizes, "bucket").withColumn(own, mine).withColumn(other, theirs).drop("n_i", "n_j")
    return part(sources, "i", "j"), part(targets, "j", "i")


def _labelled(rows: DataFrame, known: dict) -> DataFrame:
    label = F.create_map(*[F.lit(x) for k, (m, text) in known.items() for x in (k, f"{m}|{text}")])
    both = F.split(F.try_element_at(label, F.col("technique")), r"\|")
    return rows.withColumn("mitre_id", both[0]).withColumn("evidence", both[1])


def lateral_moves(sessions: DataFrame, techniques: dict | None = None, before: int = 60, after: int = 1800, share: int = 10_000) -> DataFrame:
    """Moves between hosts: the source session holds a lateral technique and a session on another
    host starts between ``before`` seconds before and ``after`` seconds after the source ends, later
    in (start, session id) order.

    One row per pair and technique, which is what the table is; lateral_first() and lateral_counts() make no pairs.
    """
    known = LATERAL_TECHNIQUES if techniques is None else techniques
    sources, targets = _dealt(*_sides(sessions, known, before, after), share)
    sources = sources.withColumnsRenamed({"session_id": "source_session", "host_id": "source_host", "start": "src_start"})
    targets = targets.withColumnsRenamed({"session_id": "target_session", "host_id": "target_host", "start": "dst_start"})
    delta = F.col("dst_start") - F.col("end")
    later = F.struct("dst_start", "target_session") > F.struct("src_start", "source_session")
    pairs = sources.join(targets, ["bucket", "i", "j"]).filter(
        (F.col("source_host") != F.col("target_host")) & later & delta.between(-before * 1_000_000, after * 1_000_000))
    return _labelled(pairs.select(
        "source_session", "target_session", "source_host", "target_host", F.timestamp_micros("dst_start").alias("ts"),
        F.struct(F.timestamp_micros("src_start").alias("start_time"), F.col("source_session").alias("session_id")).alias("src_order"), "technique"), known)


def lateral_edges(moves: DataFrame) -> DataFrame:
    """Distinct (source host, target host, technique) of a table of moves with the first move of each.

    A plain aggregate: rows are reduced in the task that reads them. From sessions, lateral_first() gives the same without moves.
    """
    first = F.min(F.struct("src_order", "ts", "target_session", "mitre_id", "evidence")).alias("f")
    return moves.groupBy("source_host", "target_host", "technique").agg(first).select(
        "source_host", "target_host", "technique", "f.mitre_id", "f.evidence", "f.ts")


def _first_targets(before: int, after: int, flush: int = 50_000) -> Callable:
    """One (bucket, i, j): for every host among the targets, the next of its starts from each source's place on, by binary search;
    of each (source host, technique) the first source that reaches the host, and the last start that any of them reaches."""
    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).sort_by([("start", "ascending"), ("session_id", "ascending"), ("is_source", "ascending")])
        is_source = rows["is_source"].to_numpy()
        sources, targets = rows.filter(pa.array(is_source)), rows.filter(pa.array(~is_source))
        starts, end = targets["start"].to_numpy(), sources["end"].to_numpy()
        low = np.maximum(np.cumsum(~is_source)[is_source], np.searchsorted(starts, end - before * 1_000_000, "left"))
        high = np.searchsorted(starts, end + after * 1_000_000, "right")
        hosts = pa.chunked_array([*sources["host_id"].chunks, *targets["host_id"].chunks], pa.string()).combine_chunks().dictionary_encode().indices.to_numpy()
        own, theirs = hosts[:len(sources)].astype(np.int64), hosts[len(sources):]
        technique = sources["technique"].combine_chunks().dictionary_encode()
        kind = own * len(technique.dictionary) + technique.indices.to_numpy()
        order = np.argsort(theirs, kind="stable")
        cuts = np.flatnonzero(np.diff(theirs[order])) + 1
        found: list[np.ndarray] = []
        held = 0

        def packed() -> pa.RecordBatch:
            src, dst, last = np.concatenate(found, axis=1)
            s, t = sources.take(pa.array(src)), targets.take(pa.array(dst))
            columns = {"source_host": s["host_id"], "target_host": t["host_id"], "technique": s["technique"], "src_start": s["start"], "source_session": s["session_id"],
                       "dst_start": t["start"], "target_session": t["session_id"], "last": pa.array(starts[last])}
            return pa.table(columns).combine_chunks().to_batches()[0]

        for places in np.split(order, cuts) if len(order) else []:
            at = np.searchsorted(places, low)
            upto = np.searchsorted(places, high)
            src = np.flatnonzero((at < upto) & (own != theirs[places[0]]))
            if not len(src):
                continue
            _, first, group = np.unique(kind[src], return_index=True, return_inverse=True)
            last = np.zeros(len(first), np.int64)
            np.maximum.at(last, group, places[upto[src] - 1])
            found.append(np.stack([src[first], places[at[src[first]]], last]))
            held += len(first)
            if held >= flush:
                yield packed()
                found, held = [], 0
        if found:
            yield packed()
    return reach


def lateral_first(sessions: DataFrame, techniques: dict | None = None, before: int = 60, after: int = 1800, share: int = 10_000) -> DataFrame:
    """lateral_edges(lateral_moves(sessions)) with ``last_ts``, the latest target start of the edge, without making the moves.

    Parts of a time bucket's sources and targets meet in one task of at most about twice ``share`` rows, which gives one row per
    (source host, target host, technique); the rows of an edge from several parts and buckets are reduced before the shuffle.
    A task's rows are dealt out by session, so a host with a large share of all sessions spreads."""
    known = LATERAL_TECHNIQUES if techniques is None else techniques
    sources, targets = _dealt(*_sides(sessions, known, before, after), share)
    both = sources.withColumn("is_source", F.lit(True)).unionByName(targets.withColumn("is_source", F.lit(False)), allowMissingColumns=True)
    schema = "source_host string, target_host string, technique string, src_start bigint, source_session string, dst_start bigint, target_session string, last bigint"
    found = both.groupBy("bucket", "i", "j").applyInArrow(_first_targets(before, after), schema)
    edges = found.groupBy("source_host", "target_host", "technique").agg(
        F.min(F.struct("src_start", "source_session", "dst_start", "target_session")).alias("f"), F.max("last").alias("last"))
    return _labelled(edges, known).select("source_host", "target_host", "technique", "mitre_id", "evidence",
                                          F.timestamp_micros("f.dst_start").alias("ts"), F.timestamp_micros("last").alias("last_ts"))


def _starts_upto(starts: DataFrame, asked: DataFrame, keys: list[str], slot: int = 10, page: int = 6000) -> DataFrame:
    """asked (session_id, sign, keys, at, id) with ``upto``: how many starts have (at, id) up to the asked place, per ``keys``.

    Running counts in three steps: pages of time slots, slots of a page, rows of a slot. No task sees more than the pages, the
    slots of one page, or the rows of one slot of ``slot`` seconds."""
    marks = starts.select(*keys, "at", "id", F.lit(1).alias("one"), F.lit(None).cast("string").alias("session_id"), F.lit(0).alias("sign"))
    marks = marks.unionByName(asked.select(*keys, "at", "id", F.lit(0).alias("one"), "session_id", "sign"))
    marks = marks.withColumn("slot", F.floor(F.col("at") / (slot * 1_000_000))).withColumn("page", F.floor(F.col("slot") / page))
    slots = marks.groupBy(*keys, "page", "slot").agg(F.sum("one").alias("n"))
    pages = slots.groupBy(*keys, "page").agg(F.sum("n").alias("n"))

    def earlier(by: list[str], order: str) -> Column:
        w = Window.partitionBy(*by).orderBy(order) if by else Window.orderBy(order)
        return F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pages = pages.select(*keys, "page", earlier(keys, "page").alias("pages_before"))
    slots = slots.select(*keys, "page", "slot", earlier([*keys, "page"], "slot").alias("slots_before"))
    inside = Window.partitionBy(*keys, "page", "slot").orderBy("at", "id").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    placed = marks.withColumn("n", F.sum("one").over(inside)).filter("one = 0")
    return (placed.join(slots, [*keys, "page", "slot"]).join(pages, [*keys, "page"])
            .select("session_id", "sign", (F.col("n") + F.col("slots_before") + F.col("pages_before")).alias("upto")))


def lateral_counts(sessions: DataFrame, techniques: dict | None = None, before: int = 60, after: int = 1800) -> DataFrame:
    """Number of lateral_moves() rows per source session, without making them.

    The sessions that start inside a source's window are a difference of two running counts, over all hosts less those on
    its own host; every one of them counts once for each lateral technique of the source."""
    known = LATERAL_TECHNIQUES if techniques is None else techniques
    timed = sessions.filter(F.col("start_time").isNotNull())
    starts = timed.select("host_id", F.unix_micros("start_time").alias("at"), F.col("session_id").alias("id"))
    end = F.unix_micros("end_time")
    src = (timed.withColumn("n_techs", F.size(F.array_intersect("technique_set", F.array(*[F.lit(k) for k in known]))))
           .filter("n_techs > 0").select("session_id", "host_id", "n_techs", F.unix_micros("start_time").alias("start"), end.alias("end")))
    last = F.col("end") + after * 1_000_000
    first = F.col("end") - before * 1_000_000
    # Up to the window's end, less up to its beginning: the source itself, or all that start before it where that is later.
    bounds = F.array(F.struct(F.lit(1).alias("sign"), last.alias("at"), F.lit("\U0010ffff").alias("id")),
                     F.struct(F.lit(-1).alias("sign"), F.greatest("start", first - 1).alias("at"),
                              F.when(F.col("start") >= first, F.col("session_id")).otherwise("\U0010ffff").alias("id")))
    asked = src.select("session_id", "host_id", F.explode(bounds).alias("b")).select("session_id", "host_id", "b.*")
    every = _starts_upto(starts.drop("host_id"), asked.drop("host_id"), [])
    same = _starts_upto(starts, asked, ["host_id"]).withColumn("sign", -F.col("sign"))
    found = every.unionByName(same).groupBy("session_id").agg(F.sum(F.col("sign") * F.col("upto")).alias("targets"))
    return (src.join(found, "session_id").filter("targets > 0")
            .select("session_id", (F.col("targets") * F.col("n_techs")).cast("bigint").alias("lateral_move_count")))


def hop_degree(edges: DataFrame) -> DataFrame:
    return (edges.select(F.explode(F.array_distinct(F.array("source_host", "target_host"))).alias("host_id"))
            .groupBy("host_id").agg(F.count("*").alias("hops")))


def credential_reuse(creds: DataFrame, moves: DataFrame, logons: DataFrame) -> DataFrame:
    """Targets reached from hosts with an extracted credential, at or after its extraction:
    (source_host, target_host, via, is_new_target).  Moves without a time count.  Of many moves of one host pair the latest decides,
    so edges with their last time do as well."""
    first = creds.filter(F.col("ts").isNotNull()).groupBy("host_id").agg(
        F.date_trunc("second", F.min("ts")).alias("cred_time"))
    by_move = (moves.select(F.col("source_host").alias("host_id"), "target_host", "ts")
               .join(first, "host_id").filter(F.col("ts").isNull() | (F.col("ts") >= F.col("cred_time")))
               .select("host_id", "target_host", F.lit("lateral").alias("via")))
    by_logon = (logons.filter((F.length("target_host") > 0) & (F.col("target_host") != F.col("host_id")))
                .join(first, "host_id").filter(F.col("ts") >= F.col("cred_time"))
                .select("host_id", "target_host", F.lit("logon").alias("via")))
    sources = first.select(F.col("host_id").alias("target_host"), F.lit(True).alias("_source"))
    return (by_move.unionByName(by_logon).distinct().join(sources, "target_host", "left")
            .select(F.col("host_id").alias("source_host"), "target_host", "via",
                    F.col("_source").isNull().alias("is_new_target")))


# Feeds asked per indicator type, in order.
FEED_ORDER = {"url": ["urlhaus", "threatfox"], "hash": ["malwarebazaar", "threatfox"],
              "ip": ["threatfox"], "domain": ["threatfox"]}


def feed_lookup(feed: DataFrame) -> DataFrame:
    """Feed reduced to one row per (key, type): the first source in lookup order."""
    order = F
    for kind, sources in FEED_ORDER.items():
        for no, source in enumerate(sources):
            order = order.when((F.col("ioc_type") == kind) & (F.col("source") == source), no)
    fields = [c for c in feed.columns if c not in ("value", "source")]
    typed = feed.withColumn("key", F.lower(F.trim("value"))).withColumn("ioc_type", feed_ioc_type(F.col("value")))
    return (typed.withColumn("no", order).filter(F.col("no").isNotNull()).groupBy("key", "ioc_type")
            .agg(F.min_by(F.struct("source", *fields), F.struct("no", *fields)).alias("f"))
            .select("key", "ioc_type", "f.*"))


def threat_hits(members: DataFrame, feed: DataFrame) -> DataFrame:
    """Feed hits for every indicator of every session."""
    keyed = members.withColumn("key", F.lower(F.trim("value"))).withColumn("ioc_type", feed_ioc_type(F.col("value")))
    return keyed.join(feed_lookup(feed), ["key", "ioc_type"]).drop("key")


def geolocate(addresses: DataFrame, ranges: DataFrame, column: str = "value") -> DataFrame:
    """Distinct public addresses joined to ranges (low, high BIGINT, inclusive; other columns kept).

    Ranges are cut at /16 borders so both sides meet on an equal key.
    """
    ips = (addresses.select(F.col(column).alias("ip")).distinct().filter(is_public(F.col("ip")))
           .withColumn("n", ip_to_long(F.col("ip"))).withColumn("block", F.floor(F.col("n") / 65536)))
    cut = ranges.withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / 65536), F.floor(F.col("high") / 65536))))
    return ips.join(cut, "block").filter(F.col("n").between(F.col("low"), F.col("high"))).drop("block", "n", "low", "high")


def tactic_table(spark) -> DataFrame:
    return spark.createDataFrame(list(TACTIC_FOR.items()), "prefix string, tactic string")


def with_tactic(findings: DataFrame, tactics: DataFrame) -> DataFrame:
    """Findings with the tactic of their five-character mitre prefix."""
    return findings.withColumn("prefix", F.substring("mitre_id", 1, 5)).join(F.broadcast(tactics), "prefix")


def with_triage(sessions: DataFrame, triage: DataFrame) -> DataFrame:
    return sessions.join(triage.select("session_id", "status", "notes"), "session_id", "left").withColumn(
        "status", F.coalesce("status", F.lit("unreviewed"))).withColumn("notes", F.coalesce("notes", F.lit("")))


def latest_triage(log: DataFrame) -> DataFrame:
    """Current status per session from a log of changes."""
    return log.groupBy("session_id").agg(F.max_by(
        F.struct("status", "notes", "ts"), F.struct("ts", "status")).alias("t")).select("session_id", "t.*")


def technique_gaps(sessions: DataFrame, covered: DataFrame) -> DataFrame:
    """(host_id, technique) pairs detected on a host without detection content."""
    seen = sessions.select("host_id", F.explode("technique_set").alias("technique_id")).distinct()
    return seen.join(F.broadcast(covered.select("technique_id")), "technique_id", "left_anti")
