"""Structured Streaming forms of the operators."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from huskwatch.catalog.rules import Rule
from huskwatch.functions.text import shannon_entropy
from huskwatch.operators.baseline import Baseline, anomaly
from huskwatch.operators.packed import Packed, scored
from huskwatch.operators.blocks import classify, decode_blocks, explode_findings
from huskwatch.operators.enrich import feed_lookup
from huskwatch.operators.sessions import session_id
from huskwatch.sources.records import RECORD_SCHEMA, normalise


def read_records(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Streaming scan of NDJSON files that arrive in a folder."""
    raw = spark.readStream.schema(RECORD_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(folder)
    return normalise(raw)


def findings(records: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Rule findings of a record stream; stateless, append mode."""
    blocks = decode_blocks(records).withColumn("entropy", shannon_entropy(F.col("raw_text")))
    return explode_findings(classify(blocks, rules), "block_id", "block_number", "host_id", "process_id", "ts")


def sessions(rows: DataFrame, gap_seconds: int = 120, lateness: str = "10 minutes") -> DataFrame:
    """Gap sessions per (host, pid) over event time; a session is emitted once the watermark passes it."""
    open_rows = rows.withWatermark("ts", lateness)
    grouped = open_rows.groupBy("host_id", "process_id", F.session_window("ts", f"{gap_seconds} seconds").alias("w")).agg(
        F.count("*").alias("block_count"), F.min("ts").alias("start_time"), F.max("ts").alias("end_time"))
    return grouped.select(session_id(F.col("host_id"), F.col("process_id"), F.col("start_time")).alias("session_id"),
                          "host_id", "process_id", "start_time", "end_time", "block_count")


def finding_counts(found: DataFrame, window: str = "10 minutes", slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Findings per host, mitre id and time window (tumbling, or sliding when ``slide`` is given)."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return (found.withWatermark("ts", lateness).groupBy(w.alias("w"), "host_id", "mitre_id").agg(F.count("*").alias("n"))
            .select(F.col("w.start").alias("window_start"), "host_id", "mitre_id", "n"))


def deduplicate(records: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Drop re-sent parts within the watermark."""
    return records.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["block_id", "block_number"])


_PART = ["block_id", "block_number", "block_total", "host_id", "process_id", "thread_id", "path", "at", "raw_text", "decoded_text"]
_HELD = ("block_number int, block_total int, host_id string, process_id int, thread_id int, path string, at bigint, raw_text string, decoded_text string")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Reassembly(StatefulProcessor):
    """Parts of one block id. A part is appended to a list state when it arrives and not read again before the block is complete
    or given up; what decides that (how many parts, the first one's place and total, the oldest time) is a small state of its own."""

    def __init__(self, wait_seconds: int) -> None:
        self.wait = wait_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getListState("parts", _HELD)
        self.known = handle.getValueState("known", "n int, number int, at bigint, total int, since bigint, overfull boolean")

    @staticmethod
    def _order(row: tuple) -> tuple:
        return row[0], row[6]

    def _single(self, key, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in sorted(rows, key=self._order)], columns=_PART)

    def _held(self) -> list[tuple]:
        return list(map(tuple, self.parts.get())) if self.parts.exists() else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        n, number, at, total, since, overfull = self.known.get() if self.known.exists() else (0, None, None, None, None, False)
        for frame in rows:
            new = list(zip(*(frame[c].tolist() for c in _PART[1:]), strict=True))
            if overfull:
                yield self._single(key, new)
                continue
            first = min(new, key=self._order)
            if number is None or self._order(first) < (number, at):
                number, at, total = first[0], first[6], first[1]
            oldest = min(r[6] for r in new) // 1000
            since, n = oldest if since is None else min(since, oldest), n + len(new)
            if n > total:  # it can no longer complete
                yield self._single(key, self._held() + new)
                self.parts.clear()
                overfull = True
            else:
                self.parts.appendList(new)
        if not overfull and n == total:
            held = sorted(self._held(), key=self._order)
            yield self._single(key, [(1, 1, *held[0][2:7], "".join(r[7] for r in held), "".join(r[8] for r in held))])
            self._forget()
            return
        self.known.update((n, number, at, total, since, overfull))
        now = timerValues.getCurrentWatermarkInMs()
        self._wait_until(max((now if overfull else since) + self.wait, now + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        if held := self._held():
            yield self._single(key, held)
        self._forget()

    def _wait_until(self, time: int) -> None:
        for old in list(self.handle.listTimers()):
            if old != time:
                self.handle.deleteTimer(old)
        self.handle.registerTimer(time)

    def _forget(self) -> None:
        self.parts.clear()
        self.known.clear()
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)


def reassemble(parts: DataFrame, lateness: str = "10 minutes", wait_seconds: int = 600) -> DataFrame:
    """Merge multi-part blocks as their parts arrive; incomplete ones are passed on part by part once
    the watermark is ``wait_seconds`` past their first part.

    Parts are decoded one by one before they are merged, as in the batch job.  Those without a time pass
    through unmerged: no watermark ever reaches them.  A block completes when the number of parts equals
    the total given by its first part.  Once an id has more parts than that it can no longer complete: its
    parts are passed on and later ones go straight through, so state stays small.

    State with lists needs the RocksDB store, which is set for queries that this session starts from now on.
    """
    parts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    decoded = parts if "decoded_text" in parts.columns else decode_blocks(parts)
    rows = decoded.withColumn("at", F.unix_micros("ts")).select(*_PART, "ts")
    timed = rows.filter(F.col("ts").isNotNull()).withWatermark("ts", lateness)
    merged = timed.groupBy("block_id").transformWithStateInPandas(Reassembly(wait_seconds), f"block_id string, {_HELD}", "append", "eventTime")
    whole = merged.unionByName(rows.filter(F.col("ts").isNull()).drop("ts"))
    return whole.withColumn("ts", F.timestamp_micros("at")).drop("at")


def unknown_content(blocks: DataFrame, baseline: Baseline) -> DataFrame:
    """Stream of blocks (column ``content_hash``) less those that the saved baseline knows."""
    return blocks.join(baseline.hashes, "content_hash", "left_anti")


def anomaly_scores(features: DataFrame, known: Packed) -> DataFrame:
    """Stream (or table) of block features with ``anomaly``, as operators.baseline.anomaly gives it.

    Each row is scored by itself against the packed baseline, so the stream needs no state, no aggregate and no shuffle."""
    return scored(features, known)


def anomaly_batches(features: DataFrame, baseline: Baseline, folder: str, checkpoint: str):
    """The scores of a baseline too large to pack: every batch is joined to the tables and written under its own id, so a batch
    that is run again replaces itself.  Returns the started query."""
    def score(batch: DataFrame, batch_id: int) -> None:
        anomaly(batch, baseline).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
    return features.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).start()


def enrich_with_feed(values: DataFrame, feed: DataFrame) -> DataFrame:
    """Stream of indicator values (column ``value``) joined to a static feed table."""
    return values.withColumn("key", F.lower(F.trim("value"))).join(feed_lookup(feed).drop("ioc_type"), "key")
