"""Triage table kept from a change stream: a snapshot in buckets, a few deltas, and a committed manifest.

Every batch writes its changes as a delta and then one manifest row, which commits it. After COMPACT deltas a batch merges them
into the buckets they touch. All folders have fixed names that are used in turn, and a manifest never names one that the next
batch writes to, so what a reader opens is whole, nothing piles up, and a batch that failed or is run again repeats its writes."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huskwatch.operators.enrich import latest_triage

#: Buckets of the snapshot, and deltas that are kept before they are merged into it.
BUCKETS, COMPACT = 32, 8
SCHEMA = "session_id string, status string, notes string, ts timestamp"
_MANIFEST = "batch long, turn int, deltas int, slots array<int>"


def _bucket(buckets: int = BUCKETS):
    return F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int")


def manifest(spark: SparkSession, folder: str, before: int | None = None) -> dict | None:
    """The latest committed manifest, of a batch earlier than ``before`` if given: one row of the two that exist."""
    found = []
    for slot in (0, 1):
        try:
            found += spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest/slot={slot}").collect()
        except Exception as e:  # noqa: BLE001  a slot that was not written yet, or was lost while it was written
            if "PATH_NOT_FOUND" not in str(e) and "FileNotFound" not in str(e):
                raise
    rows = [r.asDict() for r in found if before is None or r["batch"] < before]
    return max(rows, key=lambda r: r["batch"], default=None)


def _deltas(spark: SparkSession, folder: str, state: dict) -> list[DataFrame]:
    return [spark.read.schema(SCHEMA).parquet(f"{folder}/deltas/turn={state['turn'] % 2}/{i}") for i in range(state["deltas"])]


def _snapshot(spark: SparkSession, folder: str, slots: list[int], buckets: list[int]) -> list[DataFrame]:
    out = []
    for slot in (0, 1):
        paths = [f"{folder}/snapshot/slot={slot}/bucket={b}" for b in buckets if slots[b] == slot]
        if paths:
            out.append(spark.read.schema(SCHEMA).parquet(*paths))
    return out


def _latest(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    rows = spark.createDataFrame([], SCHEMA)
    for part in parts:
        rows = rows.unionByName(part)
    return latest_triage(rows)


def apply_batch(batch: DataFrame, batch_id: int, folder: str, compact: int = COMPACT) -> None:
    """Commit one batch of changes (session_id, status, notes, ts); a batch that is already committed changes nothing."""
    spark = batch.sparkSession
    now = manifest(spark, folder)
    if now and now["batch"] >= batch_id:
        return
    state = now or {"batch": -1, "turn": 0, "deltas": 0, "slots": [-1] * BUCKETS}
    turn, deltas, slots = state["turn"], state["deltas"], list(state["slots"])
    latest_triage(batch.select("session_id", "status", "notes", "ts")).write.mode("overwrite").parquet(f"{folder}/deltas/turn={turn % 2}/{deltas}")
    deltas += 1
    if deltas >= compact:
        changes = _deltas(spark, folder, {"turn": turn, "deltas": deltas})
        touched = sorted(r[0] for r in _latest(spark, changes).select(_bucket().alias("b")).distinct().collect())  # at most BUCKETS
        for target in (0, 1):  # a bucket moves to the slot that no manifest names
            own = [b for b in touched if slots[b] != target and (slots[b] == 1 - target or target == 0)]
            if own:
                rows = [*(d.filter(_bucket().isin(own)) for d in changes), *_snapshot(spark, folder, slots, own)]
                merged = _latest(spark, rows).withColumn("bucket", _bucket())
                merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{folder}/snapshot/slot={target}")
        slots = [(1 - s if s >= 0 else 0) if b in touched else s for b, s in enumerate(slots)]
        turn, deltas = turn + 1, 0
    row = [(batch_id, turn, deltas, slots)]
    # The slot of the older manifest is written; the latest stays readable until the new one is there.
    slot = 1 - _slot_of(spark, folder, now) if now else 0
    spark.createDataFrame(row, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/slot={slot}")


def _slot_of(spark: SparkSession, folder: str, now: dict) -> int:
    try:
        first = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest/slot=0").first()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "FileNotFound" not in str(e):
            raise
        first = None
    return 0 if first and first["batch"] == now["batch"] else 1


def upsert(log: DataFrame, folder: str, checkpoint: str, compact: int = COMPACT):
    """Keep the table in ``folder`` from a stream of changes.  Returns the started query."""
    def commit(batch: DataFrame, batch_id: int) -> None:
        apply_batch(batch, batch_id, folder, compact)
    return log.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).start()


def table(spark: SparkSession, folder: str, sessions: list[str] | None = None) -> DataFrame:
    """Current status per session (of the given sessions only, whose buckets alone are read): the snapshot and at most COMPACT
    deltas, however many batches there were."""
    state = manifest(spark, folder)
    if state is None:
        return spark.createDataFrame([], SCHEMA)
    buckets = range(BUCKETS)
    if sessions is not None:
        asked = spark.createDataFrame([(s,) for s in sessions], "session_id string")
        buckets = sorted(r[0] for r in asked.select(_bucket().alias("b")).distinct().collect())
    parts = [*_snapshot(spark, folder, state["slots"], list(buckets)), *_deltas(spark, folder, state)]
    if sessions is not None:
        parts = [p.filter(F.col("session_id").isin(sessions)) for p in parts]
    return _latest(spark, parts)
