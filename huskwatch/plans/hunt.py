"""The analysis job: from raw records to sessions, indicators, campaigns and beacons.

Text is read once: ``silver`` holds the narrow per-block features.  With a work folder the features
are written there and every later stage reads that table; without one the plan stays lazy.
"""
from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huskwatch.catalog.rules import Rule
from huskwatch.operators import beacons as beacon_ops
from huskwatch.operators import campaigns as campaign_ops
from huskwatch.operators import enrich
from huskwatch.operators.blocks import block_features, classify, decode_blocks, reassemble
from huskwatch.operators.indicators import ioc_hub, session_iocs
from huskwatch.operators.sessions import GAP_SECONDS, score, stitch, summarise

# Columns of block_features() that single tables need beside the keys.
ROW_KEYS = ("block_id", "block_number", "host_id", "process_id", "ts")
SESSION_FEATURES = ("severity", "techniques", "changed")
PRINT_FEATURES = ("raw_chars", "char_codes", "b64_runs", "calls", "parens", "join_rank", "ticks", "slots")


class Hunt:
    """Lazy tables of one analysis; each is a DataFrame built on first use."""

    def __init__(self, blocks: DataFrame, rules: list[Rule] | None = None, gap_seconds: float = GAP_SECONDS,
                 bucket_seconds: int = 3600, blob_entropy: float = 6.0, bonus_entropy: float = 5.5,
                 work_folder: str | None = None, features: tuple[str, ...] | None = None):
        """``features`` names the feature columns that the caller's tables need (all if None): no others are computed or written.
        SESSION_FEATURES serve ``sessions``, ``moves`` and ``edges``, PRINT_FEATURES ``fingerprints``, ``iocs`` ``members``."""
        self.spark = blocks.sparkSession
        self.blocks = classify(blocks, rules, blob_entropy, bonus_entropy)
        self.gap, self.bucket, self.folder, self.features = gap_seconds, bucket_seconds, work_folder, features

    @classmethod
    def from_records(cls, records: DataFrame, **options) -> "Hunt":
        """Start from parsed records (raw_text only): decode, reassemble, then analyse."""
        from huskwatch.functions.text import shannon_entropy
        parts = decode_blocks(records).withColumn("entropy", shannon_entropy(F.col("raw_text")))
        return cls(reassemble(parts), **options)

    @cached_property
    def silver(self) -> DataFrame:
        """Per-block features without texts."""
        narrow = block_features(self.blocks)
        if self.features is not None:
            narrow = narrow.select(*ROW_KEYS, *self.features)
        return self._written(narrow, "block_features")

    def _written(self, table: DataFrame, name: str) -> DataFrame:
        """The table by way of the work folder, under a name of this run alone; the lazy table where there is no folder."""
        if not self.folder:
            return table
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        table.write.parquet(path)
        return self.spark.read.parquet(path)

    @cached_property
    def texts(self) -> DataFrame:
        """Raw and decoded text of every block, for views and exports that show them more than once."""
        return self._written(self.blocks.select("block_id", "block_number", "raw_text", "decoded_text"), "texts")

    @cached_property
    def rows(self) -> DataFrame:
        """Block features with their session."""
        return stitch(self.silver, self.gap, self.bucket)

    @cached_property
    def findings(self) -> DataFrame:
        return (self.rows.select("session_id", "host_id", "process_id", "ts", "block_id", "block_number",
                                 F.explode_outer("findings").alias("f")).filter(F.col("f").isNotNull())
                .select("session_id", "host_id", "process_id", "ts", "block_id", "block_number", "f.*"))

    @cached_property
    def sessions(self) -> DataFrame:
        return score(summarise(self.rows))

    @cached_property
    def members(self) -> DataFrame:
        return session_iocs(self.rows)

    @cached_property
    def hub(self) -> DataFrame:
        return ioc_hub(self.members)

    @cached_property
    def fingerprints(self) -> DataFrame:
        return campaign_ops.session_fingerprints(self.rows)

    @cached_property
    def tagged(self) -> DataFrame:
        return campaign_ops.tag_sessions(self.sessions, self.fingerprints)

    @cached_property
    def campaigns(self) -> DataFrame:
        return campaign_ops.campaigns(self.tagged)

    @cached_property
    def beacons(self) -> DataFrame:
        return beacon_ops.beacons(beacon_ops.intervals(self.rows))

    @cached_property
    def spans(self) -> DataFrame:
        """What moves and edges read of the sessions, up to four times."""
        return self._written(self.sessions.select("session_id", "host_id", "start_time", "end_time", "technique_set"), "spans")

    @cached_property
    def moves(self) -> DataFrame:
        return enrich.lateral_moves(self.spans)

    @cached_property
    def edges(self) -> DataFrame:
        """Host-to-host edges with their first and last move."""
        return enrich.lateral_first(self.spans)

    @cached_property
    def enriched(self) -> DataFrame:
        """Sessions with indicator, move and beacon facts joined on."""
        iocs = self.members.groupBy("session_id").agg(F.count("*").alias("ioc_count"))
        return (self.tagged.join(iocs, "session_id", "left")
                .join(enrich.lateral_counts(self.spans), "session_id", "left")
                .join(self.beacons.drop("host_id"), "session_id", "left"))
