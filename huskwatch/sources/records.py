"""Schema of script-block records and their normal form."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huskwatch.functions.text import first_filled

# Record fields by meaning, in order of preference.
FIELDS = {
    "raw_text": ["ScriptBlockText", "script_block_text", "Message"],
    "host_id": ["Computer", "host", "hostname"],
    "process_id": ["ProcessId", "process_id"],
    "thread_id": ["ThreadId", "thread_id"],
    "time": ["@timestamp", "TimeCreated", "timestamp", "_time"],
    "path": ["Path", "script_path"],
    "block_id": ["ScriptBlockId"],
    "block_number": ["MessageNumber"],
    "block_total": ["MessageTotal"],
}
RECORD_FIELDS = [f for names in FIELDS.values() for f in names]
RECORD = "struct<" + ",".join(f"`{f}`:string" for f in RECORD_FIELDS) + ">"
RECORD_SCHEMA = ", ".join(f"`{f}` string" for f in RECORD_FIELDS)


def normalise(rows: DataFrame, record: str | None = None) -> DataFrame:
    """Records (flat columns, or a struct column named ``record``) to block rows.

    Rows without text are dropped.  A missing id becomes a digest of the row, so repeated runs
    agree (repeated rows share it and are told apart by nothing else); a time that cannot be read stays
    NULL and is flagged.
    """
    def field(name: str) -> Column:
        return F.col(f"{record}.`{name}`" if record else f"`{name}`")

    def pick(meaning: str) -> Column:
        return first_filled(*[field(f) for f in FIELDS[meaning]])

    def number(meaning: str, default: int) -> Column:
        n = pick(meaning).try_cast("int")
        return F.coalesce(F.when(n != 0, n), F.lit(default)) if default else F.coalesce(n, F.lit(0))

    ts = F.try_to_timestamp(pick("time"))
    out = rows.select(
        pick("block_id").alias("block_id"), number("block_number", 1).alias("block_number"),
        number("block_total", 1).alias("block_total"), F.coalesce(pick("host_id"), F.lit("unknown")).alias("host_id"),
        number("process_id", 0).alias("process_id"), number("thread_id", 0).alias("thread_id"), ts.alias("ts"),
        F.coalesce(pick("path"), F.lit("")).alias("path"), pick("raw_text").alias("raw_text"),
        ts.isNull().alias("ts_defaulted")).filter(F.length("raw_text") > 0)
    digest = F.sha2(F.concat_ws("|", "host_id", F.col("process_id").cast("string"), F.col("ts").cast("string"), "raw_text"), 256)
    return out.withColumn("block_id", F.coalesce("block_id", digest))
