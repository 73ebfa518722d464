"""Scans: SIEM JSON exports, NDJSON, event XML, baselines of files stay in operators.baseline."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from huskwatch.sources.exports import json_records
from huskwatch.sources.records import RECORD, RECORD_FIELDS, RECORD_SCHEMA, normalise


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per line (splittable, so the form for large exports); a nested ``_source`` is
    unwrapped.  Lines that are not JSON have no text and drop out."""
    rows = spark.read.schema(RECORD_SCHEMA + f", `_source` {RECORD}").option("mode", "PERMISSIVE").json(path)
    return normalise(rows.select(_record("", "_source").alias("r")), "r")


def _record(prefix: str, nested: str) -> Column:
    own = F.struct(*[F.col(f"{prefix}`{f}`").alias(f) for f in RECORD_FIELDS])
    return F.coalesce(F.col(f"{prefix}`{nested}`"), own)


def read_json_export(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array, a single object, or an object that wraps its records in ``hits`` (plain or
    nested), ``events`` or ``results``; records may sit in ``_source``.  Files of any size are read by many
    tasks (see exports)."""
    item = RECORD[:-1] + f",`_source`:{RECORD}>"
    wrapped = RECORD[:-1] + f",`_source`:{RECORD},`hits`:string,`events`:string,`results`:string>"
    rows = json_records(spark, path).select(F.from_json("text", wrapped).alias("o")).select("o.*")
    listed = f"array<{item}>"
    nested = F.from_json("hits", f"struct<hits:{listed}>").getField("hits")
    plain = F.when(F.col("hits").startswith("["), F.from_json("hits", listed))
    own = F.struct(*[F.col(f"`{f}`") for f in RECORD_FIELDS], F.col("_source").alias("_source"))
    items = F.coalesce(plain, nested, F.from_json("events", listed), F.from_json("results", listed), F.array(own))
    flat = rows.select(F.explode(items).alias("i"))
    return normalise(flat.select(_record("i.", "_source").alias("r")), "r")


EVENT_SCHEMA = """System struct<EventID:string, Computer:string, TimeCreated:struct<_SystemTime:string>,
  Execution:struct<_ProcessID:string,_ThreadID:string>>, EventData struct<Data:array<struct<_Name:string,_VALUE:string>>>"""


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Event XML: one row per Event element with its id, host, time and named data."""
    raw = spark.read.format("xml").option("rowTag", "Event").schema(EVENT_SCHEMA).load(path)
    data = F.map_from_entries(F.transform(
        F.filter(F.coalesce("EventData.Data", F.array().cast("array<struct<_Name:string,_VALUE:string>>")),
                 lambda d: d.getField("_Name").isNotNull()),
        lambda d: F.struct(d.getField("_Name"), d.getField("_VALUE"))))
    return raw.select(
        F.col("System.EventID").try_cast("int").alias("event_id"),
        F.coalesce(F.nullif(F.col("System.Computer"), F.lit("")), F.lit("unknown")).alias("host_id"),
        F.try_to_timestamp("System.TimeCreated._SystemTime").alias("ts"),
        F.coalesce(F.col("System.Execution._ProcessID").try_cast("int"), F.lit(0)).alias("pid"),
        F.coalesce(F.col("System.Execution._ThreadID").try_cast("int"), F.lit(0)).alias("tid"), data.alias("data"))


def _data(*names: str) -> Column:
    return F.coalesce(*[F.nullif(F.try_element_at("data", F.lit(n)), F.lit("")) for n in names], F.lit(""))


def _pid(*names: str) -> Column:
    text = F.coalesce(*[F.nullif(F.try_element_at("data", F.lit(n)), F.lit("")) for n in names])
    return F.coalesce(F.when(F.lower(text).startswith("0x"), F.conv(F.substring(text, 3, 16), 16, 10)).otherwise(text).try_cast("int"),
                      F.lit(0))


def _base(path: Column) -> Column:
    return F.element_at(F.split(path, r"\\"), -1)


def script_blocks(events: DataFrame) -> DataFrame:
    """4104 events as block rows."""
    flat = events.filter(F.col("event_id") == 4104).select(F.struct(
        _data("ScriptBlockText").alias("ScriptBlockText"), F.col("host_id").alias("Computer"), F.col("ts").cast("string").alias("TimeCreated"),
        F.col("pid").cast("string").alias("ProcessId"), F.col("tid").cast("string").alias("ThreadId"), _data("ScriptBlockId").alias("ScriptBlockId"),
        _data("Path").alias("Path"), _data("MessageNumber").alias("MessageNumber"), _data("MessageTotal").alias("MessageTotal"),
        *[F.lit(None).cast("string").alias(f) for f in RECORD_FIELDS if f not in (
            "ScriptBlockText", "Computer", "TimeCreated", "ProcessId", "ThreadId", "ScriptBlockId", "Path", "MessageNumber", "MessageTotal")]
    ).alias("r"))
    return normalise(flat, "r")


def process_events(events: DataFrame) -> DataFrame:
    """Process starts (4688, 1), scheduled tasks (4698, 4702) and new services (7045)."""
    eid = F.col("event_id")
    start, task = eid.isin(4688, 1), eid.isin(4698, 4702)
    return events.filter(eid.isin(4688, 1, 4698, 4702, 7045)).select(
        "event_id", "host_id", "ts",
        F.when(start, _pid("NewProcessId", "ProcessId")).otherwise(0).alias("process_id"),
        F.when(start, _pid("ProcessId", "ParentProcessId")).otherwise(0).alias("parent_pid"),
        F.when(start, _base(_data("NewProcessName", "Image"))).when(task, "schtasks.exe").otherwise(
            F.coalesce(F.nullif(_data("ServiceName"), F.lit("")), F.lit("unknown_service"))).alias("process_name"),
        F.when(start, _data("CommandLine")).when(task, _data("TaskContent", "TaskName")).otherwise(_data("ImagePath")).alias("command_line"),
        F.when(start, _base(_data("ParentProcessName", "ParentImage"))).when(task, "").otherwise("services.exe").alias("parent_name"),
        F.when(start, _data("SubjectUserName", "User")).when(task, _data("SubjectUserName")).otherwise(_data("AccountName")).alias("user"))


def logon_events(events: DataFrame) -> DataFrame:
    """Logons (4624), failed logons (4625) and explicit-credential logons (4648)."""
    return events.filter(F.col("event_id").isin(4624, 4625, 4648)).select(
        "event_id", "host_id", "ts", F.coalesce(F.nullif(_data("WorkstationName", "TargetServerName"), F.lit("")), F.col("host_id")).alias("target_host"),
        _data("TargetUserName", "SubjectUserName").alias("username"), F.coalesce(_data("LogonType").try_cast("int"), F.lit(0)).alias("logon_type"),
        _data("IpAddress").alias("source_ip"), _data("TargetLogonId").alias("logon_id"), (F.col("event_id") != 4625).alias("success"))
