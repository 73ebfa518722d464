"""Sinks: results as JSON, CSV, text and partitioned folders.  All writes are distributed."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huskwatch.functions.scoring import band_rank
from huskwatch.operators.indicators import hub_members
from huskwatch.sources.ordered import file_part, write_files


def write_results(sessions: DataFrame, campaigns: DataFrame, folder: str) -> None:
    """Session and campaign rows as JSON lines."""
    sessions.write.mode("overwrite").json(f"{folder}/sessions")
    campaigns.write.mode("overwrite").json(f"{folder}/campaigns")


def write_ioc_csv(members: DataFrame, folder: str) -> None:
    """type, value, count, session: one line per value and session, in hub order."""
    hub_members(members).select(F.col("ioc_type").alias("type"), "value", F.col("session_count").alias("count"), F.col("session_id").alias("session")).orderBy(
        F.desc("count"), "type", "value", "session").write.mode("overwrite").option("header", True).option("quoteAll", True).csv(folder)


def ioc_text_lines(hub: DataFrame) -> DataFrame:
    """Lines of the text export with their sort keys: per type a header with its size, the values in
    hub order, and an empty line."""
    types = ["url", "ip", "hash", "path"]
    no = F
    for i, t in enumerate(types):
        no = no.when(F.col("ioc_type") == t, i)
    typed = hub.withColumn("section", no).filter(F.col("section").isNotNull())
    sizes = typed.groupBy("section", "ioc_type").agg(F.count("*").alias("n"))
    head = sizes.select("section", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("order1"), F.lit("").alias("order2"),
                        F.concat(F.lit("## "), F.upper("ioc_type"), F.lit("s ("), F.col("n").cast("string"), F.lit(")")).alias("line"))
    body = typed.select("section", F.lit(1).alias("part"), (-F.col("session_count")).alias("order1"), F.col("value").alias("order2"),
                        F.col("value").alias("line"))
    tail = sizes.select("section", F.lit(2).alias("part"), F.lit(0).cast("bigint").alias("order1"), F.lit("").alias("order2"), F.lit("").alias("line"))
    return head.unionByName(body).unionByName(tail)


def write_ioc_text(hub: DataFrame, folder: str) -> None:
    """Range-sorted lines: the part files in name order are the export."""
    ioc_text_lines(hub).orderBy("section", "part", "order1", "order2").select("line").write.mode("overwrite").text(folder)


def navigator_layer(rows: DataFrame, title: str) -> DataFrame:
    """One JSON text: the layer document around the technique rows (a few hundred mitre ids at most)."""
    tech = F.struct(
        F.col("mitre_id").alias("techniqueID"), "score", F.lit("").alias("color"),
        F.concat(F.lit("Detected in "), F.col("session_count").cast("string"), F.lit(" session(s). Rules: "), F.array_join("rules", ", ")).alias("comment"),
        F.lit(True).alias("enabled"), F.lit(True).alias("showSubtechniques"))
    listed = rows.agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("o"), F.col("mitre_id").alias("m"), tech.alias("t")))).alias("l"))
    return listed.select(F.to_json(F.struct(
        F.lit(title).alias("name"),
        F.struct(F.lit("14").alias("attack"), F.lit("4.9").alias("navigator"), F.lit("4.5").alias("layer")).alias("versions"),
        F.lit("enterprise-attack").alias("domain"), F.struct(F.array(F.lit("Windows")).alias("platforms")).alias("filters"),
        F.lit(3).alias("sorting"), F.transform("l", lambda x: x.getField("t")).alias("techniques"),
        F.struct(F.array(F.lit("#fce8e8"), F.lit("#d32f2f")).alias("colors"), F.lit(0).alias("minValue"), F.lit(100).alias("maxValue")).alias("gradient")
    )).alias("layer"))


def write_bundle(objects: DataFrame, folder: str) -> None:
    """STIX objects, one JSON object per line."""
    objects.select("object").write.mode("overwrite").text(folder)


def write_session_folders(tables: dict[str, DataFrame], folder: str, session_ids: list[str]) -> None:
    """Export of the named sessions: every table partitioned by session_id.  Rows are clustered by session
    first, so a session's files come from few tasks; a very large session may span several."""
    for name, table in tables.items():
        table = table.filter(F.col("session_id").isin(session_ids))
        spread = table.withColumn("_salt", F.pmod(F.hash(*[c for c in table.columns if c != "session_id"][:1]), F.lit(8)))
        spread.repartition("session_id", "_salt").drop("_salt").write.mode("overwrite").partitionBy("session_id").json(f"{folder}/{name}")


def write_content(detections: DataFrame, platforms: list[str], folder: str) -> None:
    """Query texts as rows (platform, technique, text), partitioned by platform."""
    texts = F.explode(F.map_from_arrays(F.array(*[F.lit(p) for p in platforms]), F.array(*[F.col(p) for p in platforms]))).alias("platform", "text")
    detections.select("technique_id", "severity", texts).write.mode("overwrite").partitionBy("platform").json(folder)


def write_rule_texts(rows: DataFrame, folder: str, level: str = "level") -> None:
    """Texts of generated rules (column ``text``), most severe first: the part files in name order are the export."""
    rows.select(band_rank(F.col(level)).alias("no"), "technique_id", "text").orderBy("no", "technique_id", "text").select("text").write.mode("overwrite").text(folder)


def combined_texts(rows: DataFrame, file: str | Column, order: list[str], separator: str = "\n---\n") -> DataFrame:
    """Rows (file, no, text) of one file per value: texts in order with the separator between them."""
    name = F.lit(file) if isinstance(file, str) else file
    placed = rows.select(name.alias("file"), *order, "text").distinct().withColumn(
        "no", F.row_number().over(Window.partitionBy("file").orderBy(*order, "text")))  # one task writes the file in any case
    return placed.select("file", F.array(F.lpad(F.col("no").cast("string"), 10, "0")).alias("no"),
                         F.when(F.col("no") == 1, F.col("text")).otherwise(F.concat(F.lit(separator), F.col("text"))).alias("text"))


def write_combined(rules: DataFrame, folder: str, name: str, level: str = "level", separator: str = "\n---\n") -> None:
    """One file with all texts of generated rules (technique_id, ``level``, text), most severe first; equal rules once."""
    ranked = rules.select(band_rank(F.col(level)).alias("rank"), "technique_id", "text")
    write_files(combined_texts(ranked, name, ["rank", "technique_id"], separator), folder, "no")


def session_files(detail: DataFrame, members: DataFrame, rows: DataFrame, blocks: DataFrame, sigma: DataFrame, triage: DataFrame, session_ids: list[str]) -> DataFrame:
    """Rows (file, no, text) of the whole export of the named sessions, a folder each.

    session_info.json is the nested detail with the triage entry; indicators.txt every indicator, one a line; rules.yml the Sigma
    texts; blocks/block_00001_decoded.ps1 and so on the whole texts in time order, _raw.ps1 where the raw text differs;
    notes.txt the analyst's notes, where there are any. Undated blocks come first, and records sent twice share one text.
    """
    def named(table: DataFrame) -> DataFrame:
        return table.filter(F.col("session_id").isin(session_ids))

    def part(table: DataFrame, name: str | Column, text: Column, *no: Column) -> DataFrame:
        path = F.concat_ws("/", file_part(F.col("session_id")), F.lit(name) if isinstance(name, str) else name)
        return table.select(path.alias("file"), F.array(*[F.coalesce(n, F.lit("")) for n in no]).cast("array<string>").alias("no"), text.alias("text"))

    status = triage.select("session_id", F.struct("status", "notes", "ts").alias("triage"))
    info = named(detail).join(named(status), "session_id", "left")
    info = part(info, "session_info.json", F.to_json(F.struct(*[F.col(f"`{c}`") for c in info.columns]), {"pretty": "true", "ignoreNullFields": "false"}))
    values = part(named(members), "indicators.txt", F.concat("value", F.lit("\n")), F.col("value"))
    rules = combined_texts(named(sigma), F.concat_ws("/", file_part(F.col("session_id")), F.lit("rules.yml")), ["first_at", "technique_id"])
    keys = ["block_id", "block_number"]
    placed = named(rows).select("session_id", "ts", *keys).withColumn("no", F.row_number().over(Window.partitionBy("session_id").orderBy("ts", *keys)))
    texts = placed.join(blocks.select(*keys, "decoded_text", "raw_text").dropDuplicates(keys), keys)
    stem = F.concat(F.lit("blocks/block_"), F.lpad(F.col("no").cast("string"), 5, "0"))  # longer numbers stay whole below
    stem = F.when(F.col("no") < 100_000, stem).otherwise(F.concat(F.lit("blocks/block_"), F.col("no").cast("string")))
    decoded = part(texts, F.concat(stem, F.lit("_decoded.ps1")), F.col("decoded_text"))
    raw = part(texts.filter(~F.col("raw_text").eqNullSafe(F.col("decoded_text"))), F.concat(stem, F.lit("_raw.ps1")), F.col("raw_text"))
    told = F.concat(F.lit("Status: "), F.coalesce("status", F.lit("")), F.lit("\nTimestamp: "), F.coalesce(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("")), F.lit("\n\n"), F.col("notes"), F.lit("\n"))
    notes = part(named(triage).filter(F.length("notes") > 0), "notes.txt", told)
    return reduce(DataFrame.unionByName, [info, values, rules, decoded, raw, notes])


def write_session_export(files: DataFrame, folder: str) -> None:
    """session_files() as files, which appear together with a manifest."""
    write_files(files, folder, "no")
