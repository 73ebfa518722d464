"""Detection content for what was found, content applied as predicates, hardening advice."""
from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huskwatch.catalog.content import CONTENT, PLATFORMS
from huskwatch.functions.scoring import band_rank, severity_band

HIT_ORDER = ["ts", "block_id", "block_number", "rule_no", "pattern_no", "hit_no"]
SESSION_ORDER = ["host_id", "process_id", *HIT_ORDER]


def best_findings(findings: DataFrame) -> DataFrame:
    """Per (session, technique) the finding with the highest severity; the first one wins ties.

    ``first_at`` is where the technique first appears in the session.  Both are plain aggregates.
    """
    order = F.struct((-F.col("severity")).alias("s"), *HIT_ORDER)
    return findings.groupBy("session_id", "technique_id").agg(
        F.min_by(F.struct("mitre_id", "severity", "matched_text", "host_id", "process_id"), order).alias("b"),
        F.min(F.struct(*HIT_ORDER)).alias("first_at")).select("session_id", "technique_id", "b.*", "first_at")


def first_findings(findings: DataFrame, sessions: DataFrame, min_score: float = 40) -> DataFrame:
    """First finding per technique over sessions scoring at least ``min_score``."""
    kept = findings.join(sessions.filter(F.col("weighted_score") >= min_score).select("session_id"), "session_id", "left_semi")
    return kept.groupBy("technique_id").agg(F.min_by(
        F.struct("session_id", "block_id", "mitre_id", "severity", "matched_text"), F.struct(*SESSION_ORDER)).alias("f")).select(
        "technique_id", "f.*")


def _generic_text(platform: str) -> Column:
    """Text for a technique without an entry, from its matched text."""
    term = F.translate(F.left("matched_text", F.lit(50)), '"', "'")
    title = F.initcap(F.translate("technique_id", "_", " "))
    forms = {
        "kql": '// %s (%s)\nEvent | where EventID == 4104 | where EventData has "%s"',
        "spl": '| comment "%s (%s)"\nindex=wineventlog EventCode=4104 (Message="*%s*")',
        "aql": "-- %s (%s)\nSELECT * FROM events WHERE eventid=4104 AND (UTF8(payload) ILIKE '%%%s%%')",
        "eql": '// %s (%s)\nany where event.code == "4104" and (winlog.event_data.ScriptBlockText like~ "*%s*")',
        "yaral": 'rule %s { meta: mitre_technique = "%s" events: re.regex($e.principal.process.command_line, `%s`) nocase condition: $e }',
        "yara": 'rule %s { meta: mitre_technique = "%s" strings: $s0 = "%s" nocase condition: any of them }',
    }
    head = F.concat(F.lit("script_"), F.lower("technique_id")) if platform.startswith("yara") else title
    body = F.regexp_replace(F.left("matched_text", F.lit(60)), r"[^\w\s\-.]", "") if platform == "yara" else term
    return F.format_string(forms[platform], head, F.col("mitre_id"), body)


def detections(first: DataFrame, content: DataFrame) -> DataFrame:
    """One row per technique with a query text per platform; a generic text where no entry exists."""
    joined = first.join(F.broadcast(content), "technique_id", "left")          # content: a fixed catalogue
    texts = [F.coalesce(F.try_element_at("texts", F.lit(p)), _generic_text(p)).alias(p) for p in PLATFORMS]
    return joined.select(
        "technique_id", F.coalesce("title", F.initcap(F.translate("technique_id", "_", " "))).alias("title"),
        F.coalesce("mitre", "mitre_id").alias("mitre"), severity_band(F.col("severity")).alias("severity"), *texts)


def sigma_rows(best: DataFrame, sessions: DataFrame, content: DataFrame) -> DataFrame:
    """Sigma fields per (session, technique); one row per title in a session."""
    rows = best.join(F.broadcast(content), "technique_id", "left").join(
        sessions.select("session_id", "start_time", "weighted_score"), "session_id")
    tag = F.concat(F.lit("attack."), F.lower("mitre_id"))
    title = F.coalesce("title", F.concat(F.lit("PowerShell suspicious: "), F.lower(F.translate("technique_id", "_", " "))))
    context = F.concat(F.lit(" Detected in session "), F.col("session_id"), F.lit(" on "), F.col("host_id"), F.lit(" at "),
                       F.coalesce(F.date_format("start_time", "yyyy-MM-dd HH:mm 'UTC'"), F.lit("unknown")), F.lit(". Matched: '"),
                       F.left("matched_text", F.lit(80)), F.lit("'."))
    full = rows.select(
        "session_id", "host_id", "process_id", "start_time", "weighted_score", "technique_id", "mitre_id", "first_at", "severity",
        title.alias("title"), F.concat(F.lit("Detects "), title, F.lit("."), context).alias("description"),
        severity_band(F.col("severity")).alias("level"),
        F.array_sort(F.array_distinct(F.array_append(F.coalesce("tags", F.array().cast("array<string>")), tag))).alias("tags"),
        F.coalesce("condition", F.lit("selection")).alias("condition"), F.left("matched_text", F.lit(50)).alias("term"),
        F.concat(F.lit("https://attack.mitre.org/techniques/"), F.translate("mitre_id", ".", "/")).alias("reference"))
    other = [c for c in full.columns if c not in ("session_id", "title")]
    return full.groupBy("session_id", "title").agg(F.min_by(F.struct(*other), F.struct("first_at", "technique_id")).alias("r")).select(
        "session_id", "title", "r.*")


def _quoted(value: Column) -> Column:
    """A JSON string, which is also a YAML scalar."""
    whole = F.to_json(F.struct(F.coalesce(value, F.lit("")).alias("v")))
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def _selectors(selectors: dict, condition: str) -> str:
    """YAML of the detection part of an entry."""
    modes = {"any": "contains", "all": "contains|all", "re": "re"}
    parts = [f"  {name}:\n    EventID: 4104\n    ScriptBlockText|{modes[mode]}:\n" + "".join(f"      - {json.dumps(t)}\n" for t in terms)
             for name, (mode, terms) in selectors.items()]
    return "".join(parts) + f"  condition: {condition}\n"


def sigma_texts(rows: DataFrame, content: dict | None = None) -> DataFrame:
    """sigma_rows() with ``text``, the rule as YAML: the entry's selectors, or its matched text where the technique has no entry."""
    entries = CONTENT if content is None else content
    known = F.create_map(*[F.lit(x) for tech, (_, _, _, selectors, condition) in entries.items() for x in (tech, _selectors(selectors, condition))])
    plain = F.concat(F.lit("  selection:\n    EventID: 4104\n    ScriptBlockText|contains:\n      - "), _quoted(F.col("term")), F.lit("\n  condition: selection\n"))
    digest = F.md5(F.concat_ws("|", "session_id", "title"))
    rule_id = F.regexp_replace(digest, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    lines = [F.lit("title: "), _quoted(F.col("title")), F.lit("\nid: "), rule_id, F.lit("\nstatus: experimental\ndescription: "), _quoted(F.col("description")),
             F.lit("\ntags:\n"), F.concat_ws("", F.transform("tags", lambda t: F.concat(F.lit("  - "), t, F.lit("\n")))),
             F.lit("logsource:\n  product: windows\n  category: ps_script\ndetection:\n"), F.coalesce(F.try_element_at(known, F.col("technique_id")), plain),
             F.lit("level: "), F.col("level"), F.lit("\nreferences:\n  - "), F.col("reference"), F.lit("\n")]
    return rows.withColumn("text", F.concat(*lines))


def sigma_for_sessions(rows: DataFrame, min_score: float = 40) -> DataFrame:
    """One Sigma row per technique over sessions scoring at least ``min_score``: the first session's."""
    other = [c for c in rows.columns if c != "technique_id"]
    order = F.struct("host_id", "process_id", "start_time", "session_id")
    return rows.filter(F.col("weighted_score") >= min_score).groupBy("technique_id").agg(
        F.min_by(F.struct(*other), order).alias("r")).select("technique_id", "r.*")


def yara_rows(best: DataFrame, content: DataFrame) -> DataFrame:
    """YARA text per (session, technique) with its severity band."""
    joined = best.join(F.broadcast(content), "technique_id", "left")
    return joined.select("session_id", "technique_id", F.concat(F.lit("script_"), F.lower("technique_id")).alias("name"),
                         F.coalesce("mitre", "mitre_id").alias("mitre"), severity_band(F.col("severity")).alias("severity"),
                         F.coalesce(F.try_element_at("texts", F.lit("yara")), _generic_text("yara")).alias("text"))


def highest_level(rows: DataFrame, level: str = "level") -> DataFrame:
    """Highest level per session; low when there is none."""
    return rows.groupBy("session_id").agg(F.min_by(level, band_rank(F.col(level))).alias("highest_level"))


def hardening(sessions: DataFrame, advice: DataFrame, min_score: float = 40) -> DataFrame:
    """Advice rows: general ones and those for techniques of sessions scoring ``min_score`` or more."""
    detected = sessions.filter(F.col("weighted_score") >= min_score).select(
        F.explode("technique_set").alias("technique_id")).distinct()
    general = advice.filter(F.col("technique_id") == "")
    triggered = advice.join(F.broadcast(detected), "technique_id", "left_semi")     # detected: at most one row per technique
    return general.unionByName(triggered).withColumn("priority_rank", band_rank(F.col("priority")))


def apply_content(blocks: DataFrame, text: str = "decoded_text", content: dict | None = None) -> DataFrame:
    """Run detection entries as predicates: add ``content_hits``, the techniques whose condition holds."""
    entries = CONTENT if content is None else content
    out = blocks.withColumn("_low", F.lower(text))
    flags = {}
    for no, (tech, (_, _, _, selectors, _)) in enumerate(entries.items()):
        for sel, (mode, terms) in selectors.items():
            tests = [F.rlike(F.col(text), F.lit(t)) if mode == "re" else F.contains("_low", F.lit(t.lower())) for t in terms]
            flag = tests[0]
            for t in tests[1:]:
                flag = (flag & t) if mode == "all" else (flag | t)
            flags[f"_c{no}_{sel}"] = flag
    out = out.withColumns(flags)
    hits = []
    for no, (tech, (_, _, _, selectors, condition)) in enumerate(entries.items()):
        for sel in selectors:
            condition = re.sub(rf"\b{sel}\b", f"_c{no}_{sel}", condition)
        hits.append(F.when(F.expr(condition), F.lit(tech)))
    return out.withColumn("content_hits", F.array_compact(F.array(*hits))).drop("_low", *flags)
