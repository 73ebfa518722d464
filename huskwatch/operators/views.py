"""Session views: summary and detail rows, filters, search, pivots, narrative, report rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huskwatch.catalog.lookups import PHRASES
from huskwatch.functions.scoring import tier_rank
from huskwatch.operators.campaigns import campaign_order
from huskwatch.operators.enrich import first_per, host_processes, session_logons


def summary_rows(sessions: DataFrame) -> DataFrame:
    """Flat session summary; counts that were not joined in yet are 0."""
    def number(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)) if name in sessions.columns else F.lit(0)
    beacon = F.coalesce(F.col("is_beacon"), F.lit(False)) if "is_beacon" in sessions.columns else F.lit(False)
    campaign = F.col("campaign_id") if "campaign_id" in sessions.columns else F.lit(None).cast("string")
    parent = F.col("parent_process") if "parent_process" in sessions.columns else F.lit("")
    return sessions.select(
        "session_id", "host_id", "process_id", "alert_tier", F.round("weighted_score", 1).alias("weighted_score"),
        "start_time", "end_time", F.round("duration_seconds", 1).alias("duration_seconds"), "technique_set",
        "block_count", number("ioc_count").alias("ioc_count"), number("ti_hit_count").alias("ti_hit_count"),
        number("lateral_move_count").alias("lateral_move_count"), beacon.alias("has_beacon"),
        campaign.alias("campaign_id"), parent.alias("parent_process"), "tempo",
        F.col("changed_blocks").alias("deobfuscation_passes"), "max_severity")


def detail_children(rows: DataFrame, blocks: DataFrame, members: DataFrame, n_iocs: int = 60) -> dict[str, DataFrame]:
    """Child tables of the session detail: first indicators, block texts cut for display, findings.

    ``rows`` are stitched block rows with findings; ``blocks`` holds the texts.  Texts are cut before they travel, and
    records that were sent twice share one text.
    """
    keys = ["block_id", "block_number"]
    texts = blocks.select(*keys, F.left("decoded_text", F.lit(1200)).alias("decoded_text"),
                          F.when(F.col("raw_text") != F.col("decoded_text"), F.left("raw_text", F.lit(400))).alias("raw_text")).dropDuplicates(keys)
    found = (rows.select("session_id", *keys, F.posexplode_outer("findings").alias("pos", "f"))
             .filter(F.col("f").isNotNull()).select("session_id", *keys, "pos", "f.*")
             .withColumn("matched_text", F.left("matched_text", F.lit(200)))
             .withColumn("confidence", F.round("confidence", 2)))
    return {
        "iocs": first_per(members, ["session_id"], [F.col("value")], n_iocs),
        "blocks": rows.select("session_id", *keys, "ts", "path", F.round("entropy", 2).alias("entropy"), "severity").join(texts, keys),
        "findings": found,
    }


def detail_context(sessions: DataFrame, processes: DataFrame, logons: DataFrame, hits: DataFrame, moves: DataFrame, credentials: DataFrame,
                   n_processes: int = 30, n_logons: int = 30) -> dict[str, DataFrame]:
    """Further child tables of the session detail: processes of the session's host, logons around it, feed hits, moves from
    and to it, and credentials first seen in it; each row carries session_id."""
    own = sessions.select("session_id", "host_id")
    ends = F.explode(F.array_distinct(F.array("source_session", "target_session")))
    return {
        "processes": own.join(host_processes(processes, n_processes).withColumnRenamed("process_id", "pid"), "host_id"),
        "logons": session_logons(sessions, logons, n=n_logons),
        "hits": hits.join(own.select("session_id"), "session_id", "left_semi"),
        "moves": moves.withColumn("session_id", ends),
        "credentials": credentials,
    }


# Lists of the nested session detail: how many entries it shows and the columns they stand in order of. The child tables hold all.
DETAIL_LISTS: dict[str, tuple[int, tuple[str, ...]]] = {
    "iocs": (60, ("value",)),
    "ti_hits": (200, ("value", "source")),
    "lateral_moves": (200, ("ts", "source_session", "target_session", "technique")),
    "process_tree": (30, ("ts", "pid", "process_name")),
    "logons": (30, ("ts", "username", "target_host")),
    "blocks": (500, ("ts", "block_id", "block_number")),
    "credentials": (200, ("ts", "block_id", "value")),
}


def detail_blocks(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Block rows of the session detail with their findings; texts are cut for display before they travel."""
    keys = ["block_id", "block_number"]
    texts = blocks.select(*keys, F.left("decoded_text", F.lit(1200)).alias("decoded_text"),
                          F.when(F.col("raw_text") != F.col("decoded_text"), F.left("raw_text", F.lit(400))).alias("raw_text")).dropDuplicates(keys)
    shown = F.transform("findings", lambda f: F.struct(
        *[f.getField(c).alias(c) for c in ("technique_id", "mitre_id", "severity", "rule_name")], F.left(f.getField("matched_text"), F.lit(200)).alias("matched_text"),
        f.getField("context").alias("context"), F.round(f.getField("confidence"), 2).alias("confidence")))
    return rows.select("session_id", *keys, "ts", "path", F.round("entropy", 2).alias("entropy"), "severity", shown.alias("findings")).join(texts, keys)


def session_detail(sessions: DataFrame, children: dict[str, DataFrame], shown: dict[str, int] | None = None) -> DataFrame:
    """One nested row per session: its summary columns, one ordered list of structs per child table, and <child>_total, how many
    rows the child has.

    ``children`` are tables with session_id under names of DETAIL_LISTS; a session without rows of a child has an empty list. A
    list shows its first rows in the order of DETAIL_LISTS (null first, repeated rows each), ``shown`` of them. All
    children travel as one tagged table: rows beyond the shown ones are cut in the task that has them, so a session with very
    many rows of a child is never gathered, and totals are counts. Rows of sessions that are not in ``sessions`` go.
    """
    wanted = {name: (shown or {}).get(name, n) for name, (n, _) in DETAIL_LISTS.items()}
    if unknown := set(children) - set(DETAIL_LISTS):
        raise ValueError(f"no such list in the session detail: {sorted(unknown)}")
    tagged = None
    for name, table in children.items():
        order = [F.unix_micros(c) + 4_000_000_000_000_000_000 if c == "ts" else F.col(c) for c in DETAIL_LISTS[name][1]]  # never negative
        place = F.array(*[F.lpad(o.cast("string"), 20, "0") if c in ("ts", "pid", "block_number") else o.cast("string")
                          for c, o in zip(DETAIL_LISTS[name][1], order, strict=True)])
        rows = table.select("session_id", F.lit(name).alias("child"), place.alias("place"),
                            F.struct(*[F.col(f"`{c}`") for c in table.columns if c != "session_id"]).alias(name))
        tagged = rows if tagged is None else tagged.unionByName(rows, allowMissingColumns=True)
    if tagged is None:
        return sessions
    limit = F.create_map(*[F.lit(x) for item in wanted.items() for x in item])[F.col("child")]
    ranked = tagged.withColumn("no", F.row_number().over(Window.partitionBy("session_id", "child").orderBy("place")))
    head = ranked.filter(F.col("no") <= max(wanted[name] for name in children)).filter(F.col("no") <= limit)
    lists = head.groupBy("session_id").agg(*[
        F.array_sort(F.collect_list(F.when(F.col("child") == name, F.struct("no", name)))).alias(name) for name in children])
    lists = lists.select("session_id", *[F.col(name).getField(name).alias(name) for name in children])
    totals = tagged.groupBy("session_id").agg(*[F.count_if(F.col("child") == name).alias(f"{name}_total") for name in children])
    out = sessions.join(lists, "session_id", "left").join(totals, "session_id", "left")
    return out.withColumns({name: F.coalesce(name, F.array().cast(lists.schema[name].dataType)) for name in children} | {
        f"{name}_total": F.coalesce(f"{name}_total", F.lit(0)) for name in children})


def session_filter(sessions: DataFrame, tier: str = "all", min_score: float = 0, query: str = "") -> DataFrame:
    out = sessions.filter(F.col("weighted_score") >= min_score)
    if tier != "all":
        out = out.filter(F.col("alert_tier") == tier)
    q = query.lower().strip()
    if q:
        hay = F.lower(F.concat_ws(" ", "host_id", F.col("process_id").cast("string"), F.array_join("technique_set", " ")))
        out = out.filter(F.contains(hay, F.lit(q)))
    return out


def session_sort(sessions: DataFrame, by: str = "score", ascending: bool = False) -> DataFrame:
    key = {"score": F.col("weighted_score"), "host": F.col("host_id"), "time": F.col("start_time"),
           "tier": tier_rank(F.col("alert_tier"))}.get(by, F.col("weighted_score"))
    return sessions.orderBy(key.asc() if ascending else key.desc(), "session_id")


def text_matches(blocks: DataFrame, query: str) -> DataFrame:
    """First case-insensitive match of every decoded text that has one: the columns of ``blocks`` but its texts, with context,
    match_offset and match_len. One projection next to the scan; texts go no further."""
    n = len(query)
    at = F.instr(F.lower("decoded_text"), F.lit(query.lower()))
    start = F.greatest(F.lit(1), F.col("at") - 60)
    kept = [c for c in blocks.columns if c not in ("raw_text", "decoded_text", "context", "match_offset", "match_len", "at")]
    return blocks.withColumn("at", at).filter(F.col("at") > 0).select(
        *kept, F.substring("decoded_text", start, F.col("at") - start + n + 60).alias("context"),
        (F.col("at") - start).alias("match_offset"), F.lit(n).alias("match_len"))


def search(rows: DataFrame, sessions: DataFrame, query: str, per_session: int = 5, top: int = 50, blocks: DataFrame | None = None) -> DataFrame:
    """Case-insensitive text search over decoded blocks: one row per shown match.

    Texts are those of ``blocks`` (block_id, block_number, decoded_text), searched next to their scan before the matches meet the
    rows; without it ``rows`` hold them. Records that were sent twice share one text.  Each of the ``top`` sessions by score
    shows its first ``per_session`` blocks and its total number of matching blocks.
    """
    if len(query) < 2:
        return rows.sparkSession.createDataFrame([], (
            "session_id string, weighted_score double, alert_tier string, total_matches bigint, block_id string, "
            "context string, match_offset int, match_len int"))
    keys = ["block_id", "block_number"]
    if blocks is None:
        hits = text_matches(rows.select("session_id", *keys, "ts", "decoded_text"), query)
    else:
        hits = rows.select("session_id", *keys, "ts").join(text_matches(blocks.select(*keys, "decoded_text"), query).dropDuplicates(keys), keys)
    totals = hits.groupBy("session_id").agg(F.count("*").alias("total_matches"))
    best = (totals.join(sessions.select("session_id", "weighted_score", "alert_tier"), "session_id")
            .orderBy(F.desc("weighted_score"), "session_id").limit(top))
    shown = first_per(hits, ["session_id"], [F.col("ts"), F.col("block_id"), F.col("block_number")], per_session)
    return shown.join(F.broadcast(best), "session_id").select(          # best: at most ``top`` rows
        "session_id", F.round("weighted_score", 1).alias("weighted_score"), "alert_tier", "total_matches", "block_id",
        "context", "match_offset", "match_len")


def pivot_ioc(sessions: DataFrame, members: DataFrame, text: str) -> DataFrame:
    hit = members.filter(F.contains(F.lower("value"), F.lit(text.lower()))).select("session_id")
    return sessions.join(hit, "session_id", "left_semi")


def pivot_technique(sessions: DataFrame, technique: str) -> DataFrame:
    return sessions.filter(F.array_contains("technique_set", technique.upper()))


def narrative(sessions: DataFrame, members: DataFrame) -> DataFrame:
    """One plain-English sentence group per session: time, host, techniques, first five indicators."""
    label = F.lower(F.translate("tempo", "_", " "))
    phrases = F.array_compact(F.array(*[F.when(F.array_contains("technique_set", t), F.lit(p)) for t, p in PHRASES]))
    top = first_per(members, ["session_id"], [F.col("value")], 5).groupBy("session_id").agg(
        F.array_sort(F.collect_list("value")).alias("sample"))
    counts = members.groupBy("session_id").agg(F.count("*").alias("ioc_n"))
    head = F.concat(F.lit("At "), F.coalesce(F.date_format("start_time", "HH:mm:ss 'UTC'"), F.lit("unknown time")),
                    F.lit(" on "), F.col("host_id"), F.lit(" (PID "), F.col("process_id").cast("string"), F.lit("), a "), label,
                    F.lit(" executed "), F.col("block_count").cast("string"), F.lit(" script block"),
                    F.when(F.col("block_count") != 1, "s").otherwise(""), F.lit("."))
    did = F.when(F.size("phrases") > 0, F.concat(F.lit("The session "), F.array_join("phrases", ", then "), F.lit(".")))
    saw = F.when(F.col("ioc_n") > 0, F.concat(F.lit("Extracted IOCs: "), F.array_join("sample", ", "),
                                              F.when(F.col("ioc_n") > 5, " (and more)").otherwise(""), F.lit(".")))
    linked = F.when(F.col("campaign_id").isNotNull(), F.concat(
        F.lit("This session is part of campaign "), F.col("campaign_id"),
        F.lit(", indicating the same operator was active on other hosts.")))
    base = sessions if "campaign_id" in sessions.columns else sessions.withColumn("campaign_id", F.lit(None).cast("string"))
    return (base.join(top, "session_id", "left").join(counts, "session_id", "left").withColumn("phrases", phrases)
            .select("session_id", F.concat_ws(" ", head, did, saw, linked).alias("narrative")))


def report_rows(sessions: DataFrame, members: DataFrame, min_score: float = 40) -> DataFrame:
    """Report table: sessions with score, tempo, techniques and, from ``min_score``, the narrative."""
    told = narrative(sessions.filter(F.col("weighted_score") >= min_score), members)
    return sessions.join(told, "session_id", "left").select(
        "session_id", "alert_tier", "host_id", F.round("weighted_score").alias("score"), "tempo", "technique_set",
        F.coalesce("narrative", F.lit("")).alias("narrative"))


def report_set(sessions: DataFrame, members: DataFrame, campaigns: DataFrame, min_score: float = 40) -> dict[str, DataFrame]:
    """Tables of the report: sessions by falling score, campaigns in their order, and the number of sessions per tier."""
    return {
        "sessions": report_rows(sessions, members, min_score).orderBy(F.desc("score"), F.asc("session_id")),
        "campaigns": campaigns.orderBy(*campaign_order()),
        "tiers": sessions.groupBy("alert_tier").agg(F.count("*").alias("sessions")).orderBy(F.desc(tier_rank(F.col("alert_tier")))),
    }
