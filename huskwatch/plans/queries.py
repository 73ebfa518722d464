"""Registered queries: one per operator, over the given tables."""
from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from huskwatch.catalog.content import advice_table, content_table
from huskwatch.catalog.rules import builtin_rules
from huskwatch.functions import decode as D
from huskwatch.functions import scoring, style
from huskwatch.functions import text as X
from huskwatch.functions.net import is_public
from huskwatch.operators import baseline as base_ops
from huskwatch.operators import beacons as beacon_ops
from huskwatch.operators import blocks as block_ops
from huskwatch.operators import campaigns as campaign_ops
from huskwatch.operators import content as content_ops
from huskwatch.operators import enrich, indicators, rollups, stix, views
from huskwatch.operators import sessions as session_ops
from huskwatch.plans import adapters as A
from huskwatch.plans.hunt import PRINT_FEATURES, SESSION_FEATURES, Hunt
from huskwatch.session import checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Queries that need block features more than once: they write them to the work folder and read them back, those named alone if so stated.
_MOVES, _PRINTS = SESSION_FEATURES, (*SESSION_FEATURES, *PRINT_FEATURES)
ONCE: dict[str, tuple[str, ...] | None] = dict.fromkeys("""p5_session_summary p6_session_detail p6_session_nested c7_enriched_sessions a1_headline a27_narrative
    r7_first_findings r11_highest_level j9_detection_content j10_sigma_fields j11_sigma_for_sessions s12c_notes s12d_indicators s12e_relationships
    s12f_known_malware s14_report_tiers""".split())
ONCE |= dict.fromkeys(["j5_lateral_moves", "a23_lateral_edges", "a24_hop_degree"], _MOVES) | {"j6_credential_reuse": (*_MOVES, "creds")}
ONCE |= dict.fromkeys(["j7_threat_hits", "p13_hit_source_filter", "a19_hits_per_source"], ("iocs",))
ONCE |= dict.fromkeys(["f9_campaigns", "f10_campaign_tags", "p15_confirmed_campaigns", "a25_campaign_scalars", "l4_campaign_order"], _PRINTS)


class Tables:
    """Shared intermediate tables of one query run; all lazy, but for block features that are used more than once."""

    def __init__(self, spark: SparkSession, folder: str, once: bool = False, features: tuple[str, ...] | None = None):
        self.spark, self.folder, self.once, self.features = spark, folder, once, features
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def t(self, name: str) -> DataFrame:
        rows = A.table(self.spark, self.folder, name)
        return A.spread(rows) if name in ("documents", "pages") else rows

    @cached_property
    def hunt(self) -> Hunt:
        return Hunt(A.doc_blocks(self.spark, self.folder), A.DOC_RULES, A.DOC_GAP, A.DAY,
                    A.DOC_BLOB_ENTROPY, A.DOC_BONUS_ENTROPY, checkpoint_dir(self.spark) if self.once else None, self.features)

    @cached_property
    def events(self) -> DataFrame:
        return session_ops.stitch(A.activity(self.spark, self.folder), A.ACTIVITY_GAP, A.DAY)

    @cached_property
    def event_sessions(self) -> DataFrame:
        return session_ops.score(session_ops.summarise(self.events))

    @cached_property
    def beats(self) -> DataFrame:
        """Interval lists of whole users (two-day gaps)."""
        rows = session_ops.stitch(A.activity(self.spark, self.folder), 2 * A.DAY, A.DAY)
        return beacon_ops.intervals(rows, 2.0, 2.0 * A.DAY)

    @cached_property
    def found(self) -> DataFrame:
        return beacon_ops.beacons(self.beats, 0.0)

    @cached_property
    def benign(self) -> DataFrame:
        good = self.t("labels").filter("quality = 1").select(
            F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("block_id"))
        return self.words.join(good, "block_id", "left_semi")

    @cached_property
    def words(self) -> DataFrame:
        """Block features whose terms are the words of the text that start with a th- syllable."""
        blocks = A.doc_blocks(self.spark, self.folder)
        return blocks.select(
            "block_id", "block_number", "host_id", "process_id", "ts", "path", "entropy",
            X.block_hash(F.col("decoded_text")).alias("content_hash"),
            F.transform(F.regexp_extract_all("decoded_text", F.lit("(?i) th[a-z]+"), F.lit(0)),
                        lambda w: F.lower(F.trim(w))).alias("terms"))

    @cached_property
    def baseline(self) -> base_ops.Baseline:
        return base_ops.build(self.benign)

    @cached_property
    def triage_log(self) -> DataFrame:
        return self.hunt.rows.select("session_id", F.when(F.col("severity") >= 60, "confirmed").when(
            F.col("severity") > 0, "triaged").otherwise("unreviewed").alias("status"),
            F.col("block_id").alias("notes"), "ts")

    @cached_property
    def feed(self) -> DataFrame:
        return A.feed_from(self.hunt.members)

    @cached_property
    def covered(self) -> DataFrame:
        return self.content.select("technique_id")

    @cached_property
    def content(self) -> DataFrame:
        return content_table(self.spark)

    @cached_property
    def best(self) -> DataFrame:
        return content_ops.best_findings(self.hunt.findings)

    @cached_property
    def hits(self) -> DataFrame:
        return enrich.threat_hits(self.hunt.members, self.feed)


def query(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, folder: fn(Tables(spark, folder, fn.__name__ in ONCE, ONCE.get(fn.__name__)))
    return fn


def r6(col: str | Column, name: str | None = None) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    out = F.round(c, 6)
    return out.alias(name or col) if name or isinstance(col, str) else out


def when(col: str, name: str | None = None) -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss").alias(name or col)


def joined(col: str, name: str | None = None) -> Column:
    return F.array_join(col, ",").alias(name or col)


# -- projections and predicates ------------------------------------------------------------------

@query
def p1_first_filled(s):
    return s.t("documents").select("doc_id", X.first_filled(
        F.when(F.col("lang") == "en", "").otherwise(F.col("lang")), F.col("source")).alias("host"))


@query
def p2_nonempty_text(s):
    return s.t("documents").filter(F.length("text") > 0).groupBy("lang").agg(F.count("*").alias("n"))


@query
def p4_alert_tier(s):
    return s.event_sessions.select("session_id", "alert_tier")


@query
def p5_session_summary(s):
    v = views.summary_rows(s.hunt.enriched)
    return v.select("session_id", "host_id", "process_id", "alert_tier", "weighted_score", when("start_time"), when("end_time"),
                    "duration_seconds", joined("technique_set"), "block_count", "ioc_count", "lateral_move_count",
                    "has_beacon", "tempo", "deobfuscation_passes", "max_severity")


@query
def p6_session_detail(s):
    """Rows of each child table of the session detail, counted per session."""
    tables = views.detail_context(s.hunt.sessions, A.process_events(s.spark, s.folder), A.logon_events(s.spark, s.folder), s.hits, s.hunt.moves,
                                  indicators.first_credentials(s.hunt.rows))
    counts = [t.groupBy("session_id").agg(F.count("*").alias("n")).select("session_id", F.lit(k).alias("child"), "n") for k, t in tables.items()]
    return reduce(DataFrame.unionByName, counts)


@query
def p6_session_nested(s):
    """The nested session detail: values of its lists in order, and their whole sizes."""
    children = views.detail_context(s.hunt.sessions, A.process_events(s.spark, s.folder), A.logon_events(s.spark, s.folder), s.hits, s.hunt.moves,
                                    indicators.first_credentials(s.hunt.rows))
    names = {"processes": "process_tree", "hits": "ti_hits", "moves": "lateral_moves"}
    children = {names.get(k, k): t for k, t in children.items()} | {
        "iocs": s.hunt.members.drop("host_id"), "blocks": views.detail_blocks(s.hunt.rows, s.hunt.blocks)}
    d = views.session_detail(views.summary_rows(s.hunt.sessions), children, {"blocks": 4, "lateral_moves": 5})

    def listed(column: str, *fields: str) -> Column:
        return F.array_join(F.transform(column, lambda x: F.concat_ws(" ", *[x.getField(f).cast("string") for f in fields])), "|").alias(column)
    found = F.array_join(F.flatten(F.transform("blocks", lambda b: F.transform(b.getField("findings"), lambda f: f.getField("rule_name")))), "|")
    return d.select("session_id", "alert_tier", listed("iocs", "value"), listed("ti_hits", "value", "source", "malware_name"),
                    listed("lateral_moves", "source_session", "target_session", "technique"), listed("process_tree", "pid", "process_name"),
                    listed("logons", "username", "target_host", "event_id"), listed("credentials", "block_id", "value"),
                    found.alias("findings"), F.sha2(F.array_join(F.transform("blocks", lambda b: F.concat_ws(" ", b.getField("block_id"), b.getField("severity").cast("string"), b.getField("decoded_text"))), "|"), 256).alias("blocks"),
                    *[f"{c}_total" for c in ("iocs", "ti_hits", "lateral_moves", "process_tree", "blocks")])


@query
def s14_report_tiers(s):
    return views.report_set(s.hunt.sessions, s.hunt.members, s.hunt.campaigns)["tiers"]


@query
def p7_session_filter(s):
    return views.session_filter(s.hunt.sessions, "all", 40, "SRC1 ").select("session_id", "alert_tier", r6("weighted_score"))


@query
def p8_text_search(s):
    return views.search(s.hunt.rows, s.hunt.sessions, "License", 5, 50, s.hunt.blocks)


@query
def p9_pivot_indicator(s):
    return views.pivot_ioc(s.hunt.sessions, s.hunt.members, "EXAMPLE.com/fr").select("session_id", "alert_tier")


@query
def p10_pivot_technique(s):
    return views.pivot_technique(s.hunt.sessions, "lolbin_certutil").select("session_id", "alert_tier")


@query
def p11_score_gates(s):
    return s.hunt.sessions.agg(
        F.count_if(F.col("weighted_score") >= 40).alias("content"), F.count_if(F.col("weighted_score") > 20).alias("clustered"),
        F.count_if(F.col("alert_tier") != "CLEAN").alias("exported"),
        F.count_if(~F.col("alert_tier").isin("CLEAN", "INFO")).alias("alerted"))


@query
def p12_indicator_filter(s):
    return s.hunt.hub.filter((F.col("ioc_type") == "ip") & F.contains("value", F.lit("17"))).select("value", "session_count")


@query
def p13_hit_source_filter(s):
    return enrich.threat_hits(s.hunt.members, s.feed).filter(F.col("source") == "urlhaus").select(
        "session_id", "value", "malware_name")


@query
def p14_beacon_predicate(s):
    return s.found.filter("is_beacon").select("session_id", "confidence")


@query
def p15_confirmed_campaigns(s):
    return s.hunt.campaigns.filter("is_confirmed").agg(F.count("*").alias("n"), F.max("session_count").alias("largest"))


@query
def p16_public_address(s):
    return s.hunt.hub.filter(F.col("ioc_type") == "ip").select("value", is_public(F.col("value")).alias("is_public"))


@query
def p14_beacon_flags(s):
    """Every other user's intervals made regular, so that both answers occur."""
    steady = F.transform("intervals", lambda x, i: F.lit(60.0) + i % 5)
    mixed = s.beats.withColumn("intervals", F.when(F.size("intervals") % 2 == 0, steady).otherwise(F.col("intervals")))
    return beacon_ops.beacons(mixed, 0.0).select("session_id", "is_beacon", "confidence")


@query
def p16_address_classes(s):
    """Addresses made of doc_id that fall into private, reserved and public ranges."""
    n = F.col("doc_id")
    heads = ["10", "172.16", "172.32", "192.168", "192.0.2", "192.0.0", "198.18", "203.0.113", "8.8", "100.64", "240.1", "127.0", "169.254", "300.1", "198.51.100"]
    head = F.get(F.array(*[F.lit(h) for h in heads]), (n % len(heads)).cast("int"))
    tail = F.array_join(F.slice(F.array(*[(n * k % 256).cast("string") for k in (3, 5, 7)]), 1, 4 - F.size(F.split(head, r"\."))), ".")
    value = F.concat(head, F.lit("."), tail)
    return s.t("documents").select("doc_id", value.alias("value"), is_public(value).alias("is_public"))


@query
def r3_entropy_rule(s):
    """The fallback itself on every block, whether or not a rule matched."""
    rows = A.doc_blocks(s.spark, s.folder)
    return rows.select("block_id", F.size(block_ops.entropy_fallback(F.col("decoded_text"), F.col("entropy"), 4.2)).alias("n"))


@query
def f4_join_idioms(s):
    """Texts with one of the three idioms, two of them, or none, by doc_id."""
    tails = [" -join ''", " [string]::Join(',', $a)", " + 'x'", " nothing", " + \"y\" -JOIN \"\""]
    tail = F.get(F.array(*[F.lit(t) for t in tails]), (F.col("doc_id") % len(tails)).cast("int"))
    text = F.concat(F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-z ]", ""), tail)
    return s.t("documents").select("doc_id", style.join_style(style.join_style_rank(text)).alias("style"))


@query
def p17_known_good(s):
    return base_ops.known_good(s.words, s.baseline).select("block_id")


# -- decode transforms ---------------------------------------------------------------------------

@query
def n1_backtick(s):
    t = F.regexp_replace("text", "([a-z])", "`$1")
    return s.t("documents").select("doc_id", F.sha2(D.unwrap_backtick(t), 256).alias("digest"))


@query
def n12_credential_mark(s):
    t = F.concat(F.lit('ConvertTo-SecureString "'), "source", F.lit("\" -asplaintext; New-Object Net.NetworkCredential('"),
                 "lang", F.lit("', 'pw'); "), "text")
    return s.t("documents").select("doc_id", F.sha2(D.mark_credentials(t), 256).alias("digest"))


def _letters(s: Tables) -> tuple[DataFrame, Column, Column]:
    """Documents with the letters and blanks of their text, that text, and its characters."""
    t = F.col("letters")
    rows = s.t("documents").withColumn("letters", F.array_join(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z ]++"), F.lit(0)), ""))
    return rows, t, F.when(t != "", F.split(t, "")).otherwise(F.array())


def _marked(t: Column, codes: Column, mark: str, gap: str = "") -> Column:
    """A text's character codes, each behind a mark, with gaps in between."""
    return F.concat(F.when(t != "", mark).otherwise(""), F.array_join(codes, gap + mark))


def _digest(rows: DataFrame, decoded: Column) -> DataFrame:
    return rows.select("doc_id", F.sha2(decoded, 256).alias("digest"))


def _base64(text: Column, charset: str) -> Column:
    return F.regexp_replace(F.base64(F.encode(text, charset)), r"\s", "")


@query
def n2_join_lists(s):
    rows, t, _ = _letters(s)
    return _digest(rows, D.unwrap_join(F.concat(F.lit("x = ('"), F.replace(t, F.lit(" "), F.lit("', '")), F.lit("') -join ''"))))


@query
def n3_char_codes(s):
    rows, t, chars = _letters(s)
    return _digest(rows, D.unwrap_char_decimal(_marked(t, F.transform(chars, F.ascii).cast("array<string>"), "[char]")))


@query
def n3_char_hex_codes(s):
    rows, t, chars = _letters(s)
    return _digest(rows, D.unwrap_char_hex(_marked(t, F.transform(chars, F.hex), "[CHAR] 0x", "+")))


@query
def n4_hex_lists(s):
    rows, t, _ = _letters(s)
    pairs = F.regexp_replace(F.hex(F.concat(F.lit("invoke "), t).cast("binary")), "(..)(?=.)", "0x$1, ")
    return _digest(rows, D.unwrap_hex_list(F.concat(F.lit("$x = "), F.regexp_replace(pairs, "(..)$", "0x$1"))))


@query
def n5_base64_calls(s):
    rows, t, _ = _letters(s)
    coded = _base64(F.concat(F.lit("get "), t), "UTF-16LE")
    return _digest(rows, D.unwrap_base64_call(F.concat(F.lit("[Convert]::FromBase64String('"), coded, F.lit("')"))))


@query
def n6_base64_runs_utf16(s):
    rows, t, _ = _letters(s)
    coded = _base64(F.concat(F.lit("Write-Output with powershell "), t), "UTF-16LE")
    return _digest(rows, D.unwrap_base64_run(F.concat(F.lit("run "), coded, F.lit(" now"))))


@query
def n7_format_strings(s):
    """The words of a text as arguments in reversed order, picked by reversed slots."""
    rows, t, _ = _letters(s)
    words = F.split(F.concat(F.lit("w "), t), " ")
    slots = F.array_join(F.transform(F.reverse(F.sequence(F.lit(0), F.size(words) - 1)), lambda i: F.concat(F.lit("{"), i.cast("string"), F.lit("}"))), "")
    return _digest(rows, D.unwrap_format(F.concat(F.lit('"'), slots, F.lit('" -f "'), F.array_join(F.reverse(words), '","'), F.lit('"'))))


@query
def n8_replace_chains(s):
    rows, t, _ = _letters(s)
    return _digest(rows, D.unwrap_replace_calls(F.concat(t, F.lit(".Replace('a','b')"), F.lit('.replace( "c" , "d")'))))


@query
def n9_reversed_literals(s):
    rows, t, _ = _letters(s)
    return _digest(rows, D.unwrap_reversed(F.concat(F.lit("$a = '"), F.reverse(F.concat(F.lit("call powershell "), t)), F.lit("'; b"))))


@query
def n10_environment_picks(s):
    rows, t, _ = _letters(s)
    picks = F.concat_ws(",", *[(F.col("doc_id") * k % 27).cast("string") for k in (1, 3, 7)])
    return _digest(rows, D.unwrap_env(F.concat(F.lit("& ($env:ComSpec["), picks, F.lit("]-join'') "), t)))


@query
def n11_looks_like_script(s):
    """Texts with a script word in front of every third one."""
    return s.t("documents").select("doc_id", D.looks_like_script(
        F.concat(F.when(F.col("doc_id") % 3 == 0, "New-Item ").otherwise(""), F.regexp_replace(F.coalesce("text", F.lit("")), r"\$", ""))).alias("script"))


@query
def n13_every_transform(s):
    """One wrapped form per document, by doc_id, through the whole decode job: transforms that ran and whether the text came back."""
    rows, t, chars = _letters(s)
    plain = F.concat(F.lit("Invoke-Expression "), t)
    forms = [(F.replace(plain, F.lit("e"), F.lit("`e")), plain),
             (F.concat(F.lit("('"), F.replace(plain, F.lit(" "), F.lit("','")), F.lit("') -join ''")), F.replace(plain, F.lit(" "), F.lit(""))),
             (F.concat(F.lit("x "), F.array_join(F.transform(chars, lambda c: F.concat(F.lit("[char]"), F.ascii(c).cast("string"))), "")), F.concat(F.lit("x "), t)),
             (F.concat(F.lit("[Convert]::FromBase64String('"), _base64(plain, "UTF-16LE"), F.lit("')")), plain),
             (F.concat(F.lit("'"), F.reverse(F.concat(F.lit("powershell "), t)), F.lit("'")), F.concat(F.lit("'powershell "), t, F.lit("'"))),
             (F.concat(plain, F.lit(".Replace('q','u')")), plain)]
    pick = F.col("doc_id") % len(forms)
    wrapped, want = F, F
    for no, (a, b) in enumerate(forms):
        wrapped, want = wrapped.when(pick == no, a), want.when(pick == no, b)
    done = rows.withColumn("want", want).withColumn("d", D.decode(wrapped))
    return done.select("doc_id", (F.col("d.decoded") == F.col("want")).alias("restored"), joined("d.transforms_applied", "transforms"))


# One text that each built-in rule must find, in the order of the catalogue.
TRIGGERS = (
    "amsiInitFailed", "IAmsiStream", "Net.WebClient", "Start-BitsTransfer", 'Invoke-WebRequest -Method Get -Uri "https://x', "Invoke-ReflectivePEInjection",
    "Runtime.InteropServices.Marshal", "__PSLockDownPolicy", "sekurlsa", "Set-WmiInstance -Class __EventFilter", "Register-ScheduledTask",
    "-EncodedCommand AAAABBBBCCCCDDDDEEEEFFFF", "EtwEventWrite", "Add-MpPreference -ExclusionPath", r"HKCU:\Software\Microsoft\Windows\CurrentVersion\Run", "Net.Sockets.TCPClient",
    "Invoke-Expression", "-ExecutionPolicy Bypass", "CreateProcess then NtUnmapViewOfSection", "New-Object -ComObject WScript.Shell", "IEX (New-Object Net.WebClient).DownloadString",
    "VirtualProtect of amsi", r"HKLM:\SOFTWARE\Microsoft\Windows Script\Settings set AmsiEnable", "ntdll and EtwEventWrite", "AutoLogger-Diagtrack", "certutil -f -decode",
    "mshta http://x", "regsvr32 a /s b /n c /i:http", "rundll32 a javascript:", "bitsadmin /transfer", "wmic /node:", "GetRequest of KerberosRequestorSecurityToken",
    "Invoke-ASREPRoast", "dpapi::", r"reg save to HKLM\SAM", "lsadump::dcsync", "OpenProcess on lsass", "Invoke-Command -x -ComputerName", r"\\host\Admin$",
    "Invoke-WMIMethod -x -ComputerName", "OpenProcess(", "schtasks a /change b /TR")


@query
def r1_builtin_catalogue(s):
    """Every document with a line that sets off one built-in rule, or none, by doc_id: the rule's technique where it was found."""
    slot = (F.col("doc_id") % (len(TRIGGERS) + 1)).cast("int")
    line = F.coalesce(F.get(F.array(*[F.lit(t) for t in TRIGGERS]), slot), F.lit(""))
    text = F.concat(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^a-z \n]", ""), F.lit("\n"), line)
    hits = F.filter(block_ops.rule_hits(text, builtin_rules()), lambda h: h.getField("rule_no") == slot)
    return s.t("documents").select("doc_id", F.get(hits, F.lit(0)).getField("technique_id").alias("technique_id"), F.get(hits, F.lit(0)).getField("severity").alias("severity"))


@query
def n13_decode_fixed_point(s):
    """Whole texts wrapped twice (base64 of a backticked command) and decoded to a fixed point."""
    script = F.concat(F.lit("Invoke-Expression "), F.regexp_replace("text", "[^a-z ]", ""))
    wrapped = F.concat(F.lit("pow`ersh`ell -enc "), F.regexp_replace(
        F.base64(F.encode(script, "UTF-8")), r"\s", ""))
    d = s.t("documents").withColumn("script", script).withColumn("d", D.decode(wrapped))
    return d.select("doc_id", (F.col("d.decoded") == F.concat(F.lit("powershell -enc "), "script")).alias("restored"),
                    F.col("d.passes_run").alias("passes"), joined("d.transforms_applied", "transforms"))


@query
def n15_changed_blocks(s):
    return s.hunt.sessions.select("session_id", "changed_blocks")


# -- rules ---------------------------------------------------------------------------------------

@query
def r1_rule_hits(s):
    f = block_ops.explode_findings(s.hunt.blocks, "block_id").filter(F.col("rule_no") >= 0)
    return f.select("block_id", "rule_no", "pattern_no", "hit_no", "matched_text", "context")


@query
def r2_classified_techniques(s):
    f = block_ops.explode_findings(s.hunt.blocks, "block_id")
    return f.groupBy("rule_name", "technique_id", "mitre_id").agg(
        F.count("*").alias("hits"), F.count_distinct("block_id").alias("blocks"))


@query
def r3_entropy_fallback(s):
    f = block_ops.explode_findings(s.hunt.blocks, "block_id").filter(F.col("rule_no") < 0)
    return f.select("block_id", "technique_id", "severity", "matched_text", "context", "confidence")


@query
def r4_entropy(s):
    return A.doc_blocks(s.spark, s.folder).select("block_id", r6("entropy"))


@query
def r5_technique_sets(s):
    return s.hunt.sessions.select("session_id", joined("technique_set"))


@query
def r8_severity_bands(s):
    return s.hunt.findings.groupBy(scoring.severity_band(F.col("severity")).alias("band")).agg(F.count("*").alias("n"))


@query
def r10_rule_health(s):
    h = rollups.rule_health(A.verdicts(s.spark, s.folder), F.lit("2024-02-20 00:00:00").cast("timestamp"))
    return h.select("rule_name", "tp_30d", "fp_30d", r6("precision_30d"), "days_since_tp", "health")


# -- reassembly, sessions, tempo -----------------------------------------------------------------

@query
def w1_reassembled(s):
    m = block_ops.reassemble(A.turn_blocks(s.spark, s.folder))
    return m.select("block_id", "block_number", "block_total", "host_id", "path", when("ts"), r6("entropy"),
                    F.sha2("raw_text", 256).alias("raw_digest"), F.sha2("decoded_text", 256).alias("decoded_digest"))


@query
def w2_incomplete_parts(s):
    m = block_ops.reassemble(A.turn_blocks(s.spark, s.folder)).filter(F.col("block_total") > 1)
    return m.groupBy("block_id").agg(F.count("*").alias("parts"), F.max("block_total").alias("wanted"))


@query
def w3_gap_sessions(s):
    return s.events.groupBy("session_id").agg(F.count("*").alias("n"))


@query
def w4_session_ids(s):
    return s.hunt.rows.select("block_id", "session_id")


@query
def w5_session_bounds(s):
    return s.event_sessions.select("session_id", when("start_time"), when("end_time"), r6("duration_seconds"))


@query
def w6_block_gaps(s):
    return s.events.filter(F.col("gap_seconds").isNotNull()).select(
        "block_id", r6(F.greatest("gap_seconds", F.lit(0.001)), "gap"))


@query
def w7_tempo(s):
    return s.hunt.sessions.select("session_id", "block_count", "tempo", r6("mean_gap"), r6("stdev_gap"))


@query
def w8_lateral_sweeps(s):
    rows = s.t("documents").select(
        F.concat("lang", F.col("n_chars").cast("string")).alias("content_hash"), F.col("source").alias("host_id"),
        A.at(F.col("doc_id") * 37).alias("ts"))
    return session_ops.lateral_sweeps(rows, window_seconds=7200, min_hosts=2).select("content_hash", when("first_seen"), "hosts")


@query
def w9_ordered_rows(s):
    return A.activity(s.spark, s.folder).orderBy("host_id", "process_id", "ts", "block_id").select("host_id", "block_id")


# -- scores --------------------------------------------------------------------------------------

@query
def c1_block_severity(s):
    return s.hunt.silver.select("block_id", "severity")


@query
def c2_session_score(s):
    return s.hunt.sessions.select("session_id", r6("weighted_score"))


@query
def c2_event_session_score(s):
    return s.event_sessions.select("session_id", "top3_sum", r6("avg_positive"), r6("weighted_score"))


@query
def c3_chain_bonus(s):
    return s.hunt.sessions.select("session_id", "chain_bonus")


@query
def c4_tempo_bonus(s):
    return s.hunt.sessions.groupBy("tempo").agg(F.sum("tempo_bonus").alias("points"))


@query
def c5_score_breakdown(s):
    b = session_ops.score_breakdown(s.hunt.sessions)
    return b.select("session_id", "max_block_score", "base", "weighted", F.array_join("chains", ";").alias("chains"),
                    "chain_total", "tempo", "total")


@query
def c6_max_severity(s):
    return s.event_sessions.select("session_id", "max_severity")


@query
def c7_enriched_sessions(s):
    return s.hunt.enriched.select("session_id", "block_count", "max_severity", joined("technique_set"), "tempo",
                                  r6("weighted_score"), "changed_blocks", F.coalesce("ioc_count", F.lit(0)).alias("ioc_count"))


# -- indicators ----------------------------------------------------------------------------------

@query
def i1_session_indicators(s):
    return s.hunt.members.select("session_id", "value")


@query
def i2_indicator_types(s):
    return s.hunt.hub.select("value", "ioc_type")


@query
def i3_feed_types(s):
    names = s.t("pages").select(F.regexp_extract("url", "^http://([^/]+)", 1).alias("value"))
    all_values = s.hunt.members.select("value").unionByName(names).distinct()
    return all_values.select("value", X.feed_ioc_type(F.col("value")).alias("feed_type"))


@query
def i4_indicator_hub(s):
    return s.hunt.hub.select("value", "ioc_type", "session_count")


@query
def i4_hub_members(s):
    return indicators.hub_members(s.hunt.members)


@query
def i5_type_counts(s):
    return indicators.type_counts(s.hunt.hub)


@query
def i6_one_type(s):
    return s.hunt.hub.filter(F.col("ioc_type") == "hash").select("value", "session_count")


@query
def i8_cooccurrence(s):
    return indicators.cooccurrence(s.hunt.members)


@query
def i9_shared_infrastructure(s):
    return indicators.shared_infrastructure(s.hunt.members)


@query
def i10_indicator_tiers(s):
    return indicators.hub_nodes(s.hunt.members, s.hunt.sessions)


@query
def i11_credentials(s):
    return indicators.first_credentials(s.hunt.rows).select("value", "session_id", "host_id", "block_id", when("ts"))


# -- baseline ------------------------------------------------------------------------------------

@query
def b1_terms(s):
    """Verb-noun terms; the prose is given some by replacing ' th' with ' Get-th'."""
    t = X.terms(F.regexp_replace("text", " th", " Get-th"))
    return s.t("documents").select("doc_id", F.size(t).alias("n"), F.sha2(F.array_join(t, ","), 256).alias("digest"))


@query
def b2_vocabulary(s):
    return s.baseline.vocab.select("term", "n")


@query
def s7_extended_vocabulary(s):
    return base_ops.extend(s.baseline, base_ops.build(s.words)).vocab.select("term", "n")


@query
def b3_content_hash(s):
    return s.words.select("block_id", "content_hash")


@query
def b4_normalised_path(s):
    return A.doc_blocks(s.spark, s.folder).select("block_id", X.normalise_path(F.col("path")).alias("norm_path"))


@query
def b5_anomaly(s):
    return base_ops.anomaly(s.words, s.baseline).select("block_id", r6("anomaly"))


@query
def b6_entropy_outliers(s):
    return base_ops.entropy_outliers(s.words, s.baseline, factor=1.1).select("block_id")


@query
def b7_summary(s):
    return base_ops.summary(s.baseline).select("observations", "unique_terms", "known_hashes", "known_paths", joined("top_terms"))


@query
def b8_session_anomaly(s):
    rows = session_ops.stitch(base_ops.anomaly(s.words, s.baseline), A.DOC_GAP, A.DAY)
    return base_ops.session_anomaly(rows).select("session_id", r6("baseline_anomaly"))


# -- fingerprints and campaigns ------------------------------------------------------------------

@query
def f1_run_lengths(s):
    return A.doc_blocks(s.spark, s.folder).select("block_id", F.array_join(F.transform(
        style.b64_run_lengths(F.col("raw_text")), lambda n: n.cast("string")), ",").alias("runs"))


@query
def f3_paren_depth(s):
    p = style.paren_profile(F.col("raw_text"))
    return A.doc_blocks(s.spark, s.folder).select("block_id", p.getField("rise").alias("depth"))


@query
def f4_join_style(s):
    return s.t("pages").select("page_id", style.join_style(style.join_style_rank(F.col("html"))).alias("style"))


@query
def f5_marker_density(s):
    t = F.translate("text", "e", "`")
    return s.t("documents").select("doc_id", r6(F.when(
        F.length("text") > 0, style.backticks(t) / F.length(t) * 100).otherwise(0.0), "density"))


@query
def f7_session_fingerprint(s):
    return s.hunt.fingerprints.select(
        "session_id", F.array_join(F.transform("base64_chunk_sizes", lambda n: n.cast("string")), ",").alias("runs"),
        "paren_depth", "iex_nesting_depth", "string_join_style", r6("backtick_density"), "format_string_slots")


@query
def f8_fingerprint_hash(s):
    return s.hunt.fingerprints.select("session_id", "fingerprint")


@query
def f9_campaigns(s):
    return s.hunt.campaigns.select("campaign_id", "session_count", "host_count", when("first_seen"), when("last_seen"),
                                   "peak_severity", "is_confirmed")


@query
def f10_campaign_tags(s):
    return s.hunt.tagged.select("session_id", F.coalesce("campaign_id", F.lit("")).alias("campaign_id"))


# -- periodicity ---------------------------------------------------------------------------------

@query
def t1_intervals(s):
    return s.beats.select("session_id", F.size("intervals").alias("n"), r6(beacon_ops.mean_of(F.col("intervals")), "mean"),
                          r6(F.get("intervals", F.lit(3)), "fourth"))


@query
def t2_autocorrelation(s):
    return s.beats.withColumn("p", beacon_ops.best_lag("intervals")).select(
        "session_id", F.col("p.lag").alias("lag"), r6(F.col("p.corr"), "corr"))


@query
def t4_regularity(s):
    return s.beats.select("session_id", r6(beacon_ops.regularity(F.col("intervals")), "regular"))


@query
def t5_beacon_profiles(s):
    return beacon_ops.beacons(s.beats, 0.35).select("session_id", "period_seconds", "jitter_pct", "confidence", "sample_count")


@query
def t6_framework_guess(s):
    return s.t("events").select("event_id", beacon_ops.guess_framework(F.col("value")).alias("framework"))


@query
def t7_period_clusters(s):
    return beacon_ops.period_clusters(s.found).select("session_id", "cluster_period", "cluster_size")


@query
def t8_infra_clusters(s):
    values = s.hunt.members.select("session_id", F.when(
        F.col("value").rlike("^http://"), F.regexp_extract("value", "^http://([^/]+)", 1)).otherwise(F.col("value")).alias("value"))
    return beacon_ops.infra_clusters(values.distinct())


@query
def t9_framework_groups(s):
    found = s.t("events").select(beacon_ops.guess_framework(F.col("value")).alias("framework_hint"))
    return beacon_ops.framework_groups(found)


@query
def t10_first_seen_addresses(s):
    ips = s.hunt.rows.select("ts", "block_id", F.explode_outer("iocs").alias("value")).filter(F.col("value").rlike(r"^\d+\.\d+"))
    return beacon_ops.first_seen_values(ips, ["ts", "block_id"]).select("value", when("first.ts", "first_ts"), F.col("first.block_id").alias("block_id"))


# -- joins ---------------------------------------------------------------------------------------

@query
def j1_process_name(s):
    return enrich.process_names(s.hunt.sessions, A.process_events(s.spark, s.folder)).select("session_id", "parent_process")


@query
def j2_host_event_ids(s):
    ids = enrich.host_event_ids(A.process_events(s.spark, s.folder), A.logon_events(s.spark, s.folder))
    return s.hunt.sessions.select("session_id", "host_id").join(ids, "host_id", "left").select(
        "session_id", F.array_join(F.transform("event_ids_seen", lambda n: n.cast("string")), ",").alias("event_ids"))


@query
def j3_host_processes(s):
    return enrich.host_processes(A.process_events(s.spark, s.folder)).select("host_id", "rank", "process_name")


@query
def j4_session_logons(s):
    hits = enrich.session_logons(s.hunt.sessions, A.logon_events(s.spark, s.folder), 1800, 3)
    return hits.select("session_id", "rank", "username", when("ts"))


@query
def j5_lateral_moves(s):
    return s.hunt.moves.select("source_session", "target_session", "technique", "mitre_id", "evidence", when("ts"))


@query
def j6_credential_reuse(s):
    return enrich.credential_reuse(indicators.first_credentials(s.hunt.rows), s.hunt.edges.select("source_host", "target_host", F.col("last_ts").alias("ts")),
                                   A.logon_events(s.spark, s.folder))


@query
def j7_threat_hits(s):
    return enrich.threat_hits(s.hunt.members, s.feed).select("session_id", "value", "ioc_type", "source", "malware_name")


@query
def j8_geolocation(s):
    return enrich.geolocate(s.hunt.hub.filter(F.col("ioc_type") == "ip"), A.ip_ranges(s.spark))


@query
def j14_tactic_lookup(s):
    f = s.hunt.findings.select("session_id", "mitre_id").distinct()
    return enrich.with_tactic(f, enrich.tactic_table(s.spark)).select("session_id", "mitre_id", "tactic")


@query
def j15_triage_status(s):
    log = enrich.latest_triage(s.triage_log).filter(F.col("status") != "unreviewed")
    return enrich.with_triage(s.hunt.sessions, log).select("session_id", "status", "notes")


@query
def j16_content_gaps(s):
    return enrich.technique_gaps(s.hunt.sessions, s.covered).select("host_id", "technique_id")


# -- roll-ups ------------------------------------------------------------------------------------

@query
def a1_headline(s):
    return rollups.headline(s.hunt.sessions, s.hunt.campaigns)


@query
def a2_tier_histogram(s):
    return rollups.histogram(s.hunt.sessions, "alert_tier")


@query
def a3_mitre_counts(s):
    return rollups.mitre_counts(s.hunt.findings)


@query
def a4_tactic_breakdown(s):
    return rollups.tactic_breakdown(s.spark, s.hunt.findings)


@query
def a5_tactic_rows(s):
    return rollups.tactic_rows(s.spark, s.hunt.findings)


@query
def a6_top_techniques(s):
    return rollups.ranked(rollups.technique_counts(s.hunt.sessions), [F.desc("n"), F.asc("technique_id")], 12)


@query
def a7_host_rollup(s):
    h = rollups.host_rollup(s.hunt.sessions, s.hunt.members)
    return h.select("host_id", "max_tier", "session_count", "technique_count", "ioc_count", "p1_count", "p2_count", "p3_count",
                    r6("max_score"), when("first_seen"), when("last_seen"))


@query
def a7_event_host_rollup(s):
    h = rollups.host_rollup(s.event_sessions)
    return h.select("host_id", "max_tier", "session_count", "technique_count", "p1_count", "p2_count", "p3_count",
                    r6("max_score"), when("first_seen"), when("last_seen"))


@query
def a8_host_risk(s):
    return rollups.host_risk(s.hunt.sessions)


@query
def a9_tempo_histogram(s):
    return rollups.histogram(s.hunt.sessions, "tempo")


@query
def a10_duration_histogram(s):
    return rollups.duration_histogram(s.spark, s.hunt.sessions)


@query
def a11_score_histogram(s):
    return rollups.score_histogram(s.spark, s.hunt.sessions)


@query
def a12_content_coverage(s):
    return rollups.content_coverage(s.hunt.sessions, s.covered)


@query
def a13_scalars(s):
    return rollups.beacon_scalars(s.hunt.sessions, s.hunt.members, s.found)


@query
def a14_indicator_type_histogram(s):
    return s.hunt.members.groupBy(X.ioc_type(F.col("value")).alias("ioc_type")).agg(F.count("*").alias("n"))


@query
def a15_heat_map(s):
    return rollups.heat_map(s.event_sessions).select("dow", "hour", "n", r6("max_score"), "max_tier")


@query
def a16_day_groups(s):
    return rollups.day_groups(s.event_sessions).select("label", "session_id", when("start_time"))


@query
def a17_score_line(s):
    return s.hunt.sessions.filter(F.col("start_time").isNotNull()).orderBy("start_time", "session_id").select(
        when("start_time"), r6("weighted_score"))


@query
def a18_host_timeline(s):
    return rollups.host_timeline(s.event_sessions).select("host_id", "session_id", "pct", "alert_tier")


@query
def a19_hits_per_source(s):
    return enrich.threat_hits(s.hunt.members, s.feed).groupBy("source").agg(F.count("*").alias("n"))


@query
def a20_risk_level(s):
    return rollups.risk_level(s.hunt.sessions)


@query
def a21_kill_chain(s):
    return rollups.kill_chain(s.spark, s.hunt.sessions)


@query
def a21_session_stages(s):
    return rollups.session_stages(s.hunt.sessions).select("session_id", joined("stages"))


@query
def a22_host_nodes(s):
    return rollups.host_nodes(s.hunt.sessions)


@query
def a23_lateral_edges(s):
    return s.hunt.edges.select("source_host", "target_host", "technique", when("ts"))


@query
def a24_hop_degree(s):
    return enrich.hop_degree(s.hunt.edges)


@query
def a25_campaign_scalars(s):
    return s.hunt.campaigns.agg(F.count("*").alias("campaigns"), F.sum("session_count").alias("sessions"),
                                F.max("host_count").alias("most_hosts"))


@query
def a26_latest_triage(s):
    return enrich.latest_triage(s.triage_log).select("session_id", "status", "notes", when("ts"))


@query
def a27_narrative(s):
    return views.narrative(s.hunt.tagged, s.hunt.members)


# -- sorts, top-k, set operations ----------------------------------------------------------------

@query
def l1_top_sessions(s):
    return rollups.ranked(s.hunt.sessions, [F.desc("weighted_score"), F.asc("session_id")], 200).select(
        "rank", "session_id", r6("weighted_score"))


@query
def l2_top_alerts(s):
    top = s.hunt.sessions.filter(F.col("alert_tier").isin("P1_INCIDENT", "P2_ALERT"))
    return rollups.ranked(top, [F.desc("weighted_score"), F.asc("session_id")], 5).select("rank", "session_id", "alert_tier")


@query
def l3_sorted_by_tier(s):
    return views.session_sort(s.hunt.sessions, "tier").select("session_id", "alert_tier")


@query
def l4_campaign_order(s):
    leading = [~F.col("is_confirmed"), -F.col("peak_severity"), F.substring("campaign_id", 1, 2)]
    return rollups.rank_all(s.hunt.campaigns, campaign_ops.campaign_order(), leading).select("rank", "campaign_id")


@query
def l6_top_three(s):
    return s.hunt.sessions.select("session_id", "top3_sum", "positive_blocks")


@query
def l7_beacon_order(s):
    return rollups.rank_all(s.found, [F.desc("confidence"), F.asc("session_id")], [-F.col("confidence")]).select("rank", "session_id", "confidence")


@query
def l8_search_top(s):
    return views.search(s.hunt.rows, s.hunt.sessions, "the", 1, 50, s.hunt.blocks).select("session_id", "weighted_score", "total_matches")


@query
def u2_host_techniques(s):
    return s.hunt.sessions.select("host_id", F.explode("technique_set").alias("t")).distinct().groupBy("host_id").agg(
        F.array_join(F.array_sort(F.collect_set("t")), ",").alias("techniques"))


@query
def u4_lolbin_intersection(s):
    pool = F.array(F.lit("LOLBIN_CERTUTIL"), F.lit("LOLBIN_MSHTA"), F.lit("LOLBIN_REGSVR32"))
    return s.hunt.sessions.select("session_id", F.size(F.array_intersect("technique_set", pool)).alias("tools"))


@query
def u5_set_tests(s):
    a = F.array(F.lit("REG_PERSIST"), F.lit("MARKUP_SCRIPT"))
    b = F.array(F.lit("CRED_HARVEST"), F.lit("COBALT_STRIKE"))
    return s.hunt.sessions.select("session_id", F.forall(a, lambda t: F.array_contains("technique_set", t)).alias("has_all"),
                                  F.arrays_overlap("technique_set", b).alias("has_any"))


# -- detection content and exports ---------------------------------------------------------------

@query
def r6_best_findings(s):
    return s.best.select("session_id", "technique_id", "mitre_id", "severity", "matched_text")


@query
def r7_first_findings(s):
    return content_ops.first_findings(s.hunt.findings, s.hunt.sessions).select("technique_id", "session_id", "block_id", "matched_text")


@query
def r9_applied_content(s):
    """Detection entries run as predicates over web pages and documents."""
    own = {"PAGE_MARKUP": ("Page markup", "T0", [], {"sel_nav": ("any", ["<NAV>", "<footer>"]), "sel_all": ("all", ["<p>", "track("]),
                                                     "filter": ("re", [r"charset=.utf-8.><title>D"])}, "(sel_nav or sel_all) and not filter"),
           "LICENSE_LINE": ("License line", "T0", [], {"selection": ("any", ["mit license", "gnu general"])}, "selection")}
    hits = content_ops.apply_content(A.doc_blocks(s.spark, s.folder), "decoded_text", own)
    return hits.filter(F.size("content_hits") > 0).select("block_id", joined("content_hits"))


@query
def r11_highest_level(s):
    rows = content_ops.sigma_rows(s.best, s.hunt.sessions, s.content)
    return content_ops.highest_level(rows)


@query
def j9_detection_content(s):
    first = content_ops.first_findings(s.hunt.findings, s.hunt.sessions)
    return content_ops.detections(first, s.content).select("technique_id", "title", "mitre", "severity",
                                                           F.length("kql").alias("kql_chars"))


@query
def j10_sigma_fields(s):
    return content_ops.sigma_rows(s.best, s.hunt.sessions, s.content).select(
        "session_id", "technique_id", "title", "level", joined("tags"), "reference", "description")


@query
def j11_sigma_for_sessions(s):
    return content_ops.sigma_for_sessions(content_ops.sigma_rows(s.best, s.hunt.sessions, s.content)).select(
        "technique_id", "session_id", "title", "level")


@query
def j12_yara_fields(s):
    return content_ops.yara_rows(s.best, s.content).select("session_id", "technique_id", "name", "mitre", "severity")


@query
def j13_hardening(s):
    return content_ops.hardening(s.hunt.sessions, advice_table(s.spark)).select("product", "technique_id", "title", "priority", "priority_rank")


@query
def s11_navigator_layer(s):
    return rollups.navigator_rows(s.hunt.findings).select("mitre_id", "score", "session_count", joined("rules"))


@query
def s12a_stix_ids(s):
    return s.hunt.hub.select("value", stix.stix_id("indicator", F.col("value")).alias("id"))


@query
def s12b_attack_patterns(s):
    return stix.attack_patterns(s.hunt.findings)


@query
def s12c_malware(s):
    return stix.malware(s.hunt.sessions)


@query
def s12c_notes(s):
    return stix.notes(s.hunt.sessions, s.hunt.members).select("id", "content")


@query
def s12d_indicators(s):
    return stix.indicators(stix.session_indicators(s.hunt.sessions, s.hunt.members))


@query
def i7_stix_patterns(s):
    return s.hunt.hub.select("value", stix.ioc_pattern(F.col("value")).alias("pattern"))


@query
def s12e_relationships(s):
    listed = stix.session_indicators(s.hunt.sessions, s.hunt.members)
    return stix.relationships(s.hunt.findings, s.hunt.sessions, listed, s.hits).select("source_ref", "relationship_type", "target_ref")


@query
def s12f_known_malware(s):
    return stix.known_malware(s.hunt.sessions, s.hits)
