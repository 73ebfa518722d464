"""Common table expressions for the DuckDB side, written independently of the Spark operators."""
from __future__ import annotations

import re

from huskwatch.catalog.content import CONTENT, advice_rows
from huskwatch.catalog.lookups import FRAMEWORK_INTERVALS, KILL_CHAIN, SUMMARY_TACTICS, TACTIC_FOR, TACTIC_ORDER
from huskwatch.plans.adapters import DOC_RULES


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


TIER = "CASE WHEN {s} >= 80 THEN 'P1_INCIDENT' WHEN {s} >= 60 THEN 'P2_ALERT' WHEN {s} >= 40 THEN 'P3_WARNING' WHEN {s} > 0 THEN 'INFO' ELSE 'CLEAN' END"
RANK = "CASE {t} WHEN 'P1_INCIDENT' THEN 4 WHEN 'P2_ALERT' THEN 3 WHEN 'P3_WARNING' THEN 2 WHEN 'INFO' THEN 1 ELSE 0 END"
UNRANK = "CASE {r} WHEN 4 THEN 'P1_INCIDENT' WHEN 3 THEN 'P2_ALERT' WHEN 2 THEN 'P3_WARNING' WHEN 1 THEN 'INFO' ELSE 'CLEAN' END"
IOC = r"""(?i)https?://[^\s'")\]>]+|\b(?:\d{1,3}\.){3}\d{1,3}\b|\b[0-9a-fA-F]{32,64}\b|C:\\[^\s'")\]>]{5,}"""


BAND = "CASE WHEN {s} >= 85 THEN 'critical' WHEN {s} >= 70 THEN 'high' WHEN {s} >= 50 THEN 'medium' ELSE 'low' END"
PATTERN = r"""CASE WHEN starts_with(value, 'http://') OR starts_with(value, 'https://') THEN '[url:value = ''' || replace(value, '''', '\''') || ''']'
  WHEN regexp_full_match(value, '(?:\d{1,3}\.){3}\d{1,3}') THEN '[ipv4-addr:value = ''' || value || ''']'
  WHEN regexp_full_match(value, '[0-9a-fA-F]{64}') THEN '[file:hashes.SHA-256 = ''' || lower(value) || ''']'
  WHEN regexp_full_match(value, '[0-9a-fA-F]{32}') THEN '[file:hashes.MD5 = ''' || lower(value) || ''']' END"""


def sid(kind: str, seed: str) -> str:
    h = f"sha256({seed})"
    return f"'{kind}--' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12)"


def ioc_type(v: str) -> str:
    return (f"CASE WHEN regexp_matches({v}, '(?i)^https?://') THEN 'url' WHEN regexp_full_match({v}, '\\d{{1,3}}(?:\\.\\d{{1,3}}){{3}}') THEN 'ip' "
            f"WHEN regexp_full_match({v}, '[0-9a-fA-F]{{32,64}}') THEN 'hash' WHEN regexp_matches({v}, '^[A-Za-z]:\\\\') THEN 'path' ELSE 'other' END")


def feed_type(v: str) -> str:
    return (f"CASE WHEN regexp_matches(trim({v}), '(?i)^https?://') THEN 'url' WHEN regexp_full_match(trim({v}), '(?:\\d{{1,3}}\\.){{3}}\\d{{1,3}}') THEN 'ip' "
            f"WHEN regexp_full_match(trim({v}), '[0-9a-fA-F]{{32,64}}') THEN 'hash' "
            f"WHEN regexp_full_match(trim({v}), '(?:[a-zA-Z0-9-]+\\.)+[a-zA-Z]{{2,}}') THEN 'domain' ELSE 'unknown' END")


def sessionise(source: str, gap: int) -> str:
    return f"""SELECT *, host_id || '_' || process_id || '_' || strftime(min(ts) OVER (PARTITION BY host_id, process_id, sno), '%Y%m%dT%H%M%S') AS session_id,
      CASE WHEN jump = 0 THEN (epoch_us(ts) - epoch_us(prev)) / 1e6 END AS gap
    FROM (SELECT *, sum(jump) OVER (PARTITION BY host_id, process_id ORDER BY ts, block_id ROWS UNBOUNDED PRECEDING) AS sno
      FROM (SELECT *, CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) > {gap}000000 THEN 1 ELSE 0 END AS jump
        FROM (SELECT *, lag(ts) OVER (PARTITION BY host_id, process_id ORDER BY ts, block_id) AS prev FROM {source})))"""


def summarise(source: str, techs: str) -> str:
    return f"""SELECT a.*, coalesce(t.tech, []::VARCHAR[]) AS tech,
      CASE WHEN block_count < 2 THEN 'single_block' WHEN mean_gap < 0.5 AND coalesce(stdev_gap / mean_gap, 0) < 0.3 THEN 'automated_stager'
        WHEN mean_gap > 2.0 AND coalesce(stdev_gap / mean_gap, 0) > 0.8 THEN 'interactive_operator' ELSE 'mixed' END AS tempo
    FROM (SELECT session_id, any_value(host_id) AS host_id, any_value(process_id) AS process_id, min(ts) AS start_time, max(ts) AS end_time,
        count(*) AS block_count, max(severity) AS max_severity, avg(greatest(gap, 0.001)) FILTER (gap IS NOT NULL) AS mean_gap,
        stddev_samp(greatest(gap, 0.001)) FILTER (gap IS NOT NULL) AS stdev_gap, CAST(sum(changed) AS BIGINT) AS changed_blocks,
        CAST(coalesce(list_sum(list_sort(list(severity) FILTER (severity > 0), 'DESC')[1:3]), 0) AS BIGINT) AS top3,
        avg(severity) FILTER (severity > 0) AS avgp, count(*) FILTER (severity > 0) AS posn
      FROM {source} GROUP BY session_id) a LEFT JOIN {techs} t USING (session_id)"""


def scored(source: str) -> str:
    chains = [
        ("AMSI bypass + download cradle", 15, "list_has_all(tech, ['AMSI_BYPASS_REFLECT','DOWNLOAD_CRADLE_WC'])"),
        ("Double AMSI bypass", 8, "list_has_all(tech, ['AMSI_BYPASS_REFLECT','AMSI_BYPASS_COM'])"),
        ("Reflective injection / shellcode", 20, "list_has_any(tech, ['REFLECTIVE_INJECT','SHELLCODE_MARSHAL'])"),
        ("Cobalt Strike beacon pattern", 20, "list_contains(tech, 'COBALT_STRIKE')"),
        ("Reverse shell + download", 15, "list_has_all(tech, ['REVERSE_SHELL','DOWNLOAD_CRADLE_WC'])"),
        ("Credential access + bypass chain", 15, "list_has_any(tech, ['CRED_HARVEST','DCSYNC_PATTERN','LSASS_READ','SAM_DUMP','KERBEROAST_SPN']) AND "
         "list_has_any(tech, ['AMSI_BYPASS_REFLECT','AMSI_BYPASS_PATCH','ETW_PATCH_INLINE'])"),
        ("Download + lateral movement", 20, "list_has_any(tech, ['LATERAL_PSREMOTING','LATERAL_WMI_EXEC','LATERAL_INVOKE_CMD']) AND "
         "list_has_any(tech, ['DOWNLOAD_CRADLE_WC','DOWNLOAD_CRADLE_IWR'])"),
        ("LOLBin cluster (2+ tools)", 12, "len(list_intersect(tech, ['LOLBIN_CERTUTIL','LOLBIN_MSHTA','LOLBIN_REGSVR32','LOLBIN_RUNDLL32','LOLBIN_BITSADMIN'])) >= 2"),
    ]
    pts = " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for _, p, c in chains)
    names = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {q(n)} END" for n, _, c in chains) + "], lambda x: x IS NOT NULL)"
    return f"""SELECT *, {TIER.format(s='score')} AS tier, epoch_us(end_time) / 1e6 - epoch_us(start_time) / 1e6 AS dur FROM (
      SELECT *, CASE WHEN posn > 0 THEN least(100.0::DOUBLE, 0.4::DOUBLE * max_severity + 0.6::DOUBLE * (0.7::DOUBLE * top3 + 0.3::DOUBLE * avgp) + chain + tbonus) ELSE 0.0::DOUBLE END AS score
      FROM (SELECT *, CAST({pts} AS INTEGER) AS chain, {names} AS chain_names,
        CASE WHEN tempo = 'interactive_operator' THEN 10 ELSE 0 END AS tbonus FROM {source}))"""


CTES = {
    "rules": "SELECT * FROM (VALUES " + values(
        (rno, pno, r.name, r.technique_id, r.mitre_id, r.severity, "(?i)" + p)
        for rno, r in enumerate(DOC_RULES) for pno, p in enumerate(r.patterns)
    ) + ") AS t(rule_no, pattern_no, rule_name, technique_id, mitre_id, severity, pattern)",
    "blocks": """SELECT 'd' || doc_id AS block_id, source AS host_id, CAST((doc_id // 20) % 6 AS INTEGER) AS process_id,
        TIMESTAMP '2024-01-01' + to_seconds(doc_id * 37 + doc_id * doc_id % 4001) AS ts,
        'C:\\data\\' || lang || '\\' || source || '.txt' AS path, CASE WHEN doc_id % 4 = 0 THEN replace(text, 'y', '`y') ELSE text END AS raw_text, text FROM documents
      UNION ALL SELECT 'p' || page_id, 'src' || (page_id % 20), CAST((page_id // 20) % 6 AS INTEGER),
        TIMESTAMP '2024-01-01' + to_seconds(page_id * 149 + page_id * page_id % 4001), '', url || chr(10) || html, url || chr(10) || html FROM pages""",
    "decoded": """SELECT * EXCLUDE (text), regexp_replace(text, 'token = "([0-9a-f]+)"', '[PLAINTEXT_CRED:\\1]', 'g') AS decoded_text FROM blocks""",
    "ent": """SELECT block_id, -sum(c / n * log2(c / n)) AS e FROM (
        SELECT block_id, ch, count(*)::DOUBLE AS c, any_value(n)::DOUBLE AS n FROM (
          SELECT block_id, length(raw_text) AS n, unnest(string_split(raw_text, '')) AS ch FROM blocks) WHERE n > 0 GROUP BY block_id, ch)
      GROUP BY block_id""",
    "full_blocks": "SELECT d.*, coalesce(e.e, 0.0) AS entropy FROM decoded d LEFT JOIN ent e USING (block_id)",
    "hit_lists": """SELECT b.block_id, b.decoded_text AS t, r.rule_no, r.pattern_no, r.rule_name, r.technique_id, r.mitre_id, r.severity,
        regexp_extract_all(b.decoded_text, r.pattern) AS m, string_split_regex(b.decoded_text, r.pattern) AS p
      FROM decoded b JOIN rules r ON regexp_matches(b.decoded_text, r.pattern)""",
    "hit_rows": """SELECT *, m[i] AS hit, CAST(coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0)
        + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s0
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM hit_lists)""",
    "rule_hits": """SELECT block_id, rule_no, pattern_no, CAST(i - 1 AS INTEGER) AS hit_no, rule_name, technique_id, mitre_id, severity, left(hit, 120) AS matched_text,
        left(regexp_replace(regexp_replace(replace(substring(t, greatest(s0 - 40, 0) + 1, least(length(t), s0 + length(hit) + 40) - greatest(s0 - 40, 0)),
          chr(10), ' '), '^\\s+', ''), '\\s+$', ''), 160) AS context, 1.0::DOUBLE AS confidence FROM hit_rows""",
    "fallback": """SELECT block_id, -1 AS rule_no, 0 AS pattern_no, 0 AS hit_no, 'entropy_heuristic' AS rule_name, 'HIGH_ENTROPY_BLOB' AS technique_id,
        'T1059.001' AS mitre_id, 40 AS severity, 'entropy=' || printf('%.2f', entropy) AS matched_text, left(decoded_text, 80) AS context, 0.5::DOUBLE AS confidence
      FROM full_blocks b WHERE entropy > 4.35 AND length(decoded_text) > 300 AND NOT EXISTS (SELECT 1 FROM hit_lists h WHERE h.block_id = b.block_id)""",
    "finds": "SELECT * FROM rule_hits UNION ALL SELECT * FROM fallback",
    "sev": """SELECT b.block_id, CAST(CASE WHEN f.mx IS NULL THEN CASE WHEN entropy > 6.0 AND length(decoded_text) > 500 THEN 40 ELSE 0 END
        ELSE least(100, mx + least(15, (k - 1) * 8) + CASE WHEN entropy > 4.45 THEN 10 ELSE 0 END) END AS INTEGER) AS severity
      FROM full_blocks b LEFT JOIN (SELECT block_id, max(severity) AS mx, count(DISTINCT technique_id) AS k FROM finds GROUP BY block_id) f USING (block_id)""",
    "scored_blocks": "SELECT b.*, s.severity, CAST(raw_text <> decoded_text AS INTEGER) AS changed FROM full_blocks b JOIN sev s USING (block_id)",
    "srows": sessionise("scored_blocks", 4000),
    "sfinds": "SELECT r.session_id, r.host_id, r.ts, f.* FROM finds f JOIN srows r USING (block_id)",
    "stechs": "SELECT session_id, list_sort(list(DISTINCT technique_id)) AS tech FROM sfinds GROUP BY session_id",
    "ssum": summarise("srows", "stechs"),
    "sess": scored("ssum"),
    "acts": """SELECT 'e' || event_id AS block_id, CAST(user_id AS VARCHAR) AS host_id, 0 AS process_id, ts,
        CAST(floor(least(100.0, value)) AS INTEGER) AS severity, event_type AS technique_id, CAST(event_type = 'error' AS INTEGER) AS changed FROM events""",
    "erows": sessionise("acts", 14400),
    "etechs": "SELECT session_id, list_sort(list(DISTINCT technique_id)) AS tech FROM erows GROUP BY session_id",
    "esum": summarise("erows", "etechs"),
    "esess": scored("esum"),
    "urows": sessionise("acts", 172800),
    "members": f"""SELECT DISTINCT session_id, host_id, trim(v) AS value FROM (
        SELECT session_id, host_id, unnest(regexp_extract_all(decoded_text, {q(IOC)})) AS v FROM srows) WHERE trim(v) <> ''""",
    "hub": f"SELECT value, {ioc_type('value')} AS ioc_type, count(*) AS session_count FROM members GROUP BY value",
    "hub_ranked": "SELECT *, row_number() OVER (ORDER BY session_count DESC, ioc_type, value) AS no FROM hub",
    "words": """SELECT block_id, host_id, process_id, ts, path, entropy, substr(sha256(decoded_text), 1, 20) AS content_hash,
        list_transform(regexp_extract_all(decoded_text, '(?i) th[a-z]+'), lambda w: lower(trim(w))) AS terms FROM full_blocks""",
    "benign": "SELECT w.* FROM words w JOIN (SELECT DISTINCT 'd' || doc_id AS block_id FROM labels WHERE quality = 1) g USING (block_id)",
    "vocab": "SELECT term, count(*) AS n FROM (SELECT unnest(terms) AS term FROM benign) GROUP BY term",
    "wpath": "SELECT *, CASE WHEN length(path) > 0 THEN replace(lower(regexp_replace(path, '^[A-Za-z]:\\\\', '')), '\\', '/') END AS norm_path FROM words",
    "bpaths": "SELECT DISTINCT replace(lower(regexp_replace(path, '^[A-Za-z]:\\\\', '')), '\\', '/') AS norm_path FROM benign WHERE length(path) > 0",
    "wterms": """SELECT block_id, count(*) AS nt, count(*) FILTER (coalesce(n, 0) < 5) AS rare, count(*) FILTER (n IS NULL) AS never
      FROM (SELECT block_id, unnest(terms) AS term FROM words) LEFT JOIN vocab USING (term) GROUP BY block_id""",
    "anom": """SELECT w.block_id, w.host_id, w.process_id, w.ts, CASE WHEN (SELECT count(*) FROM benign) < 100 OR w.content_hash IN (SELECT content_hash FROM benign) OR nt IS NULL THEN 0.0
        ELSE least(100.0, (least(100.0, (rare + 1.5 * never) / nt * 80) + CASE WHEN (SELECT count(*) FROM benign) > 50 AND entropy > 1.5 * (SELECT avg(entropy) FROM benign)
          AND entropy > 4.5 THEN 15.0 ELSE 0.0 END) * CASE WHEN norm_path IN (SELECT norm_path FROM bpaths) THEN 0.3 ELSE 1.0 END) END::DOUBLE AS anomaly
      FROM wpath w LEFT JOIN wterms USING (block_id)""",
    "arows": sessionise("anom", 4000),
    "runs": "SELECT block_id, session_id, unnest(regexp_extract_all(raw_text, '[A-Za-z0-9+/]{30,}={0,2}')) AS run FROM srows",
    "parens": """SELECT session_id, block_id, ts, pos, CASE ch WHEN '(' THEN 1 ELSE -1 END AS d FROM (
        SELECT session_id, block_id, ts, unnest(cs) AS ch, generate_subscripts(cs, 1) AS pos FROM (
          SELECT session_id, block_id, ts, string_split(regexp_replace(raw_text, '[^()]+', '', 'g'), '') AS cs FROM srows)) WHERE ch IN ('(', ')')""",
    "prints": """SELECT s.session_id, s.host_id, s.start_time, s.max_severity, s.score, coalesce(r.runs, '') AS runs, coalesce(p.depth, 0) AS paren_depth, f.style, f.density
      FROM sess s JOIN (SELECT session_id, CASE min(CASE WHEN regexp_matches(raw_text, '(?i)-join\\s*[''"]') THEN 0 WHEN regexp_matches(raw_text, '(?i)\\[string\\]::Join') THEN 1
            WHEN regexp_matches(raw_text, '\\+\\s*[''"]') THEN 2 END) WHEN 0 THEN '-join' WHEN 1 THEN '[string]::Join' WHEN 2 THEN 'concat' END AS style,
          sum(length(raw_text) - length(replace(raw_text, '`', ''))) * 100.0 / (sum(length(raw_text)) + count(*) - 1) AS density FROM srows GROUP BY session_id) f USING (session_id)
      LEFT JOIN (SELECT session_id, array_to_string(list_sort(list(DISTINCT length(run))), ',') AS runs FROM runs GROUP BY session_id) r USING (session_id)
      LEFT JOIN (SELECT session_id, max(s - least(0, lo)) AS depth FROM (
          SELECT *, min(s) OVER (PARTITION BY session_id ORDER BY ts, block_id, pos ROWS UNBOUNDED PRECEDING) AS lo FROM (
            SELECT *, sum(d) OVER (PARTITION BY session_id ORDER BY ts, block_id, pos ROWS UNBOUNDED PRECEDING) AS s FROM parens)) GROUP BY session_id) p USING (session_id)""",
    "fprints": "SELECT *, substr(sha256('|0|' || coalesce(style, 'none') || '|' || printf('%.1f', round(density, 1)) || '|0'), 1, 16) AS fingerprint FROM prints",
    "camps": """SELECT substr(fingerprint, 1, 8) AS campaign_id, count(*) AS session_count, count(DISTINCT host_id) AS host_count, min(start_time) AS first_seen,
        max(start_time) AS last_seen, max(max_severity) AS peak_severity, count(DISTINCT host_id) >= 2 AND count(*) >= 3 AS is_confirmed
      FROM fprints WHERE score > 20 GROUP BY fingerprint""",
    "ivs": """SELECT session_id, list(gap ORDER BY ts, block_id) FILTER (gap BETWEEN 2 AND 172800) AS iv, count(*) AS times FROM urows GROUP BY session_id""",
    "beats": "SELECT session_id, iv, len(iv) AS n, list_avg(iv) AS mean FROM ivs WHERE times >= 6 AND len(iv) >= 5",
    "lags": """SELECT session_id, lag, list_sum(list_transform(range(lag + 1, n + 1), lambda i: (iv[i] - mean) * (iv[i - lag] - mean))) / ((n - lag) * list_var_samp(iv)) AS corr
      FROM (SELECT *, unnest(range(1, greatest(2, n // 2))) AS lag FROM beats)""",
    "bestlag": "SELECT session_id, arg_min(lag, (-corr, lag)) AS lag, max(corr) AS corr FROM lags GROUP BY session_id",
    "profiles": """SELECT session_id, round(period, 1) AS period_seconds, round(1 - regular, 3) AS jitter_pct, round(conf, 3) AS confidence, n AS sample_count FROM (
        SELECT *, greatest(0, least(1, corr)) * 0.6 + regular * 0.4 AS conf FROM (
          SELECT b.session_id, b.n, l.corr, greatest(0, 1 - list_stddev_samp(iv) / mean) AS regular, list_avg(list_filter(iv, lambda x, i: (i - 1) % lag = 0)) AS period
          FROM beats b JOIN bestlag l USING (session_id)))""",
    "frameworks": "SELECT * FROM (VALUES " + values((i, fw, iv) for i, (fw, iv) in enumerate(
        (fw, iv) for fw, ivs in FRAMEWORK_INTERVALS for iv in ivs)) + ") AS t(no, fw, iv)",
    "guesses": """SELECT event_id, CASE WHEN min(abs(value - iv) / iv) < 0.25 THEN arg_min(fw, (abs(value - iv) / iv, no)) ELSE '' END AS framework
      FROM events CROSS JOIN frameworks GROUP BY event_id""",
    "procs": """SELECT 4688 + event_id % 3 AS event_id, 'src' || (user_id % 20) AS host_id, ts, CAST(user_id % 5 AS INTEGER) AS process_id,
        event_type || '_' || event_id AS process_name FROM events""",
    "logons": """SELECT CASE event_type WHEN 'view' THEN 4624 WHEN 'error' THEN 4625 ELSE 4648 END AS event_id, 'src' || (user_id % 20) AS host_id, ts, 'src' || (event_id % 23) AS target_host,
        'u' || event_id AS username FROM events""",
    "latmap": "SELECT * FROM (VALUES ('LATERAL_PSREMOTING','T1021.006','PSRemoting'),('LATERAL_WMI_EXEC','T1021.003','WMI Exec'),('LATERAL_INVOKE_CMD','T1021.002','SMB/PsExec'),"
               "('COM_LATERAL','T1021.003','DCOM'),('WMIC_REMOTE_EXEC','T1047','WMIC Remote')) AS t(technique, mitre_id, evidence)",
    "moves": """SELECT s.session_id AS source_session, d.session_id AS target_session, s.host_id AS source_host, d.host_id AS target_host, l.technique, l.mitre_id, l.evidence,
        d.start_time AS ts, s.start_time AS src_start
      FROM sess s JOIN latmap l ON list_contains(s.tech, l.technique) JOIN sess d ON d.host_id <> s.host_id
        AND (d.start_time > s.start_time OR (d.start_time = s.start_time AND d.session_id > s.session_id))
        AND d.start_time BETWEEN s.end_time - INTERVAL 60 SECOND AND s.end_time + INTERVAL 1800 SECOND""",
    "edges": "SELECT source_host, target_host, technique, arg_min(ts, (src_start, source_session, ts, target_session)) AS ts FROM moves GROUP BY ALL",
    "creds": """SELECT value, arg_min(session_id, o) AS session_id, arg_min(host_id, o) AS host_id, arg_min(block_id, o) AS block_id, arg_min(ts, o) AS ts FROM (
        SELECT *, row_number() OVER (ORDER BY host_id, process_id, ts, block_id, pos) AS o FROM (
          SELECT session_id, host_id, process_id, ts, block_id, unnest(cs) AS value, generate_subscripts(cs, 1) AS pos FROM (
            SELECT *, regexp_extract_all(decoded_text, '\\[PLAINTEXT_CRED:([^\\]]+)\\]', 1) AS cs FROM srows))) GROUP BY value""",
    "feed": """SELECT value, CASE WHEN length(value) % 3 = 0 THEN 'threatfox' WHEN regexp_matches(value, '^https?://') THEN 'urlhaus'
        WHEN regexp_full_match(value, '[0-9a-f]{32,64}') THEN 'malwarebazaar' ELSE 'threatfox' END AS source, 'fam' || (length(value) % 5) AS malware_name
      FROM (SELECT DISTINCT value FROM members) WHERE length(value) % 3 <> 1
      UNION ALL SELECT value, 'threatfox', 'second' FROM (SELECT DISTINCT value FROM members) WHERE length(value) % 2 = 0""",
    "hits": f"""SELECT session_id, value, ioc_type, arg_min(source, (no, malware_name)) AS source, arg_min(f.malware_name, (no, malware_name)) AS malware_name FROM (
        SELECT session_id, value, {feed_type('value')} AS ioc_type FROM members) m
      JOIN (SELECT lower(value) AS k, source, malware_name, ty, CASE WHEN ty = 'url' AND source = 'urlhaus' THEN 0 WHEN ty = 'url' AND source = 'threatfox' THEN 1
          WHEN ty = 'hash' AND source = 'malwarebazaar' THEN 0 WHEN ty = 'hash' AND source = 'threatfox' THEN 1 WHEN ty IN ('ip', 'domain') AND source = 'threatfox' THEN 0 END AS no
        FROM (SELECT *, {feed_type('value')} AS ty FROM feed)) f
      ON f.k = lower(m.value) AND f.ty = m.ioc_type WHERE no IS NOT NULL GROUP BY session_id, value, ioc_type""",
    "triage_log": """SELECT session_id, CASE WHEN severity >= 60 THEN 'confirmed' WHEN severity > 0 THEN 'triaged' ELSE 'unreviewed' END AS status, block_id AS notes, ts FROM srows""",
    "triage": "SELECT session_id, arg_max(status, (ts, status)) AS status, arg_max(notes, (ts, status)) AS notes, max(ts) AS ts FROM triage_log GROUP BY session_id",
    "tactics": "SELECT * FROM (VALUES " + values(TACTIC_FOR.items()) + ") AS t(prefix, tactic)",
    "tactic_order": "SELECT * FROM (VALUES " + values(enumerate(TACTIC_ORDER)) + ") AS t(tactic_no, tactic)",
    "summary_tactics": "SELECT * FROM (VALUES " + values(
        (no, name, p) for no, (name, ps) in enumerate(SUMMARY_TACTICS) for p in ps) + ") AS t(tactic_no, tactic, base)",
    "stages": "SELECT * FROM (VALUES " + values((no, n, t) for no, (n, ts) in enumerate(KILL_CHAIN) for t in ts) + ") AS t(stage_no, stage, technique_id)",
    "covered": "SELECT * FROM (VALUES " + values((t,) for t in CONTENT) + ") AS t(technique_id)",
    "content": "SELECT * FROM (VALUES " + values((t, c[0], ",".join(sorted([f"attack.{x}" for x in c[2]] + [f"attack.{c[1].lower()}"])), c[1]) for t, c in CONTENT.items())
               + ") AS t(technique_id, title, tags, mitre)",
    "advice": "SELECT * FROM (VALUES " + values((r[0], r[2], r[3], r[4]) for r in advice_rows()) + ") AS t(product, technique_id, title, priority)",
    "best": """SELECT session_id, technique_id, min(first_no) AS first_no, arg_min(mitre_id, o) AS mitre_id, arg_min(severity, o) AS severity, arg_min(matched_text, o) AS matched_text,
        any_value(host_id) AS host_id FROM (
        SELECT *, row_number() OVER (ORDER BY severity DESC, ts, block_id, rule_no, pattern_no, hit_no) AS o, row_number() OVER (ORDER BY ts, block_id, rule_no, pattern_no, hit_no) AS first_no
        FROM sfinds) GROUP BY session_id, technique_id""",
    "firsts": """SELECT technique_id, arg_min(session_id, o) AS session_id, arg_min(block_id, o) AS block_id, arg_min(matched_text, o) AS matched_text, arg_min(mitre_id, o) AS mitre_id,
        arg_min(severity, o) AS severity FROM (SELECT f.*, row_number() OVER (ORDER BY f.host_id, s.process_id, f.ts, f.block_id, f.rule_no, f.pattern_no, f.hit_no) AS o
        FROM sfinds f JOIN sess s USING (session_id) WHERE s.score >= 40) GROUP BY technique_id""",
    "sig": f"""SELECT b.session_id, b.technique_id, b.mitre_id, b.host_id, s.process_id, s.start_time, s.score, coalesce(c.title, 'PowerShell suspicious: ' || lower(replace(b.technique_id, '_', ' '))) AS title,
        {BAND.format(s='b.severity')} AS level, coalesce(c.tags, 'attack.' || lower(b.mitre_id)) AS tags, b.matched_text FROM best b JOIN sess s USING (session_id) LEFT JOIN content c USING (technique_id)""",
    "listed": f"""SELECT session_id, value, {PATTERN} AS pattern FROM members
        WHERE session_id IN (SELECT session_id FROM sess WHERE tier <> 'CLEAN') AND {PATTERN} IS NOT NULL""",
    "stech": "SELECT session_id, host_id, unnest(tech) AS technique_id FROM sess",
    "turns": """SELECT 'c' || conv_id AS block_id, CAST(turn + 1 AS INTEGER) AS block_number,
        CAST(max(turn) OVER (PARTITION BY conv_id) + 1 + CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS block_total,
        'h' || (conv_id % 7) AS host_id, TIMESTAMP '2024-01-01' + to_seconds(conv_id * 60 + turn) AS ts, role AS path, text AS raw_text, replace(text, 'e', 'E') AS decoded_text FROM conversations""",
    "turn_groups": """SELECT block_id, count(*) AS n, arg_min(block_total, block_number) AS want, string_agg(raw_text, '' ORDER BY block_number) AS raw_text,
        string_agg(decoded_text, '' ORDER BY block_number) AS decoded_text, any_value(host_id) AS host_id, arg_min(path, block_number) AS path, min(ts) AS ts
      FROM turns WHERE block_total > 1 GROUP BY block_id""",
    "whole": """SELECT block_id, block_number, block_total, host_id, path, ts, raw_text, decoded_text FROM turns WHERE block_total <= 1
      UNION ALL SELECT block_id, 1, 1, host_id, path, ts, raw_text, decoded_text FROM turn_groups WHERE n = want
      UNION ALL SELECT t.block_id, t.block_number, t.block_total, t.host_id, t.path, t.ts, t.raw_text, t.decoded_text FROM turns t JOIN turn_groups g USING (block_id)
        WHERE t.block_total > 1 AND g.n <> g.want""",
    "search_hits": """SELECT session_id, block_id, decoded_text, strpos(lower(decoded_text), '{needle}') AS apos,
        row_number() OVER (PARTITION BY session_id ORDER BY ts, block_id) AS rn, count(*) OVER (PARTITION BY session_id) AS total FROM srows
      WHERE contains(lower(decoded_text), '{needle}')""",
}

# The same profiles over intervals of which every other list is made regular.
CTES["ivs_m"] = "SELECT session_id, CASE WHEN len(iv) % 2 = 0 THEN list_transform(iv, lambda x, i: 60.0::DOUBLE + (i - 1) % 5) ELSE iv END AS iv, times FROM ivs"
for _name in ("beats", "lags", "bestlag", "profiles"):
    CTES[f"{_name}_m"] = re.sub(r"\b(ivs|beats|lags|bestlag)\b", r"\1_m", CTES[_name])


def with_ctes(final: str, **params: str) -> str:
    """Prefix ``final`` with the tables it needs, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in CTES.items():
            if name not in needed and re.search(rf"(?:FROM|JOIN|,)\s+\(?{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)
    visit(final)
    parts = [f"{n} AS MATERIALIZED ({CTES[n]})" for n in needed]
    text = ("WITH " + ",\n".join(parts) + "\n" if parts else "") + final
    for k, v in params.items():
        text = text.replace("{" + k + "}", v)
    return text
