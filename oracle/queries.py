"""DuckDB SQL of every registered query that SQL can express."""
from __future__ import annotations

from huskwatch.catalog.content import CONTENT, render
from huskwatch.catalog.lookups import PHRASES
from oracle.ctes import BAND, PATTERN, RANK, UNRANK, feed_type, ioc_type, q, sid, values, with_ctes

TS = "%Y-%m-%d %H:%M:%S"
LETTERS = "regexp_replace(coalesce(text, ''), '[^A-Za-z ]', '', 'g')"
CMD = r"'C:\Windows\System32\cmd.exe'"


def ts(col: str, name: str | None = None) -> str:
    return f"strftime({col}, '{TS}') AS {name or col.split('.')[-1]}"


TECH = "array_to_string(tech, ',') AS technique_set"

RAW: dict[str, str] = {
    "p1_first_filled": "SELECT doc_id, coalesce(nullif(CASE WHEN lang = 'en' THEN '' ELSE lang END, ''), nullif(source, '')) AS host FROM documents",
    "p2_nonempty_text": "SELECT lang, count(*) AS n FROM documents WHERE length(text) > 0 GROUP BY lang",
    "p4_alert_tier": "SELECT session_id, tier AS alert_tier FROM esess",
    "p5_session_summary": f"""SELECT s.session_id, s.host_id, s.process_id, tier AS alert_tier, round(score, 1) AS weighted_score, {ts('start_time')}, {ts('end_time')},
        round(dur, 1) AS duration_seconds, {TECH}, block_count, coalesce(i.n, 0) AS ioc_count, coalesce(m.n, 0) AS lateral_move_count, false AS has_beacon, tempo,
        changed_blocks AS deobfuscation_passes, max_severity
      FROM sess s LEFT JOIN (SELECT session_id, count(*) AS n FROM members GROUP BY session_id) i USING (session_id)
      LEFT JOIN (SELECT source_session AS session_id, count(*) AS n FROM moves GROUP BY source_session) m USING (session_id)""",
    "p6_session_detail": """SELECT session_id, 'processes' AS child, least(30, count(*)) AS n FROM sess JOIN procs USING (host_id) GROUP BY session_id
      UNION ALL SELECT s.session_id, 'logons', least(30, count(*)) FROM sess s JOIN logons l ON l.host_id = s.host_id AND l.ts BETWEEN s.start_time - INTERVAL 300 SECOND AND s.end_time + INTERVAL 300 SECOND GROUP BY s.session_id
      UNION ALL SELECT session_id, 'hits', count(*) FROM hits GROUP BY session_id
      UNION ALL SELECT session_id, 'moves', count(*) FROM (SELECT source_session AS session_id FROM moves UNION ALL SELECT target_session FROM moves) GROUP BY session_id
      UNION ALL SELECT session_id, 'credentials', count(*) FROM creds GROUP BY session_id""",
    "p6_session_nested": """SELECT s.session_id, s.tier AS alert_tier, coalesce(i.l, '') AS iocs, coalesce(h.l, '') AS ti_hits, coalesce(m.l, '') AS lateral_moves, coalesce(p.l, '') AS process_tree,
        coalesce(g.l, '') AS logons, coalesce(c.l, '') AS credentials, coalesce(f.l, '') AS findings, b.l AS blocks,
        coalesce(i.n, 0) AS iocs_total, coalesce(h.n, 0) AS ti_hits_total, coalesce(m.n, 0) AS lateral_moves_total, coalesce(p.n, 0) AS process_tree_total, b.n AS blocks_total
      FROM sess s
      LEFT JOIN (SELECT session_id, count(*) AS n, array_to_string(list(value ORDER BY value)[1:60], '|') AS l FROM members GROUP BY session_id) i USING (session_id)
      LEFT JOIN (SELECT session_id, count(*) AS n, array_to_string(list(value || ' ' || source || ' ' || malware_name ORDER BY value, source)[1:200], '|') AS l FROM hits GROUP BY session_id) h USING (session_id)
      LEFT JOIN (SELECT e AS session_id, count(*) AS n, array_to_string(list(source_session || ' ' || target_session || ' ' || technique ORDER BY ts, source_session, target_session, technique)[1:5], '|') AS l
        FROM (SELECT *, unnest([source_session, target_session]) AS e FROM moves) GROUP BY e) m USING (session_id)
      LEFT JOIN (SELECT host_id, least(30, count(*)) AS n, array_to_string(list(process_id || ' ' || process_name ORDER BY ts, process_id, process_name)[1:30], '|') AS l FROM procs GROUP BY host_id) p USING (host_id)
      LEFT JOIN (SELECT session_id, array_to_string(list(username || ' ' || target_host || ' ' || event_id ORDER BY l.ts, username, target_host)[1:30], '|') AS l
        FROM sess s JOIN logons l ON l.host_id = s.host_id AND l.ts BETWEEN s.start_time - INTERVAL 300 SECOND AND s.end_time + INTERVAL 300 SECOND GROUP BY session_id) g USING (session_id)
      LEFT JOIN (SELECT session_id, array_to_string(list(block_id || ' ' || value ORDER BY ts, block_id, value)[1:200], '|') AS l FROM creds GROUP BY session_id) c USING (session_id)
      JOIN (SELECT session_id, count(*) AS n, sha256(array_to_string(list(block_id || ' ' || severity || ' ' || left(decoded_text, 1200) ORDER BY ts, block_id)[1:4], '|')) AS l FROM srows GROUP BY session_id) b USING (session_id)
      LEFT JOIN (SELECT session_id, string_agg(f.rule_name, '|' ORDER BY r.ts, r.block_id, f.rule_no, f.pattern_no, f.hit_no) AS l FROM (
          SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, block_id) AS no FROM srows) r JOIN finds f USING (block_id) WHERE no <= 4 GROUP BY session_id) f USING (session_id)""",
    "s14_report_tiers": "SELECT tier AS alert_tier, count(*) AS sessions FROM sess GROUP BY tier",
    "p7_session_filter": """SELECT session_id, tier AS alert_tier, round(score, 6) AS weighted_score FROM sess
      WHERE score >= 40 AND contains(lower(host_id || ' ' || process_id || ' ' || array_to_string(tech, ' ')), 'src1')""",
    "p9_pivot_indicator": "SELECT session_id, tier AS alert_tier FROM sess WHERE session_id IN (SELECT session_id FROM members WHERE contains(lower(value), 'example.com/fr'))",
    "p10_pivot_technique": "SELECT session_id, tier AS alert_tier FROM sess WHERE list_contains(tech, 'LOLBIN_CERTUTIL')",
    "p11_score_gates": """SELECT count(*) FILTER (score >= 40) AS content, count(*) FILTER (score > 20) AS clustered, count(*) FILTER (tier <> 'CLEAN') AS exported,
        count(*) FILTER (tier NOT IN ('CLEAN', 'INFO')) AS alerted FROM sess""",
    "p12_indicator_filter": "SELECT value, session_count FROM hub WHERE ioc_type = 'ip' AND contains(value, '17')",
    "p13_hit_source_filter": "SELECT session_id, value, malware_name FROM hits WHERE source = 'urlhaus'",
    "p14_beacon_predicate": "SELECT session_id, confidence FROM profiles WHERE confidence >= 0.65",
    "p15_confirmed_campaigns": "SELECT count(*) AS n, max(session_count) AS largest FROM camps WHERE is_confirmed",
    "p16_public_address": """SELECT value, coalesce(list_max(o) <= 255 AND NOT regexp_matches(value, '(^|\\.)0[0-9]') AND NOT (o[1] IN (0, 10, 127) OR (o[1] = 169 AND o[2] = 254)
        OR (o[1] = 172 AND o[2] BETWEEN 16 AND 31) OR (o[1] = 192 AND o[2] = 168) OR (o[1] = 192 AND o[2] = 0 AND o[3] = 2) OR (o[1] = 192 AND o[2] = 0 AND o[3] = 0 AND o[4] NOT IN (9, 10))
        OR (o[1] = 198 AND o[2] IN (18, 19)) OR (o[1] = 198 AND o[2] = 51 AND o[3] = 100) OR (o[1] = 203 AND o[2] = 0 AND o[3] = 113) OR o[1] >= 240), false) AS is_public
      FROM (SELECT value, list_transform(string_split(value, '.'), lambda x: CAST(x AS INTEGER)) AS o FROM hub WHERE ioc_type = 'ip')""",
    "p14_beacon_flags": "SELECT session_id, confidence >= 0.65 AS is_beacon, confidence FROM profiles_m",
    "p16_address_classes": f"""SELECT doc_id, value, coalesce(list_max(o) <= 255 AND NOT (o[1] IN (0, 10, 127) OR (o[1] = 169 AND o[2] = 254) OR (o[1] = 172 AND o[2] BETWEEN 16 AND 31)
        OR (o[1] = 192 AND o[2] = 168) OR (o[1] = 192 AND o[2] = 0 AND o[3] = 2) OR (o[1] = 192 AND o[2] = 0 AND o[3] = 0 AND o[4] NOT IN (9, 10)) OR (o[1] = 198 AND o[2] IN (18, 19))
        OR (o[1] = 198 AND o[2] = 51 AND o[3] = 100) OR (o[1] = 203 AND o[2] = 0 AND o[3] = 113) OR o[1] >= 240), false) AS is_public
      FROM (SELECT doc_id, value, list_transform(string_split(value, '.'), lambda x: CAST(x AS INTEGER)) AS o FROM (
        SELECT doc_id, head || '.' || array_to_string([doc_id * 3 % 256, doc_id * 5 % 256, doc_id * 7 % 256][1:4 - len(string_split(head, '.'))], '.') AS value FROM (
          SELECT doc_id, ['10', '172.16', '172.32', '192.168', '192.0.2', '192.0.0', '198.18', '203.0.113', '8.8', '100.64', '240.1', '127.0', '169.254', '300.1', '198.51.100'][doc_id % 15 + 1] AS head FROM documents)))""",
    "r3_entropy_rule": "SELECT block_id, CASE WHEN entropy > 4.2 AND length(decoded_text) > 300 THEN 1 ELSE 0 END AS n FROM full_blocks",
    "f4_join_idioms": "SELECT doc_id, ['-join', '[string]::Join', 'concat', NULL, '-join'][doc_id % 5 + 1] AS style FROM documents",
    "p17_known_good": "SELECT block_id FROM words WHERE content_hash IN (SELECT content_hash FROM benign)",
    "n1_backtick": "SELECT doc_id, sha256(text) AS digest FROM documents",
    "n12_credential_mark": """SELECT doc_id, sha256('"[PLAINTEXT_CRED:' || source || ']"; New-Object "[CREDENTIAL:' || lang || ':pw]"); ' || text) AS digest FROM documents""",
    "n15_changed_blocks": "SELECT session_id, changed_blocks FROM sess",
    "r1_rule_hits": "SELECT block_id, rule_no, pattern_no, hit_no, matched_text, context FROM rule_hits",
    "r2_classified_techniques": "SELECT rule_name, technique_id, mitre_id, count(*) AS hits, count(DISTINCT block_id) AS blocks FROM finds GROUP BY ALL",
    "r3_entropy_fallback": "SELECT block_id, technique_id, severity, matched_text, context, confidence FROM fallback",
    "r4_entropy": "SELECT block_id, round(entropy, 6) AS entropy FROM full_blocks",
    "r5_technique_sets": f"SELECT session_id, {TECH} FROM sess",
    "r8_severity_bands": """SELECT CASE WHEN severity >= 85 THEN 'critical' WHEN severity >= 70 THEN 'high' WHEN severity >= 50 THEN 'medium' ELSE 'low' END AS band,
        count(*) AS n FROM finds GROUP BY 1""",
    "r10_rule_health": """SELECT rule_name, tp_30d, fp_30d, round(prec, 6) AS precision_30d, days_since_tp,
        CASE WHEN days_since_tp > 90 AND tp_30d = 0 THEN 'stale' WHEN prec < 0.10 AND fp_30d > 5 THEN 'noisy' WHEN tp_30d >= 5 AND prec >= 0.70 THEN 'high_value' ELSE 'nominal' END AS health
      FROM (SELECT *, CASE WHEN tp_30d + fp_30d > 0 THEN tp_30d / (tp_30d + fp_30d) ELSE 0.0 END AS prec FROM (
        SELECT rule_name, count(*) FILTER (is_tp AND ts >= TIMESTAMP '2024-02-20' - INTERVAL 30 DAY) AS tp_30d,
          count(*) FILTER (NOT is_tp AND ts >= TIMESTAMP '2024-02-20' - INTERVAL 30 DAY) AS fp_30d,
          CAST(coalesce(floor((epoch_us(TIMESTAMP '2024-02-20') - epoch_us(max(ts) FILTER (is_tp))) / 86400000000.0), 9999) AS BIGINT) AS days_since_tp
        FROM (SELECT event_type || '_' || (user_id % 9) AS rule_name, ts, value > 3 * (user_id % 9 + 1) AS is_tp FROM events) GROUP BY rule_name))""",
    "w1_reassembled": f"""SELECT block_id, block_number, block_total, host_id, path, {ts('ts')}, coalesce(round(e, 6), 0.0) AS entropy, sha256(raw_text) AS raw_digest,
        sha256(decoded_text) AS decoded_digest
      FROM whole LEFT JOIN (SELECT block_id, block_number, -sum(c / n * log2(c / n)) AS e FROM (
        SELECT block_id, block_number, ch, count(*)::DOUBLE AS c, any_value(n)::DOUBLE AS n FROM (
          SELECT block_id, block_number, length(raw_text) AS n, unnest(string_split(raw_text, '')) AS ch FROM whole) WHERE n > 0 GROUP BY ALL)
        GROUP BY block_id, block_number) x USING (block_id, block_number)""",
    "w2_incomplete_parts": "SELECT block_id, count(*) AS parts, max(block_total) AS wanted FROM whole WHERE block_total > 1 GROUP BY block_id",
    "w3_gap_sessions": "SELECT session_id, count(*) AS n FROM erows GROUP BY session_id",
    "w4_session_ids": "SELECT block_id, session_id FROM srows",
    "w5_session_bounds": f"SELECT session_id, {ts('start_time')}, {ts('end_time')}, round(dur, 6) AS duration_seconds FROM esess",
    "w6_block_gaps": "SELECT block_id, round(greatest(gap, 0.001), 6) AS gap FROM erows WHERE gap IS NOT NULL",
    "w7_tempo": "SELECT session_id, block_count, tempo, round(mean_gap, 6) AS mean_gap, round(stdev_gap, 6) AS stdev_gap FROM sess",
    "w8_lateral_sweeps": f"""WITH seen AS (SELECT lang || n_chars AS content_hash, source, TIMESTAMP '2024-01-01' + to_seconds(doc_id * 37) AS seen_at FROM documents),
        around AS (SELECT a.content_hash, a.seen_at, count(DISTINCT b.source) AS hosts FROM (SELECT DISTINCT content_hash, seen_at FROM seen) a
          JOIN seen b ON b.content_hash = a.content_hash AND b.seen_at BETWEEN a.seen_at - INTERVAL 2 HOUR AND a.seen_at GROUP BY ALL)
      SELECT content_hash, {ts('min(seen_at)', 'first_seen')}, max(hosts) AS hosts FROM around WHERE hosts >= 2 GROUP BY content_hash""",
    "w9_ordered_rows": "SELECT host_id, block_id FROM acts",
    "c1_block_severity": "SELECT block_id, severity FROM sev",
    "c2_session_score": "SELECT session_id, round(score, 6) AS weighted_score FROM sess",
    "c2_event_session_score": "SELECT session_id, top3 AS top3_sum, round(avgp, 6) AS avg_positive, round(score, 6) AS weighted_score FROM esess",
    "c3_chain_bonus": "SELECT session_id, chain AS chain_bonus FROM sess",
    "c4_tempo_bonus": "SELECT tempo, CAST(sum(tbonus) AS BIGINT) AS points FROM sess GROUP BY tempo",
    "c5_score_breakdown": """SELECT session_id, max_block_score, base, weighted, chains, chain_total, tempo, round(least(100.0, base + weighted + chain_total + tempo), 1) AS total FROM (
        SELECT session_id, CASE WHEN posn > 0 THEN max_severity ELSE 0 END AS max_block_score, CASE WHEN posn > 0 THEN round(max_severity * 0.4::DOUBLE, 1) ELSE 0.0 END AS base,
          CASE WHEN posn > 0 THEN round((top3 * 0.7::DOUBLE + avgp * 0.3::DOUBLE) * 0.6::DOUBLE, 1) ELSE 0.0 END AS weighted,
          CASE WHEN posn > 0 THEN array_to_string(chain_names, ';') ELSE '' END AS chains,
          CASE WHEN posn > 0 THEN chain ELSE 0 END AS chain_total, CASE WHEN posn > 0 THEN tbonus ELSE 0 END AS tempo FROM sess)""",
    "c6_max_severity": "SELECT session_id, max_severity FROM esess",
    "c7_enriched_sessions": f"""SELECT s.session_id, block_count, max_severity, {TECH}, tempo, round(score, 6) AS weighted_score, changed_blocks, coalesce(i.n, 0) AS ioc_count
      FROM sess s LEFT JOIN (SELECT session_id, count(*) AS n FROM members GROUP BY session_id) i USING (session_id)""",
    "i1_session_indicators": "SELECT session_id, value FROM members",
    "i2_indicator_types": "SELECT value, ioc_type FROM hub",
    "i3_feed_types": f"""SELECT value, {feed_type('value')} AS feed_type FROM (SELECT value FROM members UNION SELECT regexp_extract(url, '^http://([^/]+)', 1) FROM pages)""",
    "i4_indicator_hub": f"""SELECT value, {ioc_type('value')} AS ioc_type, count(*) AS session_count FROM members GROUP BY value""",
    "i4_hub_members": "SELECT value, ioc_type, session_count, session_id FROM members JOIN hub USING (value)",
    "i5_type_counts": "SELECT " + ", ".join(f"count(*) FILTER (ioc_type = '{t}') AS {t}" for t in ("url", "ip", "hash", "path")) + " FROM hub",
    "i6_one_type": "SELECT value, session_count FROM hub WHERE ioc_type = 'hash'",
    "i8_cooccurrence": """SELECT a.value AS value_a, b.value AS value_b FROM (
        SELECT DISTINCT x.no AS a, y.no AS b FROM (SELECT session_id, no FROM members JOIN hub_ranked USING (value) WHERE no <= 35) x
        JOIN (SELECT session_id, no FROM members JOIN hub_ranked USING (value) WHERE no <= 35) y ON x.session_id = y.session_id AND x.no < y.no) e
      JOIN hub_ranked a ON a.no = e.a JOIN hub_ranked b ON b.no = e.b
      WHERE e.b <= (SELECT max(no) FROM (SELECT DISTINCT x.no FROM members m JOIN hub_ranked x USING (value) WHERE x.no <= 35
        AND m.session_id IN (SELECT session_id FROM members JOIN hub_ranked USING (value) WHERE no <= 35 GROUP BY session_id HAVING count(*) > 1) ORDER BY no LIMIT 20))""",
    "i9_shared_infrastructure": """SELECT a.value AS value_a, b.value AS value_b, a.session_count FROM (SELECT * FROM hub_ranked WHERE session_count > 1 AND no <= 30) a
      JOIN (SELECT * FROM hub_ranked WHERE session_count > 1 AND no <= 30) b ON a.session_count = b.session_count AND a.no < b.no""",
    "i10_indicator_tiers": f"""SELECT value, ioc_type, session_count, {UNRANK.format(r='r')} AS max_tier FROM (
        SELECT h.value, h.ioc_type, h.session_count, max({RANK.format(t='s.tier')}) AS r FROM hub_ranked h JOIN members m USING (value) JOIN sess s ON s.session_id = m.session_id
        WHERE h.no <= 50 GROUP BY ALL)""",
    "i11_credentials": f"SELECT value, session_id, host_id, block_id, {ts('ts')} FROM creds",
    "b1_terms": """SELECT doc_id, CAST(len(t) AS INTEGER) AS n, sha256(array_to_string(t, ',')) AS digest FROM (SELECT doc_id,
        list_transform(regexp_extract_all(replace(text, ' th', ' Get-th'), '(?i)\\bGet-[0-9A-Za-z_\\x{80}-\\x{10ffff}]+'), lambda x: lower(x)) AS t FROM documents)""",
    "b2_vocabulary": "SELECT term, n FROM vocab",
    "s7_extended_vocabulary": "SELECT term, CAST(sum(n) AS BIGINT) AS n FROM (SELECT term, n FROM vocab UNION ALL SELECT term, count(*) FROM (SELECT unnest(terms) AS term FROM words) GROUP BY term) GROUP BY term",
    "b3_content_hash": "SELECT block_id, content_hash FROM words",
    "b4_normalised_path": "SELECT block_id, CASE WHEN path = '' THEN '' ELSE replace(lower(substr(path, 4)), '\\', '/') END AS norm_path FROM blocks",
    "b5_anomaly": "SELECT block_id, round(anomaly, 6) AS anomaly FROM anom",
    "b6_entropy_outliers": "SELECT block_id FROM words WHERE entropy > 1.1 * (SELECT avg(entropy) FROM benign) AND entropy > 4.5 AND (SELECT count(entropy) FROM benign) > 50",
    "b7_summary": """SELECT (SELECT count(*) FROM benign) AS observations, (SELECT count(*) FROM vocab) AS unique_terms, (SELECT count(DISTINCT content_hash) FROM benign) AS known_hashes,
        (SELECT count(*) FROM bpaths) AS known_paths, (SELECT string_agg(term, ',' ORDER BY n DESC, term) FROM (SELECT * FROM vocab ORDER BY n DESC, term LIMIT 10)) AS top_terms""",
    "b8_session_anomaly": "SELECT session_id, round(arg_min(anomaly, (ts, block_id)), 6) AS baseline_anomaly FROM arows GROUP BY session_id",
    "f1_run_lengths": """SELECT block_id, coalesce((SELECT array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(raw_text, '[A-Za-z0-9+/]{30,}={0,2}'), lambda x: length(x)))), ',')), '') AS runs FROM blocks""",
    "f3_paren_depth": """SELECT b.block_id, CAST(coalesce(depth, 0) AS INTEGER) AS depth FROM blocks b LEFT JOIN (SELECT block_id, max(s - least(0, lo)) AS depth FROM (
          SELECT *, min(s) OVER (PARTITION BY block_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS lo FROM (
            SELECT *, sum(d) OVER (PARTITION BY block_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS s FROM parens)) GROUP BY block_id) USING (block_id)""",
    "f4_join_style": """SELECT page_id, CASE WHEN regexp_matches(html, '(?i)-join\\s*[''"]') THEN '-join' WHEN regexp_matches(html, '(?i)\\[string\\]::Join') THEN '[string]::Join'
        WHEN regexp_matches(html, '\\+\\s*[''"]') THEN 'concat' END AS style FROM pages""",
    "f5_marker_density": "SELECT doc_id, round(CASE WHEN length(text) > 0 THEN (length(text) - length(replace(text, 'e', ''))) * 100.0 / length(text) ELSE 0.0 END, 6) AS density FROM documents",
    "f7_session_fingerprint": """SELECT session_id, runs, CAST(paren_depth AS INTEGER) AS paren_depth, 0 AS iex_nesting_depth, style AS string_join_style, round(density, 6) AS backtick_density,
        0 AS format_string_slots FROM prints""",
    "f8_fingerprint_hash": "SELECT session_id, fingerprint FROM fprints",
    "f9_campaigns": f"SELECT campaign_id, session_count, host_count, {ts('first_seen')}, {ts('last_seen')}, peak_severity, is_confirmed FROM camps",
    "f10_campaign_tags": "SELECT session_id, CASE WHEN score > 20 THEN substr(fingerprint, 1, 8) ELSE '' END AS campaign_id FROM fprints",
    "t1_intervals": "SELECT session_id, CAST(n AS INTEGER) AS n, round(mean, 6) AS mean, round(iv[4], 6) AS fourth FROM beats",
    "t2_autocorrelation": "SELECT session_id, CAST(lag AS INTEGER) AS lag, round(corr, 6) AS corr FROM bestlag",
    "t4_regularity": "SELECT session_id, round(greatest(0, 1 - list_stddev_samp(iv) / mean), 6) AS regular FROM beats",
    "t5_beacon_profiles": "SELECT session_id, period_seconds, jitter_pct, confidence, CAST(sample_count AS INTEGER) AS sample_count FROM profiles WHERE confidence >= 0.35",
    "t6_framework_guess": "SELECT event_id, framework FROM guesses",
    "t8_infra_clusters": """SELECT cluster_type, key, count(DISTINCT session_id) AS session_count, count(DISTINCT value) AS value_count FROM (
        SELECT session_id, value, CASE WHEN regexp_full_match(value, '\\d{1,3}(\\.\\d{1,3}){3}') THEN 'IP /24' ELSE 'Domain' END AS cluster_type,
          CASE WHEN regexp_full_match(value, '\\d{1,3}(\\.\\d{1,3}){3}') THEN regexp_extract(value, '^(\\d+\\.\\d+\\.\\d+)\\.', 1) || '.0/24'
            WHEN regexp_full_match(value, '[a-zA-Z0-9]([a-zA-Z0-9\\-]{0,61}[a-zA-Z0-9])?(\\.[a-zA-Z]{2,})+') THEN '*.' || regexp_extract(value, '([^.]+\\.[^.]+)$', 1) END AS key
        FROM (SELECT DISTINCT session_id, CASE WHEN value LIKE 'http://%' THEN regexp_extract(value, '^http://([^/]+)', 1) ELSE value END AS value FROM members))
      WHERE key IS NOT NULL GROUP BY cluster_type, key HAVING count(DISTINCT session_id) >= 2""",
    "t9_framework_groups": "SELECT CASE WHEN framework = '' THEN 'unknown' ELSE framework END AS framework, count(*) AS sessions FROM guesses GROUP BY 1",
    "t10_first_seen_addresses": f"""SELECT value, {ts('min(ts)', 'first_ts')}, arg_min(block_id, (ts, block_id)) AS block_id FROM (
        SELECT ts, block_id, unnest(regexp_extract_all(decoded_text, '\\b(?:\\d{{1,3}}\\.){{3}}\\d{{1,3}}\\b')) AS value FROM srows) GROUP BY value""",
    "j1_process_name": """SELECT session_id, coalesce(name, '') AS parent_process FROM sess s LEFT JOIN (
        SELECT host_id, process_id, arg_max(process_name, (ts, event_id, process_name)) AS name FROM procs GROUP BY ALL) p USING (host_id, process_id)""",
    "j2_host_event_ids": """SELECT session_id, ids AS event_ids FROM sess LEFT JOIN (SELECT host_id, array_to_string(list_sort(list(DISTINCT event_id)), ',') AS ids FROM (
        SELECT host_id, event_id FROM procs UNION ALL SELECT host_id, event_id FROM logons) GROUP BY host_id) USING (host_id)""",
    "j3_host_processes": """SELECT host_id, CAST(rn AS INTEGER) AS rank, process_name FROM (
        SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY ts, process_id, process_name) AS rn FROM procs) WHERE rn <= 50""",
    "j4_session_logons": f"""SELECT session_id, CAST(rn AS INTEGER) AS rank, username, {ts('ts')} FROM (
        SELECT s.session_id, l.username, l.ts, row_number() OVER (PARTITION BY s.session_id ORDER BY l.ts, l.username, l.target_host) AS rn
        FROM sess s JOIN logons l ON l.host_id = s.host_id AND l.ts BETWEEN s.start_time - INTERVAL 1800 SECOND AND s.end_time + INTERVAL 1800 SECOND) WHERE rn <= 3""",
    "j5_lateral_moves": f"SELECT source_session, target_session, technique, mitre_id, evidence, {ts('ts')} FROM moves",
    "j6_credential_reuse": """SELECT source_host, target_host, via, target_host NOT IN (SELECT host_id FROM creds) AS is_new_target FROM (
        SELECT m.source_host, m.target_host, 'lateral' AS via FROM moves m JOIN (SELECT host_id, date_trunc('second', min(ts)) AS c FROM creds GROUP BY host_id) f ON f.host_id = m.source_host AND m.ts >= f.c
        UNION SELECT l.host_id, l.target_host, 'logon' FROM logons l JOIN (SELECT host_id, date_trunc('second', min(ts)) AS c FROM creds GROUP BY host_id) f ON f.host_id = l.host_id AND l.ts >= f.c
        WHERE l.target_host <> l.host_id)""",
    "j7_threat_hits": "SELECT session_id, value, ioc_type, source, malware_name FROM hits",
    "j8_geolocation": """SELECT value AS ip, 'zone' || (CAST(string_split(value, '.')[1] AS INTEGER) % 7) AS country FROM hub WHERE ioc_type = 'ip'
        AND list_max(list_transform(string_split(value, '.'), lambda x: CAST(x AS INTEGER))) <= 255
        AND NOT regexp_matches(value, '^(0|10|127|24[0-9]|25[0-5])\\.|^192\\.168\\.|^169\\.254\\.|^172\\.(1[6-9]|2[0-9]|3[01])\\.|^198\\.1[89]\\.|^192\\.0\\.2\\.|^198\\.51\\.100\\.|^203\\.0\\.113\\.')""",
    "n2_join_lists": f"SELECT doc_id, sha256('x = ' || replace({LETTERS}, ' ', '')) AS digest FROM documents",
    "n3_char_codes": f"SELECT doc_id, sha256({LETTERS}) AS digest FROM documents",
    "n3_char_hex_codes": f"SELECT doc_id, sha256(array_to_string(list_filter(string_split({LETTERS}, ''), lambda c: c <> ''), '+')) AS digest FROM documents",
    "n4_hex_lists": f"""SELECT doc_id, sha256('$x = "invoke ' || {LETTERS} || '"') AS digest FROM documents""",
    "n5_base64_calls": f"SELECT doc_id, sha256('get ' || {LETTERS}) AS digest FROM documents",
    "n6_base64_runs_utf16": f"SELECT doc_id, sha256('run Write-Output with powershell ' || {LETTERS} || ' now') AS digest FROM documents",
    "n7_format_strings": f"SELECT doc_id, sha256('w' || replace({LETTERS}, ' ', '')) AS digest FROM documents",
    "n8_replace_chains": f"SELECT doc_id, sha256({LETTERS}) AS digest FROM documents",
    "n9_reversed_literals": f"SELECT doc_id, sha256('$a = ''call powershell ' || {LETTERS} || '''; b') AS digest FROM documents",
    "n10_environment_picks": f"""SELECT doc_id, sha256('& (' || substr({CMD}, doc_id % 27 + 1, 1) || substr({CMD}, doc_id * 3 % 27 + 1, 1) || substr({CMD}, doc_id * 7 % 27 + 1, 1)
      || ') ' || {LETTERS}) AS digest FROM documents""",
    "n11_looks_like_script": """SELECT doc_id, length(t) >= 5 AND regexp_matches(lower(t), 'invoke|iex|powershell|cmdlet|param\\(|function |write-|get-|set-|new-|webclient|downloadstring|bypass|hidden|-nop|amsi') AS script
      FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'New-Item ' ELSE '' END || replace(coalesce(text, ''), '$', '') AS t FROM documents)""",
    "n13_every_transform": f"""SELECT doc_id, true AS restored, CASE doc_id % 6 WHEN 0 THEN 'backtick' WHEN 1 THEN 'join' WHEN 2 THEN CASE WHEN {LETTERS} = '' THEN '' ELSE 'char_concat' END
      WHEN 3 THEN 'base64' WHEN 4 THEN 'reversed' ELSE 'replace_chain' END AS transforms FROM documents""",
    "r1_builtin_catalogue": """SELECT doc_id, technique_id, severity FROM documents LEFT JOIN (SELECT * FROM (VALUES
      (0, 'AMSI_BYPASS_REFLECT', 90), (1, 'AMSI_BYPASS_COM', 90), (2, 'DOWNLOAD_CRADLE_WC', 75), (3, 'DOWNLOAD_CRADLE_BITS', 70), (4, 'DOWNLOAD_CRADLE_IWR', 65), (5, 'REFLECTIVE_INJECT', 95),
      (6, 'SHELLCODE_MARSHAL', 95), (7, 'CLM_BYPASS', 80), (8, 'CRED_HARVEST', 90), (9, 'WMI_PERSIST', 80), (10, 'SCHTASK_CREATE', 55), (11, 'ENCODED_CMD', 50),
      (12, 'ETW_BYPASS', 80), (13, 'AV_EXCLUSION', 75), (14, 'REG_PERSIST', 55), (15, 'REVERSE_SHELL', 95), (16, 'IEX_EXEC', 40), (17, 'EXEC_POLICY_BYPASS', 35),
      (18, 'PROC_HOLLOW', 90), (19, 'COM_LATERAL', 75), (20, 'COBALT_STRIKE', 90), (21, 'AMSI_BYPASS_PATCH', 95), (22, 'AMSI_FORCE_DISABLE', 85), (23, 'ETW_PATCH_INLINE', 90),
      (24, 'ETW_PROVIDER_DISABLE', 75), (25, 'LOLBIN_CERTUTIL', 75), (26, 'LOLBIN_MSHTA', 80), (27, 'LOLBIN_REGSVR32', 80), (28, 'LOLBIN_RUNDLL32', 75), (29, 'LOLBIN_BITSADMIN', 70),
      (30, 'WMIC_REMOTE_EXEC', 80), (31, 'KERBEROAST_SPN', 85), (32, 'ASREPROAST', 85), (33, 'DPAPI_DECRYPT', 80), (34, 'SAM_DUMP', 90), (35, 'DCSYNC_PATTERN', 95),
      (36, 'LSASS_READ', 90), (37, 'LATERAL_PSREMOTING', 80), (38, 'LATERAL_INVOKE_CMD', 75), (39, 'LATERAL_WMI_EXEC', 80), (40, 'PROC_INJECT_OPENPROC', 90), (41, 'SCHTASK_HIJACK', 75)) AS v(slot, technique_id, severity)) ON slot = doc_id % 43""",
    "n13_decode_fixed_point": """SELECT doc_id, long AS restored, 2 AS passes, CASE WHEN long THEN 'backtick,base64' ELSE 'backtick' END AS transforms FROM (
        SELECT doc_id, ceil((18 + length(regexp_replace(text, '[^a-z ]', '', 'g'))) * 4 / 3.0) >= 60 AS long FROM documents)""",
    "r6_best_findings": "SELECT session_id, technique_id, mitre_id, severity, matched_text FROM best",
    "r7_first_findings": "SELECT technique_id, session_id, block_id, matched_text FROM firsts",
    "r9_applied_content": """SELECT block_id, array_to_string(list_filter([CASE WHEN (contains(t, '<nav>') OR contains(t, '<footer>') OR (contains(t, '<p>') AND contains(t, 'track(')))
        AND NOT regexp_matches(decoded_text, 'charset=.utf-8.><title>D') THEN 'PAGE_MARKUP' END, CASE WHEN contains(t, 'mit license') OR contains(t, 'gnu general') THEN 'LICENSE_LINE' END],
        lambda x: x IS NOT NULL), ',') AS content_hits FROM (SELECT *, lower(decoded_text) AS t FROM decoded) WHERE contains(t, 'mit license') OR contains(t, 'gnu general')
        OR ((contains(t, '<nav>') OR contains(t, '<footer>') OR (contains(t, '<p>') AND contains(t, 'track('))) AND NOT regexp_matches(decoded_text, 'charset=.utf-8.><title>D'))""",
    "r11_highest_level": "SELECT session_id, arg_min(level, CASE level WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END) AS highest_level FROM sig GROUP BY session_id",
    "j10_sigma_fields": """SELECT session_id, technique_id, title, level, tags, 'https://attack.mitre.org/techniques/' || replace(mitre_id, '.', '/') AS reference,
        'Detects ' || title || '. Detected in session ' || session_id || ' on ' || host_id || ' at ' || strftime(start_time, '%Y-%m-%d %H:%M UTC') || '. Matched: ''' || left(matched_text, 80) || '''.' AS description FROM sig""",
    "j11_sigma_for_sessions": """SELECT technique_id, session_id, title, level FROM (SELECT *, row_number() OVER (PARTITION BY technique_id ORDER BY host_id, process_id, start_time, session_id) AS rn
        FROM sig WHERE score >= 40) WHERE rn = 1""",
    "j12_yara_fields": f"SELECT session_id, technique_id, 'script_' || lower(technique_id) AS name, mitre_id AS mitre, {BAND.format(s='severity')} AS severity FROM best",
    "j13_hardening": """SELECT product, technique_id, title, priority, CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS priority_rank FROM advice
      WHERE technique_id = '' OR technique_id IN (SELECT unnest(tech) FROM sess WHERE score >= 40)""",
    "s11_navigator_layer": "SELECT mitre_id, max(severity) AS score, count(DISTINCT session_id) AS session_count, array_to_string(list_sort(list(DISTINCT technique_id)), ',') AS rules FROM sfinds GROUP BY mitre_id",
    "s12a_stix_ids": f"SELECT value, {sid('indicator', 'value')} AS id FROM hub",
    "s12b_attack_patterns": f"""SELECT 'attack-pattern' AS type, {sid('attack-pattern', 'mitre_id')} AS id, mitre_id, 'MITRE ATT&CK ' || mitre_id || ': ' || technique_id AS name,
        'https://attack.mitre.org/techniques/' || replace(mitre_id, '.', '/') AS url FROM (SELECT mitre_id, arg_min(technique_id, o) AS technique_id FROM (
        SELECT f.*, row_number() OVER (ORDER BY f.host_id, s.process_id, f.ts, f.block_id, rule_no, pattern_no, hit_no) AS o FROM sfinds f JOIN sess s USING (session_id)) GROUP BY mitre_id)""",
    "s12c_malware": f"""SELECT 'malware' AS type, {sid('malware', 'session_id')} AS id, session_id, 'Session ' || session_id AS name, false AS is_family, 'Tier: ' || tier || ' | Score: ' || printf('%.0f', score)
        || '/100 | Host: ' || host_id || ' | Techniques: ' || array_to_string(tech, ', ') AS description FROM sess WHERE tier <> 'CLEAN'""",
    "s12c_notes": f"""SELECT {sid('note', "session_id || '-note'")} AS id, 'Session ID: ' || session_id || chr(10) || 'Host: ' || host_id || chr(10) || 'Alert Tier: ' || tier || chr(10)
        || 'Score: ' || printf('%.1f', round(round(score, 6), 1)) || '/100' || chr(10) || 'Blocks: ' || block_count || chr(10) || 'IOC count: ' || coalesce(n, 0) || chr(10) || 'Techniques: '
        || CASE WHEN len(tech) > 0 THEN array_to_string(tech, ', ') ELSE 'none' END AS content
      FROM sess LEFT JOIN (SELECT session_id, count(*) AS n FROM members GROUP BY session_id) m USING (session_id) WHERE tier <> 'CLEAN'""",
    "s12d_indicators": f"SELECT DISTINCT 'indicator' AS type, {sid('indicator', 'value')} AS id, left(value, 120) AS name, pattern FROM listed",
    "i7_stix_patterns": f"SELECT value, {PATTERN} AS pattern FROM hub",
    "s12e_relationships": f"""SELECT {sid('malware', 'session_id')} AS source_ref, 'uses' AS relationship_type, {sid('attack-pattern', 'mitre_id')} AS target_ref FROM (
        SELECT DISTINCT session_id, mitre_id FROM sfinds WHERE session_id IN (SELECT session_id FROM sess WHERE tier <> 'CLEAN'))
      UNION ALL SELECT {sid('indicator', 'value')}, 'indicates', {sid('malware', 'session_id')} FROM listed
      UNION ALL SELECT {sid('malware', 'session_id')}, 'variant-of', {sid('malware', "malware_name || '-known'")} FROM (SELECT DISTINCT session_id, malware_name FROM hits
        WHERE session_id IN (SELECT session_id FROM sess WHERE tier <> 'CLEAN'))""",
    "s12f_known_malware": f"""SELECT 'malware' AS type, {sid('malware', "malware_name || '-known'")} AS id, malware_name AS name, true AS is_family, 'Source: ' || min(source) AS description FROM hits
      WHERE session_id IN (SELECT session_id FROM sess WHERE tier <> 'CLEAN') GROUP BY malware_name""",
    "t7_period_clusters": """SELECT session_id, s AS cluster_period, n AS cluster_size FROM (SELECT *, count(*) OVER (PARTITION BY s) AS n FROM (
        SELECT session_id, (SELECT max(s) FROM (WITH RECURSIVE st(s) AS (SELECT min(period_seconds) FROM profiles UNION ALL
            SELECT (SELECT min(period_seconds) FROM profiles WHERE period_seconds > st.s AND (period_seconds - st.s) / st.s > 0.10) FROM st WHERE st.s IS NOT NULL)
          SELECT s FROM st WHERE s IS NOT NULL) WHERE s <= period_seconds) AS s FROM profiles)) WHERE n >= 2""",
    "j14_tactic_lookup": "SELECT DISTINCT session_id, mitre_id, tactic FROM sfinds JOIN tactics ON prefix = left(mitre_id, 5)",
    "j15_triage_status": """SELECT session_id, coalesce(t.status, 'unreviewed') AS status, coalesce(t.notes, '') AS notes FROM sess LEFT JOIN (
        SELECT * FROM triage WHERE status <> 'unreviewed') t USING (session_id)""",
    "j16_content_gaps": "SELECT DISTINCT host_id, technique_id FROM stech WHERE technique_id NOT IN (SELECT technique_id FROM covered)",
    "a1_headline": """SELECT count(*) FILTER (tier = 'P1_INCIDENT') AS p1, count(*) FILTER (tier = 'P2_ALERT') AS p2, count(*) FILTER (tier = 'P3_WARNING') AS p3, count(*) AS total,
        (SELECT count(*) FROM camps) AS campaigns FROM sess""",
    "a2_tier_histogram": "SELECT tier AS alert_tier, count(*) AS n FROM sess GROUP BY tier",
    "a3_mitre_counts": "SELECT mitre_id, count(*) AS n FROM finds GROUP BY mitre_id",
    "a4_tactic_breakdown": """SELECT t.tactic_no, t.tactic, count(f.mitre_id) AS hits, CAST(coalesce(sum(f.n), 0) AS BIGINT) AS total, count(f.mitre_id) > 0 AS active
      FROM summary_tactics t LEFT JOIN (SELECT mitre_id, count(*) AS n FROM finds GROUP BY mitre_id) f ON string_split(f.mitre_id, '.')[1] = t.base GROUP BY t.tactic_no, t.tactic""",
    "a5_tactic_rows": """SELECT o.tactic_no, o.tactic, coalesce(x.n, 0) AS sessions, CAST((SELECT count(*) FROM tactics t WHERE t.tactic = o.tactic) AS INTEGER) AS total, x.n IS NOT NULL AS active
      FROM tactic_order o LEFT JOIN (SELECT tactic, count(DISTINCT session_id) AS n FROM sfinds JOIN tactics ON prefix = left(mitre_id, 5) GROUP BY tactic) x USING (tactic)""",
    "a6_top_techniques": "SELECT technique_id, n, CAST(row_number() OVER (ORDER BY n DESC, technique_id) AS INTEGER) AS rank FROM (SELECT technique_id, count(*) AS n FROM stech GROUP BY 1) ORDER BY n DESC, technique_id LIMIT 12",
    "a7_host_rollup": f"""SELECT s.*, coalesce(i.n, 0) AS ioc_count FROM (SELECT host_id, {UNRANK.format(r='max(' + RANK.format(t='tier') + ')')} AS max_tier, count(*) AS session_count,
          CAST(len(list_distinct(flatten(list(tech)))) AS INTEGER) AS technique_count, count(*) FILTER (tier = 'P1_INCIDENT') AS p1_count, count(*) FILTER (tier = 'P2_ALERT') AS p2_count,
          count(*) FILTER (tier = 'P3_WARNING') AS p3_count, round(max(score), 6) AS max_score, {ts('min(start_time)', 'first_seen')}, {ts('max(end_time)', 'last_seen')} FROM sess GROUP BY host_id) s
      LEFT JOIN (SELECT host_id, count(DISTINCT value) AS n FROM members GROUP BY host_id) i USING (host_id)""",
    "a7_event_host_rollup": f"""SELECT host_id, {UNRANK.format(r='max(' + RANK.format(t='tier') + ')')} AS max_tier, count(*) AS session_count,
          CAST(len(list_distinct(flatten(list(tech)))) AS INTEGER) AS technique_count, count(*) FILTER (tier = 'P1_INCIDENT') AS p1_count, count(*) FILTER (tier = 'P2_ALERT') AS p2_count,
          count(*) FILTER (tier = 'P3_WARNING') AS p3_count, round(max(score), 6) AS max_score, {ts('min(start_time)', 'first_seen')}, {ts('max(end_time)', 'last_seen')} FROM esess GROUP BY host_id""",
    "a8_host_risk": """SELECT *, p1 * 3 + p2 * 2 + p3 AS risk FROM (SELECT host_id, count(*) FILTER (tier = 'P1_INCIDENT') AS p1, count(*) FILTER (tier = 'P2_ALERT') AS p2,
        count(*) FILTER (tier = 'P3_WARNING') AS p3, round(max(score), 1) AS max_score FROM sess GROUP BY host_id) ORDER BY risk DESC, host_id LIMIT 12""",
    "a9_tempo_histogram": "SELECT tempo, count(*) AS n FROM sess GROUP BY tempo",
    "a10_duration_histogram": """SELECT b.bucket_no, b.label, count(s.session_id) AS n FROM (VALUES (0, '0–30s'), (1, '30s–2m'), (2, '2–10m'), (3, '10–30m'), (4, '30m+')) AS b(bucket_no, label)
      LEFT JOIN sess s ON b.bucket_no = CASE WHEN dur < 30 THEN 0 WHEN dur < 120 THEN 1 WHEN dur < 600 THEN 2 WHEN dur < 1800 THEN 3 ELSE 4 END GROUP BY ALL""",
    "a11_score_histogram": """SELECT b.bucket_no, b.label, count(s.session_id) AS n FROM (VALUES (0, '0-20'), (1, '20-40'), (2, '40-60'), (3, '60-80'), (4, '80+')) AS b(bucket_no, label)
      LEFT JOIN sess s ON b.bucket_no = CASE WHEN round(score, 1) < 20 THEN 0 WHEN round(score, 1) < 40 THEN 1 WHEN round(score, 1) < 60 THEN 2 WHEN round(score, 1) < 80 THEN 3 ELSE 4 END GROUP BY ALL""",
    "a12_content_coverage": """SELECT count(c.technique_id) AS covered, count(*) AS total, round(count(c.technique_id) * 100.0 / count(*), 1) AS pct
      FROM (SELECT DISTINCT technique_id FROM stech) t LEFT JOIN covered c USING (technique_id)""",
    "a13_scalars": "SELECT count(DISTINCT host_id) AS unique_hosts, (SELECT count(DISTINCT value) FROM members) AS unique_iocs, (SELECT count(*) FROM profiles WHERE confidence >= 0.65) AS beacon_count FROM sess",
    "a14_indicator_type_histogram": f"SELECT {ioc_type('value')} AS ioc_type, count(*) AS n FROM members GROUP BY 1",
    "a15_heat_map": f"""SELECT CAST(isodow(start_time) - 1 AS INTEGER) AS dow, CAST(hour(start_time) AS INTEGER) AS hour, count(*) AS n, round(max(score), 6) AS max_score,
        {UNRANK.format(r='max(' + RANK.format(t='tier') + ')')} AS max_tier FROM esess GROUP BY 1, 2""",
    "a16_day_groups": f"SELECT strftime(start_time, '%A, %B %d %Y') AS label, session_id, {ts('start_time')} FROM esess",
    "a17_score_line": f"SELECT {ts('start_time')}, round(score, 6) AS weighted_score FROM sess",
    "a18_host_timeline": """SELECT host_id, session_id, CASE WHEN n = 1 THEN 50.0 ELSE greatest(3.0, least(97.0, round(CASE WHEN t1 > t0 THEN (t - t0) / (t1 - t0) * 100.0 ELSE 50.0 END, 1))) END::DOUBLE AS pct,
        tier AS alert_tier FROM (SELECT *, epoch_us(start_time)::DOUBLE AS t, min(epoch_us(start_time)) OVER (PARTITION BY host_id)::DOUBLE AS t0,
          max(epoch_us(start_time)) OVER (PARTITION BY host_id)::DOUBLE AS t1, count(*) OVER (PARTITION BY host_id) AS n FROM esess)""",
    "a19_hits_per_source": "SELECT source, count(*) AS n FROM hits GROUP BY source",
    "a20_risk_level": f"SELECT CASE max({RANK.format(t='tier')}) WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM sess",
    "a21_kill_chain": "SELECT stage_no, stage, count(t.session_id) AS hits FROM stages LEFT JOIN stech t USING (technique_id) GROUP BY stage_no, stage",
    "a21_session_stages": """SELECT s.session_id, coalesce(x.stages, '') AS stages FROM sess s LEFT JOIN (SELECT session_id, string_agg(stage, ',' ORDER BY stage_no) AS stages FROM (
        SELECT DISTINCT session_id, stage_no, stage FROM stech JOIN stages USING (technique_id)) GROUP BY session_id) x USING (session_id)""",
    "a22_host_nodes": f"SELECT host_id, arg_max(tier, (score, {RANK.format(t='tier')})) AS tier FROM sess GROUP BY host_id",
    "a23_lateral_edges": f"SELECT source_host, target_host, technique, {ts('ts')} FROM edges",
    "a24_hop_degree": "SELECT host_id, count(*) AS hops FROM (SELECT source_host AS host_id FROM edges UNION ALL SELECT target_host FROM edges) GROUP BY host_id",
    "a25_campaign_scalars": "SELECT count(*) AS campaigns, CAST(sum(session_count) AS BIGINT) AS sessions, max(host_count) AS most_hosts FROM camps",
    "a26_latest_triage": f"SELECT session_id, status, notes, {ts('ts')} FROM triage",
    "l1_top_sessions": "SELECT CAST(rn AS INTEGER) AS rank, session_id, round(score, 6) AS weighted_score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, session_id) AS rn FROM sess) WHERE rn <= 200",
    "l2_top_alerts": "SELECT CAST(rn AS INTEGER) AS rank, session_id, tier AS alert_tier FROM (SELECT *, row_number() OVER (ORDER BY score DESC, session_id) AS rn FROM sess WHERE tier IN ('P1_INCIDENT', 'P2_ALERT')) WHERE rn <= 5",
    "l3_sorted_by_tier": "SELECT session_id, tier AS alert_tier FROM sess",
    "l4_campaign_order": "SELECT CAST(rn AS INTEGER) AS rank, campaign_id FROM (SELECT *, row_number() OVER (ORDER BY is_confirmed DESC, peak_severity DESC, campaign_id) AS rn FROM camps)",
    "l6_top_three": "SELECT session_id, top3 AS top3_sum, posn AS positive_blocks FROM sess",
    "l7_beacon_order": "SELECT CAST(rn AS INTEGER) AS rank, session_id, confidence FROM (SELECT *, row_number() OVER (ORDER BY confidence DESC, session_id) AS rn FROM profiles)",
    "u2_host_techniques": "SELECT host_id, array_to_string(list_sort(list(DISTINCT technique_id)), ',') AS techniques FROM stech GROUP BY host_id",
    "u4_lolbin_intersection": "SELECT session_id, CAST(len(list_intersect(tech, ['LOLBIN_CERTUTIL', 'LOLBIN_MSHTA', 'LOLBIN_REGSVR32'])) AS INTEGER) AS tools FROM sess",
    "u5_set_tests": "SELECT session_id, list_has_all(tech, ['REG_PERSIST', 'MARKUP_SCRIPT']) AS has_all, list_has_any(tech, ['CRED_HARVEST', 'COBALT_STRIKE']) AS has_any FROM sess",
}

SEARCH = """SELECT session_id, round(score, 1) AS weighted_score, tier AS alert_tier, total AS total_matches, block_id,
    substring(decoded_text, greatest(1, apos - 60), apos - greatest(1, apos - 60) + {n} + 60) AS context, CAST(apos - greatest(1, apos - 60) AS INTEGER) AS match_offset, {n} AS match_len
  FROM search_hits JOIN (SELECT session_id, score, tier FROM sess WHERE session_id IN (SELECT session_id FROM search_hits) ORDER BY score DESC, session_id LIMIT 50) USING (session_id)
  WHERE rn <= 5"""
SEARCH_TOP = """SELECT session_id, round(score, 1) AS weighted_score, total AS total_matches FROM search_hits JOIN (SELECT session_id, score FROM sess
    WHERE session_id IN (SELECT session_id FROM search_hits) ORDER BY score DESC, session_id LIMIT 50) USING (session_id) WHERE rn <= 1"""


PHRASE_LIST = "list_filter([" + ", ".join(f"CASE WHEN list_contains(tech, {q(t)}) THEN {q(p)} END" for t, p in PHRASES) + "], lambda x: x IS NOT NULL)"
NARRATIVE = f"""SELECT session_id, concat_ws(' ', 'At ' || strftime(start_time, '%H:%M:%S') || ' UTC on ' || host_id || ' (PID ' || process_id || '), a ' || replace(tempo, '_', ' ') || ' executed ' ||
      block_count || ' script block' || CASE WHEN block_count <> 1 THEN 's' ELSE '' END || '.', CASE WHEN len(ph) > 0 THEN 'The session ' || array_to_string(ph, ', then ') || '.' END,
      CASE WHEN n > 0 THEN 'Extracted IOCs: ' || top || CASE WHEN n > 5 THEN ' (and more)' ELSE '' END || '.' END,
      CASE WHEN score > 20 THEN 'This session is part of campaign ' || substr(fingerprint, 1, 8) || ', indicating the same operator was active on other hosts.' END) AS narrative
    FROM (SELECT s.*, f.fingerprint, i.n, i.top, {PHRASE_LIST} AS ph FROM sess s JOIN fprints f USING (session_id) LEFT JOIN (
      SELECT session_id, count(*) AS n, array_to_string(list_sort(list(value))[1:5], ', ') AS top FROM members GROUP BY session_id) i USING (session_id))"""
DETECTIONS = f"""SELECT technique_id, coalesce(c.title, array_to_string(list_transform(string_split(lower(technique_id), '_'), lambda w: upper(w[1]) || w[2:]), ' ')) AS title,
    mitre_id AS mitre, {BAND.format(s='severity')} AS severity, CAST(coalesce(k.n, length('// ' || replace(technique_id, '_', ' ') || ' (' || mitre_id || ')') + 1
      + length('Event | where EventID == 4104 | where EventData has ""') + least(50, length(matched_text))) AS INTEGER) AS kql_chars
  FROM firsts LEFT JOIN content c USING (technique_id) LEFT JOIN (VALUES {values((t, len(render("kql", t, c[0], c[1], c[3], c[4]))) for t, c in CONTENT.items())}) AS k(technique_id, n) USING (technique_id)"""


def oracle_sql() -> dict[str, str]:
    out = {name: with_ctes(text) for name, text in RAW.items()}
    out["p8_text_search"] = with_ctes(SEARCH, needle="license", n="7")
    out["a27_narrative"] = with_ctes(NARRATIVE)
    out["j9_detection_content"] = with_ctes(DETECTIONS)
    out["l8_search_top"] = with_ctes(SEARCH_TOP, needle="the")
    return out
