import collections
import datetime as dt
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from huskwatch.catalog.content import advice_table, content_table
from huskwatch.catalog.rules import Rule
from huskwatch.operators import baseline as B
from huskwatch.operators import beacons as T
from huskwatch.operators import campaigns as C
from huskwatch.operators import content, enrich, indicators, rollups, stix, views
from huskwatch.operators.blocks import block_features, classify
from huskwatch.operators.sessions import stitch
from huskwatch.plans.hunt import Hunt
from tests.conftest import BASE


# -- baseline ------------------------------------------------------------------------------------

def features(make_blocks, *items):
    return block_features(classify(make_blocks(*items)))


def test_baseline_scores(make_blocks):
    base = B.build(features(make_blocks, *[{"text": "Get-Process | Where-Object CPU", "path": "C:\\Ops\\Run.ps1"}] * 150))
    new = features(make_blocks, ("Get-Process | Where-Object CPU", 0), ("Invoke-ReflectivePEInjection -PEBytes $b", 1), ("no terms here", 2),
                   {"text": "Invoke-Other x", "path": "D:\\OPS\\run.ps1", "sec": 3}, ("Write-Host x; Get-Process", 4))
    got = {r.block_id: r.anomaly for r in B.anomaly(new, base).collect()}
    assert got["b0000"] == 0.0 and got["b0001"] == 100.0 and got["b0002"] == 0.0
    assert abs(got["b0003"] - 30.0) < 1e-9        # fully novel, trusted path
    assert got["b0004"] == 0.0                    # universal and frequent terms only
    assert [r.block_id for r in B.known_good(new, base).collect()] == ["b0000"]


def test_entropy_outliers_fire(make_blocks):
    """A dense block among plain ones is an outlier, and weighs 15 in its score; fifty samples are too few."""
    odd = "Invoke-New " + "".join(chr(33 + i % 94) for i in range(0, 900, 7))
    plain = [("Get-Process aaaa", i) for i in range(120)]
    base = B.build(features(make_blocks, *plain))
    new = features(make_blocks, (odd, 0), ("Get-Process | aaaa Invoke-New", 1))
    assert [r.block_id for r in B.entropy_outliers(new, base).collect()] == ["b0000"]
    known = features(make_blocks, ("Get-Process " * 7 + odd, 0))
    assert abs(B.anomaly(known, base).first().anomaly - (2.5 / 8 * 80 + 15)) < 1e-9
    assert B.entropy_outliers(new, B.build(features(make_blocks, *plain[:50]))).count() == 0


def test_baseline_needs_enough_observations(make_blocks):
    base = B.build(features(make_blocks, *[("Get-Process", i) for i in range(10)]))
    assert B.anomaly(features(make_blocks, ("Invoke-New x", 0)), base).first().anomaly == 0.0


def test_baseline_save_load_extend(spark, make_blocks, tmp_path):
    base = B.build(features(make_blocks, *[("Get-Process; Get-Item", i) for i in range(10)]))
    B.save(base, str(tmp_path))
    again = B.extend(B.load(spark, str(tmp_path)), base)
    assert {r.term: r.n for r in again.vocab.collect()} == {"get-process": 20, "get-item": 20}
    s = B.summary(again).first()
    assert (s.observations, s.unique_terms, s.known_hashes, s.known_paths, s.top_terms) == (20, 2, 1, 0, ["get-item", "get-process"])


# -- beacons -------------------------------------------------------------------------------------

def plain_best_lag(iv):
    n, mean = len(iv), statistics.mean(iv)
    var = statistics.variance(iv)
    if var == 0:
        return 0, 1.0
    best, top = 1, -1.0
    for lag in range(1, max(2, n // 2)):
        corr = sum((iv[i] - mean) * (iv[i - lag] - mean) for i in range(lag, n)) / ((n - lag) * var)
        if corr > top:
            best, top = lag, corr
    return best, top


def test_best_lag_direct_and_by_transform():
    rnd = random.Random(5)
    for n in (5, 6, 11, 200):
        iv = [rnd.uniform(2, 90) for _ in range(n)]
        lag, corr = T._best_lag(np.array(iv))
        want = plain_best_lag(iv)
        assert lag == want[0] and abs(corr - want[1]) < 1e-9
    iv = [30 + 10 * math.sin(i * 2 * math.pi / 9) + rnd.random() for i in range(3000)]
    want = plain_best_lag(iv)
    got = T._best_lag(np.array(iv))
    assert got[0] == want[0] and abs(got[1] - want[1]) < 1e-9


def test_beacon_profile(make_blocks):
    rows = stitch(make_blocks(*[("beat", i * 60) for i in range(15)]))
    r = T.beacons(T.intervals(rows)).first()
    assert (r.period_seconds, r.jitter_pct, r.confidence, r.sample_count, r.framework_hint, r.is_beacon) == (60.0, 0.0, 1.0, 14, "cobalt_strike", True)
    assert T.intervals(stitch(make_blocks(*[("x", i * 60) for i in range(5)]))).count() == 0


def test_period_clusters(spark):
    periods = [60.0, 61.0, 66.0, 66.1, 70.0, 600.0, 10.0]
    found = spark.createDataFrame([(f"s{i}", p) for i, p in enumerate(periods)], "session_id string, period_seconds double")
    got = {r.session_id: (r.cluster_period, r.cluster_size) for r in T.period_clusters(found).collect()}
    assert got == {"s0": (60.0, 3), "s1": (60.0, 3), "s2": (60.0, 3), "s3": (66.1, 2), "s4": (66.1, 2)}


@pytest.mark.parametrize("kind", ["dense", "sparse", "empty", "zero"])
def test_cluster_starts_equal_the_fold(spark, kind):
    """A million distinct periods, none of them gathered in one row; gaps of empty cells; nothing; zero and ties of rounding."""
    if kind == "dense":
        periods = [i / 10 for i in range(1, 1_000_001)]
        table = spark.range(1, 1_000_001).select((F.col("id") / 10).alias("p"))
    else:
        periods = {"sparse": [0.1, 0.5, 0.5500000000000001, 0.55, 77.0, 84.7, 84.70000000000002, 9e5, 1e9], "empty": [], "zero": [0.0, 0.0001, 0.00011, 0.5, 1.0, 1.1, 1.21]}[kind]
        table = spark.createDataFrame([(float(p),) for p in periods], "p double")
    starts = []
    for p in sorted(periods):
        if not starts or (p - starts[-1]) / max(starts[-1], 0.001) > 0.10:
            starts.append(p)
    assert sorted(r.p for r in T.cluster_starts(table).collect()) == starts


@pytest.mark.parametrize("period,want", [(60.0, "cobalt_strike"), (5.2, "metasploit"), (10.0, "empire"), (100.0, ""), (7.4, "empire"), (0.0, "")])
def test_framework(spark, period, want):
    from huskwatch.catalog.lookups import FRAMEWORK_INTERVALS
    best, dist = "", float("inf")
    for fw, ivs in FRAMEWORK_INTERVALS:
        for iv in ivs:
            if abs(period - iv) / iv < dist:
                best, dist = fw, abs(period - iv) / iv
    assert spark.range(1).select(T.guess_framework(F.lit(period)).alias("f")).first().f == (best if dist < 0.25 else "")


# -- campaigns -----------------------------------------------------------------------------------

def test_same_style_on_three_hosts(make_blocks):
    text = "po`w`ersh`ell [char]73+[char]69 sekurlsa"
    hunt = Hunt(make_blocks(*[{"text": text, "host": f"h{i}", "sec": i} for i in range(3)], {"text": "sekurlsa", "host": "h9"}))
    rows = hunt.campaigns.orderBy(*C.campaign_order()).collect()
    assert [(r.session_count, r.host_count, r.is_confirmed) for r in rows] == [(3, 3, True), (1, 1, False)]
    assert hunt.tagged.filter("campaign_id is null").count() == 0


@pytest.mark.parametrize("slice_seconds", [1, 5, 10000])
def test_fingerprint_slices_do_not_matter(make_blocks, slice_seconds):
    rows = stitch(block_features(classify(make_blocks(*[("iex(" if i % 3 else "x))`", i) for i in range(30)]))))
    r = C.session_fingerprints(rows, slice_seconds).first()
    text = "\n".join("iex(" if i % 3 else "x))`" for i in range(30))
    d = top = 0
    for ch in text:
        d = d + 1 if ch == "(" else max(0, d - 1) if ch == ")" else d
        top = max(top, d)
    assert r.iex_nesting_depth == min(20, top) and abs(r.backtick_density - text.count("`") / len(text) * 100) < 1e-9


# -- lateral moves and other joins -----------------------------------------------------------------

SESSIONS = "session_id string, host_id string, process_id int, s int, e int, technique_set array<string>, weighted_score double, alert_tier string"


def make_sessions(spark, rows):
    return (spark.createDataFrame([(f"s{i:03d}", h, 1, s, e, t, 50.0, "P3_WARNING") for i, (h, s, e, t) in enumerate(rows)], SESSIONS)
            .withColumn("start_time", F.timestamp_seconds("s")).withColumn("end_time", F.timestamp_seconds("e")))


def plain_moves(rows):
    known = set(enrich.LATERAL_TECHNIQUES)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][1], f"s{i:03d}"))
    out = set()
    for a, i in enumerate(order):
        for j in order[a + 1:]:
            if rows[j][0] != rows[i][0] and -60 <= rows[j][1] - rows[i][2] <= 1800:
                out |= {(f"s{i:03d}", f"s{j:03d}", t) for t in set(rows[i][3]) & known}
    return out


def test_lateral_moves_equal_nested_loop(spark):
    rnd = random.Random(11)
    techs = ["LATERAL_PSREMOTING", "COM_LATERAL", "IEX_EXEC"]
    rows = []
    for _ in range(120):
        s = rnd.randint(0, 9000)
        rows.append((rnd.choice("abcd"), s, s + rnd.choice([0, 30, 600, 5000]), rnd.sample(techs, rnd.randint(0, 3))))
    rows += [("x", 20000, 20000, ["LATERAL_PSREMOTING"])] + [("y", 20000 + d, 20000 + d, []) for d in (-61, -60, -1, 0, 1800, 1801)]
    moves = enrich.lateral_moves(make_sessions(spark, rows))
    got = {(r.source_session, r.target_session, r.technique) for r in moves.collect()}
    assert got == plain_moves(rows)
    counts = {r.session_id: r.lateral_move_count for r in enrich.lateral_counts(make_sessions(spark, rows)).collect()}
    assert counts == {k: n for k, n in collections.Counter(m[0] for m in plain_moves(rows)).items()}
    edges = enrich.lateral_edges(moves)
    assert edges.count() == len({(r.source_host, r.target_host, r.technique) for r in moves.collect()})
    assert {r.host_id for r in enrich.hop_degree(edges).collect()} >= {"x", "y"}
    assert {tuple(r) for r in enrich.lateral_moves(make_sessions(spark, rows), share=3).collect()} == {tuple(r) for r in moves.collect()}


@pytest.mark.parametrize("share", [3, 10_000])
def test_first_moves_equal_reduced_moves(spark, share):
    """One host with a third of all sessions, equal starts, sources that last for hours, and a start missing; in one part and in many."""
    rnd = random.Random(5)
    techs = ["LATERAL_PSREMOTING", "COM_LATERAL", "IEX_EXEC"]
    rows = []
    for _ in range(240):
        s = rnd.randint(0, 400) * 30
        rows.append((rnd.choice("aaabcdef"), s, s + rnd.choice([0, 30, 600, 5000]), rnd.sample(techs, rnd.randint(0, 3))))
    rows.append(("g", None, None, techs))
    sessions = make_sessions(spark, rows)
    moves = enrich.lateral_moves(sessions)
    want = {tuple(r) for r in enrich.lateral_edges(moves).collect()}
    first = enrich.lateral_first(sessions, share=share)
    got = first.collect()
    assert {tuple(r)[:-1] for r in got} == want and len(got) == len(want) == 60
    last = {(r.source_host, r.target_host, r.technique): r.ts for r in moves.groupBy("source_host", "target_host", "technique").agg({"ts": "max"}).withColumnRenamed("max(ts)", "ts").collect()}
    assert {(r.source_host, r.target_host, r.technique): r.last_ts for r in got} == last
    assert enrich.lateral_first(sessions.limit(0)).count() == 0 and enrich.lateral_first(sessions.filter("host_id = 'b'")).count() == 0


def test_session_logons(spark):
    sessions = make_sessions(spark, [("a", 10000, 20000, []), ("b", 10000, 10000, [])])
    times = [9699, 9700, 15000, 20300, 20301]
    logons = spark.createDataFrame([("a", t, f"u{t}", "z") for t in times] + [("c", 15000, "u", "z")], "host_id string, t int, username string, target_host string").withColumn(
        "ts", F.timestamp_seconds("t"))
    assert [r.username for r in enrich.session_logons(sessions, logons).orderBy("rank").collect()] == ["u9700", "u15000", "u20300"]
    assert enrich.session_logons(sessions, logons, n=1).count() == 1


def test_credential_reuse(spark):
    ts = lambda n: BASE + dt.timedelta(seconds=n)                                        # noqa: E731
    creds = spark.createDataFrame([("a", ts(10)), ("a", ts(50)), ("b", ts(5))], "host_id string, ts timestamp")
    moves = spark.createDataFrame([("a", "c", ts(9)), ("a", "d", ts(10)), ("a", "b", ts(99)), ("a", "e", None)], "source_host string, target_host string, ts timestamp")
    logons = spark.createDataFrame([("b", "f", ts(6)), ("b", "b", ts(7)), ("b", "g", ts(1)), ("q", "r", ts(9))], "host_id string, target_host string, ts timestamp")
    got = {(r.source_host, r.target_host, r.via, r.is_new_target) for r in enrich.credential_reuse(creds, moves, logons).collect()}
    assert got == {("a", "d", "lateral", True), ("a", "b", "lateral", False), ("a", "e", "lateral", True), ("b", "f", "logon", True)}


def test_feed_precedence(spark):
    feed = spark.createDataFrame([("http://x/a", "threatfox", "T"), ("HTTP://X/a", "urlhaus", "U"), ("1.2.3.4", "urlhaus", "no"), ("f" * 32, "malwarebazaar", "M")],
                                 "value string, source string, malware_name string")
    members = spark.createDataFrame([("s", "h", "http://x/A"), ("s", "h", "1.2.3.4"), ("s", "h", "F" * 32)], "session_id string, host_id string, value string")
    got = {(r.value, r.source, r.malware_name) for r in enrich.threat_hits(members, feed).collect()}
    assert got == {("http://x/A", "urlhaus", "U"), ("F" * 32, "malwarebazaar", "M")}


def test_no_indicator_of_a_session_is_left_out(spark):
    members = spark.createDataFrame([("s", "h", f"http://x/{i:02d}") for i in range(40)], "session_id string, host_id string, value string")
    feed = members.select("value", F.lit("urlhaus").alias("source"), F.lit("U").alias("malware_name"))
    assert enrich.threat_hits(members, feed).count() == 40
    sessions = spark.createDataFrame([("s", "INFO")], "session_id string, alert_tier string")
    assert stix.session_indicators(sessions, members).count() == 40 and stix.session_indicators(sessions, members, 30).count() == 30


def test_geolocation(spark):
    ips = spark.createDataFrame([("8.8.8.8",), ("8.9.0.1",), ("10.0.0.1",), ("8.8.8.8",)], "value string")
    ranges = spark.createDataFrame([(8 * 2**24, 8 * 2**24 + 9 * 2**16 - 1, "AA"), (8 * 2**24 + 9 * 2**16, 9 * 2**24 - 1, "BB")], "low bigint, high bigint, country string")
    assert {(r.ip, r.country) for r in enrich.geolocate(ips, ranges).collect()} == {("8.8.8.8", "AA"), ("8.9.0.1", "BB")}


# -- indicators ----------------------------------------------------------------------------------

def test_hub_has_one_grain_at_any_size(spark):
    members = spark.createDataFrame([(f"s{i:04d}", "h", "1.2.3.4") for i in range(1500)] + [("s0001", "h", "5.6.7.8")], "session_id string, host_id string, value string")
    assert {(r.value, r.session_count) for r in indicators.ioc_hub(members).collect()} == {("1.2.3.4", 1500), ("5.6.7.8", 1)}
    rows = indicators.hub_members(members).collect()
    assert len(rows) == 1501 and {r.session_count for r in rows if r.value == "1.2.3.4"} == {1500}
    lists = {r.value: r.sessions for r in indicators.hub_lists(members).collect()}
    assert lists == {"1.2.3.4": [f"s{i:04d}" for i in range(1500)], "5.6.7.8": ["s0001"]}


def test_rank_all_equals_one_sort(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice([0.1, 0.5, 0.9]), f"s{i:03d}") for i in range(300)]
    got = rollups.rank_all(spark.createDataFrame(rows, "c double, k string"), [F.desc("c"), F.asc("k")], [-F.col("c")]).collect()
    assert {r.k: r["rank"] for r in got} == {k: n for n, (_, k) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])), 1)}
    assert rollups.rank_all(spark.createDataFrame([], "c double, k string"), [F.asc("c")], [F.col("c")]).count() == 0


def test_first_credentials(make_blocks):
    hunt = Hunt(make_blocks(*[{"text": "x", "decoded": f"[PLAINTEXT_CRED:{v}]", "sec": i} for i, v in enumerate(["b", "a", "b"])]))
    assert {(r.value, r.block_id) for r in indicators.first_credentials(hunt.rows).collect()} == {("b", "b0000"), ("a", "b0001")}


# -- content, STIX, views --------------------------------------------------------------------------

def analysed(make_blocks):
    rules = [Rule("a", "AMSI_BYPASS_REFLECT", "T1562.001", 90, ("aaa",)), Rule("a2", "AMSI_BYPASS_REFLECT", "T1562.001", 70, ("bbb",)),
             Rule("u", "MY_OWN", "T9999", 55, ("ccc",)), Rule("low", "LOW", "T1", 15, ("ddd",))]
    return Hunt(make_blocks({"text": "bbb", "host": "h1"}, {"text": "aaa ccc http://e/x 1.2.3.4", "host": "h1", "sec": 5}, {"text": "ddd", "host": "h2"}, {"text": "quiet", "host": "h3"}), rules=rules)


def test_content(spark, make_blocks):
    hunt = analysed(make_blocks)
    table = content_table(spark)
    best = content.best_findings(hunt.findings)
    rows = {r.technique_id: r for r in content.sigma_rows(best, hunt.sessions, table).filter("host_id = 'h1'").collect()}
    assert rows["AMSI_BYPASS_REFLECT"].level == "critical" and "amsi" in rows["AMSI_BYPASS_REFLECT"].title.lower()
    assert rows["MY_OWN"].title == "PowerShell suspicious: my own" and rows["MY_OWN"].level == "medium" and rows["MY_OWN"].tags == ["attack.t9999"]
    assert "h1" in rows["MY_OWN"].description
    every = content.sigma_for_sessions(content.sigma_rows(best, hunt.sessions, table))
    assert {r.technique_id for r in every.collect()} == {"AMSI_BYPASS_REFLECT", "MY_OWN"}         # the low session is left out
    found = {r.technique_id: r for r in content.detections(content.first_findings(hunt.findings, hunt.sessions), table).collect()}
    assert "amsiInitFailed" in found["AMSI_BYPASS_REFLECT"].kql and "ccc" in found["MY_OWN"].eql and found["AMSI_BYPASS_REFLECT"].severity == "high"
    assert content.highest_level(content.sigma_rows(best, hunt.sessions, table)).filter("highest_level = 'critical'").count() == 1
    assert content.yara_rows(best, table).filter("technique_id = 'MY_OWN'").first().text.count("ccc") == 1
    advice = content.hardening(hunt.sessions, advice_table(spark))
    assert {r.technique_id for r in advice.select("technique_id").distinct().collect()} == {"", "AMSI_BYPASS_REFLECT"}


def test_stix(spark, make_blocks):
    hunt = analysed(make_blocks)
    listed = stix.session_indicators(hunt.sessions, hunt.members)
    hits = spark.createDataFrame([("h1_1_20240601T120000", "1.2.3.4", "Fam", "threatfox")], "session_id string, value string, malware_name string, source string")
    edges = stix.relationships(hunt.findings, hunt.sessions, listed, hits).collect()
    assert sorted({e.relationship_type for e in edges}) == ["indicates", "uses", "variant-of"] and len({e.id for e in edges}) == len(edges)
    objects = stix.bundle(stix.identity(spark), stix.attack_patterns(hunt.findings), stix.malware(hunt.sessions), stix.notes(hunt.sessions, hunt.members),
                          stix.indicators(listed), stix.known_malware(hunt.sessions, hits))
    kinds = {r.type: r["count"] for r in objects.groupBy("type").count().collect()}
    assert kinds == {"identity": 1, "attack-pattern": 3, "malware": 3, "note": 2, "indicator": 2}


def test_views(make_blocks):
    hunt = analysed(make_blocks)
    rows = hunt.rows.join(hunt.blocks.select("block_id", "decoded_text"), "block_id")
    hit = views.search(rows, hunt.sessions, "CCC").first()
    assert hit.context[hit.match_offset:hit.match_offset + hit.match_len] == "ccc" and hit.total_matches == 1
    assert views.search(rows, hunt.sessions, "c").count() == 0
    twice = hunt.blocks.unionByName(hunt.blocks)
    assert views.search(hunt.rows, hunt.sessions, "CCC", blocks=twice).collect() == views.search(rows, hunt.sessions, "CCC").collect()
    told = {r.session_id: r.narrative for r in views.narrative(hunt.tagged, hunt.members).collect()}
    text = told["h1_1_20240601T120000"]
    assert text.startswith("At 12:00:00 UTC on h1 (PID 1), a mixed executed 2 script blocks. The session bypassed AMSI via .NET reflection.")
    assert "Extracted IOCs: 1.2.3.4, http://e/x." in text
    assert views.report_rows(hunt.sessions, hunt.members).filter("narrative != ''").count() == 1
    children = views.detail_children(hunt.rows, hunt.blocks, hunt.members)
    assert children["findings"].count() == 4 and children["blocks"].count() == 4 and children["iocs"].count() == 2


def test_rollups(spark, make_blocks):
    hunt = analysed(make_blocks)
    assert rollups.risk_level(hunt.sessions).first().risk_level == "CRITICAL"
    head = rollups.headline(hunt.sessions, hunt.campaigns).first()
    assert (head.p1, head.total) == (1, 3)
    assert [r.n for r in rollups.duration_histogram(spark, hunt.sessions).orderBy("bucket_no").collect()] == [3, 0, 0, 0, 0]
    layer = rollups.navigator_rows(hunt.findings).filter("mitre_id = 'T1562.001'").first()
    assert (layer.score, layer.session_count, layer.rules) == (90, 1, ["AMSI_BYPASS_REFLECT"])
    assert rollups.host_nodes(hunt.sessions).count() == 3


def test_rule_health(spark):
    now = dt.datetime(2024, 6, 1)
    rows = ([("good", now - dt.timedelta(days=1), True)] * 5 + [("noisy", now - dt.timedelta(days=2), False)] * 6 + [("stale", now - dt.timedelta(days=100), True)]
            + [("plain", now - dt.timedelta(days=40), True)])
    got = {r.rule_name: r.health for r in rollups.rule_health(spark.createDataFrame(rows, "rule_name string, ts timestamp, is_tp boolean"), F.lit(now)).collect()}
    assert got == {"good": "high_value", "noisy": "stale", "stale": "stale", "plain": "nominal"}
