"""Plan shapes that matter at scale, and registered queries against SQL on the smallest tables."""
import math
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

import __spark_entry__ as entry_mod
from huskwatch.operators import enrich, rollups
from huskwatch.plans import adapters as A
from huskwatch.plans.queries import QUERIES, Tables

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_query_joins_all_pairs(spark):
    """Plans every registered query once, several at a time."""
    def bad(name):
        text = plan(QUERIES[name](spark, FOLDER))
        return name if "CartesianProduct" in text or "BroadcastNestedLoopJoin" in text else None
    with ThreadPoolExecutor(8) as pool:
        assert [x for x in pool.map(bad, sorted(QUERIES)) if x] == []


def test_top_per_key_is_cut_before_the_shuffle(spark):
    text = plan(enrich.host_processes(A.process_events(spark, FOLDER)))
    assert text.count("WindowGroupLimit") == 2


def test_scan_reads_needed_columns_only(spark):
    text = plan(rollups.histogram(Tables(spark, FOLDER).event_sessions, "alert_tier"))
    assert "props" not in text
    assert "text" not in plan(QUERIES["w3_gap_sessions"](spark, FOLDER))


def test_text_is_not_shuffled_by_the_session_stage(spark):
    """Below the stitch exchange only features remain (the spread of small inputs aside)."""
    t = Tables(spark, FOLDER)
    assert not {"raw_text", "decoded_text"} & set(t.hunt.rows.columns)


@pytest.mark.parametrize("name", ["a7_event_host_rollup", "w3_gap_sessions", "r1_rule_hits", "c2_session_score", "i4_indicator_hub", "j5_lateral_moves", "f9_campaigns", "b5_anomaly"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "documents", "pages", "labels", "conversations"):
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    cur = con.execute(entry_mod.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)

    def norm(rows, cols):
        place = sorted(range(len(cols)), key=lambda i: cols[i])
        return sorted(tuple(f"{r[i]:.5f}" if isinstance(r[i], float) and not math.isnan(r[i]) else str(r[i]) for i in place) for r in rows)
    assert norm(df.collect(), df.columns) == norm(cur.fetchall(), names)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry_mod.oracle_sql())
