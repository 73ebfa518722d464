import csv
import datetime as dt
import glob
import json
import pathlib
import time

import pytest
from pyspark.sql import functions as F

from huskwatch.catalog.content import content_table
from huskwatch.functions.text import block_hash
from huskwatch.operators import baseline, blocks, content, rollups, views
from huskwatch.plans.hunt import Hunt
from huskwatch.sources import readers, sinks
from huskwatch.sources.ordered import check_name, file_part, write_files
from huskwatch.streaming import jobs, triage

RECORDS = [
    {"ScriptBlockText": "sekurlsa 1.2.3.4", "Computer": "A", "ProcessId": 7, "ThreadId": 1, "TimeCreated": "2024-06-01T14:00:00Z", "ScriptBlockId": "g1",
     "MessageNumber": 1, "MessageTotal": 1, "Path": "C:\\x.ps1"},
    {"script_block_text": "pow`ershell", "host": "B", "process_id": "8", "@timestamp": "2024-06-01T14:00:01.250Z", "TimeCreated": "2020-01-01T00:00:00Z"},
    {"Message": "third", "hostname": "C", "_time": "2024-06-01T14:00:02+02:00", "script_path": "p"},
    {"ScriptBlockText": "", "Computer": "D"},
    {"ScriptBlockText": "bad time", "timestamp": "yesterday"},
]
WANT = {("A", 7, "sekurlsa 1.2.3.4", "2024-06-01 14:00:00", "C:\\x.ps1"), ("B", 8, "pow`ershell", "2024-06-01 14:00:01", ""),
        ("C", 0, "third", "2024-06-01 12:00:02", "p"), ("unknown", 0, "bad time", None, "")}


def rows_of(df):
    return {(r.host_id, r.process_id, r.raw_text, r.t, r.path) for r in df.withColumn("t", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).collect()}


@pytest.mark.parametrize("wrap", [
    lambda r: r, lambda r: {"events": r}, lambda r: {"results": r}, lambda r: {"hits": r},
    lambda r: {"hits": {"total": 5, "hits": [{"_index": "x", "_source": x} for x in r]}}, lambda r: [{"_source": x} for x in r]])
def test_json_export(spark, tmp_path, wrap):
    f = tmp_path / "x.json"
    f.write_text(json.dumps(wrap(RECORDS), indent=1))
    df = readers.read_json_export(spark, str(f))
    assert rows_of(df) == WANT
    assert df.filter("ts_defaulted").count() == 1


def test_single_object_and_ids(spark, tmp_path):
    f = tmp_path / "x.json"
    f.write_text(json.dumps(RECORDS[1]))
    a, b = readers.read_json_export(spark, str(f)).first(), readers.read_json_export(spark, str(f)).first()
    assert a.block_id == b.block_id and len(a.block_id) == 64 and (a.block_number, a.block_total) == (1, 1)


def test_ndjson(spark, tmp_path):
    f = tmp_path / "x.jsonl"
    f.write_text("\n".join([json.dumps(r) for r in RECORDS[:3]] + [json.dumps({"_source": RECORDS[4]}), "{broken", ""]))
    assert rows_of(readers.read_ndjson(spark, str(f))) == WANT


def event(eid, data, pid="7"):
    body = "".join(f'<Data Name="{k}">{v}</Data>' for k, v in data.items())
    return (f'<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><EventID>{eid}</EventID><TimeCreated SystemTime="2024-06-01T14:00:00.5Z"/>'
            f'<Execution ProcessID="{pid}" ThreadID="3"/><Computer>HOST</Computer></System><EventData>{body}</EventData></Event>')


def test_event_xml(spark, tmp_path):
    f = tmp_path / "x.xml"
    f.write_text("<Events>" + "".join([
        event(4104, {"ScriptBlockText": "get-item", "ScriptBlockId": "g", "MessageNumber": "1", "MessageTotal": "2"}),
        event(4688, {"NewProcessName": "C:\\W\\p.exe", "ParentProcessName": "C:\\W\\q.exe", "NewProcessId": "0x1f", "ProcessId": "0x10", "CommandLine": "p -x", "SubjectUserName": "u"}),
        event(1, {"Image": "C:\\s.exe", "ProcessId": "44", "ParentImage": "t.exe", "User": "v"}),
        event(4625, {"TargetUserName": "w", "LogonType": "3", "IpAddress": "1.2.3.4", "WorkstationName": "WS"}), event(4648, {"TargetServerName": "SRV"}),
        event(4698, {"TaskName": "T"}), event(7045, {"ServiceName": "S", "ImagePath": "C:\\i", "AccountName": "a"}), event(9999, {})]) + "</Events>")
    events = readers.read_events(spark, str(f))
    b = readers.script_blocks(events).collect()
    assert [(r.block_id, r.host_id, r.process_id, r.thread_id, r.raw_text, r.block_total) for r in b] == [("g", "HOST", 7, 3, "get-item", 2)]
    p = {r.event_id: r for r in readers.process_events(events).collect()}
    assert (p[4688].process_id, p[4688].parent_pid, p[4688].process_name, p[4688].parent_name, p[4688].user) == (31, 16, "p.exe", "q.exe", "u")
    assert (p[1].process_id, p[1].process_name, p[1].user) == (44, "s.exe", "v")
    assert (p[4698].process_name, p[4698].command_line, p[7045].process_name, p[7045].parent_name) == ("schtasks.exe", "T", "S", "services.exe")
    log = {r.event_id: r for r in readers.logon_events(events).collect()}
    assert (log[4625].target_host, log[4625].logon_type, log[4625].success, log[4648].target_host, log[4648].success) == ("WS", 3, False, "SRV", True)


@pytest.fixture()
def hunt(spark, tmp_path):
    f = tmp_path / "in.json"
    f.write_text(json.dumps(RECORDS))
    return Hunt.from_records(readers.read_json_export(spark, str(f)))


def lines(folder):
    return [x.rstrip("\n") for p in sorted(glob.glob(f"{folder}/part-*")) for x in open(p, encoding="utf-8")]


def test_sinks(hunt, tmp_path):
    sinks.write_results(hunt.sessions, hunt.campaigns, str(tmp_path / "r"))
    assert len(lines(tmp_path / "r/sessions")) == 4
    sinks.write_ioc_csv(hunt.members, str(tmp_path / "csv"))
    rows = [r for p in glob.glob(str(tmp_path / "csv/part-*")) for r in csv.reader(open(p))]
    assert ["type", "value", "count", "session"] in rows and ["ip", "1.2.3.4", "1", "A_7_20240601T140000"] in rows
    sinks.write_ioc_text(hunt.hub, str(tmp_path / "txt"))
    assert lines(tmp_path / "txt") == ["## IPs (1)", "1.2.3.4", ""]
    sinks.write_session_folders({"findings": hunt.findings}, str(tmp_path / "s"), ["A_7_20240601T140000"])
    assert len(glob.glob(str(tmp_path / "s/findings/session_id=*"))) == 1
    assert glob.glob(str(tmp_path / "s/findings/session_id=A_7_20240601T140000/*.json"))
    layer = json.loads(sinks.navigator_layer(rollups.navigator_rows(hunt.findings), "t").first().layer)
    assert layer["techniques"][0]["techniqueID"] == "T1003.001" and layer["techniques"][0]["score"] == 90


def test_content_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("T2", "low", "rule two {\n  a\n}"), ("T1", "critical", "rule one"), ("T0", "low", "rule zero")], "technique_id string, level string, text string")
    sinks.write_rule_texts(rows, str(tmp_path / "rules"))
    assert lines(tmp_path / "rules") == ["rule one", "rule zero", "rule two {", "  a", "}"]
    found = spark.createDataFrame([("T1", "high", "kql text", "eql text")], "technique_id string, severity string, kql string, eql string")
    sinks.write_content(found, ["kql", "eql"], str(tmp_path / "content"))
    assert {(r.platform, r.text) for r in spark.read.json(str(tmp_path / "content")).collect()} == {("kql", "kql text"), ("eql", "eql text")}


def tree(folder):
    return {str(p.relative_to(folder)): p.read_text(encoding="utf-8") for p in pathlib.Path(folder).rglob("*")
            if p.is_file() and not p.name.startswith((".", "_"))}


def test_ordered_files(spark, tmp_path):
    """Every file once, in order, from many partitions; an empty table; texts as they are; bad names and failures leave nothing."""
    rows = [(f"f{i % 5}/x.txt", i, f"{i} \u00e4\r\n") for i in range(2000)] + [("f0/x.txt", 5000, None), ("one", 1, "")]
    df = spark.createDataFrame(rows, "file string, no long, text string").repartition(7)
    write_files(df, str(tmp_path / "a"), "no")
    want = {n: "".join(t or "" for f, _, t in rows if f == n) for n in {r[0] for r in rows}}
    got = {n: (tmp_path / "a" / n).read_bytes().decode() for n in want}
    assert got == want and set(tree(tmp_path / "a")) == set(want)
    manifest = json.loads((tmp_path / "a" / "_manifest.json").read_text())
    assert {n: m["bytes"] for n, m in manifest.items()} == {n: len(t.encode()) for n, t in want.items()}
    assert not list((tmp_path / "a" / "_pending").glob("*"))
    write_files(df.filter("file = 'one'").withColumn("text", F.lit("new")), str(tmp_path / "a"), "no")
    assert (tmp_path / "a" / "one").read_text() == "new"
    write_files(df.limit(0), str(tmp_path / "b"), "no")
    assert json.loads((tmp_path / "b" / "_manifest.json").read_text()) == {}
    for bad in ("../x", "/x", "_pending/x", "a/.b", "", None):
        with pytest.raises(Exception, match="not a name"):
            write_files(spark.createDataFrame([("good", 0, "t"), (bad, 1, "t")], "file string, no long, text string"), str(tmp_path / "c"), "no")
    failing = df.withColumn("text", F.when(F.col("no") == 1999, F.raise_error(F.lit("stopped"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="stopped"):
        write_files(failing, str(tmp_path / "c"), "no")
    assert tree(tmp_path / "c") == {} and not (tmp_path / "c" / "_manifest.json").exists()


def test_file_parts(spark):
    names = ["A_7_20240601T140000", "a/b", "a_b", "..", "", "\u00e9"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(file_part(F.col("n"))).collect()]
    assert got[0] == names[0] and got[2] == "a_b" and len(set(got)) == len(names)
    assert all(check_name(g) for g in got)


def test_combined_rules(spark, tmp_path):
    rows = spark.createDataFrame([("T2", "low", "two"), ("T1", "critical", "one"), ("T0", "low", "zero"), ("T0", "low", "zero")], "technique_id string, level string, text string")
    sinks.write_combined(rows, str(tmp_path), "rules.yml")
    assert tree(tmp_path) == {"rules.yml": "one\n---\nzero\n---\ntwo"}


def test_session_export(spark, tmp_path):
    """The folder of a named session holds everything the session has, and no other session's."""
    sid = "A_7_20240601T140000"
    (tmp_path / "in.json").write_text(json.dumps(RECORDS))
    hunt = Hunt.from_records(readers.read_json_export(spark, str(tmp_path / "in.json")), work_folder=str(tmp_path / "work"))
    best = content.best_findings(hunt.findings)
    sigma = content.sigma_texts(content.sigma_rows(best, hunt.sessions, content_table(spark)))
    children = {"iocs": hunt.members.drop("host_id"), "blocks": views.detail_blocks(hunt.rows, hunt.texts)}
    detail = views.session_detail(views.summary_rows(hunt.sessions), children)
    notes = spark.createDataFrame([(sid, "confirmed", "seen before", dt.datetime(2024, 6, 2)), ("other", "x", "y", None)], "session_id string, status string, notes string, ts timestamp")
    files = sinks.session_files(detail, hunt.members, hunt.rows, hunt.texts, sigma, notes, [sid, "B_8_20240601T140001"])
    sinks.write_session_export(files, str(tmp_path / "out"))
    found = tree(tmp_path / "out")
    assert found.pop(f"{sid}/notes.txt") == "Status: confirmed\nTimestamp: 2024-06-02 00:00:00\n\nseen before\n"
    assert found.pop(f"{sid}/indicators.txt") == "1.2.3.4\n" and found.pop(f"{sid}/blocks/block_00001_decoded.ps1") == "sekurlsa 1.2.3.4"
    info = json.loads(found.pop(f"{sid}/session_info.json"))
    assert info["session_id"] == sid and info["iocs"] == [{"value": "1.2.3.4"}] and info["blocks_total"] == 1 and info["triage"]["notes"] == "seen before"
    assert info["blocks"][0]["findings"][0]["technique_id"] == "CRED_HARVEST"
    rule = found.pop(f"{sid}/rules.yml")
    assert rule.startswith('title: "') and "\ndetection:\n  " in rule and "level: critical\n" in rule and rule.count("\nid: ") == 1
    other = "B_8_20240601T140001"
    assert {n: found[n] for n in found if n.endswith(".ps1")} == {f"{other}/blocks/block_00001_decoded.ps1": "powershell", f"{other}/blocks/block_00001_raw.ps1": "pow`ershell"}
    assert json.loads(found[f"{other}/session_info.json"])["iocs"] == [] and {n.split("/")[0] for n in found} == {other}


def test_session_detail_lists(spark):
    """Order, cuts, totals, ties, missing times, sessions without rows, rows without a session, clashing column names."""
    sessions = spark.createDataFrame([("s1", 1), ("s2", 2), ("s3", 3)], "session_id string, no int")
    iocs = spark.createDataFrame([("s1", f"v{i:04d}") for i in range(3000)] + [("gone", "v"), (None, "v")], "session_id string, value string").repartition(5)
    logons = spark.createDataFrame([("s1", 5, "u", "t"), ("s1", -7_000, "u", "t"), ("s1", None, "u", "t"), ("s2", 5, "b", "t"), ("s2", 5, "a", "t"), ("s2", 5, "a", "t")],
                                   "session_id string, no long, username string, target_host string").withColumn("ts", F.timestamp_seconds("no"))
    got = {r.session_id: r for r in views.session_detail(sessions, {"iocs": iocs, "logons": logons}, {"logons": 2}).collect()}
    assert set(got) == {"s1", "s2", "s3"} and [got[s].no for s in ("s1", "s2", "s3")] == [1, 2, 3]
    assert [v.value for v in got["s1"].iocs] == [f"v{i:04d}" for i in range(60)] and got["s1"].iocs_total == 3000
    assert [x.no for x in got["s1"].logons] == [None, -7000] and got["s1"].logons_total == 3
    assert [x.username for x in got["s2"].logons] == ["a", "a"] and got["s2"].logons_total == 3
    assert (got["s3"].iocs, got["s3"].logons, got["s3"].iocs_total) == ([], [], 0)
    assert views.session_detail(sessions, {"iocs": iocs.limit(0)}).filter("size(iocs) = 0").count() == 3
    with pytest.raises(ValueError, match="no such list"):
        views.session_detail(sessions, {"other": iocs})


# -- streams -------------------------------------------------------------------------------------

def run(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name).collect()


def feed_files(folder, batches):
    folder.mkdir(exist_ok=True)
    for i, rows in enumerate(batches):
        (folder / f"{i:03d}.json").write_text("\n".join(json.dumps(r) for r in rows))
        time.sleep(0.02)


def rec(text, t, host="A", pid=1, **kw):
    return {"ScriptBlockText": text, "Computer": host, "ProcessId": pid, "TimeCreated": t, **kw}


def test_stream_findings_equal_batch(spark, tmp_path):
    feed_files(tmp_path / "in", [[rec("seku`rlsa", "2024-06-01T10:00:00Z")], [rec("amsiInitFailed", "2024-06-01T10:00:05Z"), rec("quiet", "2024-06-01T10:00:06Z")]])
    got = run(jobs.findings(jobs.read_records(spark, str(tmp_path / "in"), 1)), "f1")
    assert sorted(r.technique_id for r in got) == ["AMSI_BYPASS_REFLECT", "CRED_HARVEST"]
    counts = run(jobs.finding_counts(jobs.findings(jobs.read_records(spark, str(tmp_path / "in"), 1)), "10 minutes", "5 minutes"), "f2", "complete")
    assert sum(r.n for r in counts) == 4


def test_stream_sessions_equal_batch(spark, tmp_path):
    minute = ["2024-06-01T10:00:00Z", "2024-06-01T10:02:00Z", "2024-06-01T10:04:01Z", "2024-06-01T10:01:00Z"]
    feed_files(tmp_path / "in", [[rec("a", m)] for m in minute] + [[rec("z", "2024-06-01T12:00:00Z", "Z")], [rec("z", "2024-06-01T13:00:00Z", "Z")]])
    got = run(jobs.sessions(jobs.read_records(spark, str(tmp_path / "in"), 1)), "s1")
    assert {(r.session_id, r.block_count) for r in got if r.host_id == "A"} == {("A_1_20240601T100000", 3), ("A_1_20240601T100401", 1)}


def test_stream_reassembly_and_deduplication(spark, tmp_path):
    def part(i, n, total, text, t):
        return rec(text, t, ScriptBlockId=i, MessageNumber=n, MessageTotal=total)
    feed_files(tmp_path / "in", [
        [part("m", 2, 2, "two", "2024-06-01T10:00:01Z"), part("i", 1, 3, "lone", "2024-06-01T10:00:00Z")], [part("m", 1, 2, "one-", "2024-06-01T10:00:00Z")],
        [part("s", 1, 1, "single", "2024-06-01T10:00:03Z")], [part("t", 1, 1, "tick", "2024-06-01T11:00:00Z")], [part("u", 1, 1, "tock", "2024-06-01T12:00:00Z")],
        [part("v", 1, 1, "end", "2024-06-01T13:00:00Z")]])
    got = {(r.block_id, r.block_number, r.raw_text) for r in run(jobs.reassemble(jobs.read_records(spark, str(tmp_path / "in"), 1)), "r1")}
    assert {("m", 1, "one-two"), ("i", 1, "lone"), ("s", 1, "single")} <= got
    feed_files(tmp_path / "over", [[part("o", 1, 2, "a", "2024-06-01T10:00:00Z"), part("o", 2, 2, "b", "2024-06-01T10:00:01Z"), part("o", 2, 2, "c", "2024-06-01T10:00:02Z")],
                                   [part("o", 2, 2, "d", "2024-06-01T10:00:03Z")]])
    assert sorted(r.raw_text for r in run(jobs.reassemble(jobs.read_records(spark, str(tmp_path / "over"), 1)), "r2")) == ["a", "b", "c", "d"]
    feed_files(tmp_path / "dup", [[part("d", 1, 1, "x", "2024-06-01T10:00:00Z")], [part("d", 1, 1, "x", "2024-06-01T10:00:00Z"), part("d", 2, 2, "y", "2024-06-01T10:00:00Z")]])
    assert len(run(jobs.deduplicate(jobs.read_records(spark, str(tmp_path / "dup"), 1)), "d1")) == 2


def test_stream_reassembly_equals_batch(spark, tmp_path):
    """Undated parts, tokens across part borders, paths and threads: the stream gives what the batch job gives."""
    def part(i, n, total, text, t):
        return rec(text, t, ScriptBlockId=i, MessageNumber=n, MessageTotal=total, ThreadId=7, Path="C:\\\\x.ps1")
    rows = [part("m", 2, 2, "-join('b','c')", "2024-06-01T10:00:01Z"), part("m", 1, 2, "in`voke ", "2024-06-01T10:00:00Z"), part("n", 1, 1, "no t`ime", "bad"),
            part("k", 1, 1, "sing`le", "2024-06-01T10:00:02Z")]
    feed_files(tmp_path / "in", [[r] for r in rows])
    names = ["block_id", "block_number", "block_total", "thread_id", "path", "ts", "raw_text", "decoded_text"]
    got = {tuple(r[n] for n in names) for r in run(jobs.reassemble(jobs.read_records(spark, str(tmp_path / "in"), 1)), "r9")}
    batch = blocks.reassemble(blocks.decode_blocks(readers.read_ndjson(spark, str(tmp_path / "in"))))
    assert got == {tuple(r[n] for n in names) for r in batch.collect()} and len(got) == 3


def test_stream_baseline(spark, tmp_path):
    feed_files(tmp_path / "in", [[rec("known", "2024-06-01T10:00:00Z"), rec("new", "2024-06-01T10:00:01Z")]])
    stream = jobs.read_records(spark, str(tmp_path / "in")).withColumn("content_hash", block_hash(F.col("raw_text")))
    hashes = spark.createDataFrame([("known",)], "raw_text string").select(block_hash(F.col("raw_text")).alias("content_hash"))
    known = baseline.Baseline(None, hashes, None, None, None)
    assert [r.raw_text for r in run(jobs.unknown_content(stream, known), "b1")] == ["new"]


def test_stream_triage_and_feed(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, (s, st) in enumerate([("a", "open"), ("b", "open"), ("a", "closed")]):
        (folder / f"{i}.json").write_text(json.dumps({"session_id": s, "status": st, "notes": "", "ts": f"2024-06-01T10:00:0{i}Z"}))
        time.sleep(0.02)
    log = spark.readStream.schema("session_id string, status string, notes string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(folder))
    q = triage.upsert(log, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert {(r.session_id, r.status) for r in triage.table(spark, str(tmp_path / "out")).collect()} == {("a", "closed"), ("b", "open")}
    feed = spark.createDataFrame([("1.2.3.4", "threatfox", "Fam")], "value string, source string, malware_name string")
    values = jobs.read_records(spark, str(folder)).select(F.col("raw_text").alias("value"))
    feed_files(tmp_path / "v", [[rec("1.2.3.4", "2024-06-01T10:00:00Z"), rec("9.9.9.9", "2024-06-01T10:00:00Z")]])
    values = jobs.read_records(spark, str(tmp_path / "v")).select(F.col("raw_text").alias("value"))
    assert [(r.value, r.malware_name) for r in run(jobs.enrich_with_feed(values, feed), "e1")] == [("1.2.3.4", "Fam")]
