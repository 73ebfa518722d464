import datetime as dt
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from huskwatch.functions.text import block_hash, shannon_entropy, terms
from huskwatch.operators import baseline, packed
from huskwatch.streaming import jobs, triage


class Cell:
    """A state of one key in memory that counts what is done to it."""

    def __init__(self):
        self.rows, self.reads, self.appended = [], 0, 0

    def exists(self):
        return bool(self.rows)

    def clear(self):
        self.rows = []


class ListCell(Cell):
    def get(self):
        self.reads += 1
        return iter(self.rows)

    def appendList(self, rows):  # noqa: N802
        self.appended += len(rows)
        self.rows += rows


class ValueCell(Cell):
    def get(self):
        return self.rows[0]

    def update(self, row):
        self.rows = [row]


class Handle:
    def __init__(self):
        self.timers, self.parts, self.known = set(), ListCell(), ValueCell()

    def getListState(self, *_):  # noqa: N802
        return self.parts

    def getValueState(self, *_):  # noqa: N802
        return self.known

    def listTimers(self):  # noqa: N802
        return iter(self.timers)

    def deleteTimer(self, t):  # noqa: N802
        self.timers.discard(t)

    def registerTimer(self, t):  # noqa: N802
        self.timers.add(t)


class Clock:
    def __init__(self, ms=0):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms


def frame(*parts, total):
    return pd.DataFrame([("k", n, total, "h", 1, 1, "", t * 1_000_000, f"{n};", f"{n};") for n, t in parts], columns=jobs._PART)


def test_parts_are_appended_and_read_once():
    own, handle = jobs.Reassembly(600), Handle()
    own.init(handle)
    order = list(range(1, 41))
    random.Random(1).shuffle(order)
    out = []
    for i, n in enumerate(order):
        out += list(own.handleInputRows(("k",), iter([frame((n, 100 + n), total=40)]), Clock()))
        assert handle.parts.reads == (i == 39) and len(handle.timers) == (i < 39)
    assert len(out) == 1 and out[0]["raw_text"].tolist() == ["".join(f"{n};" for n in range(1, 41))] and handle.parts.appended == 40
    assert not handle.parts.rows and not handle.known.rows


def test_given_up_and_overfull_blocks():
    own, handle = jobs.Reassembly(600), Handle()
    own.init(handle)
    assert list(own.handleInputRows(("k",), iter([frame((2, 5), (1, 9), total=3)]), Clock())) == []
    assert handle.timers == {605_000}
    late = list(own.handleExpiredTimer(("k",), Clock(606_000), None))
    assert late[0]["block_number"].tolist() == [1, 2] and not handle.timers and not handle.known.rows
    over = list(own.handleInputRows(("k",), iter([frame((1, 1), (2, 2), (2, 3), total=2), frame((3, 4), total=2)]), Clock()))
    assert [f["block_number"].tolist() for f in over] == [[1, 2, 2], [3]] and not handle.parts.rows
    assert [f["block_number"].tolist() for f in own.handleInputRows(("k",), iter([frame((4, 5), total=2)]), Clock())] == [[4]]


def changes(rng, n):
    base = dt.datetime(2024, 1, 1)
    return [(f"s{rng.randrange(40)}", rng.choice(["open", "closed", "false"]), f"n{i}", base + dt.timedelta(seconds=rng.randrange(10_000))) for i in range(n)]


def brute(rows):
    best = {}
    for s, status, notes, ts in rows:
        best[s] = max(best.get(s, ()), (ts, status, notes)) if s in best else (ts, status, notes)
    return {(s, v[1], v[0]) for s, v in best.items()}


def shown(df):
    return {(r.session_id, r.status, r.ts) for r in df.collect()}


def test_triage_table_equals_all_changes(spark, tmp_path, monkeypatch):
    rng, folder, seen = random.Random(2), str(tmp_path / "t"), []
    assert triage.table(spark, folder).collect() == []
    folders = set()
    for n in range(8):
        rows = changes(rng, rng.choice([0, 3, 12]))
        batch = spark.createDataFrame(rows, triage.SCHEMA)
        if n in (2, 5):  # the batch fails before its manifest is written, and is run again
            with monkeypatch.context() as m:
                m.setattr(triage, "_slot_of", lambda *_: 1 / 0)
                with pytest.raises(ZeroDivisionError):
                    triage.apply_batch(batch, n, folder, 3)
            assert {x[0] for x in shown(triage.table(spark, folder))} == {x[0] for x in brute(seen)}
        triage.apply_batch(batch, n, folder, 3)
        seen += rows
        before = shown(triage.table(spark, folder))
        triage.apply_batch(batch, n, folder, 3)  # committed already
        assert shown(triage.table(spark, folder)) == before == brute(seen)
        folders = {d for d, _, _ in os.walk(folder) if "bucket=" not in d}
    assert len(folders) <= 2 + 2 * 3 + 10  # fixed names: nothing piles up
    some = triage.table(spark, folder, ["s1", "s2", "none"])
    assert shown(some) == {x for x in brute(seen) if x[0] in ("s1", "s2")}


def features(df):
    return df.select("*", terms(F.col("decoded_text")).alias("terms"), block_hash(F.col("raw_text")).alias("content_hash"))


def test_stream_scores_equal_the_batch(spark, make_blocks, tmp_path):
    rng = random.Random(6)
    verbs = ["Get-Item", "Set-Thing", "Invoke-Rare", "Write-Host", "New-Odd", "Test-Path", "Get-Never"]
    text = lambda k: " ".join(rng.choice(verbs[:k]) for _ in range(rng.randint(0, 6)))
    old = features(make_blocks(*[{"text": text(5) + f" {i}", "path": f"C:\\x{i % 4}.ps1", "sec": i} for i in range(120)]))
    new = features(make_blocks(*[{"text": text(7) + rng.choice(["", " " + "".join(chr(33 + rng.randrange(90)) for _ in range(300))]), "path": rng.choice(["", "c:\\X1.PS1", "D:\\new.ps1"]), "sec": 9000 + i} for i in range(150)], {"text": "", "sec": 9999})).unionByName(old.limit(5), allowMissingColumns=True)
    base = baseline.build(old)
    known = packed.pack(base)
    want = {(r.block_id, r.block_number, r.ts): round(r.anomaly, 9) for r in baseline.anomaly(new, base).collect()}
    got = [((r.block_id, r.block_number, r.ts), round(r.anomaly, 9)) for r in jobs.anomaly_scores(new, known).collect()]
    assert dict(got) == want and len({v for _, v in got}) > 5
    version = packed.save(known, spark, str(tmp_path / "p"))
    again = packed.load(spark, str(tmp_path / "p"), version)
    assert again.version == version and [r.anomaly for r in packed.scored(new, again).collect()] == [r.anomaly for r in packed.scored(new, known).collect()]
    with pytest.raises(packed.TooLarge):
        packed.pack(base, 8)
    new.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(new.schema).parquet(str(tmp_path / "in"))
    q = jobs.anomaly_scores(stream, known).select("block_id", "block_number", "ts", "anomaly").writeStream.format("memory").queryName("x8").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.block_id, r.block_number, r.ts): round(r.anomaly, 9) for r in spark.table("x8").collect()} == want
    b = jobs.anomaly_batches(stream, base, str(tmp_path / "out"), str(tmp_path / "ck"))
    b.processAllAvailable()
    b.stop()
    assert {(r.block_id, r.block_number, r.ts): round(r.anomaly, 9) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want
    small = packed.pack(baseline.build(old.limit(50)))
    assert {r.anomaly for r in packed.scored(new, small).collect()} == {0.0}
