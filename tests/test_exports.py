import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from huskwatch.sources import exports, readers

WRAPS = [lambda r: r, lambda r: {"took": 3, "events": r}, lambda r: {"results": r, "n": {"results": [{"x": 1}]}}, lambda r: {"results": [{"Message": "not these"}], "hits": r},
         lambda r: {"hits": {"total": {"value": 5}, "hits": [{"_index": "x", "_source": x} for x in r]}, "tail": [{"hits": 1}]}]


def records(rng, n):
    odd = ['}', '{', '"', '\\', '[{"hits": [', "é😀", "\n", '\\"}', "plain", ']', "hits", ":"]
    return [{"Message": f"{i} " + "".join(rng.choice(odd) for _ in range(rng.randint(0, 30))), "Computer": f"h{i % 3}", "extra": {"a": [1, {"hits": [{"b": "}"}]}], "}": rng.choice(odd)}} for i in range(n)]


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield use
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("size", [97, 2500])
def test_splits_anywhere(spark, tmp_path, small_splits, size):
    """Splits inside strings, escapes and nested objects: each record comes out whole, once."""
    rng = random.Random(size)
    want = []
    for n, wrap in enumerate(WRAPS):
        rows = records(rng, 8 if size < 100 else 25)
        (tmp_path / f"{n}.json").write_text(json.dumps(wrap(rows), indent=rng.choice([None, 1]), ensure_ascii=n % 2 == 0), encoding="utf-8")
        want += [x if n < 4 else {"_index": "x", "_source": x} for x in rows]
    (tmp_path / "own.json").write_text(json.dumps({"Message": "own " + "}" * 500, "list": [{"a": 1}]}))
    want.append({"Message": "own " + "}" * 500, "list": [{"a": 1}]})
    small_splits(size)
    found = exports.json_records(spark, str(tmp_path))
    assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 4
    got = [json.loads(r.text) for r in found.collect()]
    assert sorted(map(json.dumps, got)) == sorted(map(json.dumps, want))
    read = readers.read_json_export(spark, str(tmp_path)).select("raw_text").collect()
    assert sorted(r.raw_text for r in read) == sorted(x.get("_source", x)["Message"] for x in want)


def test_one_split_equals_many(spark, tmp_path, small_splits):
    rng = random.Random(9)
    (tmp_path / "a.json").write_text(json.dumps({"hits": {"hits": [{"_source": x} for x in records(rng, 400)]}}))
    whole = {r.raw_text for r in readers.read_json_export(spark, str(tmp_path)).collect()}
    small_splits(700)
    df = readers.read_json_export(spark, str(tmp_path))
    assert len(whole) == 400 and {r.raw_text for r in df.collect()} == whole


def test_odd_files(spark, tmp_path):
    for name, text in {"empty": "", "blank": " \n", "none": "[]", "hits": '{"hits": []}', "null": '{"hits": null, "Message": "kept"}', "numbers": "[1, 2, \"}\"]", "cut": '[{"Message": "first"}, {"Message": "sec',
                       "two": '{"Message": "one"}\n{"Message": "two"}'}.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = readers.read_json_export(spark, str(tmp_path)).select("raw_text").collect()
    assert sorted(r.raw_text for r in got) == ["first", "kept", "one", "two"]


def test_states_compose():
    """A record that runs over three splits belongs to the split it begins in."""
    parts = ['[{"a": "x', '} y', ' z"}, {"b": 1', ']']
    sums = []
    for start, text in enumerate(parts):
        cases = []
        for quoted in (False, True):
            b, paths = exports.Brackets([], quoted), set()
            for _, _, opened in b.feed(text + ("}" if start < 3 else "")):
                if opened and b.stack[-1][0] == "[":
                    paths.add((b.closed, *b.stack))
            cases.append({"closed": b.closed, "stack": b.stack, "quoted": b.quoted, "paths": sorted(paths)})
        sums.append(("f", start, json.dumps(cases)))
    got = exports.composed(pd.DataFrame(sums, columns=["file", "start", "sums"]))
    assert got["owner"].fillna(-1).tolist() == [-1, 0, 0, -1] and got["kind"].tolist() == [0] * 4
    assert got["quoted"].tolist() == [False, True, True, False]


def test_plan_has_no_whole_file_task(spark, tmp_path):
    (tmp_path / "a.json").write_text("[]")
    plan = exports.json_records(spark, str(tmp_path)).select(F.length("text"))._jdf.queryExecution().toString()
    assert "multiLine" not in plan and "BroadcastHashJoin" in plan
