"""Scan of whole-file JSON exports by many tasks: a prefix pass over quotes and brackets tells each split where it begins.

A file is read as text cut at closing braces, so its splits are those of any text file. Alone, a split does not know whether it
begins inside a string, nor how deep. The first pass therefore sums up each split for both cases (brackets closed, brackets
opened, whether a string is open at the end); the sums of a file compose from split to split into the state at each split's
start. The second pass cuts out the records; those that cross splits are put together from their parts."""
from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where records lie, in order of preference: brackets from the file's start, with the wrapper key's first letter.
PATHS = [("[",), ("{", "[h"), ("{", "{h", "[h"), ("{", "[e"), ("{", "[r")]
#: The file is one object, its own record.
OWN = len(PATHS)
_TOKEN = re.compile(r'"(hits|events|results)"\s*:\s*([\[{])|"(?:[^"\\]|\\.)*("?)|[{}\[\]]', re.DOTALL)
_REST = re.compile(r'(?:[^"\\]|\\.)*"', re.DOTALL)
_STATE = "file string, start long, stack string, quoted boolean, kind int, owner long"


class Brackets:
    """Open brackets of a text that is fed piece by piece, each ending in a closing brace."""

    def __init__(self, stack: list[str], quoted: bool) -> None:
        self.stack, self.quoted, self.closed = stack, quoted, 0

    def feed(self, piece: str) -> Iterator[tuple[int, int, bool]]:
        """(start, end, opened) of each bracket, after it has changed the stack."""
        at = 0
        if self.quoted:
            if (m := _REST.match(piece)) is None:
                return
            at, self.quoted = m.end(), False
        for m in _TOKEN.finditer(piece, at):
            first = m[0][0]
            if m[2]:
                self.stack.append(m[2] + m[1][0])
                yield m.end() - 1, m.end(), True
            elif first == '"':
                self.quoted = not m[3]
            elif first in "{[":
                self.stack.append(first)
                yield m.start(), m.end(), True
            else:
                if self.stack:
                    self.stack.pop()
                else:
                    self.closed += 1
                yield m.start(), m.end(), False


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[str]]]:
    """Each split of the task with its pieces; a task's splits follow one another."""
    rows = (r for b in batches for i in range(0, b.num_rows, 256) for r in b.slice(i, 256).to_pylist())
    row = next(rows, None)
    while row is not None:
        head = row

        def pieces() -> Iterator[str]:
            nonlocal row
            while row is not None and (row["file"], row["start"]) == (head["file"], head["start"]):
                yield (row["value"] or "") + "}"
                row = next(rows, None)
        own = pieces()
        yield head, own
        for _ in own:
            pass


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for head, pieces in _splits(batches):
        cases, seen = [Brackets([], False), Brackets([], True)], [set(), set()]
        for piece in pieces:
            for case, paths in zip(cases, seen, strict=True):
                for _, _, opened in case.feed(piece):
                    if opened and len(case.stack) <= 3 and case.stack[-1][0] == "[":
                        paths.add((case.closed, *case.stack))
        sums = [{"closed": c.closed, "stack": c.stack, "quoted": c.quoted, "paths": sorted(p)} for c, p in zip(cases, seen, strict=True)]
        yield pa.RecordBatch.from_pylist([{"file": head["file"], "start": head["start"], "sums": json.dumps(sums)}])


def composed(found: pd.DataFrame) -> pd.DataFrame:
    """States at the start of a file's splits, from their sums: one short row a split."""
    found = found.sort_values("start")
    stack, quoted, kinds, states = [], False, set(), []
    for start, sums in zip(found["start"], found["sums"], strict=True):
        own = json.loads(sums)[quoted]
        kept = stack[:max(0, len(stack) - own["closed"])]
        for closed, *opened in own["paths"]:
            path = (*stack[:max(0, len(stack) - closed)], *opened)
            if path in PATHS:
                kinds.add(PATHS.index(path))
        after = kept + own["stack"]
        states.append((start, stack, quoted, len(kept), after))
        stack, quoted = after, own["quoted"]
    kind = min(kinds, default=OWN)
    path = list(PATHS[kind]) if kind < OWN else []
    rows, owner = [], None
    for start, before, inside, least, after in states:
        rows.append((found["file"].iloc[0], start, json.dumps(before), inside, kind, owner))
        if not (len(after) > len(path) and after[:len(path)] == path):
            owner = None
        elif owner is None or least <= len(path):
            owner = start
    return pd.DataFrame(rows, columns=["file", "start", "stack", "quoted", "kind", "owner"]).astype({"owner": "Int64"})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records (whole) and parts of records that cross the split's ends."""
    schema = pa.schema([("file", pa.string()), ("owner", pa.int64()), ("part", pa.int64()), ("whole", pa.bool_()), ("text", pa.string())])
    for head, pieces in _splits(batches):
        path = list(PATHS[head["kind"]]) if head["kind"] < OWN else []
        state, out = Brackets(json.loads(head["stack"]), head["quoted"]), []
        depth = len(path) + 1
        held, owner = ([], head["owner"]) if head["owner"] is not None else (None, None)
        for piece in pieces:
            at = 0
            for start, end, opened in state.feed(piece):
                if opened and held is None and len(state.stack) == depth and state.stack[-1][0] == "{" and state.stack[:-1] == path:
                    held, owner, at = [], head["start"], start
                elif not opened and held is not None and len(state.stack) == depth - 1:
                    held.append(piece[at:end])
                    out.append((head["file"], owner, head["start"], owner == head["start"], "".join(held)))
                    held, at = None, end
            if held is not None:
                held.append(piece[at:])
            if len(out) >= 500:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if held:
            out.append((head["file"], owner, head["start"], False, "".join(held)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """file, text of each record object of JSON files: the elements of a top-level array, of an array under ``hits`` (plain, or
    nested in an object of that name), ``events`` or ``results``, whichever the file has first in this order, else the
    file's own objects.

    The states, a short row for each split of the input, are broadcast: about a megabyte for a terabyte at default split size."""
    pieces = (spark.read.option("lineSep", "}").text(path)
              .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")))
    sums = pieces.mapInArrow(_summed, "file string, start long, sums string")
    states = sums.groupBy("file").applyInPandas(composed, _STATE)
    cut = pieces.join(F.broadcast(states), ["file", "start"]).mapInArrow(_cut, "file string, owner long, part long, whole boolean, text string")
    crossing = (cut.filter("not whole").groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("parts"))
                .select("file", F.array_join("parts.text", "").alias("text")))
    return cut.filter("whole").select("file", "text").unionByName(crossing)
