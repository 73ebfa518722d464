"""Line deduplication by winnowing over line hashes: later copies of runs of lines are deleted."""
from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huskwatch.llm.common import SPACES, cut, give_back, merged, spread, text_key

#: Lines of the shortest run that is deleted, and so the winnowing window; fewer lines count if they hold WORDS words together.
RUN, WORDS = 3, 50
#: Cells of the table that finds frequent fingerprints; its size does not depend on the input.
CELLS = 1 << 20
#: Fingerprints in cells above this and above four times the mean are dealt out by whole windows instead.
FREQUENT = 1000
_SCOPE = 1 << 17
_SIZE = 16

_ROW = "bucket long, packed binary, doc_id long, key long, start int, count int, anchor int, size int"


def full_lines(text: bytes | None) -> list[bytes]:
    """The lines that hold a word, stripped of white space."""
    return [s for line in text.split(b"\n") if (s := line.strip(SPACES))] if text else []


def line_hashes(lines: list[bytes]) -> bytes:
    """128-bit hashes of the lines, one after the other."""
    return b"".join(map(xxhash.xxh3_128_digest, lines))


def short_windows(lines: list[bytes], run: int) -> Iterator[tuple[int, int]]:
    """(first line, lines) of the windows of fewer than ``run`` lines: the shortest from each line on that holds WORDS words.

    A text of fewer than ``run`` lines is a window of its own as well, given with its lines below zero: only whole texts equal it."""
    if 0 < len(lines) < run:
        yield 0, -len(lines)
    bytes_of = [len(x) for x in lines]
    for n in range(len(lines)):
        for k in range(1, min(run, len(lines) - n + 1)):
            if sum(bytes_of[n:n + k]) + k >= 2 * WORDS and sum(len(x.split()) for x in lines[n:n + k]) >= WORDS:
                yield n, k
                break


def fingerprints(hashes: bytes, run: int) -> Iterator[tuple[int, int, int, int]]:
    """(fingerprint, its line, first window, windows): the leftmost smallest line hash of each window of ``run`` lines,
    with the consecutive windows that select it. Any two equal windows select the same line."""
    lines = np.frombuffer(hashes, np.uint64)[::2]
    if len(lines) < run:
        return
    windows = np.lib.stride_tricks.sliding_window_view(lines, run)
    place = windows.argmin(axis=1) + np.arange(len(windows))
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    count = np.diff(np.r_[first, len(place)])
    at = place[first]
    yield from zip(lines[at].tolist(), at.tolist(), first.tolist(), count.tolist(), strict=True)


class Scope:
    """Matches of a map task in scopes of bounded size.

    Of equal stretches of lines the earliest travels; the others are later copies already and only send their place."""

    def __init__(self, frequent: np.ndarray, run: int) -> None:
        self.frequent, self.run = frequent, run
        self.seen: dict[tuple[bytes, int], tuple] = {}
        self.rows: list[tuple] = []

    def add(self, doc: int | None, key: int, lines: list[bytes]) -> None:
        frequent, cells, run, hashes = self.frequent, len(self.frequent), self.run, line_hashes(lines)
        for n, k in short_windows(lines, run):
            part = hashes[n * _SIZE:(n + abs(k)) * _SIZE]
            self._put(part, (xxhash.xxh64_intdigest(part, k & 0xFF), doc, key, n, 1, n, k))
        for mark, line, first, count in fingerprints(hashes, run):
            if frequent[mark % cells]:
                for i in range(first, first + count):
                    part = hashes[i * _SIZE:(i + run) * _SIZE]
                    self._put(part, (xxhash.xxh64_intdigest(part), doc, key, i, 1, i, run))
            else:
                self._put(hashes[first * _SIZE:(first + count + run - 1) * _SIZE], (mark, doc, key, first, count, line, run))

    def _put(self, part: bytes, new: tuple) -> None:
        old = self.seen.setdefault((part, new[6]), new)
        if old == new:
            return
        a, b = _order(old), _order(new)
        if a == b:
            self._send(part, new)
            return
        if b < a:
            self.seen[part, new[6]] = new
        self._send(None, old if b < a else new)

    def _send(self, part: bytes | None, x: tuple) -> None:
        bucket = x[0] if part is not None else xxhash.xxh64_intdigest(str(x[1:]))  # no comparison: spread them
        self.rows.append((bucket - (1 << 64) if bucket >> 63 else bucket, part, *x[1:]))

    def flush(self) -> Iterator[pa.RecordBatch]:
        for (part, _), x in self.seen.items():
            self._send(part, x)
        rows, self.seen, self.rows = self.rows, {}, []
        if rows:
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), *[pa.int32()] * 4)
            names = [c.split()[0] for c in _ROW.split(", ")]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    @property
    def full(self) -> bool:
        return len(self.seen) + len(self.rows) >= _SCOPE


def _order(x: tuple) -> tuple:
    """Place of a stretch: by id, rows without one last, then by line."""
    return (x[1] is None, x[1] or 0, x[5])


def later_copies(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(doc_id, key, start, end) of the windows that an earlier row of the same bucket has too, rows sorted by bucket and place.

    From the common fingerprint the match is extended to both sides by whole windows."""
    now, first = None, {}
    for bucket, part, doc, key, start, count, anchor, size in rows:
        run = abs(size)
        if part is None:
            yield doc, key, start, start + count + run - 1
            continue
        if bucket != now:
            now, first = bucket, {}
        for i in range(count):
            window = (part[i * _SIZE:(i + run) * _SIZE], size < 0)
            if first.setdefault(window, (doc, anchor)) != (doc, anchor):
                yield doc, key, start + i, start + i + run


def copies(docs: DataFrame, run: int = RUN, cells: int = CELLS) -> DataFrame:
    """(doc_id, key, ranges): ranges [start, end) of lines with a word that repeat an earlier run."""
    texts = docs.select("doc_id", text_key(F.col("text")).alias("key"), F.col("text").cast("binary").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [m % cells for t in batch.column(2).to_pylist() for m, *_ in fingerprints(line_hashes(full_lines(t)), run)]
            cell, n = np.unique(np.array(marks, np.int64), return_counts=True)
            yield pa.record_batch({"cell": cell, "n": n.astype(np.int64)})

    tally = cut(texts.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")))
    total = tally.agg(F.sum("n")).first()[0] or 0
    hot = np.zeros(cells, bool)
    hot[tally.where(F.col("n") > max(FREQUENT, 4 * total / cells)).select("cell").toPandas()["cell"].to_numpy(np.int64)] = True
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(hot))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scope = Scope(np.unpackbits(sent.value)[:cells], run)
        for batch in batches:
            for doc, key, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                scope.add(doc, key, full_lines(t))
                if scope.full:
                    yield from scope.flush()
        yield from scope.flush()
        give_back()

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = chain.from_iterable(zip(*(c.to_pylist() for c in b.columns), strict=True) for b in batches)
        held: list[tuple] = []
        for found in chain(later_copies(rows), [None]):
            if found is None or len(held) >= 50_000:
                if held:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=["doc_id", "key", "start", "end"])
                held = []
            if found is not None:
                held.append(found)
        give_back()

    order = ("bucket", F.col("doc_id").asc_nulls_last(), "anchor")
    found = spread(texts.mapInArrow(match, _ROW), "bucket").sortWithinPartitions(*order).mapInArrow(extend, "doc_id long, key long, start int, end int")
    return found.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))


def without_lines(text: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The text without the given lines, counted among those with a word, and how many there were."""
    out, n, gone = [], 0, set(chain.from_iterable(range(a, b) for a, b in ranges))
    for line in text.split(b"\n"):
        full = bool(line.strip(SPACES))
        if not (full and n in gone):
            out.append(line)
        n += full
    return b"\n".join(out), n


def deduplicate(docs: DataFrame, run: int = RUN) -> DataFrame:
    """docs with the text without later copies of line runs, and a struct column ``lines``: n_lines, n_removed.

    Lines are compared without white space at their ends, lines without a word are passed over and stay. A window of ``run``
    such lines, or of fewer that hold WORDS words together, that also occurs earlier, by doc_id and then line, goes with all its
    lines; so does a whole text of fewer lines that an earlier text equals. Rows without an id come last.
    Rows that share doc_id and line are not later than each other, so repeated rows are treated alike. Null texts stay null."""
    @F.pandas_udf("text string, n_lines long, n_removed long")
    def strip(texts: pd.Series, ranges: pd.Series) -> pd.DataFrame:
        rows = []
        for text, given in zip(texts, ranges, strict=True):
            found = merged((r["start"], r["end"]) for r in given) if given is not None else []
            left, n = without_lines(text or b"", found)
            rows.append((None if text is None else left.decode("utf-8", "replace"), n, sum(b - a for a, b in found)))
        return pd.DataFrame(rows, columns=["text", "n_lines", "n_removed"])

    found = copies(docs, run).select(F.col("doc_id").alias("_op_id"), F.col("key").alias("_op_key"), F.col("ranges").alias("_op_ranges"))
    names = [c for c in docs.columns if c != "lines"]
    joined = docs.join(found, docs["doc_id"].eqNullSafe(found["_op_id"]) & (text_key(docs["text"]) == found["_op_key"]), "left")
    done = joined.select(*[docs[c] for c in names if c != "text"], strip(docs["text"].cast("binary"), F.col("_op_ranges")).alias("lines"))
    return done.select(*[F.col("lines.text").alias(c) if c == "text" else F.col(f"`{c}`") for c in names], F.struct("lines.n_lines", "lines.n_removed").alias("lines"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines (with a word), n_removed, kept_sha256 (of the text that is left): one row per document row."""
    found = deduplicate(docs.select("doc_id", "text"))
    return found.select("doc_id", "lines.n_lines", "lines.n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
