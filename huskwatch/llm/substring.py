"""Exact substring deduplication: windows of words travel as super-k-mers to the bucket of their minimiser."""
from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain
from operator import itemgetter
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huskwatch.llm.common import cut, merged, spread

WINDOW = 35
#: Words of a minimiser.
SEED = 4
#: Cells of the table that finds frequent minimisers; its size does not depend on the input.
CELLS = 1 << 20
#: Minimisers in cells above this and above four times the mean are dealt out by whole windows instead.
FREQUENT = 20_000
#: Super-k-mers of one bucket, on average.
BUCKET = 20_000
#: Words that are scanned at once, and super-k-mers that are compared with each other before they travel.
_SLICE, _SCOPE = 1 << 18, 1 << 17
_LOW = np.uint64((1 << 24) - 1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)

Entry = tuple[int, bytes, int, int, int]  # minimiser, text, row, first word, windows


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _SPREAD
    return x ^ (x >> np.uint64(29))


def _sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n neighbours."""
    span = 1
    while span * 2 <= n:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:len(x) - (n - span)], x[n - span:]) if n > span else x


def super_kmers(words: list[bytes], row: int, window: int, seed: int) -> Iterator[Entry]:
    """Maximal runs of consecutive windows that share the place of their minimiser, each as one text.

    The minimiser of a window is its word group of ``seed`` words with the smallest hash, the leftmost of equals; it depends
    on the window's words alone. Very long documents are cut into overlapping slices, which splits runs but no window."""
    for at in range(0, len(words) - window + 1, _SLICE):
        part = words[at:at + _SLICE + window - 1]
        h = _mix(np.fromiter(map(crc32, part), np.uint64, len(part)) + np.uint64(1))
        n = len(part) - seed + 1
        group = np.zeros(n, np.uint64)
        for i in range(seed):
            group = group * np.uint64(0xD6E8FEB86659FD93) + h[i:i + n]
        group = _mix(group)
        place = _sliding_least(group & ~_LOW | np.arange(n, dtype=np.uint64), window - seed + 1) & _LOW
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        last = np.r_[first[1:], len(place)]
        text = b" ".join(part)
        ends = np.r_[np.flatnonzero(np.frombuffer(text, np.uint8) == 32), len(text)]
        begin = np.r_[0, ends + 1][first]
        end = ends[last + window - 2]
        for key, a, b, w, k in zip(group[place[first].astype(np.int64)].tolist(), begin.tolist(), end.tolist(), first.tolist(), (last - first).tolist(), strict=True):
            yield key, text[a:b], row, at + w, k


def windows_of(text: bytes, count: int, window: int) -> list[bytes]:
    """The windows packed in a super-k-mer, in order."""
    if count == 1:
        return [text]
    words = text.split(b" ")
    begin = [0]
    for w in words:
        begin.append(begin[-1] + len(w) + 1)
    return [text[begin[i]:begin[i + window] - 1] for i in range(count)]


def repeated(entries: list[tuple[bytes, int, bool]], window: int) -> Iterator[tuple[int, int, int]]:
    """(entry, first, last window) for runs of windows that occur more than once among the entries (text, windows, seen twice).

    Sorting brings equal windows together, and neighbours are compared word for word."""
    found: dict[int, list[int]] = {}
    every = []
    for i, (text, count, many) in enumerate(entries):
        every += [(w, i, j, many) for j, w in enumerate(windows_of(text, count, window))]
    every.sort(key=itemgetter(0))
    for x, (w, i, j, many) in enumerate(every):
        if many or x and every[x - 1][0] == w or x + 1 < len(every) and every[x + 1][0] == w:
            found.setdefault(i, []).append(j)
    for i, places in found.items():
        for a, b in merged((j, j + 1) for j in places):
            yield i, a, b


class Packer:
    """Super-k-mers of a map task, compared with each other in scopes of bounded size and packed by bucket.

    Of equal super-k-mers in a scope one travels, marked as seen twice; the others are repeats already and send only their
    place. So however often a passage occurs, its bucket gets at most one such row from each scope."""

    def __init__(self, buckets: int, frequent: np.ndarray, window: int) -> None:
        self.buckets, self.frequent, self.window = buckets, frequent, window
        self.press = zstandard.ZstdCompressor(level=3)
        self.start()

    def start(self) -> None:
        self.seen: dict[bytes, list] = {}
        self.direct: list[tuple[int, int, int]] = []
        self.rows: list[tuple] = []

    def add(self, row: tuple, entries: Iterable[Entry]) -> Iterator[pa.RecordBatch]:
        n = len(self.rows)
        self.rows.append(row)
        frequent, cells, seen = self.frequent, len(self.frequent), self.seen
        for key, text, _, start, count in entries:
            if frequent[key % cells]:
                whole = [(xxhash.xxh64_intdigest(w), w, start + j, 1) for j, w in enumerate(windows_of(text, count, self.window))]
            else:
                whole = ((key, text, start, count),)
            for k, t, s, c in whole:
                old = seen.setdefault(t, (k, n, s, c))
                if old != (k, n, s, c):
                    if len(old) == 4:
                        seen[t] = (*old, True)
                    self.direct.append((n, s, c))
            if len(seen) + len(self.direct) >= _SCOPE:
                yield from self.flush()
                n = 0
                self.rows.append(row)
                seen = self.seen

    def flush(self) -> Iterator[pa.RecordBatch]:
        """One row for each bucket that gets something: its number and the packed super-k-mers."""
        texts = list(self.seen)
        given = list(self.seen.values())
        key = np.array([g[0] for g in given], np.uint64)
        bucket = (key % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1]]) if len(order) else []
        out = []
        for part in np.split(order, cuts[1:]) if len(order) else []:
            own = part.tolist()
            out.append((int(bucket[own[0]]), self._pack([given[i] for i in own], [texts[i] for i in own])))
        if self.direct:
            out.append((self.buckets + self.direct[0][1] % self.buckets, self._pack([(0, n, s, c, True) for n, s, c in self.direct], [])))
        self.start()
        if out:
            yield pa.record_batch({"bucket": pa.array([x[0] for x in out], pa.int64()), "packed": pa.array([x[1] for x in out], pa.binary())})

    def _pack(self, given: list[tuple], texts: list[bytes]) -> bytes:
        rows = [self.rows[g[1]] for g in given]
        head = [np.array([len(given), bool(texts)], np.int64), np.array([r[0] or 0 for r in rows], np.int64), np.array([r[1] for r in rows], np.int64).astype(np.uint32),
                np.array([g[0] & 0xFFFFFFFF for g in given], np.uint32), np.array([g[2] for g in given], np.uint32), np.array([g[3] for g in given], np.uint32),
                np.array([(len(g) > 4) + 2 * (r[0] is None) for g, r in zip(given, rows, strict=True)], np.uint8)]
        return self.press.compress(b"".join([x.tobytes() for x in head]) + b"\n".join(texts))


def unpack(packed: bytes) -> tuple[list[np.ndarray], list[bytes]]:
    """doc id, text key, minimiser, first word, windows, flags (1: seen twice, 2: no id) and the texts, none for mere places."""
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n, has = np.frombuffer(raw, np.int64, 2).tolist()
    at, out = 16, []
    for kind in (np.int64, np.uint32, np.uint32, np.uint32, np.uint32, np.uint8):
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return out, raw[at:].split(b"\n") if has else []


def _bucket_ranges(blobs: list[bytes], window: int) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int]]]]:
    """Repeated word ranges of one bucket: (columns, [(entry, start, end)])."""
    parts = [unpack(b) for b in blobs]
    columns = [np.concatenate(x) for x in zip(*(p[0] for p in parts), strict=True)]
    texts = [t for p in parts for t in p[1]]
    first, count, many = columns[3].tolist(), columns[4].tolist(), (columns[5] & 1).astype(bool).tolist()
    found = []
    if not texts:
        found = [(i, f, f + c + window - 1) for i, (f, c) in enumerate(zip(first, count, strict=True))]
    else:
        order = np.argsort(columns[2], kind="stable")
        key = columns[2][order]
        cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[cuts, len(key)])
        order = order.tolist()
        for a, n in zip(cuts.tolist(), sizes.tolist(), strict=True):
            group = order[a:a + n]
            if n == 1:
                i = group[0]
                if many[i]:
                    found.append((i, first[i], first[i] + count[i] + window - 1))
                continue
            for x, lo, hi in repeated([(texts[i], count[i], many[i]) for i in group], window):
                found.append((group[x], first[group[x]] + lo, first[group[x]] + hi + window - 1))
    yield columns, found


def key_of(text: Column) -> Column:
    """With doc_id it names a row's text; rows with equal doc_id and text share their result."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, cells: int = CELLS) -> DataFrame:
    """(doc_id, key, ranges): word ranges [start, end) covered by windows that also start elsewhere.

    First all super-k-mers are counted by minimiser, in a table of ``cells`` numbers. Then they travel to their bucket; those
    of frequent minimisers go as single windows to the bucket of the whole window."""
    texts = docs.select("doc_id", key_of(F.col("text")).alias("key"), F.col("text").cast("binary").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [k % cells for row, t in enumerate(batch.column(2).to_pylist()) if t for k, *_ in super_kmers(t.split(), row, window, seed)]
            cell, n = np.unique(np.array(keys, np.int64), return_counts=True)
            yield pa.record_batch({"cell": cell, "n": n.astype(np.int64)})

    tally = cut(texts.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")))
    total = tally.agg(F.sum("n")).first()[0] or 0
    often = tally.where(F.col("n") > max(FREQUENT, 4 * total / cells)).select("cell").toPandas()["cell"].to_numpy(np.int64)
    hot = np.zeros(cells, bool)
    hot[often] = True
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(hot))
    buckets = max(1, total // BUCKET)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(buckets, np.unpackbits(sent.value)[:cells], window)
        for batch in batches:
            for doc, key, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if t:
                    yield from packer.add((doc, key), super_kmers(t.split(), 0, window, seed))
        yield from packer.flush()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        now = None
        rows = ((b, p) for batch in batches for b, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for bucket, packed in chain(rows, [(None, b"")]):
            if bucket != now and held:
                for columns, found in _bucket_ranges(held, window):
                    if found:
                        at = np.array([f[0] for f in found])
                        yield pa.record_batch({"doc_id": pa.array(columns[0][at], mask=(columns[5][at] & 2) > 0), "key": columns[1][at].astype(np.int64),
                                               "start": pa.array([f[1] for f in found], pa.int32()), "end": pa.array([f[2] for f in found], pa.int32())})
                held = []
            now = bucket
            held.append(packed)

    found = spread(texts.mapInArrow(pack, "bucket long, packed binary"), "bucket").sortWithinPartitions("bucket").mapInArrow(compare, "doc_id long, key long, start int, end int")
    return found.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))


def deduplicate(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with a struct column ``kept``: n_words, n_removed, text (kept words joined by one space).

    Every word covered by a window of ``window`` consecutive words whose sequence also starts anywhere else, in the same
    document or another row, is removed; windows are judged on the input. Null and empty texts have no words and stay as an
    empty text; repeated rows repeat each other. Other columns stay, but for one named ``kept``."""
    @F.pandas_udf("binary")
    def pressed(texts: pd.Series) -> pd.Series:
        press = zstandard.ZstdCompressor(level=3)
        return pd.Series([press.compress(t) if t else None for t in texts], dtype=object)

    @F.pandas_udf("n_words long, n_removed long, text string")
    def kept(texts: pd.Series, ranges: pd.Series) -> pd.DataFrame:
        rows = []
        unpress = zstandard.ZstdDecompressor()
        for text, given in zip(texts, ranges, strict=True):
            words = unpress.decompress(text).split() if text else []
            n = len(words)
            for a, b in reversed(merged((r["start"], r["end"]) for r in given) if given is not None else []):
                del words[a:b]
            rows.append((n, n - len(words), b" ".join(words).decode("utf-8", "replace")))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "text"])

    found = repeats(docs, window).select(F.col("doc_id").alias("_op_id"), F.col("key").alias("_op_key"), F.col("ranges").alias("_op_ranges"))
    names = [c for c in docs.columns if c != "kept"]
    own = docs.select(*names, key_of(F.col("text")).alias("_op_own"), pressed(F.col("text").cast("binary")).alias("_op_text"))
    joined = own.join(found, own["doc_id"].eqNullSafe(found["_op_id"]) & (own["_op_own"] == found["_op_key"]), "left")
    return joined.select(*[F.col(f"`{c}`") for c in names], kept("_op_text", "_op_ranges").alias("kept"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row per document row."""
    found = deduplicate(docs.select("doc_id", "text"))
    return found.select("doc_id", "kept.n_words", "kept.n_removed", F.sha2(F.col("kept.text").cast("binary"), 256).alias("kept_sha256"))
