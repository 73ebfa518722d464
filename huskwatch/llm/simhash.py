"""SimHash near-duplicates: bit-sliced Hamming comparison inside blocks of equal key bits."""
from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huskwatch.llm.common import cut, nested, restored, spread, text_key
from huskwatch.llm.components import components

RADIUS = 2
SHINGLE = 3
PARTS = 8
_PAIRS = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64 majority bits over the hashes of all word shingles (A-Z lowered); a shorter text is one shingle, one without words gives 0."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    digest, join, n = xxhash.xxh64_digest, b" ".join, len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = words[at:at + (1 << 16) + shingle - 1]
        raw = b"".join([digest(s, 42) for s in map(join, zip(*(part[i:] for i in range(shingle)), strict=False))])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs with a long column ``fp``, the fingerprint as a signed number."""
    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn("fp", fp(F.col("text").cast("binary")))


class Block:
    """Fingerprints (rows of one or more 64-bit words), sorted by key and compared in the ``free`` bits; links are kept as a forest.

    Each run of equal keys is cut into blocks of 64 lanes. A block holds one 64-bit plane per free bit, so that one step
    adds a bit of 64 distances to carry-save counters; a block whose lanes all exceed the radius is given up."""

    def __init__(self, key: np.ndarray, fp: np.ndarray, free: list[int], radius: int) -> None:
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        self.kept = np.flatnonzero(np.repeat(sizes > 1, sizes))
        sizes = sizes[sizes > 1]
        self.words, self.free, self.radius = np.ascontiguousarray(fp.reshape(len(fp), -1)[self.kept].T), free, radius
        self.root = np.arange(len(self.kept))
        if not len(self.kept):
            return
        first = np.r_[0, np.cumsum(sizes)[:-1]]
        place = np.arange(len(self.kept)) - np.repeat(first, sizes)
        self.lane = (place % 64).astype(np.uint64)
        blocks = -(-sizes // 64)
        offset = np.r_[0, np.cumsum(blocks)[:-1]]
        self.block = np.repeat(offset, sizes) + place // 64
        self.end = np.repeat(offset + blocks, sizes)
        self.start = np.flatnonzero(np.r_[True, self.block[1:] != self.block[:-1]])
        bit = np.uint64(1) << self.lane
        self.valid = np.bitwise_or.reduceat(bit, self.start)
        self.planes = [np.bitwise_or.reduceat(np.where(self._bit(b), bit, np.uint64(0)), self.start) for b in free]
        self._run()

    def _run(self) -> None:
        for _ in self._steps():
            pass

    def _steps(self) -> Iterator[None]:
        """Compare _PAIRS rows with a block each at a time."""
        if not len(self.kept):
            return
        total = np.r_[0, np.cumsum(self.end - self.block)]
        for at in range(0, int(total[-1]), _PAIRS):
            pair = np.arange(at, min(at + _PAIRS, int(total[-1])))
            row = np.searchsorted(total, pair, "right") - 1
            self._compare(row, self.block[row] + pair - total[row])
            yield

    def _bit(self, b: int, row: np.ndarray | slice = slice(None)) -> np.ndarray:
        return self.words[b // 64][row] >> np.uint64(b % 64) & np.uint64(1)

    def _compare(self, row: np.ndarray, block: np.ndarray) -> None:
        """Distances of each row to the lanes of a block at or after its own."""
        n = len(row)
        own = self.lane[row] + np.uint64(1)
        after = np.where(own < 64, ~np.uint64(0) << (own % np.uint64(64)), np.uint64(0))
        wanted = self.valid[block] & np.where(block == self.block[row], after, ~np.uint64(0))
        counters = [np.zeros(n, np.uint64) for _ in range((self.radius + 1).bit_length())]
        over = np.zeros(n, np.uint64)
        for step, b in enumerate(self.free):
            add = self.planes[step][block] ^ (np.uint64(0) - self._bit(b, row))
            for i, c in enumerate(counters):
                counters[i], add = c ^ add, c & add
            over |= add
            if step % 4 == 3 and step >= self.radius:
                alive = (wanted & ~(over | self._beyond(counters))) != 0
                if alive.mean() < 0.7:
                    row, block, wanted, over = row[alive], block[alive], wanted[alive], over[alive]
                    counters = [c[alive] for c in counters]
                if not len(row):
                    return
        near = wanted & ~(over | self._beyond(counters))
        some = np.flatnonzero(near)
        which, lane = np.nonzero(np.unpackbits(near[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        self._link(row[some][which], self.start[block[some][which]] + lane)

    def _beyond(self, counters: list[np.ndarray]) -> np.ndarray:
        """Lanes whose counter is larger than the radius."""
        more, same = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
        for i in reversed(range(len(counters))):
            if self.radius >> i & 1:
                same = same & counters[i]
            else:
                more, same = more | same & counters[i], same & ~counters[i]
        return more

    def _link(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            apart = low != high
            a, b = a[apart], b[apart]
            np.minimum.at(root, high[apart], low[apart])
            while (jump := root[root]).tobytes() != root.tobytes():
                root[:] = jump

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Places in the input of each linked row and of the first row of its group."""
        moved = np.flatnonzero(self.root != np.arange(len(self.root)))
        return self.kept[moved], self.kept[self.root[moved]]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        moved = np.flatnonzero(self.root != np.arange(len(self.root)))
        return self.words[0][moved], self.words[0][self.root[moved]]


class Pairs(Block):
    """Like Block, but hands out every near pair of rows whose labels differ, step by step."""

    def __init__(self, key: np.ndarray, fp: np.ndarray, free: list[int], radius: int, label: np.ndarray) -> None:
        self.all_labels, self.found = label, []
        super().__init__(key, fp, free, radius)

    def _run(self) -> None:
        self.label = self.all_labels[self.kept]

    def _link(self, a: np.ndarray, b: np.ndarray) -> None:
        apart = self.label[a] != self.label[b]
        self.found.append((self.kept[a[apart]], self.kept[b[apart]]))

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for _ in self._steps():
            yield from self.found
            self.found = []


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect exactly the distinct fingerprints ``fp`` within the radius.

    Of the eight bytes of two such fingerprints at least ``8 - radius`` are equal. Each fingerprint goes to one bucket for
    every choice of that many bytes, so a bucket holds at most 2^(8 * radius) fingerprints, whatever the input. Within a
    bucket each comparison is exact; what leaves it is a forest with at most one edge for each of its rows."""
    chosen = [sum(0xFF << 8 * p for p in c) for c in combinations(range(PARTS), PARTS - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in chosen]
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)]))
    rows = spread(prints.select("fp", keys.alias("k")).select("k.choice", "k.key", "fp"), "choice", "key").sortWithinPartitions("choice", "key")

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
        for batch in chain(batches, [None]):
            if batch is not None:
                new = [np.asarray(batch.column(i)).astype(np.int64) for i in range(3)]
                held = [np.concatenate(x) for x in zip(held, new, strict=True)]
                changed = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1]))
                end = int(changed[-1]) + 1 if len(changed) else 0
            else:
                end = len(held[0])
            ready, held = [x[:end] for x in held], [x[end:] for x in held]
            for choice in np.unique(ready[0]):
                own = ready[0] == choice
                free = [b for b in range(64) if not chosen[choice] >> b & 1]
                a, b = Block(ready[1][own], ready[2][own].view(np.uint64), free, radius).edges()
                if len(a):
                    yield pa.record_batch({"a": a.view(np.int64), "b": b.view(np.int64)})

    return rows.mapInArrow(connect, "a long, b long")


def clusters(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, key (hash of the text), fp, cluster (smallest signed fingerprint of the component), component_id: a row per document row.

    component_id is the smallest doc_id in the component, nulls aside; it is null where the component has no other id.
    Null and empty texts have fingerprint 0 and are linked like any other. Rows with a repeated doc_id all stay."""
    rows = cut(fingerprints(docs.select("doc_id", "text")).select("doc_id", text_key(F.col("text")).alias("key"), "fp"))
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(prints.select("fp"), radius)).withColumnRenamed("node", "fp")
    placed = prints.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("cluster"))
    least = placed.groupBy("cluster").agg(F.min("least").alias("component_id"))
    return rows.join(placed.select("fp", "cluster").join(least, "cluster"), "fp")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per document row."""
    return clusters(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each component: the one with the smallest doc_id, rows without an id coming last.

    Among rows of the same id the smallest hash of the text decides; rows equal in both count as one. All columns are kept."""
    return keep_first(docs, clusters(docs, radius))


def keep_first(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """The documents that come first in their cluster, given by doc_id, key and cluster for each row."""
    # Keys without nulls, so that the join and what follows it share one shuffle of the texts.
    keys = {"_none": F.col("doc_id").isNull(), "_id": F.coalesce("doc_id", F.lit(0))}
    first = placed.withColumns(keys).groupBy("cluster").agg(F.min(F.struct("_none", "_id", "key")).alias("f"))
    first = first.select("f._none", "f._id", F.col("f.key").alias("_own")).distinct()
    own = nested(docs).withColumns({**keys, "_own": text_key(F.col("text"))}).drop("doc_id", "text")
    kept = own.join(first, ["_none", "_id", "_own"], "left_semi")
    return restored(kept.dropDuplicates(["_none", "_id", "_own"]), docs.columns)
