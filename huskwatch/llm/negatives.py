"""Hard-negative mining over Hilbert-curve-ordered blocks with zone maps.

Rows are ordered by label and Hilbert key, cut into stripes (one task each) and blocks, and written as Parquet; a block keeps
the least and greatest value of each dimension. Interval arithmetic on those bounds every score of an anchor with a block's
rows from both sides, so an anchor reads only blocks that can hold scores in its windows. Anchors, the stated query set,
travel in groups to the stripes; a task holds one stripe and streams the groups past it. Two passes: positives, then negatives
in the window that each positive's score opens. Results travel packed, at most LIST entries for each slot of a group."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huskwatch.llm.common import shared_folder

#: Rows of a block, anchors of a group, positives of an anchor and negatives of a positive.
BLOCK, GROUP, LIST = 256, 256, 5
#: Bits of a coordinate on the curve, which covers components from -1 to 1; those beyond count as the border for the order only.
BITS = 4
ANCHORS = 100
LEAST, MOST = -(1 << 63), (1 << 63) - 1

_KEYED = "vec_id long, label int, key binary, vec binary, wide boolean"
#: kind 0: a block of rows, 1: a group of anchors, 2: results of a group, 3: a stripe's zone; binary columns are little-endian arrays (labels, ids: 4 and 8 bytes; vectors, lo, hi: doubles).
_STORED = "kind int, stripe int, no long, first long, label_lo int, label_hi int, n int, labels binary, ids binary, rows binary, vecs binary, lo binary, hi binary, of binary, low binary, high binary"
_STORED_NAMES = [f.split()[0] for f in _STORED.split(", ")]


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert keys of rows of cell numbers (Skilling's transform, all rows at once), as rows of bytes in the curve's order."""
    x = cells.astype(np.int64).T.copy()
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        for i in range(len(x)):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(up, q - 1, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn, q = np.zeros(x.shape[1], np.int64), top
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    planes = np.stack([(x >> b) & 1 for b in range(bits - 1, -1, -1)])  # bit, dimension, row
    return np.packbits(planes.reshape(-1, x.shape[1]).T.astype(np.uint8), axis=1)


def prepared(rows: DataFrame) -> DataFrame:
    """vec_id, label, embedding of the rows that take part: no null id, label, vector or component, finite components only.

    Labels are as used: where vec_id is divisible by 7, the next one modulo 10."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.where("vec_id is not null and label is not null and embedding is not null").where(~odd).select("vec_id", label.cast("int").alias("label"), "embedding")


def _padded(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows of different length as a matrix; missing components count as zero."""
    out = np.zeros((len(sizes), max(1, int(sizes.max(initial=0)))))
    if len(values):
        out[np.arange(out.shape[1]) < sizes[:, None]] = values
    return out


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(2)
        sizes = np.diff(lists.offsets.to_numpy())
        with np.errstate(over="ignore"):
            whole = np.floor(256.0 * _padded(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), sizes))
        whole = np.clip(np.nan_to_num(whole), -np.finfo(float).max, np.finfo(float).max)
        side = 1 << BITS
        keys = hilbert(np.clip(np.floor((whole + 256) * side / 512), 0, side - 1), BITS)
        wide = np.abs(whole).max(axis=1, initial=0) >= 1 << 31
        vecs = [(v if w else v.astype("<i4")).tobytes() for v, w in zip(whole, wide, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([k.tobytes() for k in keys], pa.binary()), pa.array(vecs, pa.binary()), pa.array(wide)], names=["vec_id", "label", "key", "vec", "wide"])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of two sets of whole-numbered rows; beyond 64 bits, the nearest 64-bit integer."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * d < 2**53:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[sum(int(x) * int(y) for x, y in zip(r, c, strict=True)) for c in b] for r in a], dtype=object).reshape(len(a), len(b))
    return np.clip(exact, LEAST, MOST).astype(np.int64)


def bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each row of ``a`` with any vector between a row of ``lo`` and the same row of ``hi``."""
    d = max(a.shape[1], lo.shape[1])
    a, lo, hi = (np.pad(m, ((0, 0), (0, d - m.shape[1]))) for m in (a, lo, hi))
    plus, minus = np.maximum(a, 0), np.minimum(a, 0)
    with np.errstate(over="ignore", invalid="ignore"):
        least, most = plus @ lo.T + minus @ hi.T, plus @ hi.T + minus @ lo.T
        slack = np.abs(a) @ np.maximum(np.abs(lo), np.abs(hi)).T * 1e-12  # rounding of the sums
    return np.nan_to_num(least - slack, nan=-np.inf), np.nan_to_num(most + slack, nan=np.inf)


def _firsts(slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Positions of the LIST best entries of each slot: higher scores, then smaller ids."""
    order = np.lexsort((ids, ~score, slot))
    of = slot[order]
    return order[np.arange(len(of)) - np.searchsorted(of, of) < LIST]


def _stored(**columns) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([columns.get(n)], types[t]) for n, t in (f.split() for f in _STORED.split(", "))], names=_STORED_NAMES)


def _zones(vecs: np.ndarray) -> dict[str, bytes]:
    return {"lo": vecs.min(axis=0).tobytes(), "hi": vecs.max(axis=0).tobytes()}


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a sorted stripe, its anchors in groups, whose lower bound is the LIST-th best score inside their own block, and
    the zone of the whole stripe."""
    stripe, count, made, groups = TaskContext.get().partitionId(), 0, 0, 0
    ids, labels, vecs, waiting, zone = [], [], [], [], {}

    def block() -> pa.RecordBatch:
        nonlocal count, made
        matrix = _padded(np.concatenate(vecs), np.array([len(v) for v in vecs]))
        own, kinds = np.array(ids, np.int64), np.array(labels, np.int32)
        first = (stripe << 40) + count
        at = np.flatnonzero(own % ANCHORS == 0)
        if len(at):
            near = np.where(kinds[at, None] == kinds[None], products(matrix[at], matrix), LEAST)
            near[np.arange(len(at)), at] = LEAST
            low = np.sort(near, axis=1)[:, -LIST] if len(own) >= LIST else np.full(len(at), LEAST)
            waiting.extend(zip(own[at], kinds[at], first + at, matrix[at], low, strict=True))
        out = _stored(kind=0, stripe=stripe, no=(stripe << 32) + made, first=first, label_lo=int(kinds.min()), label_hi=int(kinds.max()), n=len(own), labels=kinds.tobytes(),
                      ids=own.tobytes(), vecs=matrix.tobytes(), **_zones(matrix))
        count, made = count + len(own), made + 1
        for name, value in (("lo", matrix.min(axis=0)), ("hi", matrix.max(axis=0)), ("label", int(kinds.min())), ("label", int(kinds.max()))):
            zone.setdefault(name, []).append(value)
        for a in (ids, labels, vecs):
            a.clear()
        return out

    def group() -> pa.RecordBatch:
        nonlocal groups
        part = waiting[:GROUP]
        del waiting[:GROUP]
        own, kinds, rows, found, low = zip(*part, strict=True)
        matrix = _padded(np.concatenate(found), np.array([len(v) for v in found]))
        groups += 1
        return _stored(kind=1, stripe=stripe, no=(stripe << 32) + groups - 1, n=len(part), labels=np.array(kinds, np.int32).tobytes(), ids=np.array(own, np.int64).tobytes(), rows=np.array(rows, np.int64).tobytes(),
                       vecs=matrix.tobytes(), of=np.arange(len(part), dtype=np.int32).tobytes(), low=np.array(low, np.int64).tobytes(), high=np.full(len(part), MOST).tobytes())

    for batch in batches:
        for vec_id, label, vec, wide in zip(*(batch.column(i) for i in (0, 1, 3, 4)), strict=True):
            ids.append(vec_id.as_py())
            labels.append(label.as_py())
            vecs.append(np.frombuffer(vec.as_py(), "<f8" if wide.as_py() else "<i4").astype(np.float64))
            if len(ids) == BLOCK:
                yield block()
                while len(waiting) >= GROUP:
                    yield group()
    if ids:
        yield block()
    while waiting:
        yield group()
    if zone:
        lo, hi = (_padded(np.concatenate(z), np.array([len(v) for v in z])) for z in (zone["lo"], zone["hi"]))
        yield _stored(kind=3, stripe=stripe, label_lo=min(zone["label"]), label_hi=max(zone["label"]), lo=lo.min(axis=0).tobytes(), hi=hi.max(axis=0).tobytes())


def _array(row: dict, name: str) -> np.ndarray:
    kind = {"labels": np.int32, "of": np.int32, "ids": np.int64, "rows": np.int64, "low": np.int64, "high": np.int64}.get(name, np.float64)
    found = np.frombuffer(row[name] or b"", kind)
    return found.reshape(row["n"], -1) if name == "vecs" else found


def _wanted(group: dict, zones: list[dict], same: bool) -> np.ndarray:
    """Which zones each slot of a group must read, by label range and score bounds: slots by zones."""
    of, labels = _array(group, "of"), _array(group, "labels")[_array(group, "of")]
    least, most = bounds(_array(group, "vecs"), *(_padded(np.concatenate([_array(z, k) for z in zones]), np.array([len(_array(z, k)) for z in zones])) for k in ("lo", "hi")))
    lo, hi = (np.array([z[k] for z in zones]) for k in ("label_lo", "label_hi"))
    fits = (lo <= labels[:, None]) & (labels[:, None] <= hi) if same else (lo != hi) | (lo != labels[:, None])
    return fits & (most[of] >= _array(group, "low")[:, None]) & (least[of] <= _array(group, "high")[:, None])


def _searched(group: dict, blocks: list[dict], same: bool) -> pa.RecordBatch | None:
    """The LIST best rows of one stripe for each slot of a group, inside the slot's window of scores."""
    wanted = _wanted(group, blocks, same)
    of, low, high, rows = (_array(group, k) for k in ("of", "low", "high", "rows"))
    labels, vecs, floor = _array(group, "labels"), _array(group, "vecs"), low.copy()
    kept = [np.zeros(0, np.int64)] * 3
    most = bounds(vecs, *(_padded(np.concatenate([_array(b, k) for b in blocks]), np.array([len(_array(b, k)) for b in blocks])) for k in ("lo", "hi")))[1][of]
    for i in np.argsort(-np.where(wanted, most, -np.inf).max(axis=0, initial=-np.inf), kind="stable"):
        slots = np.flatnonzero(wanted[:, i] & (most[:, i] >= floor))
        if not len(slots):
            continue
        block, used, at = blocks[i], *np.unique(of[slots], return_inverse=True)
        score = products(vecs[used], _array(block, "vecs"))
        alike = labels[used, None] == _array(block, "labels")[None]
        allowed = alike if same else ~alike
        place = rows[used] - block["first"]
        inside = np.flatnonzero((place >= 0) & (place < block["n"]))
        allowed[inside, place[inside]] = False
        hit, column = np.nonzero(allowed[at] & (score[at] >= floor[slots, None]) & (score[at] <= high[slots, None]))
        if len(hit):
            kept = [np.concatenate(p) for p in zip(kept, (slots[hit], score[at[hit], column], _array(block, "ids")[column]), strict=True)]
            best = _firsts(*kept)
            kept = [k[best] for k in kept]
            full, counts = np.unique(kept[0], return_counts=True)
            full = full[counts == LIST]
            worst = np.searchsorted(kept[0], full, side="right") - 1  # sorted by slot, then by falling score
            floor[full] = np.maximum(floor[full], kept[1][worst])
    if not len(kept[0]):
        return None
    return _stored(kind=2, no=group["no"], n=len(kept[0]), of=kept[0].astype(np.int32).tobytes(), low=kept[1].tobytes(), ids=kept[2].tobytes())


def _found(groups: DataFrame, blocks: DataFrame, zones: list[dict], same: bool) -> DataFrame:
    """Packed results of the groups in every stripe that their bounds let them meet; each stripe's blocks are read once."""
    spark, stripes = groups.sparkSession, [z["stripe"] for z in zones]
    known = spark.sparkContext.broadcast(zones)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in batch.to_pylist():
                for i in np.flatnonzero(_wanted(group, known.value, same).any(axis=0)):
                    yield _stored(**group | {"stripe": stripes[i]})

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripe, blocks = None, []
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                if row["stripe"] != stripe:
                    stripe, blocks = row["stripe"], []
                if row["kind"] == 0:
                    blocks.append(row)
                elif (out := _searched(row, blocks, same)) is not None:
                    yield out

    travelling = groups.mapInArrow(sent, _STORED).unionByName(blocks)
    return travelling.repartition(len(stripes), "stripe").sortWithinPartitions("stripe", "kind", "no").mapInArrow(searched, _STORED)


def _merged(groups: DataFrame, found: DataFrame, kind: str, finish) -> DataFrame:
    """``finish(group, slots, scores, ids)`` over each group with the LIST best of all its results."""
    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, kept = None, [np.zeros(0, np.int64)] * 3
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                if row["kind"] == 1:
                    if group is not None and (out := finish(group, *kept)) is not None:
                        yield out
                    group, kept = row, [np.zeros(0, np.int64)] * 3
                else:
                    kept = [np.concatenate(p) for p in zip(kept, (_array(row, "of").astype(np.int64), _array(row, "low"), _array(row, "ids")), strict=True)]
                    best = _firsts(*kept)
                    kept = [k[best] for k in kept]
        if group is not None and (out := finish(group, *kept)) is not None:
            yield out

    rows = groups.unionByName(found)
    return rows.repartition("no").sortWithinPartitions("no", "kind").mapInArrow(merged, kind)


def _windows(group: dict, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> pa.RecordBatch | None:
    """The group with one slot for each positive: its id in ``rows``' place of ``first``, and the window of its score."""
    if not len(slot):
        return None
    low = np.array([-(-80 * s // 100) for s in score.tolist()], np.int64)
    return _stored(**group | {"of": slot.astype(np.int32).tobytes(), "low": low.tobytes(), "high": score.tobytes(), "lo": ids.tobytes()})


_MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _listed(group: dict, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> pa.RecordBatch | None:
    if not len(slot):
        return None
    positive = np.frombuffer(group["lo"], np.int64)
    rank = np.arange(len(slot)) - np.searchsorted(slot, slot) + 1
    columns = [_array(group, "ids")[_array(group, "of")[slot]], positive[slot], rank.astype(np.int32), ids, _array(group, "high")[slot], score]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f.split()[0] for f in _MINED.split(", ")])


def mined(rows: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of every anchor (vec_id divisible by ANCHORS).

    Positives are the anchor's LIST best other rows of its label; negatives the LIST best rows of other labels that score
    between 80 and 100 per cent of the positive. Every row counts for itself, repeated ids and vectors included; ties go to the
    smaller id. Vectors of different length meet as if the shorter ended in zeros. Rows that prepared() leaves out take no part;
    empty tables give no rows; other columns are not looked at.

    The number of stripes grows with the square root of the rows, so what is broadcast (one zone each) and what a task holds
    (one stripe) both stay small: a billion rows give 1,977 zones and half a million rows a stripe."""
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession)
    clean = prepared(rows)
    stripes = max(1, math.ceil(math.sqrt(clean.count()) / 16))
    ordered = clean.mapInArrow(_keyed, _KEYED).repartitionByRange(stripes, "label", "key", "vec_id", "vec").sortWithinPartitions("label", "key", "vec_id", "vec")
    ordered.mapInArrow(_packed, _STORED).write.partitionBy("kind").parquet(f"{folder}/blocks")
    stored = spark.read.schema(_STORED).parquet(f"{folder}/blocks").select(_STORED_NAMES)
    blocks, groups = stored.where("kind = 0"), stored.where("kind = 1")
    zones = [r.asDict() for r in stored.where("kind = 3").select("stripe", "label_lo", "label_hi", "lo", "hi").orderBy("stripe").collect()]  # one row a stripe
    if not zones:
        return spark.createDataFrame([], _MINED)
    slots = _merged(groups, _found(groups, blocks, zones, True), _STORED, _windows)
    slots.write.parquet(f"{folder}/windows")
    slots = spark.read.schema(_STORED).parquet(f"{folder}/windows")
    return _merged(slots, _found(slots, blocks, zones, False), _MINED, _listed)
