"""Best-fit packing: a configuration linear program over the histogram of piece lengths.

A configuration is a multiset of lengths that fits one sequence. The program asks for the fewest sequences whose
configurations cover the histogram; multiplicative weights solve it, a knapsack program prices configurations, and whole
copies plus exact subset sums over what is left round it. Its size depends on the sequence length alone, never on the rows:
the driver sees one count for each length."""
from __future__ import annotations

import json
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from huskwatch.llm.bpe import NEWER, Codec, Recent, byte_symbols, read_spec
from huskwatch.llm.common import give_back, shared_folder

#: Tokens of a sequence, and the id behind each document.
CAPACITY, END = 2048, 0
#: Bytes of words and their ids that one generation of a worker's memo holds.
WORDS = 48 << 20
#: Rounds of the weights, and the share of a length's count that one step covers at most.
ROUNDS, SHARE = 100, 1 / 8
#: Exponents by which the weight of a wholly covered length has fallen; tried in turn.
RATES = (1.0, 4.0)


@dataclass
class Plan:
    """Configurations as (length -> how often) with their copies, and a lower bound of the number of sequences."""

    capacity: int
    made: list[tuple[dict[int, int], int]]
    bound: int

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.made)

    def runs(self) -> dict[str, np.ndarray]:
        """For each length, sorted, the ranks at which a configuration's places begin: length, rank, times, sequence, offset."""
        rows, sequence = [], 0
        for config, copies in self.made:
            at = 0
            for length in sorted(config, reverse=True):
                rows.append((length, config[length], copies, sequence, at))
                at += length * config[length]
            sequence += copies
        rows.sort(key=lambda r: (r[0], r[3]))
        length, times, copies, first, offset = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 5
        before = np.concatenate([[0], np.cumsum(times * copies)])[:-1] if rows else np.zeros(0, np.int64)
        starts = np.searchsorted(length, length)  # the first run of each run's length
        return {"length": length, "rank": before - before[starts] if rows else before, "times": times, "sequence": first, "offset": offset}


def priced(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value of each capacity with any number of each length (price -inf: not to be had), and the length taken last, 0 for none."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        values = price[1:c + 1] + best[c - 1::-1]
        i = int(values.argmax())
        if values[i] > best[c - 1]:
            best[c], last[c] = values[i], i + 1
        else:
            best[c] = best[c - 1]
    return best, last


def _traced(last: np.ndarray, room: int, first: int) -> dict[int, int]:
    """The configuration of ``first`` and the best filling of the room it leaves."""
    out, room = {first: 1}, room - first
    while room > 0:
        if (length := int(last[room])) == 0:
            room -= 1
            continue
        out[length] = out.get(length, 0) + 1
        room -= length
    return out


def fractional(counts: np.ndarray, capacity: int, rate: float) -> tuple[list[tuple[dict[int, int], float]], float]:
    """Configurations with fractional copies that cover lengths up to their counts, and the dual bound of the program.

    A length's weight starts at its share of all tokens and falls as it is covered. Each round prices all configurations at
    once; the lengths that lag, least covered first, get copies of the best configuration that holds them, SHARE of the count
    of its scarcest length at most, unless a member is too far ahead of the others: then it waits for the next prices."""
    have = np.flatnonzero(counts)
    covered, found, bound = np.zeros(capacity + 1), {}, 0.0
    for _ in range(ROUNDS):
        level = covered[have].min()
        price = np.full(capacity + 1, -np.inf)
        price[have] = have * np.exp(-rate * (covered[have] - level))
        best, last = priced(price, capacity)
        bound = max(bound, float((counts[have] * price[have]).sum() / best[capacity]))
        if level >= 1 - 1e-9:
            break
        limit = level + 2 * SHARE
        for length in have[np.lexsort((-have, covered[have]))].tolist():
            if covered[length] > limit:
                break
            config = _traced(last, capacity, length)
            copies = min(min(SHARE, 1 - covered[k]) * counts[k] / n for k, n in config.items())
            if copies <= 0 or any(covered[k] > limit for k in config):
                continue
            key = tuple(sorted(config.items()))
            found[key] = found.get(key, 0.0) + copies
            for k, n in config.items():
                covered[k] += n * copies / counts[k]
    return sorted(((dict(k), x) for k, x in found.items()), key=lambda p: (-p[1], sorted(p[0].items()))), bound


def _fullest(left: np.ndarray, capacity: int) -> dict[int, int]:
    """A configuration of the longest length left and those that fill its room best, longer ones first; never more than are left."""
    longest = int(np.flatnonzero(left)[-1])
    room = capacity - longest
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in np.flatnonzero(left)[::-1].tolist():
        spare = min(int(left[length]) - (length == longest), room // length)
        many = 1
        while spare > 0 and not reach >> room & 1:
            many = min(many, spare)
            spare -= many
            steps.append((length, many, reach))
            reach |= reach << length * many & mask
            many *= 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {longest: 1}
    for length, many, before in reversed(steps):
        if not before >> at & 1:
            at -= length * many
            out[length] = out.get(length, 0) + many
    return out


def rounded(counts: np.ndarray, parts: list[tuple[dict[int, int], float]], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Whole copies that hold each length exactly as often as it occurs: those of the fractional solution, then, for what is
    left, the longest length with its fullest filling."""
    left, made = counts.copy(), []

    def use(config: dict[int, int], copies: int) -> None:
        if copies > 0:
            made.append((config, copies))
            for k, n in config.items():
                left[k] -= n * copies

    for config, x in parts:
        use(config, min(int(x), *(int(left[k]) // n for k, n in config.items())))
    while left.any():
        config = _fullest(left, capacity)
        use(config, min(int(left[k]) // n for k, n in config.items()))
    return made


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The best of a few rates of the weights; the first that meets the lower bound ends the search."""
    if any(not 1 <= k <= capacity for k in histogram):
        raise ValueError("lengths must lie between 1 and the capacity")
    counts = np.zeros(capacity + 1, np.int64)
    for k, n in histogram.items():
        counts[k] = n
    plan = Plan(capacity, [], 0)
    if not counts.any():
        return plan
    plan.bound = -(-int((counts * np.arange(capacity + 1)).sum()) // capacity)
    for rate in RATES:
        parts, dual = fractional(counts, capacity, rate)
        plan.bound = max(plan.bound, int(np.ceil(dual - 1e-6)))
        made = rounded(counts, parts, capacity)
        if not plan.made or sum(n for _, n in made) < plan.sequences:
            plan.made = made
        if plan.sequences <= plan.bound:
            break
    return plan


@cache
def _unknown() -> np.ndarray:
    """Marks the code points whose class or lower case Python may not know: those unassigned in its tables, and NEWER."""
    return np.array([unicodedata.category(chr(c)) == "Cn" or c in NEWER for c in range(0x110000)])


class Coder(Codec):
    """The encoder of bpe with the tokenizers library in two places: it merges words, and it takes whole texts that hold a
    character which Python may not know."""

    def __init__(self, spec: str) -> None:
        super().__init__(json.loads(spec))
        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.model, self.alphabet = self.library.model, byte_symbols()
        self._chunks, self._pieces = Recent(WORDS), Recent(WORDS)

    def _piece(self, piece: str) -> bytes:
        if (got := self._pieces.new.get(piece) or self._pieces.find(piece)) is not None:
            return got
        word = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.alphabet)
        out = array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
        if len(piece) <= 64:
            self._pieces.put(piece, out)
        return out

    def encode(self, text: str) -> bytes:
        if not text.isascii() and _unknown()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].any():
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return super().encode(text)


@cache
def coder(spec: str) -> Coder:
    return Coder(spec)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, task, nth: the pieces of every document, in one pass without a shuffle.

    A document's ids end with END; null texts are empty and give one piece of that id. Longer documents are cut into pieces of
    ``capacity``. nth counts the pieces of equal length before this one in its task. Repeated rows are documents of their own."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(docs.sparkSession, vocabulary))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("piece", T.IntegerType()),
                           *[T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")], T.StructField("task", T.IntegerType()), T.StructField("nth", T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(spec.value)
        task, seen, end = TaskContext.get().partitionId(), [0] * (capacity + 1), END.to_bytes(4, "little")
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                rows, out = [], []
                for row, text in enumerate(part.column(1)):
                    text = text.as_py() or ""
                    raw = own.encode(text) + end
                    for at in range(0, len(raw), 4 * capacity):
                        ids = raw[at:at + 4 * capacity]
                        n = len(ids) // 4
                        rows.append(row)
                        out.append((at // (4 * capacity), at // 4, n, zlib.crc32(ids), task, seen[n]))
                        seen[n] += 1
                if out:
                    cols = [part.column(0).take(pa.array(rows, pa.int64()))] + [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()), strict=True)]
                    yield pa.RecordBatch.from_arrays(cols, names=schema.names)
        give_back()

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def placed(found: DataFrame, plan: Plan) -> DataFrame:
    """pieces with sequence_id and offset: the k-th piece of a length takes the k-th place of that length in the plan.

    Ranks are sums over tasks plus the count inside a task, so no length, however common, is ordered in one task. The places are
    broadcast as runs of equal configurations; their number depends on the capacity alone."""
    counts = found.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = found.join(base, ["task", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    runs = found.sparkSession.sparkContext.broadcast(plan.runs())
    rows = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    schema = T.StructType([f for f in rows.schema.fields if f.name != "rank"] + [T.StructField(n, T.LongType()) for n in ("sequence_id", "offset")])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = runs.value
        starts, key = np.searchsorted(r["length"], np.arange(plan.capacity + 2)), int(r["rank"].max(initial=0)) + 1
        whole = r["length"] * key + r["rank"]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            at = np.searchsorted(whole, length * key + np.minimum(rank, key - 1), side="right") - 1
            at = np.maximum(at, starts[length])
            k = rank - r["rank"][at]
            where = r["offset"][at] + k % r["times"][at] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(r["sequence"][at] + k // r["times"][at]), pa.array(where)], names=schema.names)

    return rows.mapInArrow(place, schema)


def packed(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its sequence and offset; sequences hold at most ``capacity`` tokens, without gaps.

    The pieces (numbers only) are written to the shared folder once: counting and placing read the same rows, and a lost
    executor encodes nothing again. Empty tables give no rows; columns but doc_id and text are not looked at."""
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    pieces(docs, vocabulary, capacity).write.parquet(f"{folder}/pieces")
    found = spark.read.parquet(f"{folder}/pieces")
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    return placed(found, solve(histogram, capacity))
