"""Chat formatting with prefix-target expansion: each assistant turn is an example of its own."""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huskwatch.llm.common import spread

#: Marks of the template: ``<s>[INST] role [/INST] text</s>`` for each turn.
OPEN, HEAD, BODY, CLOSE = "<s>", "[INST] ", " [/INST] ", "</s>"
#: A backslash, or the first character of a control string, gets a backslash behind it.
_ESCAPED = r"\\|<(?=/?s>|</?SYS>>)|\[(?=/?INST\])"
_TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\] (.*?)</s>", re.DOTALL)
#: Turns of a conversation whose lengths are summed in one task before the sums meet.
STRETCH = 1000


def escape(text: Column) -> Column:
    """No control string is left in the result, and unescape() gives the text back; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _ESCAPED, r"$0\\")


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def segments(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, place, segment, start, end, target_start, target_end: the formatted text of each turn.

    Turns stand in the order of turn, role and text, nulls first. start and end are code points in the conversation's
    formatted text; the target is the part of an assistant's segment that is trained on, its text without marks, and null in
    other turns. Lengths are first summed over stretches of turns, so that a very long conversation is no single task."""
    role, text = escape(F.col("role")), escape(F.col("text"))
    # Keys without nulls, so that the windows and the join share one shuffle of the texts.
    keys = ["_no_conv", "_conv", "_stretch"]
    stretch = F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(-(1 << 62)))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.length(text).alias("n"),
                        F.concat(F.lit(OPEN + HEAD), role, F.lit(BODY), text, F.lit(CLOSE)).alias("segment"),
                        F.col("conv_id").isNull().alias("_no_conv"), F.coalesce("conv_id", F.lit(0)).alias("_conv"), stretch.alias("_stretch"))
    rows = rows.withColumn("length", F.length("segment").cast("long"))
    sums = rows.groupBy(*keys).agg(F.sum("length").alias("total"), F.count("*").alias("turns"))
    before = Window.partitionBy(*keys[:2]).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("turns").over(before), F.lit(0)).alias("skip"))
    inside = Window.partitionBy(*keys).orderBy("turn", "role", "segment")
    rows = rows.withColumn("upto", F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("at", F.row_number().over(inside))
    rows = rows.join(sums, keys)
    end = F.col("base") + F.col("upto")
    last = end - len(CLOSE)
    target = F.col("role") == "assistant"
    return rows.select("conv_id", "turn", "role", (F.col("skip") + F.col("at")).alias("place"), "segment", (end - F.col("length")).alias("start"), end.alias("end"),
                       F.when(target, last - F.col("n")).alias("target_start"), F.when(target, last).alias("target_end"))


def examples(formatted: DataFrame) -> DataFrame:
    """conv_id, example (place of its last turn), length, target_start, target_end: one row per assistant turn.

    An example's text is the first ``length`` code points of its conversation's formatted text: all turns before, then the
    reply, which alone is trained on. Examples of one conversation share their context, so what is stored grows with the
    turns and not with their square; expand() writes the texts out. Turns after the last reply are in no example."""
    return formatted.where("target_end is not null").select("conv_id", F.col("place").alias("example"), F.col("end").alias("length"), "target_start", "target_end")


def expand(formatted: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, example, text, target_start, target_end with every context written out; its size grows with the square of a conversation's turns."""
    parts = found.alias("e").join(formatted.alias("f"), F.col("e.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("f.place") <= F.col("e.example")))
    rows = parts.groupBy("e.conv_id", "e.example", "e.target_start", "e.target_end").agg(F.sort_array(F.collect_list(F.struct("f.place", "f.segment"))).alias("p"))
    return rows.select("conv_id", "example", F.concat_ws("", F.col("p.segment")).alias("text"), "target_start", "target_end")


def read_back(formatted: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, parsed from the formatted texts and the examples ``found``.

    A conversation's segments and examples pass in order through hashes of constant size, without being gathered: each example
    comes right after its last segment. Its length must be that of the text so far, and its target lie in that segment."""
    segment = formatted.select("conv_id", "place", F.lit(0).alias("kind"), "segment", *[F.lit(None).cast("long").alias(c) for c in ("length", "target_start", "target_end")])
    example = found.select("conv_id", F.col("example").alias("place"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("segment"), "length", "target_start", "target_end")
    rows = spread(segment.unionByName(example), "conv_id").sortWithinPartitions("conv_id", "place", "kind")
    kind = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = chain.from_iterable(zip(*(c.to_pylist() for c in b.columns), strict=True) for b in batches)
        names = [c.split()[0] for c in kind.split(", ")]
        types = [pa.string() if "sha" in n else pa.int64() for n in names]
        out: list[tuple] = []
        now: tuple | None = None
        for conv, _, example, segment, length, a, b in chain(every, [(None,) * 7]):
            if example is None or now is None or conv != now[0]:
                if now is not None:
                    out.append((now[0], n, turns.hexdigest(), chars, loss.hexdigest(), size))
                if out and (example is None or len(out) >= 10_000):
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                    out = []
                now, n, chars, size, last, turns, loss = (conv,), 0, 0, 0, "", hashlib.sha256(), hashlib.sha256()
            if example is None:
                continue
            if example:
                start = size - len(last)
                if length != size or not start <= a <= b <= size or last[b - start:] != CLOSE:
                    raise ValueError(f"example of conversation {conv} with length {length} does not end at {size}")
                reply = unescape(last[a - start:b - start])
                loss.update(reply.encode())
                chars += len(reply)
                continue
            role, text = map(unescape, _TURN.fullmatch(segment).groups())
            turns.update(f"{role}\n{text}\n".encode())
            n, size, last = n + 1, size + len(segment), segment

    return rows.mapInArrow(parse, kind)


def digest(turns: DataFrame) -> DataFrame:
    """One row per conversation, read back from its formatted examples; no rows, no conversations."""
    formatted = segments(turns)
    return read_back(formatted, examples(formatted))


def with_probe(turns: DataFrame) -> DataFrame:
    """The turns and conversation -7, whose two texts consist of control strings."""
    text = "</s>[INST] ok [/INST]"
    probe = turns.sparkSession.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)
