"""Conversation prefix trie by vertical bitmaps.

Conversations, as paths of turn digests, are sorted by path over all tasks and cut into shards. A shard indexes each (position,
turn) to a bitset of its conversations; a depth-first walk intersects the parent's bitset with postings, which yields children,
popcounts and end lists. Nodes that lie in several shards are neighbours on a path, and one shard, the last that holds a node,
counts it for its ancestors; so every figure of a node is a sum over shards, whatever the size of a group."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huskwatch.llm.common import shared_folder

#: Conversations and turns of a shard, at most (one conversation may have more turns).
SHARD, TURNS = 1024, 1 << 16
#: Conversations that share the first turns of one, and the turns of one task's stretch in counting places.
FAMILY, MOST_HEAD, STRETCH = 20, 3, 1000
#: Bytes of a turn's digest and of a node's key.
WIDTH = 16

_PATHS = "task int, shard long, at long, conv_id long, path binary, words binary, follows binary"
_NODES = "depth int, key binary, parent binary, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, first_end long, ends binary"
_ROOT = bytes(WIDTH)


def head_turns() -> Column:
    """How many turns a conversation takes from the first of its family: CRC-32 of its decimal id, modulo 4."""
    return (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_HEAD + 1)).cast("int")


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), digest, words of each turn. Turns stand in the order of turn, role and text, nulls first; null
    roles and texts count as empty. Rows without conv_id belong to no conversation and take no part.

    Places are counted inside stretches of turns first, so that no task orders a whole long conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    stretch = F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(-(1 << 62)))
    rows = turns.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), text.alias("text"), stretch.alias("stretch"))
    inside = Window.partitionBy("conv_id", "stretch").orderBy("turn", "role", "text")
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    rows = rows.select("conv_id", "stretch", F.row_number().over(inside).alias("at"), digest.alias("digest"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))
    ends = turns.where("conv_id is not null").groupBy("conv_id", stretch.alias("stretch")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    skip = ends.select("conv_id", "stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    return rows.join(skip, ["conv_id", "stretch"]).select("conv_id", (F.col("skip") + F.col("at")).alias("place"), "digest", "words")


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, path, words: each conversation with the first turns of the first of its family in place of its own.

    ``path`` holds the digests of its turns one after the other, ``words`` their word counts (4 bytes each): 20 bytes a turn.
    ``turns`` is numbered(); it is read several times and should be a written table."""
    sizes = turns.groupBy("conv_id").agg(F.max("place").alias("own")).withColumn("head", head_turns())
    first = sizes.select("*", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("first"))
    lead = sizes.select(F.col("conv_id").alias("first"), F.least("own", F.lit(MOST_HEAD)).alias("lead"))
    plan = first.join(lead, "first", "left").withColumn("lead", F.least("head", F.coalesce("lead", F.lit(0))))
    tail = turns.join(plan.select("conv_id", "head", "lead"), "conv_id").where("place > head")
    tail = tail.select("conv_id", (F.col("place") - F.col("head") + F.col("lead")).alias("place"), "digest", "words")
    heads = turns.where((F.col("place") <= MOST_HEAD) & (F.col("conv_id") % FAMILY == 0))
    heads = heads.withColumnRenamed("conv_id", "first").join(plan.select("conv_id", "first", "lead"), "first").where("place <= lead")
    rows = heads.select("conv_id", "place", "digest", "words").unionByName(tail)
    # A conversation's path is one value of 20 bytes a turn; its texts stay behind.
    one = F.array_sort(F.collect_list(F.struct("place", "digest", "words")))
    packed = rows.groupBy("conv_id").agg(one.alias("t"))
    found = packed.mapInArrow(_joined, "conv_id long, path binary, words binary")
    bare = sizes.join(packed.select("conv_id"), "conv_id", "left_anti").select("conv_id", F.lit(b"").alias("path"), F.lit(b"").alias("words"))
    return found.unionByName(bare)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        offsets, flat = lists.offsets.to_numpy(), lists.values
        digests, words = flat.field(1).to_pylist(), flat.field(2).to_numpy(zero_copy_only=False).astype("<i4")
        spans = list(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b"".join(digests[a:b]) for a, b in spans], pa.binary()), pa.array([words[a:b].tobytes() for a, b in spans], pa.binary())], names=["conv_id", "path", "words"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the sorted rows of a task and cut them into shards; a shard's last row gets the path that ``follows`` it."""
    names = [f.split()[0] for f in _PATHS.split(", ")]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    task, at, shard, rows, turns, out = TaskContext.get().partitionId(), 0, 0, 0, 0, []

    def batched(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    for batch in batches:
        for conv_id, path, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n = len(path) // WIDTH
            if rows and (rows == SHARD or turns + n > TURNS):
                shard, rows, turns, out[-1][6] = shard + 1, 0, 0, path
            if len(out) >= 256:
                yield batched(out)
                out = []
            out.append([task, (task << 32) + shard, at, conv_id, path, words, None])
            rows, turns, at = rows + 1, turns + n, at + 1
    if out:
        yield batched(out)


def _alike(a: bytes, b: bytes) -> int:
    """Turns that two paths share from the start."""
    n = min(len(a), len(b)) // WIDTH
    if a[:n * WIDTH] == b[:n * WIDTH]:
        return n
    low = 0
    while low < n and a[low * WIDTH:(low + 1) * WIDTH] == b[low * WIDTH:(low + 1) * WIDTH]:
        low += 1
    return low


def walked(convs: list[int], paths: list[bytes], words: list[np.ndarray], shared: int) -> Iterator[tuple]:
    """Nodes of one shard, children before parents: depth, key, parent's key, smallest member, members, children, leaves, saved,
    first end, ends.

    ``paths`` are sorted. Nodes of the last path down to depth ``shared`` go on in the next shard, which then counts them as
    children, leaves and texts; every other node is counted here. A node's key chains its parent's with its turn's digest.
    saved_tokens comes in two sums: each member's words from the node on, less the words of the nodes counted here."""
    turns = [[p[i:i + WIDTH] for i in range(0, len(p), WIDTH)] for p in paths]
    postings: dict[tuple[int, bytes], int] = {}
    ended: dict[int, int] = {}
    for i, path in enumerate(turns):
        bit = 1 << i
        for place, turn in enumerate(path):
            postings[place, turn] = postings.get((place, turn), 0) | bit
        ended[len(path)] = ended.get(len(path), 0) | bit
    later = [np.append(np.cumsum(w[::-1])[::-1], 0) for w in words]  # words from each place to the end
    last = 1 << (len(paths) - 1)

    def opened(depth: int, key: bytes, parent: bytes, members: int, text: int) -> list:
        ends = members & ended.get(depth, 0)
        return [depth, key, parent, members, members & ~ends, ends, text, 0, 0, 0, 0]  # then children, leaves, texts below, rest of members' words

    stack = [opened(0, _ROOT, b"", (1 << len(paths)) - 1, 0)]
    while stack:
        node = stack[-1]
        depth, key, _, members, left, ends = node[:6]
        if left:
            lowest = (left & -left).bit_length() - 1
            turn = turns[lowest][depth]
            child = members & postings[depth, turn]
            node[4] = left & ~child
            stack.append(opened(depth + 1, hashlib.md5(key + turn).digest(), key, child, int(words[lowest][depth])))
            continue
        stack.pop()
        mine = not (members & last and depth <= shared)
        leaves = node[8] + (mine and members == ends)
        texts = node[9] + (node[6] if mine else 0)
        rest = sum(int(later[i][depth - 1 if depth else 0]) for i in _bits(members))
        ids = sorted(convs[i] for i in _bits(ends))
        yield depth, key, node[2], min(convs[i] for i in _bits(members)), members.bit_count(), node[7], leaves, rest - texts, ids[0] if ids else None, np.array(ids, "<i8").tobytes()
        if stack:
            above = stack[-1]
            above[7] += mine
            above[8] += leaves
            above[9] += texts


def _bits(found: int) -> Iterator[int]:
    while found:
        low = found & -found
        yield low.bit_length() - 1
        found ^= low


def _walk(batches: Iterator[pa.RecordBatch], after: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
    """Shard after shard of rows in order. A shard is followed by the row behind it or, at its task's end, by the next task's
    first path, which ``after`` holds."""
    names = [f.split()[0] for f in _NODES.split(", ")]
    types = [pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 6, pa.binary()]

    def nodes(held: list[dict]) -> Iterator[pa.RecordBatch]:
        follows = held[-1]["follows"]
        follows = after.get(held[-1]["task"]) if follows is None else follows
        shared = -1 if follows is None else _alike(held[-1]["path"], follows)
        found = walked([r["conv_id"] for r in held], [r["path"] for r in held], [np.frombuffer(r["words"], "<i4").astype(np.int64) for r in held], shared)
        while out := list(islice(found, 4096)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    held: list[dict] = []
    for batch in batches:
        for row in (r for i in range(0, batch.num_rows, 64) for r in batch.slice(i, 64).to_pylist()):
            if held and row["shard"] != held[-1]["shard"]:
                yield from nodes(held)
                held = []
            held.append(row)
    if held:
        yield from nodes(held)


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each node's sorted member ids, streamed over its end lists, whose ids all follow one another."""
    now, digest, begun = None, hashlib.sha256(), False
    for batch in batches:
        out = []
        for depth, key, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if (depth, key) != now:
                if now is not None:
                    out.append((*now, digest.hexdigest()))
                now, digest, begun = (depth, key), hashlib.sha256(), False
            ids = ",".join(map(str, np.frombuffer(ends.as_buffer(), "<i8").tolist()))
            digest.update((("," if begun else "") + ids).encode())
            begun = True
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.string()), strict=True)], names=["depth", "key", "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*now, digest.hexdigest()), (pa.int32(), pa.binary(), pa.string()), strict=True)], names=["depth", "key", "ends_sha256"])


def sharded(paths: DataFrame, folder: str) -> DataFrame:
    """Rows of rebuilt() in one order over all tasks, written with their shard and the path that follows each shard."""
    spark = paths.sparkSession
    paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(_cut, _PATHS).write.parquet(f"{folder}/paths")
    return spark.read.schema(_PATHS).parquet(f"{folder}/paths")


def _afters(rows: DataFrame) -> dict[int, bytes]:
    """For each task of the sort, the first path of the next one: one path a task reaches the driver."""
    firsts = [tuple(r) for r in rows.where("at = 0").select("task", "path").orderBy("task").collect()]
    return {a[0]: bytes(b[1]) for a, b in zip(firsts, firsts[1:])}


def nodes(turns: DataFrame, folder: str | None = None) -> DataFrame:
    """depth, key, parent, conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of the trie.

    Equal turns (role and text) after equal parents are one node; repeated conversations are members of the same nodes. An
    empty table has no conversations and gives no nodes. What is written to the shared folder (turns by digest, sorted paths,
    nodes by shard) is read again by several stages, so that a lost executor repeats little."""
    spark = turns.sparkSession
    folder = folder or shared_folder(spark)
    numbered(turns).write.parquet(f"{folder}/turns")
    rows = sharded(rebuilt(spark.read.parquet(f"{folder}/turns")), folder)
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    after = spark.sparkContext.broadcast(_afters(rows))
    rows.repartition(tasks, "shard").sortWithinPartitions("shard", "at").mapInArrow(lambda batches: _walk(batches, after.value), _NODES).write.parquet(f"{folder}/nodes")
    found = spark.read.parquet(f"{folder}/nodes")
    sums = found.groupBy("depth", "key").agg(F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    # Lists of a node in several shards follow one another: equal paths are sorted by conv_id.
    ends = found.where("first_end is not null").select("depth", "key", "first_end", "ends").repartition(tasks, "depth", "key").sortWithinPartitions("depth", "key", "first_end")
    lists = ends.select("depth", "key", "ends").mapInArrow(_ended, "depth int, key binary, ends_sha256 string")
    return sums.join(lists, ["depth", "key"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))


def digest(turns: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row per node."""
    spark, folder = turns.sparkSession, shared_folder(turns.sparkSession)
    nodes(turns, folder).write.parquet(f"{folder}/trie")
    found = spark.read.parquet(f"{folder}/trie")
    above = found.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return found.join(above, ["depth", "parent"], "left").select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
