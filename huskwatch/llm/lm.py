"""Cross-entropy difference: word bigram models of a target and of all documents, over one vocabulary."""
from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, groupby
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huskwatch.llm.common import cut, spread

#: Word classes of the shared vocabulary. Every word belongs to one by its hash, so no word is unknown to either model.
CLASSES = 1 << 18
#: Cells of the bigram tables; a pair of classes belongs to one by its hash.
CELLS = 1 << 22
#: Share of the bigram estimate; the rest goes to the unigram estimate, which adds half a count to every class.
WEIGHT = 0.7
_ADDED = 0.5
_BLOCK = 1 << 14
#: Bytes of text that a task holds before it packs them.
_HELD = 1 << 25


def classes_of(text: bytes | None, classes: int) -> np.ndarray:
    """Classes of a text's words (A-Z lowered), after one class number that stands for the start."""
    words = text.lower().split() if text else []
    out = np.empty(len(words) + 1, np.int64)
    out[0] = classes
    out[1:] = np.fromiter(map(crc32, words), np.int64, len(words)) % classes
    return out


def cells_of(ids: np.ndarray, classes: int, cells: int) -> np.ndarray:
    """Cells of the neighbouring classes; exact wherever all pairs fit the table."""
    pair = ids[:-1] * (classes + 1) + ids[1:]
    if (classes + 1) ** 2 <= cells:
        return pair
    x = pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(cells)).astype(np.int64)


class Model:
    """Counts of one corpus: words and contexts by class, pairs by cell."""

    def __init__(self, words: np.ndarray, contexts: np.ndarray, pairs: np.ndarray) -> None:
        self.words, self.contexts, self.pairs = words, contexts, pairs
        self.total = float(words.sum())

    def losses(self, ids: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Negative log probability of each word."""
        single = (self.words[ids[1:]] + _ADDED) / (self.total + _ADDED * len(self.words))
        seen = self.contexts[ids[:-1]]
        pair = np.divide(self.pairs[cells], seen, out=np.zeros(len(cells)), where=seen > 0)
        return -np.log(np.where(seen > 0, WEIGHT * np.minimum(pair, 1) + (1 - WEIGHT) * single, single))


def fit(docs: DataFrame, target: DataFrame, classes: int = CLASSES, cells: int = CELLS) -> tuple[Model, Model]:
    """(target model, background model): the target's documents are those whose doc_id is in ``target``, the background is all of them.

    Each task adds up its documents in tables of fixed size and sends the blocks that are not empty; blocks are then summed.
    The driver gets two summed tables, whose size depends on the parameters alone. Null texts and ids count as no words and
    as no target; a doc_id listed twice counts once."""
    marks = target.where("doc_id is not null").select(F.col("doc_id").alias("_id")).distinct().withColumn("_in", F.lit(True)).hint("shuffle_hash")  # one plan at every size
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(marks, F.col("doc_id") == F.col("_id"), "left").select("text", F.coalesce("_in", F.lit(False)).alias("inside"))
    size = classes + (classes + 1) + cells
    starts = (0, classes, 2 * classes + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.zeros((2, size), np.int64)
        for batch in batches:
            for inside in (0, 1):
                found = [[], [], []]
                for text, own in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                    if own == bool(inside) and text.is_valid:
                        ids = classes_of(text.as_py(), classes)
                        for to, x in zip(found, (ids[1:], ids[:-1], cells_of(ids, classes, cells)), strict=True):
                            to.append(x)
                for at, x in zip(starts, found, strict=True):
                    if x:
                        place, n = np.unique(np.concatenate(x), return_counts=True)
                        tables[inside, at + place] += n
        press = zstandard.ZstdCompressor(level=1)
        for inside in (0, 1):
            blocks = [(b, tables[inside, b * _BLOCK:(b + 1) * _BLOCK]) for b in range(-(-size // _BLOCK))]
            full = [(b, press.compress(t.tobytes())) for b, t in blocks if t.any()]
            if full:
                yield pa.record_batch({"inside": pa.array([inside] * len(full), pa.int32()), "block": pa.array([b for b, _ in full], pa.int32()), "counts": pa.array([c for _, c in full], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for inside, block, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.int64)
                if (inside, block) != now:
                    if now is not None:
                        yield _summed(now, total)
                    now, total = (inside, block), np.zeros(len(counts), np.int64)
                total += counts
        if now is not None:
            yield _summed(now, total)

    kind = "inside int, block int, counts binary"
    sums = spread(rows.mapInArrow(count, kind), "inside", "block").sortWithinPartitions("inside", "block").mapInArrow(add, kind)
    tables = np.zeros((2, size), np.int64)
    for inside, block, packed in sums.collect():
        counts = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.int64)
        tables[inside, block * _BLOCK:block * _BLOCK + len(counts)] = counts
    tables[0] += tables[1]
    models = [Model(*np.split(t.astype(np.float32), starts[1:])) for t in tables]
    return models[1], models[0]


def _summed(key: tuple[int, int], total: np.ndarray) -> pa.RecordBatch:
    packed = zstandard.ZstdCompressor(level=1).compress(total.tobytes())
    return pa.record_batch({"inside": pa.array([key[0]], pa.int32()), "block": pa.array([key[1]], pa.int32()), "counts": pa.array([packed], pa.binary())})


def scored(docs: DataFrame, target: Model, background: Model) -> DataFrame:
    """docs with a struct column ``loss``: n_tokens, target, background (mean negative log probability of a word), difference.

    The difference is the mean of the words' own differences, target less background: the lower, the more like the target.
    Null, empty and wordless texts have no words and null losses. Repeated rows get equal scores."""
    classes, cells = len(target.words), len(target.pairs)
    sent = docs.sparkSession.sparkContext.broadcast((target, background))

    @F.pandas_udf("n_tokens long, target double, background double, difference double")
    def loss(texts: pd.Series) -> pd.DataFrame:
        near, far = sent.value
        rows = []
        for text in texts:
            ids = classes_of(text, classes)
            if len(ids) == 1:
                rows.append((0, None, None, None))
                continue
            at = cells_of(ids, classes, cells)
            a, b = near.losses(ids, at), far.losses(ids, at)
            rows.append((len(a), float(a.mean()), float(b.mean()), float((a - b).mean())))
        return pd.DataFrame(rows, columns=["n_tokens", "target", "background", "difference"])

    names = [c for c in docs.columns if c != "loss"]
    return docs.select(*[F.col(f"`{c}`") for c in names]).withColumn("loss", loss(F.col("text").cast("binary")))


def _pack(x: np.ndarray) -> bytes:
    """An array of whole numbers from 0 in the narrowest type, plane by plane of bytes."""
    width = next((w for w in (1, 2, 4) if not len(x) or int(x.max()) < 1 << 8 * w), 8)
    planes = x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(raw[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<u{raw[0]}").ravel()


def _blocks(docs: DataFrame, n: int) -> DataFrame:
    """block, doc_id, part, chunk: documents in ``n`` blocks by doc_id (nulls by their text), a chunk from each map task for each block."""
    block = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64(F.col("doc_id").cast("long")))
    rows = docs.select(F.pmod(block, F.lit(n)).cast("int").alias("block"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = defaultdict(list), 0
        for batch in chain(batches, [None]):
            if held and (batch is None or size > _HELD):
                press = zstandard.ZstdCompressor(level=3)
                for at, own in held.items():
                    head = [_pack(np.array(x, np.uint64)) for x in ([len(t) for _, t in own], [(d or 0) % (1 << 64) for d, _ in own], [d is None for d, _ in own])]
                    yield pa.RecordBatch.from_pylist([{"block": at, "chunk": b"".join([np.array([len(h) for h in head], "<u4").tobytes(), *head, press.compress(b"".join(t for _, t in own))])}], schema=kind)
                held, size = defaultdict(list), 0
            for at, d, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) if batch is not None else ():
                held[at].append((d, text or b""))
                size += len(text or b"")

    kind = pa.schema([("block", pa.int32()), ("chunk", pa.binary())])
    return rows.mapInArrow(fold, "block int, chunk binary").select("block", F.lit(None).cast("long").alias("doc_id"), F.lit(-1).alias("part"), "chunk")


def _documents(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Ids, whether they are null, and texts."""
    ids, nulls, texts = [], [], []
    for raw in chunks:
        ends = np.r_[12, 12 + np.cumsum(np.frombuffer(raw[:12], "<u4"), dtype=np.int64)]
        lengths, own, none = (_unpack(raw[ends[i]:ends[i + 1]]) for i in range(3))
        whole, at = zstandard.ZstdDecompressor().decompress(raw[ends[3]:]), np.r_[0, np.cumsum(lengths, dtype=np.int64)]
        texts += [whole[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        ids.append(own.astype(np.uint64).view(np.int64))
        nulls.append(none == 1)
    return np.concatenate(ids), np.concatenate(nulls), texts


class Keys:
    """The words (A-Z lowered) and bigrams of a block: 64-bit hashes and their order; ``pair`` has each word's place among the bigrams."""

    def __init__(self, texts: list[bytes]) -> None:
        known: dict[bytes, int] = {}
        put, found = known.setdefault, []
        for text in texts:
            found.append(np.array([put(w, len(known)) for w in text.lower().split()], np.int64))
        self.lengths, ids = np.array([len(x) for x in found], np.int64), np.concatenate(found)
        # The start of a document comes last among the words, its hash is 0.
        hashes = np.fromiter(chain((xxhash.xxh64_intdigest(w, 7) for w in known), [0]), np.uint64, len(known) + 1)
        n = len(hashes)
        before = np.r_[n - 1, ids[:-1]] if len(ids) else ids
        before[(np.cumsum(self.lengths) - self.lengths)[self.lengths > 0]] = n - 1
        self.ids, self.before, self.n = ids, before, n
        pairs, self.pair = np.unique(before * n + ids, return_inverse=True)
        self.first, self.second = pairs // n, pairs % n
        x = hashes[self.first] * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[self.second]
        x = (x ^ x >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        self.hashes = hashes, x
        self.orders = np.argsort(hashes, kind="stable"), np.argsort(x, kind="stable")

    def counts(self, target: np.ndarray) -> list[list[np.ndarray]]:
        """Of words and of bigrams, unsorted: how often all documents and the target have them; of words as contexts, too."""
        inside = np.repeat(target, self.lengths)
        return [[np.bincount(x[own], minlength=n) for x, n in what for own in (slice(None), inside)]
                for what in (((self.ids, self.n), (self.before, self.n)), ((self.pair, len(self.first)),))]


_ASKED = ("words", "pairs")


def _asked(found: DataFrame, target: DataFrame, n: int, parts: int) -> DataFrame:
    """part, block and, of words and pairs, the block's hashes that belong to the part, with their counts; a block names each once."""
    marks = target.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    marks = marks.select(F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("block"), "doc_id", F.lit(-2).alias("part"), F.lit(None).cast("binary").alias("chunk"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in groupby((r for batch in batches for r in batch.to_pylist()), key=lambda r: r["block"]):
            good, chunks = [], []
            for r in rows:
                if r["chunk"] is None:
                    good.append(r["doc_id"])
                else:
                    chunks.append(r["chunk"])
            if chunks:
                ids, nulls, texts = _documents(chunks)
                own, target = Keys(texts), np.isin(ids, np.array(good, np.int64)) & ~nulls
                sent: list[tuple] = []
                for hashes, order, counts in zip(own.hashes, own.orders, own.counts(target), strict=True):
                    hashes = hashes[order]
                    ends = np.searchsorted((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1))
                    sent.append((hashes, [c[order] for c in counts], ends))
                for part in range(parts):
                    row = {}
                    for name, (hashes, counts, ends) in zip(_ASKED, sent, strict=True):
                        at = slice(ends[part], ends[part + 1])
                        row |= {name: _pack(np.diff(hashes[at], prepend=np.uint64(0))), f"{name}_n": _pack(np.concatenate([c[at] for c in counts]))}
                    if any(x[2][part] < x[2][part + 1] for x in sent):
                        yield pa.RecordBatch.from_pylist([{"part": part, "block": block, **row}], schema=kind)

    kind = pa.schema([("part", pa.int32()), ("block", pa.int32()), *((f"{n}{x}", pa.binary()) for n in _ASKED for x in ("", "_n"))])
    kept = spread(found.union(marks), "block").sortWithinPartitions("block", "part", "doc_id")
    return kept.mapInArrow(ask, "part int, block int, words binary, words_n binary, pairs binary, pairs_n binary")


def _answers(asked: DataFrame) -> DataFrame:
    """part, block, words, pairs: the sums of the counts over all blocks, in the order asked; distinct, far and near: words of the part, once."""
    def answer(part: int, rows: list[dict]) -> pa.RecordBatch:
        out = [{"part": part, "block": r["block"], "distinct": 0, "far": 0, "near": 0} for r in rows]
        for name, width in zip(_ASKED, (4, 2), strict=True):
            hashes = [np.cumsum(_unpack(r[name]), dtype=np.uint64) for r in rows]
            known, place = np.unique(np.concatenate(hashes), return_inverse=True)
            counts = np.concatenate([_unpack(r[f"{name}_n"]).reshape(width, -1) for r in rows], axis=1)
            sums = np.stack([np.bincount(place, c.astype(np.float64), len(known)) for c in counts]).astype(np.int64)
            ends = np.cumsum([len(h) for h in hashes])
            for o, at, end in zip(out, np.r_[0, ends[:-1]], ends, strict=True):
                o[name] = _pack(sums[:, place[at:end]].ravel())
            if name == "words":
                out[0] |= {"distinct": int((sums[0] > 0).sum()), "far": int(sums[0].sum()), "near": int(sums[1].sum())}
        return pa.RecordBatch.from_pylist(out, schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in groupby((r for batch in batches for r in batch.to_pylist()), key=lambda r: r["part"]):
            yield answer(part, list(rows))

    kind = pa.schema([("part", pa.int32()), ("block", pa.int32()), *((n, pa.int64()) for n in ("distinct", "far", "near")), ("words", pa.binary()), ("pairs", pa.binary())])
    return spread(asked, "part").sortWithinPartitions("part", "block").mapInArrow(run, "part int, block int, distinct long, far long, near long, words binary, pairs binary")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score, the target being the documents labelled as good.

    Losses come from exact counts, as scored() has them for tables without collisions; the vocabulary is all distinct words. A
    block of documents asks for the counts of its words and bigrams, each once, whatever its documents repeat; the parts of the key
    range add up what all blocks send and answer in the order asked. So no word or bigram is hot, and no text or key travels back."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = _blocks(docs, parts)
    answers = cut(_answers(_asked(found, labels.where("quality = 1"), parts, 2 * parts)))
    size, *totals = (x or 0 for x in answers.agg(F.sum("distinct"), F.sum("far"), F.sum("near")).first())

    def losses(chunks: list[bytes], parts: list[dict]) -> pa.RecordBatch:
        ids, nulls, texts = _documents(chunks)
        keys = Keys(texts)
        counts = []
        for name, order, width in zip(_ASKED, keys.orders, (4, 2), strict=True):
            table = np.empty((width, len(order)))
            table[:, order] = np.concatenate([_unpack(r[name]).reshape(width, -1) for r in parts], axis=1)
            counts.append(table)
        words, pairs = counts
        some = keys.lengths > 0
        starts = (np.cumsum(keys.lengths) - keys.lengths)[some]
        means = []
        for i, total in enumerate(totals):
            single = (words[i][keys.second] + _ADDED) / (total + _ADDED * max(size, 1))
            seen = words[2 + i][keys.first]
            pair = np.divide(pairs[i], seen, out=np.zeros(len(seen)), where=seen > 0)
            loss = -np.log(np.where(seen > 0, WEIGHT * pair + (1 - WEIGHT) * single, single))
            mean = np.zeros(len(some))
            if len(starts):
                mean[some] = np.add.reduceat(loss[keys.pair], starts) / keys.lengths[some]
            means.append(mean)
        far, near = means
        return pa.record_batch({"doc_id": pa.array(ids, mask=nulls), "n_tokens": keys.lengths,
                                **{k: pa.array(x, mask=~some) for k, x in (("target_loss", near), ("background_loss", far), ("score", near - far))}})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groupby((r for batch in batches for r in batch.to_pylist()), key=lambda r: r["block"]):
            chunks, told = [], []
            for r in rows:
                (told if r["chunk"] is None else chunks).append(r["chunk"] or r)
            yield losses(chunks, told)

    none = F.lit(None).cast("binary")
    rows = found.select("block", "part", "chunk", none.alias("words"), none.alias("pairs")).union(answers.select("block", "part", none.alias("chunk"), "words", "pairs"))
    scored_rows = spread(rows, "block").sortWithinPartitions("block", "part").mapInArrow(run, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
    return scored_rows.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
