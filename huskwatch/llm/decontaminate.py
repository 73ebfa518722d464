"""Benchmark decontamination with a generalised suffix automaton of normalised test items."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huskwatch.llm.common import merged, nested, restored

WINDOW = 10
#: Words of one automaton; a larger benchmark is cut into several, which the documents pass one after the other.
SHARD_WORDS = 2_000_000
_LETTERS = bytes(b if b in b"0123456789abcdefghijklmnopqrstuvwxyz" or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words: runs of ASCII letters, digits and bytes of other scripts; none for null."""
    return text.translate(_LETTERS).split() if text else []


class Automaton:
    """Generalised suffix automaton over word ids.

    ``hit[s]`` is the length that must be reached in state s for its nearest window to have occurred,
    ``items[s]`` the items that hold the window of state s."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(key, [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]) for key, words in items if words]
        for _, ids in coded:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self._mark(coded)
        self.shortest = min((min(len(ids), window) for _, ids in coded), default=0)

    def _extend(self, last: int, c: int) -> int:
        step, link, length = self.step, self.link, self.length
        if c in step[last]:
            q = step[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, q, c)
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p != -1:
            q = step[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
        return new

    def _clone(self, p: int, q: int, c: int) -> int:
        copy = len(self.step)
        self.step.append(dict(self.step[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = copy
        while p != -1 and self.step[p].get(c) == q:
            self.step[p][c] = copy
            p = self.link[p]
        return copy

    def _mark(self, coded: list[tuple[int, list[int]]]) -> None:
        """The state of each window gets its items; every other state the nearest such state among its suffixes."""
        self.items: dict[int, set[int]] = {}
        for key, ids in coded:
            size, state = min(len(ids), self.window), 0
            for at, c in enumerate(ids):
                state = self.step[state][c]
                if at + 1 >= size:
                    s = state
                    while self.length[self.link[s]] >= size:
                        s = self.link[s]
                    self.items.setdefault((s, size), set()).add(key)
        sizes: dict[int, list[int]] = {}
        for s, size in self.items:
            sizes.setdefault(s, []).append(size)
        self.marks: list[tuple] = [()] * len(self.step)
        for s in sorted(range(len(self.step)), key=self.length.__getitem__):
            above = self.marks[self.link[s]] if s else ()
            self.marks[s] = tuple((size, s) for size in sorted(sizes.get(s, ()), reverse=True)) + above

    def spans(self, ids: list[int]) -> Iterator[tuple[int, int, set[int]]]:
        """(start, end, items) for each window that occurs in a document's word ids, 0 standing for any other word."""
        step, link, length, marks = self.step, self.link, self.length, self.marks
        state = matched = 0
        for at, c in enumerate(ids):
            if not c:
                state = matched = 0
                continue
            while state and c not in step[state]:
                state = link[state]
                matched = length[state]
            if c in step[state]:
                state = step[state][c]
                matched += 1
            for size, s in marks[state]:
                if matched >= size:
                    yield at + 1 - size, at + 1, self.items[s, size]

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged ranges of hit words and the items with occurring windows. Runs of item words shorter than every window are skipped."""
        get = self.vocabulary.get
        ids = [get(w, 0) for w in words]
        ranges, found = [], set()
        start, n = 0, len(ids)
        while start < n:
            if not ids[start]:
                start += 1
                continue
            try:
                end = ids.index(0, start)
            except ValueError:
                end = n
            if end - start >= self.shortest:
                for a, b, items in self.spans(ids[start:end]):
                    if ranges and a + start <= ranges[-1][1] and a + start >= ranges[-1][0]:
                        ranges[-1] = (ranges[-1][0], b + start)
                    else:
                        ranges.append((a + start, b + start))
                    found |= items
            start = end
        return merged(ranges), found


def shards(benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> list[Automaton]:
    """Automata of the benchmark's items, each of at most ``shard_words`` words (or one longer item).

    The rows come to the driver one partition at a time; a benchmark is the stated query set. Null texts have no words."""
    out, held, size = [], [], 0
    for row in benchmark.select("item_id", F.col("text").cast("binary").alias("text")).toLocalIterator():
        words = words_of(row["text"])
        if held and size + len(words) > shard_words:
            out.append(Automaton(held, window))
            held, size = [], 0
        held.append((row["item_id"], words))
        size += len(words)
    return [*out, Automaton(held, window)]


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """docs with a struct column ``leak``: n_words, n_hit, items (ids as strings, sorted as strings), ranges (hit words).

    A window is ``window`` consecutive item words, or a whole shorter item that has words. Null and empty texts have no
    words and no hits; item ids that are null count as the empty string; repeated items and rows change nothing else."""
    kind = "n_words long, n_hit long, items array<string>, ranges array<struct<start:int,end:int>>"
    sent = [docs.sparkSession.sparkContext.broadcast(a) for a in shards(benchmark, window, shard_words)]

    @F.pandas_udf(kind)
    def leak(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            words = words_of(text)
            ranges, found = [], set()
            for automaton in sent:
                r, f = automaton.value.match(words)
                ranges += r
                found |= f
            ranges = merged(ranges)
            rows.append((len(words), sum(b - a for a, b in ranges), sorted("" if i is None else str(i) for i in found), ranges))
        return pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "ranges"])

    return docs.withColumn("leak", leak(F.col("text").cast("binary")))


def without_spans(text: bytes, ranges: list[tuple[int, int]]) -> bytes:
    """The text without the bytes from the first to the last word of each range."""
    clean = text.translate(_LETTERS)
    out, at, words = [], 0, 0
    bounds = iter([x for r in ranges for x in r])
    place, wanted, inside, kept = 0, next(bounds, None), False, 0
    for word in clean.split():
        place = clean.index(word, at)
        if words == wanted and not inside:
            out.append(text[kept:place])
            inside, wanted = True, next(bounds)
        at = place + len(word)
        words += 1
        if inside and words == wanted:
            kept, inside, wanted = at, False, next(bounds, None)
    return b"".join([*out, b"" if inside else text[kept:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5) -> DataFrame:
    """Documents without the spans that match the benchmark.

    A document with a larger share of hit words than ``max_coverage`` goes as a whole. All other columns stay as they are;
    a text without hits, null included, is unchanged."""

    @F.pandas_udf("string")
    def removed(texts: pd.Series, ranges: pd.Series) -> pd.Series:
        return pd.Series([without_spans(t, [(x["start"], x["end"]) for x in r]).decode("utf-8", "replace") if t and len(r) else None
                          for t, r in zip(texts, ranges, strict=True)], dtype=object)

    found = contaminated(nested(docs), benchmark, window)
    found = found.where(F.col("leak.n_hit") <= max_coverage * F.col("leak.n_words"))
    text = F.when(F.col("leak.n_hit") > 0, removed(F.col("text").cast("binary"), F.col("leak.ranges"))).otherwise(F.col("text"))
    return restored(found, docs.columns, text=text)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row per document row."""
    found = contaminated(docs.select("doc_id", "text"), benchmark)
    return found.select("doc_id", F.col("leak.n_words").alias("n_words"), F.col("leak.n_hit").alias("n_hit"),
                        F.size("leak.items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "leak.items").cast("binary"), 256).alias("items_sha256"),
                        (F.col("leak.n_hit") > 0).alias("contaminated"))


def brute(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = WINDOW) -> dict:
    """The same digest by comparing every window with every place; for tests."""
    out = {}
    cut = [(k, words_of((t or "").encode())) for k, t in items]
    for doc, text in docs:
        words, hit, found = words_of((text or "").encode()), set(), set()
        for key, item in cut:
            size = min(window, len(item))
            for i in range(len(item) - size + 1 if size else 0):
                for j in range(len(words) - size + 1):
                    if words[j:j + size] == item[i:i + size]:
                        hit.update(range(j, j + size))
                        found.add(key)
        out[doc] = (len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))
    return out
