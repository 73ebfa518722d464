"""Quality rules: a linear-chain conditional random field labels lines, and the share of content decides."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huskwatch.llm.common import SPACES, nested, restored

MIN_WORDS = 50
MAX_REPEATED = 0.5
#: Least share of a document's word characters that must lie in content lines.
MIN_CONTENT = 0.5
#: Labelled documents of each quality that the field is trained on at most; chosen by a hash of doc_id.
SAMPLE = 600
_SYMBOLS = b"#*$%&|<>"
_PUNCTUATION = b"!?;:=+~^_@/\\{}[]()\"'-"
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_FEATURES = 17


def counts(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text; all 0 for null."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.split()
    chars = sum(map(len, words)) - len(text.translate(None, bytes(b for b in range(256) if not 128 <= b < 192)))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip(SPACES):
            seen.add(line)
    return len(words), chars, symbols, dup, repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    windows = pairs[:-1] * len(number) + ids[2:]
    _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
    start = np.flatnonzero(times[which] > 1)
    hit = np.zeros(n, bool)
    for i in range(3):
        hit[start + i] = True
    return int(hit.sum())


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """0/1 features of each line with a word, and its word characters in bytes.

    Shares of symbols, other marks, capitals and digits, repeated words, length, a sentence's end, an equal line before."""
    rows, sizes = [], []
    seen: set[bytes] = set()
    for line in text.split(b"\n"):
        words = line.split()
        if not words:
            continue
        size = sum(map(len, words))
        share = lambda marks, line=line, size=size: (len(line) - len(line.translate(None, marks))) / size
        symbols, marks, upper, digits = share(_SYMBOLS), share(_PUNCTUATION), share(_UPPER), share(_DIGITS)
        fresh = len(set(words)) / len(words)
        mean = size / len(words)
        rows.append((1, symbols > 0.02, symbols > 0.08, symbols > 0.25, marks > 0.05, marks > 0.15, upper > 0.15, upper > 0.5, digits > 0.3,
                     len(words) >= 8 and fresh < 0.6, len(words) >= 8 and fresh < 0.35, len(words) < 4, len(words) > 20, mean > 15, mean < 3,
                     words[-1][-1:] in b".!?", line in seen))
        sizes.append(size)
        seen.add(line)
    return np.array(rows, np.float64).reshape(-1, _FEATURES), np.array(sizes, np.int64)


class Field:
    """A linear-chain conditional random field over two labels: 0 boilerplate, 1 content."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray) -> None:
        self.weights, self.moves = weights, moves

    def viterbi(self, features: np.ndarray) -> list[int]:
        """The most probable labels of a document's lines; content wins ties."""
        scores = (features @ self.weights.T).tolist()
        (s00, s01), (s10, s11) = self.moves.tolist()
        a, b = scores[0] if scores else (0.0, 0.0)
        back = []
        for x, y in scores[1:]:
            from_a, from_b = a + s01 > b + s11, a + s00 > b + s10
            a, b, step = (a + s00 if from_b else b + s10) + x, (a + s01 if from_a else b + s11) + y, (not from_b, not from_a)
            back.append(step)
        label = int(b >= a)
        out = [label] if scores else []
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]

    @classmethod
    def train(cls, documents: list[tuple[np.ndarray, np.ndarray]], rounds: int = 150, decay: float = 1.0) -> Field:
        """Maximum likelihood with a quadratic penalty, by gradient steps of adapted length; documents are (features, labels).

        Forward and backward passes run over all documents of a length class at once. No documents give an all-zero field."""
        weights, moves = np.zeros((2, _FEATURES)), np.zeros((2, 2))
        documents = [d for d in documents if len(d[1])]
        if not documents:
            return cls(weights, moves)
        groups: dict[int, list] = {}
        for x, y in documents:
            groups.setdefault(int(np.ceil(np.log2(len(y) + 1))), []).append((x, y))
        batches = []
        for docs in groups.values():
            longest = max(len(y) for _, y in docs)
            x = np.zeros((len(docs), longest, _FEATURES))
            y = np.zeros((len(docs), longest), int)
            mask = np.zeros((len(docs), longest))
            for i, (a, b) in enumerate(docs):
                x[i, :len(b)], y[i, :len(b)], mask[i, :len(b)] = a, b, 1
            batches.append((x, y, mask))
        total = sum(len(y) for _, y in documents)
        steps = [np.zeros_like(weights), np.zeros_like(moves)]
        squares = [np.zeros_like(weights), np.zeros_like(moves)]
        for r in range(1, rounds + 1):
            grads = [-decay * weights, -decay * moves]
            for x, y, mask in batches:
                for g, more in zip(grads, _gradient(x, y, mask, weights, moves), strict=True):
                    g += more
            for value, g, m, v in zip((weights, moves), grads, steps, squares, strict=True):
                g = g / total
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                value += 0.15 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
        return cls(weights, moves)


def _gradient(x: np.ndarray, y: np.ndarray, mask: np.ndarray, weights: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Observed less expected features and moves over documents of one length class."""
    emit = x @ weights.T * mask[..., None]
    n, longest, _ = emit.shape
    forward, backward = np.zeros_like(emit), np.zeros_like(emit)
    forward[:, 0] = emit[:, 0]
    for t in range(1, longest):
        new = np.logaddexp.reduce(forward[:, t - 1, :, None] + moves, axis=1) + emit[:, t]
        forward[:, t] = np.where(mask[:, t, None] > 0, new, forward[:, t - 1])
    for t in range(longest - 2, -1, -1):
        new = np.logaddexp.reduce(moves + (emit[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
        backward[:, t] = np.where(mask[:, t + 1, None] > 0, new, 0)
    norm = np.logaddexp.reduce(forward[:, -1], axis=1)
    single = np.exp(forward + backward - norm[:, None, None]) * mask[..., None]
    truth = np.eye(2)[y] * mask[..., None]
    both = mask[:, 1:] * mask[:, :-1]
    joint = np.exp(forward[:, :-1, :, None] + moves + (emit + backward)[:, 1:, None, :] - norm[:, None, None, None]) * both[..., None, None]
    seen = truth[:, :-1, :, None] * truth[:, 1:, None, :]
    return np.einsum("ntl,ntf->lf", truth - single, x), (seen - joint).sum(axis=(0, 1))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """A field from at most ``sample`` labelled documents of each quality, whose lines get the document's label.

    Only line features leave the executors. Null labels and ids are left out; a doc_id labelled twice counts for both."""
    marked = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", "quality").distinct()
    parts = [marked.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for q in (0, 1)]
    chosen = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, q, line_features(t or b"")[0].astype(np.uint8).tobytes()) for d, t, q in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
            yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["doc_id", "quality", "features"])

    rows = sorted(map(tuple, chosen.select("doc_id", "text", F.col("quality").cast("int")).mapInArrow(featured, "doc_id long, quality int, features binary").collect()))
    x = [(np.frombuffer(f, np.uint8).reshape(-1, _FEATURES).astype(np.float64), q) for _, q, f in rows]
    return Field.train([(f, np.full(len(f), q)) for f, q in x])


def judged(docs: DataFrame, field: Field) -> DataFrame:
    """docs with a struct column ``rules``: the five counts, content_share, base_failed, kept.

    content_share is the share of word characters in lines that Viterbi decoding marks as content. A document fails the base
    rules with fewer than 50 words, or with more than half of its words in repeated 3-word windows; null and empty texts have
    no words and fail. Repeated rows are judged alike; other columns stay, but for one named ``rules``."""
    kind = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_share double, base_failed boolean, kept boolean")
    sent = docs.sparkSession.sparkContext.broadcast((field.weights, field.moves))

    @F.pandas_udf(kind)
    def rules(texts: pd.Series) -> pd.DataFrame:
        own = Field(*sent.value)
        rows = []
        for text in texts:
            c = counts(text)
            failed = c[0] < MIN_WORDS or c[4] > MAX_REPEATED * c[0]
            features, sizes = line_features(text or b"")
            share = float(sizes[np.array(own.viterbi(features), bool)].sum() / sizes.sum()) if len(sizes) else 0.0
            rows.append((*c, share, failed, not failed and share >= MIN_CONTENT))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in kind.split(", ")])

    names = [c for c in docs.columns if c != "rules"]
    return docs.select(*[F.col(f"`{c}`") for c in names]).withColumn("rules", rules(F.col("text").cast("binary")))


def accepted(docs: DataFrame, field: Field) -> DataFrame:
    """The documents that are kept, with the columns they had."""
    return restored(judged(nested(docs), field).where("rules.kept"), docs.columns)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the five counts, base_failed, kept, content_share: one row per document row."""
    found = judged(docs.select("doc_id", "text"), train(docs, labels))
    return found.select("doc_id", *[f"rules.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")])
