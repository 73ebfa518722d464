"""BPE encoding by a bounded-lookahead streaming transducer, and decoding by a byte-to-text state machine.

The vocabulary file is a JSON of merges over byte symbols with a word-end suffix; its path is a parameter."""
from __future__ import annotations

import json
import re
import unicodedata
from array import array
from codecs import getincrementaldecoder
from collections.abc import Iterable, Iterator
from functools import cache
from hashlib import sha256
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from huskwatch.llm.common import give_back

#: Bytes of text pieces and their ids that one generation of a memo holds; results do not depend on it.
REMEMBERED = 16 << 20
#: What an entry costs beside its own bytes.
_ENTRY = 150
#: Bytes of ids and texts that a worker holds at once, unless one row has more, and ids whose text is hashed at once.
_HELD, _STEP = 2 << 20, 1 << 14


def byte_symbols() -> dict[int, str]:
    """The printable symbol of each byte: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@cache
def members(kind: str) -> str:
    """The inside of a character class with all characters whose general category starts with ``kind``."""
    out, start = [], None
    for c in range(0x110001):
        inside = c < 0x110000 and unicodedata.category(chr(c))[0] == kind
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"{chr(start)}-{chr(c - 1)}")
            start = None
    return "".join(out)


#: Lower-case forms that Python's own tables do not have yet (fixed values of Unicode 16).
NEWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {c: c + 0x20 for c in range(0x10D50, 0x10D66)}


#: Capital sigma and dotted I, whose lower case Python makes depend on what surrounds them, and the letters above.
LATE = regex.compile("[\u03a3\u0130" + "".join(map(chr, NEWER)) + "]")
ID_BITS = 24
ID_MASK = (1 << ID_BITS) - 1
NEVER = 1 << 62


class Recent:
    """A memo of bounded bytes: the entries used since it was last full stay, the others go. ``new`` may be read directly."""

    def __init__(self, most: int | None = None) -> None:
        self.most, self.held = most, 0
        self.new: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def find(self, key: str) -> bytes | None:
        if (got := self.older.get(key)) is not None:
            self.put(key, got)
        return got

    def put(self, key: str, value: bytes) -> None:
        size = _ENTRY + len(key) + len(value)
        if self.held + size > (self.most or REMEMBERED):
            self.older = dict(self.new)
            self.new.clear()
            self.held = 0
        self.new[key] = value
        self.held += size


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, spec: dict) -> None:
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.piece = re.compile(re.sub(r"\\p\{(L|N)\}", lambda m: members(m[1]), pattern.replace(r"\s", " ")))  # the pattern has its classes in brackets
        symbols = byte_symbols()
        self.inner = [vocab.get(symbols[b]) for b in range(256)]
        self.last = [vocab.get(symbols[b] + self.suffix) for b in range(256)]
        #: Rank and new id of a pair in one integer, so that the smallest is the next merge.
        self.merge: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merge.setdefault((vocab[a], vocab[b]), rank << ID_BITS | vocab[a + b])
        self.token = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for text, i in [*vocab.items(), *self.special.items()]:
            self.token[i] = text
        self.lookahead = self._lookahead()
        self._chunks, self._pieces = Recent(), Recent()
        byte = {s: bytes([b]) for b, s in symbols.items()}
        own = set(self.special.values())
        #: The bytes of each token; a word's end gives a space.
        self.raw = [t.encode() if i in own else b"".join(byte.get(c, b"") for c in t.removesuffix(self.suffix)) + b" " * (bool(self.suffix) and t.endswith(self.suffix)) for i, t in enumerate(self.token)]

    def _lookahead(self) -> int:
        """Symbols beyond a token's end that can still change it.

        Text that follows changes the segmentation only from its own border leftwards. Each merge that moves the border
        left by its left part has a later rank than the merge before, and its right part begins with the part that moved
        last. The longest such chain, in symbols, is the bound; one more symbol stands for the word's end."""
        size = {i: 1 for i in [*self.inner, *self.last] if i is not None}
        left: dict[int, int] = {}
        reach: dict[int, int] = {}
        most = 0
        for (a, b), value in self.merge.items():
            new = value & ID_MASK
            size.setdefault(new, size[a] + size[b])
            left.setdefault(new, a)
            far, part = 0, b
            while part is not None:
                far = max(far, reach.get(part, 0))
                part = left.get(part)
            reach[a] = max(reach.get(a, 0), size[a] + far)
            most = max(most, reach[a])
        return most + 1

    def _merged(self, ids: list[int]) -> list[int]:
        """All merges of a symbol sequence, lowest rank first, leftmost among equals."""
        get = self.merge.get
        pairs = [get(p, NEVER) for p in zip(ids, ids[1:])]
        while pairs and (best := min(pairs)) != NEVER:
            i = pairs.index(best)
            ids[i] = new = best & ID_MASK
            del ids[i + 1], pairs[i]
            if i:
                pairs[i - 1] = get((ids[i - 1], new), NEVER)
            if i < len(pairs):
                pairs[i] = get((new, ids[i + 1]), NEVER)
        return ids

    def stream(self, symbols: Iterable[int]) -> Iterator[int]:
        """Tokens of a symbol stream, each as soon as it is stable; holds at most four times the lookahead."""
        keep, held, count = self.lookahead, [], 0
        for s in symbols:
            held.append(s)
            if len(held) < 4 * keep:
                continue
            count = 0
            for t in self._merged(list(held)):
                if count + self._width(t) > len(held) - keep:
                    break
                count += self._width(t)
                yield t
            del held[:count]
        yield from self._merged(held)

    @cache  # noqa: B019  one codec lives as long as its worker
    def _width(self, token: int) -> int:
        text = self.token[token]
        return len(text.removesuffix(self.suffix)) if self.suffix else len(text)

    def _piece(self, piece: str) -> bytes:
        """Ids of one pre-token, as little-endian unsigned 32-bit integers."""
        if (got := self._pieces.new.get(piece) or self._pieces.find(piece)) is not None:
            return got
        raw = piece.encode()
        symbols = [*map(self.inner.__getitem__, raw[:-1]), self.last[raw[-1]]]
        if None in symbols:
            symbols = [i for i in symbols if i is not None]
        if len(symbols) > self.lookahead:
            return array("I", self.stream(symbols)).tobytes()
        out = array("I", self._merged(symbols)).tobytes()
        self._pieces.put(piece, out)
        return out

    def _chunk(self, chunk: str) -> bytes:
        """Ids of text without white space."""
        if (got := self._chunks.find(chunk)) is not None:
            return got
        if chunk.isascii():
            text = chunk.lower()
        else:
            text = "".join(c.lower() for c in unicodedata.normalize("NFC", chunk).translate(NEWER)) if LATE.search(chunk) else unicodedata.normalize("NFC", chunk).lower()
        body = text.rstrip(".,")
        if body.isalpha():  # letters with a full stop or comma, or nothing, behind: the common case of the pattern
            out = self._piece(body) + self._piece(text[len(body):]) if len(body) < len(text) else self._piece(text)
        else:
            out = b"".join(map(self._piece, self.piece.findall(text)))
        if len(chunk) <= 64:
            self._chunks.put(chunk, out)
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text; special tokens in it count as such."""
        out, at = [], 0
        if any(map(text.__contains__, self.special)):
            for m in self.split_special.finditer(text):
                out += [*map(self._chunk, WHITE.split(text[at:m.start()])), array("I", [self.special[m[0]]]).tobytes()]
                at = m.end()
        known, chunk = self._chunks.new.get, self._chunk
        pieces = (text[at:] if at else text)
        pieces = pieces.split() if not ODD.search(pieces) else WHITE.split(pieces)
        out += [known(p) or chunk(p) for p in pieces]
        return b"".join(out)

    def decode(self, ids: Iterable[int]) -> str:
        """The library's own decode without a decoder: the tokens' strings, joined by one space."""
        return " ".join(map(self.token.__getitem__, ids))

    def text(self, ids: Iterable[int]) -> Iterator[str]:
        """Readable text by a state machine over the tokens' bytes, which holds at most one incomplete character between steps."""
        machine, rest = getincrementaldecoder("utf-8")("replace"), iter(ids)
        while step := list(islice(rest, _STEP)):
            yield machine.decode(b"".join(map(self.raw.__getitem__, step)))
        yield machine.decode(b"", final=True)


#: White space of the vocabulary's own rule, and the characters where Python's split() differs from it.
WHITE = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
ODD = regex.compile(r"[\x1c-\x1f]")


@cache
def codec(spec: str) -> Codec:
    return Codec(json.loads(spec))


def read_spec(spark: SparkSession, path: str) -> str:
    """The vocabulary file's text, read by Spark, or by the driver where the file is its own."""
    from huskwatch.llm.common import local_path

    if (own := local_path(path)) is not None:
        with open(own, encoding="utf-8") as f:
            return f.read()
    return spark.read.text(path, wholetext=True).first()[0]


def coded(docs: DataFrame, vocabulary: str, whole: bool = True) -> DataFrame:
    """docs with a struct column ``bpe``: n_tokens, ids (little-endian unsigned 32-bit), ids_sha256, decoded_sha256, text_sha256
    and, if ``whole``, decoded.

    decoded is the library's text (token strings joined by spaces), text the state machine's readable one; both are hashed step
    by step in the worker. Null texts count as empty: no ids, empty text. The vocabulary text is broadcast; its size does not
    depend on the rows."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(docs.sparkSession, vocabulary))

    names = [c for c in docs.columns if c != "bpe"]
    rows = docs.select(*[F.col(f"`{c}`") for c in names])
    fields = {"n_tokens": (T.LongType(), pa.int64()), "ids": (T.BinaryType(), pa.binary()), "ids_sha256": (T.StringType(), pa.string()), "decoded_sha256": (T.StringType(), pa.string()), "text_sha256": (T.StringType(), pa.string())}
    fields |= {"decoded": (T.StringType(), pa.string())} if whole else {}
    kind = T.StructType([*rows.schema.fields, T.StructField("bpe", T.StructType([T.StructField(n, t) for n, (t, _) in fields.items()]))])
    at = names.index("text")

    def one(own: Codec, text: str | None) -> tuple:
        raw = own.encode(text) if text else b""
        ids, decoded, shown = memoryview(raw).cast("I"), sha256(), sha256()
        for i in range(0, len(ids), _STEP):
            decoded.update((" " * bool(i) + own.decode(ids[i:i + _STEP])).encode())
        for part in own.text(ids):
            shown.update(part.encode("utf-8", "surrogatepass"))
        return len(ids), raw, sha256(raw).hexdigest(), decoded.hexdigest(), shown.hexdigest(), *([own.decode(ids)] if whole else [])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(spec.value)
        struct = pa.struct([(n, t) for n, (_, t) in fields.items()])

        def part(batch: pa.RecordBatch, first: int, out: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array([x[i] for x in out], struct.field(i).type) for i in range(len(fields))]
            return pa.RecordBatch.from_arrays([*batch.slice(first, len(out)).columns, pa.StructArray.from_arrays(columns, fields=list(struct))], names=[*names, "bpe"])

        for batch in batches:
            first, held, out = 0, 0, []
            for text in batch.column(at):
                out.append(one(own, text.as_py()))
                held += len(out[-1][1]) * (4 if whole else 2)
                if held >= _HELD:
                    yield part(batch, first, out)
                    first, held, out = first + len(out), 0, []
            if out:
                yield part(batch, first, out)
        give_back()

    return rows.mapInArrow(code, kind)


def digest(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, text_sha256 (of the readable text): one row per document row."""
    found = coded(docs.select("doc_id", "text"), vocabulary, whole=False)
    return found.select("doc_id", *[F.col(f"bpe.{c}").alias(c) for c in ("n_tokens", "ids_sha256", "decoded_sha256", "text_sha256")])
