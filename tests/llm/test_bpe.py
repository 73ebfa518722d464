import hashlib
import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from huskwatch.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def own():
    with open(PATH) as f:
        return bpe.Codec(json.load(f))


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def ids(own, text):
    return list(memoryview(own.encode(text)).cast("I"))


def test_equals_the_library(own, library):
    rng = random.Random(0)
    bits = ["the", "in", "an", "re", "A", "é", "Ω", "Σ", "'s", "'LL", " ", "\n", "é", "ͅ", "1", "2", "$", "<|endoftext|>", "<|startoftext|>x", "<|", "İ", "ß", "😀", "​",
            " ", "　", "\x1c", "\x85", "x", "..", ",", "z", "\x00", "ñ", "中文", "ǅ"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 20)))
        want = library.encode(text, add_special_tokens=False).ids
        assert ids(own, text) == want, repr(text)
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)


def test_stream_with_lookahead_equals_the_library(own, library):
    rng = random.Random(1)
    assert 16 < own.lookahead < 5000
    for n in range(120):
        letters = rng.choice(["ab", "abc", "in", "tha", "aeinrst", "abcdefghijklmnopqrstuvwxyz", "!?", "=-", "é", "a"])
        text = "".join(rng.choice(letters) for _ in range(rng.randint(own.lookahead, own.lookahead * 9)))
        assert ids(own, text) == library.encode(text, add_special_tokens=False).ids


def test_lookahead_is_what_keeps_tokens_stable(own):
    rng = random.Random(2)
    for _ in range(200):
        word = "".join(rng.choice("thaeinrs") for _ in range(60))
        symbols = [*map(own.inner.__getitem__, word.encode()[:-1]), own.last[ord(word[-1])]]
        full = own._merged(list(symbols))
        assert list(own.stream(symbols)) == full


def test_memo_of_bounded_size_changes_nothing(own, monkeypatch):
    text = " ".join(f"word{i % 700}x" for i in range(3000))
    want = own.encode(text)
    monkeypatch.setattr(bpe, "REMEMBERED", 8000)
    own._chunks, own._pieces = bpe.Recent(), bpe.Recent()
    assert own.encode(text) == want and len(own._chunks.new) <= 50


def test_readable_text(own):
    assert "".join(own.text(ids(own, "Hello  été 😀!<|endoftext|>"))) == "hello été 😀! <|endoftext|>"
    broken = ids(own, "é")[:1]
    assert "".join(own.text([own.inner[0xC3], own.inner[0x41], *broken])).startswith("�A")


def test_digest(spark, library):
    rows = [(1, "Some text, été.", "x"), (2, None, "x"), (3, "", "x"), (None, " \n", "x"), (1, "Some text, été.", "x"), (4, "long " * 100_000 + "w" * 20_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bpe string")
    got = sorted((tuple(r)[:4] for r in bpe.digest(docs, PATH).collect()), key=str)
    shown = {r["doc_id"]: r["text_sha256"] for r in bpe.digest(docs, PATH).collect()}
    assert shown[1] == hashlib.sha256("some text , été . ".encode()).hexdigest() and shown[2] == hashlib.sha256(b"").hexdigest()
    assert [r["bpe"]["decoded"] for r in bpe.coded(docs.where("doc_id = 1").limit(1), PATH).collect()] == [library.decode(library.encode("Some text, été.", add_special_tokens=False).ids, skip_special_tokens=False)]
    want = []
    for doc, text, _ in rows:
        i = library.encode(text or "", add_special_tokens=False).ids
        raw = b"".join(x.to_bytes(4, "little") for x in i)
        want.append((doc, len(i), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode(i, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.digest(docs.limit(0), PATH).collect() == []
