import bisect
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from huskwatch.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def best_fit(histogram, capacity):
    rooms, n = [], 0
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            i = bisect.bisect_left(rooms, length)
            room = (rooms.pop(i) if i < len(rooms) else capacity) - length
            n += room == capacity - length and i == len(rooms)
            if room:
                bisect.insort(rooms, room)
    return n


def check(histogram, plan):
    used = Counter()
    for config, copies in plan.made:
        assert copies > 0 and sum(k * n for k, n in config.items()) <= plan.capacity
        for k, n in config.items():
            used[k] += n * copies
    assert used == Counter(histogram) and plan.sequences >= plan.bound


@pytest.mark.parametrize("seed", range(4))
def test_plans_hold_every_length_once(seed):
    rng = random.Random(seed)
    for capacity, low, high, n in ((100, 1, 100, 400), (100, 30, 60, 300), (64, 20, 24, 90), (2048, 100, 900, 500)):
        histogram = dict(Counter(rng.randint(low, high) for _ in range(n)))
        plan = packing.solve(histogram, capacity)
        check(histogram, plan)
        assert plan.sequences <= 1.01 * best_fit(histogram, capacity) + 1


def test_few_plans_are_optimal():
    assert packing.solve({}, 8).sequences == 0 and packing.solve({}, 8).runs()["length"].size == 0
    for histogram, capacity, least in (({8: 5}, 8, 5), ({5: 4, 3: 4}, 8, 4), ({1: 17}, 8, 3), ({4: 3}, 8, 2), ({6: 2, 2: 1, 1: 2}, 8, 2), ({1: 10**9}, 2048, -(-10**9 // 2048))):
        plan = packing.solve(histogram, capacity)
        check(histogram, plan)
        assert plan.sequences == least
    with pytest.raises(ValueError):
        packing.solve({9: 1}, 8)


def test_pricing_equals_plain_knapsack():
    price = np.full(21, -np.inf)
    for k, v in {3: 2.0, 5: 4.5, 7: 6.1}.items():
        price[k] = v
    best, _ = packing.priced(price, 20)
    want = [max(a * 2.0 + b * 4.5 + c * 6.1 for a in range(7) for b in range(5) for c in range(3) if 3 * a + 5 * b + 7 * c <= room) for room in range(21)]
    assert best == pytest.approx(want)


def test_packed_documents(spark):
    rng = random.Random(5)
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    texts = [" ".join(rng.choice("the of law code run 12 naïve Ünder x,y".split()) for _ in range(rng.choice([0, 1, 3, 20, 60, 400]))) for _ in range(300)]
    texts += [None, "", "same text"] + ["same text"] * 40 + ["\U000323b0 Ᲊ new letters", "x" * 3000]
    rows = [(i if i != 7 else None, t, "p", i) for i, t in enumerate(texts)] + [(3, texts[3], "p", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string, sequence_id int").repartition(5)
    got = packing.packed(docs, PATH, 64).collect()
    want = Counter()
    for doc, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        for n, at in enumerate(range(0, len(ids), 64)):
            part = ids[at:at + 64]
            want[doc, n, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    histogram = dict(Counter(r.length for r in got))
    assert len(places) == packing.solve(histogram, 64).sequences <= best_fit(histogram, 64) + 1


def test_no_documents(spark):
    found = packing.packed(spark.createDataFrame([], "doc_id long, text string"), PATH)
    assert found.count() == 0 and found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
