import hashlib
import io
import random

import pytest

from huskwatch.llm import warc


def archive(pages, compressed):
    parts = [warc.page_record(i, f"http://x/{i}", p, None, False) for i, p in pages]
    return [warc.member(p) if compressed else p for p in parts]


def names(data):
    found = list(warc.salvage(io.BytesIO(data)))
    spans = [(x.start, x.end) for x in found]
    assert spans == sorted(spans) and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and (not spans or spans[-1][1] == len(data) and spans[0][0] == 0)
    return [int(x.headers["Page-Id"]) for x in found if not x.gap], [(x.start, x.end, x.gap) for x in found if x.gap]


@pytest.mark.parametrize("compressed", [True, False])
def test_salvage_recovers_everything_around_damage(compressed):
    rng = random.Random(5)
    pages = [(i, rng.randbytes(rng.choice([0, 10, 900, 20_000])) + b"\r\n\r\nWARC/1.0\r\nfake" * (i % 3 == 0)) for i in range(30)]
    parts = archive(pages, compressed)
    assert names(b"".join(parts)) == (list(range(30)), [])
    for _ in range(40):
        hit = sorted(rng.sample(range(30), rng.randint(1, 4)))
        own = list(parts)
        for h in hit:
            at = rng.randrange(1, len(own[h]) - 4)
            own[h] = rng.choice([own[h][:at], own[h][:at] + b"XY" + own[h][at + 2:], own[h][:at] + rng.randbytes(50) + own[h][at:]])
        good, gaps = names(b"".join(own))
        assert set(range(30)) - set(hit) <= set(good)
        assert (len(good) == 30) == (not gaps)


def test_salvage_of_odd_files():
    assert names(b"") == ([], [])
    assert names(b"no archive at all") == ([], [(0, 17, "header end")])
    whole = b"".join(archive([(1, b"a"), (2, b"b" * 3_000_000)], True))
    assert names(b"junk" * 20 + whole)[0] == [1, 2]
    assert names(whole[:-5])[0] == [1]


@pytest.mark.parametrize("compressed", [False, True])
@pytest.mark.parametrize("size", [1000, 200_000, 3_000_000])
def test_salvage_after_a_damaged_first_record(compressed, size):
    """However long the damaged beginning, the records behind it are found, in either form."""
    rng = random.Random(size)
    parts = archive([(1, rng.randbytes(size)), (2, rng.randbytes(500)), (3, b"c" * 500)], compressed)
    for at in (0, 1, len(parts[0]) // 2):
        own = parts[0][:at] + bytes([parts[0][at] ^ 0x55]) + parts[0][at + 1:]
        good, gaps = names(own + parts[1] + parts[2])
        assert good == [2, 3] and len(gaps) == 1 and gaps[0][:2] == (0, len(own))


def test_write_and_read_back(spark):
    body = "é" * 60
    rows = [(3, "u", body), (1, "u\nx%", body), (None, None, body), (2, "v", "short"), (4, "v", "short"), (5, "w", None), (1, "again", body), (6, "x", "z" * 5_000_000)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, digest int")
    got = sorted(map(tuple, warc.digest(pages).collect()), key=str)
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        other = len(raw) >= 100 and html == body and page != 1
        want.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if other else "response", 1 if other else None))
    assert got == sorted(want, key=str)
    found = warc.read(warc.write(pages, compressed=False, archive_bytes=100)).collect()
    assert {(r["page_id"], r["url"]) for r in found} == {(p, u or "") for p, u, _ in rows}
    assert all(r["payload"] is None or hashlib.sha256(r["payload"]).hexdigest() == r["digest"] for r in found)
    assert warc.digest(pages.limit(0)).collect() == []
