import random

import numpy as np
import pytest
import xxhash

from huskwatch.llm import simhash
from huskwatch.llm.components import components


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    import re
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """{row: smallest id} for rows (id, fingerprint) by comparing all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(doc, fp, least.get(find(i))) for i, (doc, fp) in enumerate(prints)]


def key(r):
    return tuple((x is not None, x) for x in r)


def test_block_links_equal_all_pairs():
    rng = random.Random(3)
    for case in range(60):
        base = [rng.getrandbits(64) for _ in range(3)]
        free = sorted(rng.sample(range(64), 16))
        fps = set()
        while len(fps) < (200 if case % 3 == 0 else 40):
            f = rng.choice(base)
            for b in rng.sample(free, rng.randint(0, 6)):
                f ^= 1 << b
            fps.add(f)
        fixed = ((1 << 64) - 1) & ~sum(1 << b for b in free)
        rows = sorted(((f & fixed) - (1 << 64) if (f & fixed) >> 63 else f & fixed, f) for f in fps)
        radius = case % 4
        block = simhash.Block(np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.uint64), free, radius)
        a, b = block.edges()
        got = {int(f): int(f) for f in fps} | dict(zip(map(int, a), map(int, b), strict=True))
        groups = {}
        for f in fps:
            r = f
            while got[r] != r:
                r = got[r]
            groups.setdefault(r, set()).add(f)
        want, left = set(), set(fps)
        while left:
            part, todo = set(), [left.pop()]
            while todo:
                x = todo.pop()
                part.add(x)
                near = {y for y in left if bin(x ^ y).count("1") <= radius and (x ^ y) & fixed == 0}
                left -= near
                todo += near
            want.add(frozenset(part))
        assert {frozenset(g) for g in groups.values()} == want


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)} | {201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("rows", [
    [],
    [(1, None, 0), (2, "", 0), (3, " \n", 0), (None, "", 0)],
    [(5, "One Two", 1), (4, "one  two", 1), (6, "one", 1), (6, "one", 1), (6, "two words more than that", 1)],
])
def test_edge_cases(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = [(r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in simhash.digest(docs).collect()]
    assert sorted(got, key=key) == sorted(plain_components([(d, plain_fingerprint(t)) for d, t, _ in rows]), key=key)
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert kept.count() == simhash.clusters(docs).select("cluster").distinct().count()


def test_near_copies_equal_all_pairs(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for group in range(12):
        text = [rng.choice(words) for _ in range(rng.randint(5, 400))]
        for copy in range(rng.randint(1, 25)):
            own = list(text)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((len(rows), " ".join(own)))
    rows.append((len(rows), "ends with a long text " + "many words " * 40000))
    got = simhash.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    want = plain_components([(d, plain_fingerprint(t)) for d, t in rows])
    assert sorted((r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in got) == sorted(want)
