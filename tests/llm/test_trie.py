import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

from huskwatch.llm import trie


def plain(rows):
    """Brute force: every prefix of every rebuilt conversation as a tuple."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full = own.get(c - c % 20, [])[:h] + turns[h:]
        for d in range(len(full) + 1):
            members[tuple(full[:d])].append(c)
        ends[tuple(full)].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, own_members in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(own_members) - 1) * words
    return Counter((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n, m in members.items())


def found(spark, rows, parts=3):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, path string, shard int").repartition(parts)
    return Counter(tuple(r) for r in trie.digest(frame).collect())


def made(rng, convs, spread):
    rows = []
    for c in convs:
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, ["user", "assistant"][t % 2], rng.choice(["one", "two words", "three\tof them", ""][:spread])))
    return rows


def test_equals_brute_force_in_small_shards(spark, monkeypatch):
    rng = random.Random(1)
    rows = made(rng, range(400), 4) + [(c, t, "user", "the same") for c in range(400, 700) for t in range(3)] + [(1000, t, "user", f"turn {t % 3}") for t in range(150)]
    rows += [(1001 + n, t, "user", f"turn {t % 3}") for n in range(3) for t in range(140 + n)]
    want = plain(rows)
    assert found(spark, rows) == want
    walk = trie._cut
    for size, turns in ((1, 1 << 16), (7, 1 << 16), (50, 20)):
        monkeypatch.setattr(trie, "_cut", _small(walk, size, turns))
        assert found(spark, rows) == want


def _small(cut, size, turns):
    def small(batches):  # the bounds must change in the worker
        from huskwatch.llm import trie

        old, trie.SHARD, trie.TURNS = (trie.SHARD, trie.TURNS), size, turns
        try:
            yield from cut(batches)
        finally:
            trie.SHARD, trie.TURNS = old
    return small


def test_odd_turns(spark):
    rows = [(0, None, None, None), (0, None, None, None), (0, 2, "user", "é  ü"), (-5, 1, "", "a"), (-25, 1, "a", ""), (-20, 0, "x", "y"), (3, 0, None, "a"), (3, 0, None, "a"), (None, 0, "user", "lost"), (7, 5, "u:", "b"), (8, 5, "u", ":b"),
            (21, 0, "user", "no first of the family"), (9, 1, "user", "w " * 50_000), (10**15, 0, "user", "far")]
    rows += [(c, 0, "user", "hi") for c in range(40, 60)]
    # a negative id's family begins at c - c % 20 with the sign of SQL's remainder, towards zero
    signed = {(r[0]): r[0] - (abs(r[0]) % 20) * (1 if r[0] >= 0 else -1) for r in rows if r[0] is not None}
    assert signed[-25] == -20
    positive = [r for r in rows if r[0] is None or r[0] >= 0]
    assert found(spark, positive) == plain(positive)
    assert sum(found(spark, rows).values()) >= sum(plain(positive).values())


def test_turnless_and_empty(spark):
    assert found(spark, []) == Counter()
    lone = [c for c in range(61, 80) if zlib.crc32(str(c).encode()) % 4 >= 1]
    rows = [(c, 0, "user", "gone") for c in lone]  # the first turn would come from an absent conversation
    got = found(spark, rows)
    assert got == plain(rows) == Counter({(min(lone), 0, None, len(lone), 0, 1, 0, hashlib.sha256(",".join(map(str, lone)).encode()).hexdigest()): 1})
