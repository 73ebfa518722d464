import random
import re

import pytest

from huskwatch.llm import linededup


def brute(rows, run, words=50):
    lines = [[x.strip(" \t\x0b\x0c\r") for x in (t or "").split("\n")] for _, t in rows]
    full = [[(i, x) for i, x in enumerate(ls) if x] for ls in lines]
    order = lambda doc, n: (doc is None, doc or 0, n)

    def windows(ls):
        plain = [x for _, x in ls]
        if 0 < len(plain) < run:
            yield 0, len(plain), ("whole", *plain)
        for n in range(len(plain)):
            for k in range(1, run + 1):
                part = plain[n:n + k]
                if len(part) == k and (k == run or sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in part) >= words):
                    yield n, k, tuple(part)

    first = {}
    for (doc, _), ls in zip(rows, full, strict=True):
        for n, _, w in windows(ls):
            first[w] = min(first.get(w, order(doc, n)), order(doc, n))
    out = []
    for (doc, text), ls in zip(rows, full, strict=True):
        gone = set()
        for n, k, w in windows(ls):
            if first[w] < order(doc, n):
                gone.update(range(n, n + k))
        drop = {ls[n][0] for n in gone}
        out.append((str(doc), None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop), len(ls), len(gone)))
    return sorted(out, key=str)


def run_op(spark, rows, run):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lines int").repartition(3)
    return sorted(((str(r["doc_id"]), r["text"], r["lines"]["n_lines"], r["lines"]["n_removed"]) for r in linededup.deduplicate(docs, run).collect()), key=str)


@pytest.mark.parametrize("frequent", [20_000, 0])
@pytest.mark.parametrize("run", [1, 3])
def test_equals_brute_force(spark, monkeypatch, run, frequent):
    monkeypatch.setattr(linededup, "FREQUENT", frequent)
    rng = random.Random(run)
    parts = [[f"line {rng.randint(0, 9)}" for _ in range(rng.randint(2, 9))] for _ in range(5)]
    rows = []
    for d in range(80):
        lines = []
        for _ in range(rng.randint(0, 4)):
            lines += rng.choice(parts) if rng.random() < 0.6 else [f"own {rng.random()} ", " ", "é\t"][: rng.randint(1, 3)]
        rows.append((d, "\n".join(lines)))
    rows += [(None, rows[5][1]), (None, rows[5][1]), (3, rows[4][1]), (rows[6][0], rows[6][1]), (90, None), (91, ""), (92, "a\na\na\na\na\na")]
    assert run_op(spark, rows, run) == brute(rows, run)


def test_scope_keeps_the_earliest():
    import numpy as np
    scope = linededup.Scope(np.zeros(8, bool), 2)
    for doc in (5, 2, 2, 9, None):
        scope.add(doc, doc or 0, linededup.full_lines(b"a\nb\nc"))
    rows = [r for b in scope.flush() for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert {r[2] for r in rows if r[1] is not None} == {2}
    assert sorted(str(r[2]) for r in rows if r[1] is None) == sorted(["5", "9", "None"] * (len(rows) // 4))


def test_empty_and_long(spark):
    assert run_op(spark, [], 3) == []
    rows = [(1, "\n".join(f"l{i}" for i in range(50_000))), (2, "\n".join(f"l{i}" for i in range(40_000, 60_000)))]
    assert run_op(spark, rows, 3) == brute(rows, 3)


def test_long_lines_and_short_texts(spark):
    """One or two lines of 50 words, whole copies of texts of few lines, and nothing shorter."""
    long, half, other = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("a", 50), ("b", 30), ("c", 30)))
    rows = [(1, f"x\n{long}\ny"), (2, f"{long}"), (3, f"z\n{half}\n{other}\nz2"), (4, f"{half}\n{other}"), (5, half), (6, half), (7, f"{half}\nown"), (8, "few words"), (9, " few words\n"), (10, "few words\nand"),
            (11, f"{long}\n{long}"), (12, f"q\n{half}\n\n {other}\nr"), (None, "few words"), (2, long)]
    got = run_op(spark, rows, 3)
    assert got == brute(rows, 3)
    left = {r[0]: r[1] for r in got}
    assert left["2"] == "" and left["4"] == "" and left["5"] == half and left["6"] == "" and left["7"] == f"{half}\nown" and left["12"] == "q\n\nr" and left["10"] == "few words\nand" and left["None"] == ""
