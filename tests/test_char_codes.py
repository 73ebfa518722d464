"""Character codes: every form against Python's re, and long runs against the transform match by match."""
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from huskwatch.functions import decode as D
from huskwatch.functions.text import replace_matches

FORMS = {"decimal": (D.unwrap_char_decimal, D.CHAR_PATTERN, 10), "hex": (D.unwrap_char_hex, D.CHAR_HEX_PATTERN, 16)}
MARKS = ["[char]", "[CHAR]", "[Char] ", "[char]\t\n", "[char]\x01", "[char]0x", "[CHAR] 0x", "[char]0X", "[char", "[[char]"]
CODES = ["65", "7", "0", "00", "065", "41", "7f", "80", "9F", "127", "128", "0041", "255", "1055", "4E2D", "128512", "1F600", "55296", "D800", "1114111",
         "1114112", "10FFFF", "110000", "00000000041", "99999999999", "9" * 30, "", "+65", "-5", "6 5", "6.5"]
GAPS = ["", "+", " + ", ",", " ", "\n", "\x7f", "\\E", "\\", ".", "$1", "x", "0", "e", "é", "\U0001F600", "; ", "] [", "long gap here", "٣"]


def want(text: str, form: str) -> str:
    _, pattern, base = FORMS[form]

    def one(m: re.Match) -> str:
        code = int(m[1], base)
        return m[0] if code > 0x10FFFF else "�" if 0xD800 <= code <= 0xDFFF else chr(code)
    return re.sub(pattern, one, text, flags=re.A)


def texts() -> list[str]:
    rnd, out = random.Random(11), ["", "65", "65[char]66", "x 65+[char]66+[char]67", "[char]65[char]66 ", "[char]65 [char]66 [char]67 \t", "[char]0x41[char]0x4"]
    for _ in range(600):
        mark, gap = rnd.choice(MARKS), rnd.choice(GAPS)
        parts = []
        for _ in range(rnd.randint(1, 12)):
            odd = rnd.random()
            parts += [rnd.choice(GAPS) if odd < 0.15 else gap, rnd.choice(MARKS) if 0.1 < odd < 0.25 else mark,
                      rnd.choice(CODES) if odd > 0.6 else str(rnd.randint(32, 99))]
        out.append("".join(parts[rnd.randint(0, 2):] + [rnd.choice(GAPS)]))
    return out


@pytest.mark.parametrize("form", FORMS)
def test_every_form(spark, form):
    rows = spark.createDataFrame([*enumerate(texts()), (-1, None)], "i int, t string").repartition(4)
    got = {r.i: r.v for r in rows.select("i", FORMS[form][0](F.col("t")).alias("v")).collect()}
    assert got.pop(-1) is None
    for i, t in enumerate(texts()):
        assert got[i] == want(t, form), repr(t)


@pytest.mark.parametrize("form,spelt", [("decimal", "[char]%d"), ("hex", "+[CHAR] 0x%X")])
def test_long_runs_cost_less_than_match_by_match(spark, form, spelt):
    """A run of codes takes at most half the time of rendering it match by match, and gives the same text."""
    fn, pattern, base = FORMS[form]
    plain = "The quick brown fox jumps over the lazy dog " * 1500
    run = "".join(spelt % ord(c) for c in plain)
    rows = spark.range(0, 64, 1, 8).select(F.concat(F.lit(run), F.col("id").cast("string")).alias("t")).localCheckpoint()

    def single(m, d):
        return F.decode(F.unhex(F.lpad(F.hex(F.conv(d, base, 10).try_cast("bigint")), 8, "0")), "UTF-32")

    def seconds(column):
        best = []
        for _ in range(2):
            t0 = time.monotonic()
            got = sorted(r.h for r in rows.select(F.sha2(column, 256).alias("h")).collect())
            best.append(time.monotonic() - t0)
        return min(best), got

    slow, quick = seconds(replace_matches(F.col("t"), pattern, single)), seconds(fn(F.col("t")))
    assert quick[1] == slow[1]
    assert quick[0] < slow[0] / 2, (quick[0], slow[0])
