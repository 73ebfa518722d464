import base64
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from huskwatch.functions import style
from huskwatch.functions import text as X
from huskwatch.functions.decode import decode
from huskwatch.functions.net import ip_to_long, is_public, subnet24


def entropy(t):
    n = len(t)
    return -sum(c / n * math.log2(c / n) for c in Counter(t).values()) if t else 0.0


def test_entropy(spark):
    texts = ["", "aaaa", "aB3xKj9mRnTqLpVwYzFsEuHcDiOgN2+/==", "é😀ab😀", "".join(chr(0x4E00 + i % 900) for i in range(3000))]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.shannon_entropy(F.col("t")).alias("e")).collect()
    for r in rows:
        assert abs(r.e - entropy(texts[r.i])) < 1e-9


COMMAND = "Invoke-Expression (New-Object Net.WebClient).DownloadString"
UTF16 = base64.b64encode(COMMAND.encode("utf-16-le")).decode()
UTF8 = base64.b64encode(b"powershell -nop -w hidden; get-item something quite long").decode()
CASES = [
    ("pow`ersh`ell", "powershell", ["backtick"], 2),
    ("('I','E','X') -join ''", "IEX", ["join"], 2),
    ("[char]73+[char]69+[char]88", "I+E+X", ["char_concat"], 2),
    ("[char]128512 [char]55296 [char]99999999999", "\U0001F600 \ufffd [char]99999999999", ["char_concat"], 2),
    ('"{0}{2}{1}" -f "po","hell","wers"', "powershell", ["format_string"], 2),
    ("x 0x69,0x65,0x78, 0x20, 0x24", 'x "iex $"', ["hex_strings"], 2),
    ("x 0x41,0x42,0x43,0x44,", "x 0x41,0x42,0x43,0x44,", [], 1),
    (f"[Convert]::FromBase64String('{UTF16}')", COMMAND, ["base64"], 2),
    ("run " + UTF16, "run " + COMMAND, ["base64"], 2),
    ("run " + UTF8, "run powershell -nop -w hidden; get-item something quite long", ["base64"], 2),
    ("'abc'.Replace('a','b').Replace(\"c\",'')", "'abc'", ["replace_chain"], 2),
    ("$x='llehsrewop neddih'", "$x='hidden powershell'", ["reversed"], 2),
    ("$env:ComSpec[4,26,25]-join''", "iex", ["env_vars"], 2),
    ('ConvertTo-SecureString "pw1" -AsPlainText -Force', '"[PLAINTEXT_CRED:pw1]" -Force', ["securestring"], 2),
    ("Net.NetworkCredential('u','p')", '"[CREDENTIAL:u:p]")', ["securestring"], 2),
    ("Write-Host 'nothing hidden'", "Write-Host 'nothing hidden'", [], 1),
    ("", "", [], 1),
    ("('p`o','w') -join ''; [char]65", "pow; A", ["backtick", "join", "char_concat"], 2),
    ("($x) [char]65" * 100, "($x) A" * 100, ["char_concat"], 2),
]


def test_decode_cases(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, t string")
    for r in df.select("i", decode(F.col("t")).alias("d")).select("i", "d.*").collect():
        text, want, names, passes = CASES[r.i]
        assert (r.decoded, r.transforms_applied, r.passes_run, r.changed) == (want, names, passes, want != text), text


def test_decode_nested_and_long(spark):
    inner = base64.b64encode(("iex " + "[char]65" * 30 + " powershell").encode()).decode()
    outer = base64.b64encode(("powershell run " + inner).encode()).decode()
    long_list = "(" + ",".join(f"'{c}'" for c in "get-item " * 2000) + ") -join ''"
    rows = spark.createDataFrame([(0, outer), (1, long_list)], "i int, t string").select("i", decode(F.col("t")).alias("d")).orderBy("i").collect()
    assert rows[0].d.decoded == "powershell run iex " + "A" * 30 + " powershell"
    assert rows[0].d.passes_run <= 12
    assert rows[1].d.decoded == "get-item " * 2000


def test_indicators_match_reference_semantics(spark):
    text = ("see http://10.0.0.5/a.ps1' and 10.0.0.6, é10.0.0.7 hash 0123456789abcdef0123456789abcdef "
            "path C:\\Users\\x\\y.txt) https://Host/x>y HTTP://UP/z")
    want = re.findall(r'https?://[^\s\'")\]>]+|\b(?:\d{1,3}\.){3}\d{1,3}\b|\b[0-9a-fA-F]{32,64}\b|C:\\[^\s\'")\]>]{5,}', text, re.I)
    got = spark.createDataFrame([(text,)], "t string").select(X.indicators(F.col("t")).alias("v")).first().v
    assert sorted(set(want)) == sorted(got)


@pytest.mark.parametrize("value,kind,feed", [
    ("https://a/b", "url", "url"), ("1.2.3.4", "ip", "ip"), ("A" * 32, "hash", "hash"), ("C:\\x", "path", "unknown"),
    ("evil.example.com", "other", "domain"), ("nothing", "other", "unknown")])
def test_types(spark, value, kind, feed):
    r = spark.createDataFrame([(value,)], "v string").select(X.ioc_type(F.col("v")).alias("a"), X.feed_ioc_type(F.col("v")).alias("b")).first()
    assert (r.a, r.b) == (kind, feed)


def test_net(spark):
    import ipaddress
    ips = ["8.8.8.8", "10.1.2.3", "127.0.0.1", "169.254.1.1", "172.31.0.1", "172.32.0.1", "192.168.1.1", "999.1.1.1", "198.18.0.1", "203.0.113.9", "240.0.0.1", "01.2.3.4"]
    rows = spark.createDataFrame([(i,) for i in ips], "v string").select("v", ip_to_long(F.col("v")).alias("n"), is_public(F.col("v")).alias("p"), subnet24(F.col("v")).alias("s")).collect()
    for r in rows:
        try:
            a = ipaddress.ip_address(r.v)
        except ValueError:
            assert r.n is None and not r.p and r.s is None
            continue
        assert r.n == int(a) and r.p == (not a.is_private and not a.is_loopback and not a.is_link_local), r.v
        assert r.s == str(ipaddress.ip_network(f"{r.v}/24", strict=False))


def depth(text):
    d = top = 0
    for ch in text:
        d = d + 1 if ch == "(" else max(0, d - 1) if ch == ")" else d
        top = max(top, d)
    return top


def test_paren_profiles_compose(spark):
    import random
    rnd = random.Random(7)
    texts = ["".join(rnd.choice("()a") for _ in range(rnd.randint(0, 30))) for _ in range(40)]
    chunks = [texts[i:i + 4] for i in range(0, 40, 4)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(chunks)], "i int, ts array<string>")
    got = df.select("i", style.combine_profiles(F.transform("ts", style.paren_profile)).getField("rise").alias("r")).collect()
    for r in got:
        assert r.r == depth("\n".join(chunks[r.i]))


def test_style_features(spark):
    t = "iex('a'+\"b\"); Invoke-Expression `x`; [char]65 [CHAR]10; \"{0}{1}\" -f 'x'; " + "A" * 40
    r = spark.createDataFrame([(t,)], "t string").select(
        style.char_codes(F.col("t")).alias("c"), style.b64_run_lengths(F.col("t")).alias("b"), style.call_count(F.col("t")).alias("n"),
        style.join_style(style.join_style_rank(F.col("t"))).alias("j"), style.backticks(F.col("t")).alias("k"), style.format_slots(F.col("t")).alias("s")).first()
    assert ([int(x) for x in r.c], r.b, r.n, r.j, r.k, r.s) == ([65], [40], 2, "concat", 2, 2)
