"""Decode job: unwrap obfuscated script text to a fixed point with column expressions only.

Ten transforms run in a fixed order; passes repeat until nothing changes or ``max_passes`` is
reached.  The whole loop is one expression per row, so the job is a map-side projection: no
shuffle, no driver loop.  Rows without any trigger skip it after a cheap test.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from huskwatch.catalog.lookups import ENV_VALUES, REVERSED_MARKS, SCRIPT_MARKS
from huskwatch.functions.text import let, replace_matches

MAX_PASSES = 12

# Patterns of the wrapped forms (written with possessive groups so that long lists
# do not deepen the matcher's stack).
JOIN_PATTERN = r"""(?iU)\(\s*((?:["'][^"']*+["'](?:\s*,\s*)?+)++)\)\s*-join\s*["']["']"""
CHAR_PATTERN = r"(?i)\[char\]\s*(\d+)"
CHAR_HEX_PATTERN = r"(?i)\[char\]\s*0x([0-9a-fA-F]+)"
# Two codes of one spelling with a short gap in between (groups: mark, gap).
CHAR_PAIR = r"(?i)(\[char\]\s*+)\d++([^\d\[\\]{0,4}+)\1"
CHAR_HEX_PAIR = r"(?i)(\[char\]\s*+0x)[0-9a-fA-F]++([^0-9a-fA-F\[\\]{0,4}+)\1"
HEX_LIST_PATTERN = r"(?:0x[0-9a-fA-F]{2}\s*,\s*(?=0x[0-9a-fA-F]{2})){3,}+0x[0-9a-fA-F]{2}"
B64_CALL_PATTERN = (r"""(?i)\[(?:System\.)?Convert\]::FromBase64String\s*\(\s*['"]"""
                    r"""([A-Za-z0-9+/=\s]+)['"]\s*\)""")
B64_RUN_PATTERN = r"(?<![A-Za-z0-9+/])([A-Za-z0-9+/]{60,}={0,2})(?![A-Za-z0-9+/])"
FORMAT_PATTERN = (r"""(?i)["'](\{[\d\s,:-]+\}(?:\{[\d\s,:-]+\})*+)["']\s*-f\s*"""
                  r"""((?:["'][^"']*+["'](?:\s*,\s*)?+)++)""")
REPLACE_PATTERN = r"""(?i)\.Replace\s*\(\s*['"]([^'"]*)['"]\s*,\s*['"]([^'"]*)['"\s]*\)"""
ENV_PATTERN = r"""(?i)\$env:(\w+)\s*\[\s*([\d,\s]+)\s*\]\s*-join\s*['"]['"]"""
SECURE_PATTERN = r"""(?i)ConvertTo-SecureString\s+['"]([^'"]+)['"]\s+-AsPlainText"""
NETCRED_PATTERN = (r"""(?i)Net\.NetworkCredential\s*\(\s*['"]([^'"]+)['"]\s*,"""
                   r"""\s*['"]([^'"]+)['"]""")
QUOTED = r"""["']([^"']*)["']"""
# Bytes (as hex) that form valid UTF-16LE.
UTF16_HEX = r"^(?:..(?:[0-9A-CEF].|D[0-7])|..D[89AB]..D[C-F])*+$"


def looks_like_script(text: Column) -> Column:
    low = F.lower(text)
    marks = F.array(*[F.lit(m) for m in SCRIPT_MARKS])
    return (F.length(text) >= 5) & let(low, lambda t: F.exists(marks, lambda m: F.contains(t, m)))


def _chr(code: Column) -> Column:
    """Character of a code point; NULL when out of range."""
    wide = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.coalesce(_ascii(code), F.when(code.between(0xD800, 0xDFFF), F.lit("\ufffd"))
                      .when(code.between(0, 0x10FFFF), wide))


def _ascii(code: Column) -> Column:
    """Character of a code point below 128, by a look-up; NULL for others."""
    return F.get(F.array(*[F.lit(chr(i)) for i in range(128)]), code.try_cast("int"))


def _replace_codes(text: Column, pattern: str, pair: str, plain: Callable[[Column, Column], Column],
                   lookup: Callable[[Column], Column], render: Callable[..., Column]) -> Column:
    """``replace_matches`` for texts that are mostly character codes.

    Where two codes stand side by side, their gap and mark, as written there, cut the text wherever the regular
    expression ``plain(gap, cut)`` finds a short code behind them: a piece that is that code alone takes ``lookup``,
    NULL for any other piece.  These, and the one before the first cut, get their mark back and take the pattern.  No
    match reaches across a cut, since it holds one bracket, its first, and a gap holds neither brackets nor digits.
    """
    def whole(t: Column) -> Column:
        return replace_matches(t, pattern, render)

    def rebuild(s: Column) -> Column:
        t, mark, gap = s.getField("t"), s.getField("mark"), s.getField("gap")
        cut = F.concat(F.lit(r"\Q"), gap, mark, F.lit(r"\E"))
        parts = F.when(mark == "", F.array(t)).otherwise(F.split(t, F.concat(cut, plain(gap, cut)), -1))
        return let(parts, lambda p: F.call_function("array_join", F.concat(
            F.array(whole(F.get(p, F.lit(0)))),
            F.transform(F.slice(p, 2, F.size(p)), lambda c: F.coalesce(lookup(c), whole(F.concat(mark, c))))), gap))

    return let(text, lambda t: let(F.struct(
        t.alias("t"), F.regexp_extract(t, pair, 1).alias("mark"), F.regexp_extract(t, pair, 2).alias("gap")), rebuild))


def unwrap_backtick(t: Column) -> Column:
    return F.regexp_replace(t, "`([A-Za-z])", "$1")


def unwrap_join(t: Column) -> Column:
    return replace_matches(t, JOIN_PATTERN, lambda m, items: F.array_join(
        F.regexp_extract_all(items, F.lit(QUOTED), F.lit(1)), ""))


def unwrap_char_decimal(t: Column) -> Column:
    def plain(gap: Column, cut: Column) -> Column:
        ends = F.when(gap == "", F.lit(r"\[")).otherwise(cut)
        return F.concat(F.lit(r"(?=\d{1,3}+(?:"), ends, F.lit(r"|\z))"))
    return _replace_codes(t, CHAR_PATTERN, CHAR_PAIR, plain, _ascii, lambda m, d: _chr(d.try_cast("bigint")))


def unwrap_char_hex(t: Column) -> Column:
    return _replace_codes(
        t, CHAR_HEX_PATTERN, CHAR_HEX_PAIR, lambda gap, cut: F.lit("(?=[0-7]?[0-9a-fA-F](?![0-9a-fA-F]))"),
        lambda h: F.unhex(h).cast("string"),
        lambda m, h: _chr(F.when(F.length(F.ltrim(h, F.lit("0"))) <= 8, F.conv(h, 16, 10).try_cast("bigint"))))


def unwrap_hex_list(t: Column) -> Column:
    def render(m: Column) -> Column:
        digits = F.array_join(F.regexp_extract_all(m, F.lit("0x([0-9a-fA-F]{2})"), F.lit(1)), "")
        return let(F.make_valid_utf8(F.unhex(digits).cast("string")),
                   lambda d: F.when(looks_like_script(d), F.concat(F.lit('"'), d, F.lit('"'))))
    return replace_matches(t, HEX_LIST_PATTERN, render, groups=0)


def _b64_bytes(raw: Column) -> Column:
    """Bytes of a base64 text, white space dropped and padding repaired; NULL when not decodable."""
    body = F.regexp_extract(F.regexp_replace(raw, r"\s", ""), r"^[A-Za-z0-9+/]*", 0)
    return let(body, lambda b: F.when(
        F.length(b) % 4 != 1,
        F.try_to_binary(F.rpad(b, (F.ceil(F.length(b) / 4) * 4).cast("int"), F.lit("=")), F.lit("base64"))))


def _utf16(data: Column) -> Column:
    return F.when(F.hex(data).rlike(UTF16_HEX), F.regexp_replace(
        F.decode(data, "UTF-16LE"), r"^\x00+|\x00+$", ""))


def unwrap_base64_call(t: Column) -> Column:
    return replace_matches(t, B64_CALL_PATTERN, lambda m, raw: let(
        _utf16(_b64_bytes(raw)), lambda d: F.when(d.rlike(r"^[ [^\p{C}\p{Z}]]+$"), d)))


def unwrap_base64_run(t: Column) -> Column:
    def fits(d: Column) -> Column:
        return F.when((F.length(d) > 10) & looks_like_script(d), d)

    def render(m: Column, raw: Column) -> Column:
        return let(_b64_bytes(raw), lambda data: F.coalesce(
            let(_utf16(data), fits),
            let(F.regexp_replace(F.try_validate_utf8(data.cast("string")), r"^\x00+|\x00+$", ""), fits)))
    return replace_matches(t, B64_RUN_PATTERN, render)


def unwrap_format(t: Column) -> Column:
    def render(m: Column, fmt: Column, args: Column) -> Column:
        parts = F.regexp_extract_all(args, F.lit(QUOTED), F.lit(1))
        slots = F.regexp_extract_all(fmt, F.lit(r"\{(\d+)\}"), F.lit(1))
        picked = let(parts, lambda p: F.array_join(
            F.transform(slots, lambda s: F.get(p, s.try_cast("int"))), ""))
        return let(picked, lambda r: F.when(r != "", r))
    return replace_matches(t, FORMAT_PATTERN, render, groups=2)


def unwrap_replace_calls(t: Column) -> Column:
    for _ in range(5):
        t = F.regexp_replace(t, REPLACE_PATTERN, "")
    return t


def unwrap_reversed(t: Column) -> Column:
    """Reverse the quoted literal around the first occurrence of a reversed marker."""
    def flip(text: Column, case: Column) -> Column:
        quote = case.getField("quote")

        def cut(i: Column) -> Column:
            before = F.substring(text, F.lit(1), i - 1)
            after = F.substring(text, i, F.length(text))
            back = F.instr(F.reverse(before), quote)
            ahead = F.instr(after, quote)
            inner = F.concat(F.right(before, back - 1), F.substring(after, F.lit(1), ahead - 1))
            return F.when((i > 0) & (back > 0) & (ahead > 0), F.concat(
                F.substring(before, F.lit(1), F.length(before) - back + 1), F.reverse(inner),
                F.substring(after, ahead, F.length(after)))).otherwise(text)
        return let(F.instr(F.lower(text), case.getField("marker")), cut)

    cases = F.array(*[F.struct(F.lit(m).alias("marker"), F.lit(q).alias("quote"))
                      for m in REVERSED_MARKS for q in ('"', "'")])
    return F.aggregate(cases, t, flip)


def unwrap_env(t: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in ENV_VALUES.items() for x in kv])

    def render(m: Column, name: Column, picks: Column) -> Column:
        base = F.try_element_at(known, F.lower(name))
        index = F.transform(F.split(picks, ","), lambda p: F.trim(F.regexp_replace(p, r"\s", " ")).try_cast("int"))
        word = let(base, lambda b: let(index, lambda ix: F.when(
            ~F.exists(ix, lambda i: i.isNull()),
            F.array_join(F.transform(ix, lambda i: F.substring(b, i + 1, F.lit(1))), ""))))
        return let(word, lambda w: F.when(w != "", w))
    return replace_matches(t, ENV_PATTERN, render, groups=2)


def mark_credentials(t: Column) -> Column:
    marked = F.regexp_replace(t, SECURE_PATTERN, r'"[PLAINTEXT_CRED:$1]"')
    return F.regexp_replace(marked, NETCRED_PATTERN, r'"[CREDENTIAL:$1:$2]"')


# Order matters: name, transform, substrings of which a text must hold one (empty: base64 run).
TRANSFORMS = [
    ("backtick", unwrap_backtick, ["`"]),
    ("join", unwrap_join, ["-join"]),
    ("char_concat", unwrap_char_decimal, ["[char]"]),
    ("char_concat", unwrap_char_hex, ["[char]"]),
    ("hex_strings", unwrap_hex_list, ["0x"]),
    ("base64", unwrap_base64_call, ["frombase64string"]),
    ("base64", unwrap_base64_run, []),
    ("format_string", unwrap_format, ["-f"]),
    ("replace_chain", unwrap_replace_calls, [".replace"]),
    ("reversed", unwrap_reversed, REVERSED_MARKS),
    ("env_vars", unwrap_env, ["$env:"]),
    ("securestring", mark_credentials, ["convertto-securestring", "net.networkcredential"]),
]


def _gate(text: Column, low: Column, marks: list[str]) -> Column:
    if not marks:
        return text.rlike(r"[A-Za-z0-9+/]{60}")
    cond = F.contains(low, F.lit(marks[0]))
    for m in marks[1:]:
        cond = cond | F.contains(low, F.lit(m))
    return cond


def _apply(text: Column, step: Column) -> Column:
    """The transform numbered ``step`` applied to ``text`` when its gate holds."""
    def choose(low: Column) -> Column:
        branch = F
        for no, (_, fn, marks) in enumerate(TRANSFORMS):
            branch = branch.when((step == no) & _gate(text, low, marks), fn(text))
        return F.coalesce(branch.otherwise(text), text)
    return let(F.lower(text), choose)


def decode(text: Column, max_passes: int = MAX_PASSES) -> Column:
    """STRUCT(decoded, passes_run, transforms_applied, changed) for a text column."""
    return let(text, lambda t: _decode(t, max_passes))


def _decode(text: Column, max_passes: int) -> Column:
    last = len(TRANSFORMS) - 1
    names = F.array(*[F.lit(n) for n, _, _ in TRANSFORMS])
    none = F.array().cast("array<string>")

    def state(t, applied, passes, start, done):
        return F.struct(t.alias("t"), applied.alias("applied"), passes.alias("passes"),
                        start.alias("start"), done.alias("done"))

    def advance(acc: Column, i: Column) -> Column:
        step = i % len(TRANSFORMS)
        before, applied = acc.getField("t"), acc.getField("applied")
        name = F.get(names, step)
        ends = step == last

        def after(t: Column) -> Column:
            new = (t != before) & ~F.array_contains(applied, name)
            return state(
                t, F.when(new, F.array_append(applied, name)).otherwise(applied),
                acc.getField("passes") + ends.cast("int"),
                F.when(ends, t).otherwise(acc.getField("start")),
                ends & (t == acc.getField("start")))
        return F.when(acc.getField("done"), acc).otherwise(let(_apply(before, step), after))

    begin = state(text, none, F.lit(0), text, F.lit(False))
    loop = F.aggregate(F.sequence(F.lit(0), F.lit(max_passes * len(TRANSFORMS) - 1)), begin, advance)
    marks = sorted({m for _, _, ms in TRANSFORMS for m in ms})
    touched = let(F.lower(text), lambda low: _gate(text, low, marks)) | _gate(text, text, [])
    clean = state(text, none, F.lit(1), text, F.lit(True))
    return let(F.when(touched, loop).otherwise(clean), lambda r: F.struct(
        r.getField("t").alias("decoded"), r.getField("passes").alias("passes_run"),
        r.getField("applied").alias("transforms_applied"),
        (r.getField("t") != text).alias("changed")))
