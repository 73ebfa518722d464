"""Obfuscation-style features of one raw text, and how they combine over a session.

All features but nesting depth combine with plain max / sum / distinct.  Parenthesis depth is
order-dependent; each block is reduced to four integers that compose associatively, so a long
session never has to be joined into one text.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from huskwatch.functions.text import extract_all

# Style patterns.
B64_RUN = r"[A-Za-z0-9+/]{30,}={0,2}"
CHAR_CODE = r"\[char\]\s*(\d+)"
CALLS = r"\bIEX\b|\bInvoke-Expression\b"
FORMAT_SLOTS = r"""["'](\{[\d\s,:-]+\}(?:\s*\{[\d\s,:-]+\})*+)["']"""
PROFILE = ("total", "high", "rise", "depth")
JOIN_STYLES = [("-join", r"""(?i)-join\s*['"]"""), ("[string]::Join", r"(?i)\[string\]::Join"),
               ("concat", r"""\+\s*['"]""")]


def b64_run_lengths(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(
        F.regexp_extract_all(text, F.lit(B64_RUN), F.lit(0)), F.length)))


def char_codes(text: Column) -> Column:
    """Distinct character codes above 31."""
    codes = F.transform(F.regexp_extract_all(text, F.lit("(?i)" + CHAR_CODE), F.lit(1)),
                        lambda d: d.try_cast("decimal(38,0)"))
    return F.array_sort(F.array_distinct(F.filter(codes, lambda c: c > 31)))


def call_count(text: Column) -> Column:
    return F.size(extract_all(text, CALLS))


def join_style_rank(text: Column) -> Column:
    """Rank (0 first) of the first join idiom found; NULL when none."""
    out = F
    for rank, (_, pattern) in enumerate(JOIN_STYLES):
        out = out.when(text.rlike(pattern), rank)
    return out


def join_style(rank: Column) -> Column:
    out = F
    for no, (name, _) in enumerate(JOIN_STYLES):
        out = out.when(rank == no, name)
    return out


def backticks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("`"), F.lit("")))


def format_slots(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(FORMAT_SLOTS), F.lit(1))
    return F.coalesce(F.array_max(F.transform(found, lambda m: F.regexp_count(m, F.lit(r"\{\d+\}")))), F.lit(0))


def paren_profile(text: Column) -> Column:
    """STRUCT(total, high, rise, depth) of the parenthesis walk of a text.

    ``total`` is the net step and ``high`` the highest prefix (start included); ``rise`` is the
    largest and ``depth`` the last depth when the walk starts at 0 and never goes below 0.
    """
    steps = F.split(F.regexp_replace(text, r"[^()]+", ""), "")
    zero = F.struct(*[F.lit(0).alias(c) for c in PROFILE])

    def walk(a: Column, ch: Column) -> Column:
        d = F.when(ch == "(", 1).when(ch == ")", -1).otherwise(0)
        total = a.getField("total") + d
        depth = F.greatest(F.lit(0), a.getField("depth") + d)
        return F.struct(total.alias("total"), F.greatest(a.getField("high"), total).alias("high"),
                        F.greatest(a.getField("rise"), depth).alias("rise"), depth.alias("depth"))
    return F.aggregate(steps, zero, walk)


def combine_profiles(profiles: Column) -> Column:
    """Fold an ordered array of profiles into one profile."""
    zero = F.struct(*[F.lit(0).alias(c) for c in PROFILE])

    def join(a: Column, b: Column) -> Column:
        ta, tb = a.getField("total"), b.getField("total")
        # Entering b at depth x: the walk is floored at 0, so it ends at max(x + total, depth of b
        # from 0) and peaks at max(x + high, rise of b from 0).
        x = a.getField("depth")
        return F.struct(
            (ta + tb).alias("total"),
            F.greatest(a.getField("high"), ta + b.getField("high")).alias("high"),
            F.greatest(a.getField("rise"), x + b.getField("high"), b.getField("rise")).alias("rise"),
            F.greatest(x + tb, b.getField("depth")).alias("depth"))
    return F.aggregate(profiles, zero, join)
