"""Small scoring expressions shared by operators and views."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from huskwatch.catalog.lookups import BAND_RANK, BANDS, CHAINS, TIER_RANK, TIERS


def alert_tier(score: Column) -> Column:
    out = F
    for tier, low, _ in TIERS:
        out = out.when(score >= low, tier)
    return out.when(score > 0, "INFO").otherwise("CLEAN")


def tier_rank(tier: Column) -> Column:
    out = F
    for name, rank in TIER_RANK.items():
        out = out.when(tier == name, rank)
    return out.otherwise(0)


def tier_of_rank(rank: Column) -> Column:
    out = F
    for name, r in TIER_RANK.items():
        out = out.when(rank == r, name)
    return out.otherwise("CLEAN")


def severity_band(severity: Column) -> Column:
    out = F
    for band, low in BANDS:
        out = out.when(severity >= low, band)
    return out.otherwise("low")


def band_rank(band: Column) -> Column:
    out = F
    for name, r in BAND_RANK.items():
        out = out.when(band == name, r)
    return out.otherwise(4)


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def chain_hits(techniques: Column, chains=None) -> Column:
    """ARRAY<STRUCT<label, points>> of the kill-chain rules that fire on a technique set."""
    made = []
    for c in (CHAINS if chains is None else chains):
        cond = F.lit(True)
        if c.get("all_of"):
            cond = cond & F.forall(_strings(c["all_of"]), lambda t: F.array_contains(techniques, t))
        for group in c.get("any_of", []):
            cond = cond & F.arrays_overlap(techniques, _strings(group))
        if c.get("pool"):
            cond = cond & (F.size(F.array_intersect(techniques, _strings(c["pool"]))) >= c["at_least"])
        made.append(F.struct(F.lit(c["label"]).alias("label"), F.lit(c["points"]).alias("points"),
                             F.coalesce(cond, F.lit(False)).alias("hit")))
    return F.transform(F.filter(F.array(*made), lambda x: x.getField("hit")),
                       lambda x: F.struct(x.getField("label").alias("label"),
                                          x.getField("points").alias("points")))


def chain_points(hits: Column) -> Column:
    return F.aggregate(hits, F.lit(0), lambda acc, x: acc + x.getField("points"))


def block_severity(findings: Column, entropy: Column, decoded: Column, bonus_entropy: float = 5.5) -> Column:
    """0-100 severity of one block from its findings array."""
    top = F.array_max(F.transform(findings, lambda f: f.getField("severity")))
    kinds = F.size(F.array_distinct(F.transform(findings, lambda f: f.getField("technique_id"))))
    fired = F.least(F.lit(100), top + F.least(F.lit(15), (kinds - 1) * 8)
                    + F.when(entropy > bonus_entropy, 10).otherwise(0))
    quiet = F.when((entropy > 6.0) & (F.length(decoded) > 500), 40).otherwise(0)
    return F.when(F.size(findings) > 0, fired).otherwise(quiet).cast("int")
