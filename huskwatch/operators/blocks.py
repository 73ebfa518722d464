"""Block-level pass: decode, reassembly, rule matching and per-block features.

Everything derived from text is computed here, next to the scan, in one map-side projection;
later operators shuffle only the narrow results.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huskwatch.catalog.rules import Rule, builtin_rules
from huskwatch.functions import style
from huskwatch.functions.decode import decode
from huskwatch.functions.scoring import block_severity
from huskwatch.functions.text import (block_hash, clean, credentials, indicators, let,
                                      required_literal, shannon_entropy, shared_pieces, terms)

SIDE = 40        # context characters kept on each side of a hit
FINDING = ("struct<rule_no:int,pattern_no:int,hit_no:int,rule_name:string,technique_id:string,"
           "mitre_id:string,severity:int,matched_text:string,context:string,confidence:double>")


def decode_blocks(blocks: DataFrame, text: str = "raw_text") -> DataFrame:
    """Add decoded_text and the audit columns of the decode job."""
    out = blocks.withColumn("_d", decode(F.col(text)))
    return (out.withColumn("decoded_text", F.col("_d.decoded"))
            .withColumn("passes_run", F.col("_d.passes_run"))
            .withColumn("transforms_applied", F.col("_d.transforms_applied"))
            .drop("_d"))


def reassemble(blocks: DataFrame, bulky_parts: int = 100_000) -> DataFrame:
    """Merge complete multi-part blocks; pass singles and incomplete parts through.

    Completeness is decided on a narrow count per block id.  Parts of an id that has more than
    ``bulky_parts`` of them and is not complete are set aside before the join, so they are never
    brought together; whether those few ids are broadcast is decided by their measured size.
    """
    singles = blocks.filter(F.col("block_total") <= 1)
    parts = blocks.filter(F.col("block_total") > 1)
    counts = parts.groupBy("block_id").agg(
        F.count("*").alias("_n"),
        F.min_by("block_total", F.struct("block_number", "ts")).alias("_want"))
    bulky = counts.filter((F.col("_n") > bulky_parts) & (F.col("_n") != F.col("_want"))).select("block_id")
    marked = (parts.join(bulky, "block_id", "left_anti").join(counts, "block_id")
              .withColumn("_complete", F.col("_n") == F.col("_want")))
    other = [c for c in blocks.columns if c not in
             ("block_id", "block_number", "block_total", "raw_text", "decoded_text", "entropy")]
    merged = (marked.filter("_complete").groupBy("block_id")
              .agg(F.array_sort(F.collect_list(F.struct(
                  "block_number", "ts", "raw_text", "decoded_text",
                  *[F.col(c).alias("_" + c) for c in other]))).alias("_p"))
              .select("block_id",
                      F.lit(1).alias("block_number"), F.lit(1).alias("block_total"),
                      F.array_join(F.transform("_p", lambda p: p.getField("raw_text")), "").alias("raw_text"),
                      F.array_join(F.transform("_p", lambda p: p.getField("decoded_text")), "").alias("decoded_text"),
                      *[F.col("_p")[0].getField("_" + c).alias(c) for c in other]))
    columns = [c for c in blocks.columns if c != "entropy"]
    out = (singles.select(columns)
           .unionByName(merged.select(columns))
           .unionByName(marked.filter(~F.col("_complete")).select(columns))
           .unionByName(parts.join(bulky, "block_id", "left_semi").select(columns)))
    return out.withColumn("entropy", shannon_entropy(F.col("raw_text"))) if "entropy" in blocks.columns else out


def _hits(text: Column, regex: Column) -> Column:
    """All hits of one pattern: matched text (first 120 characters) and context (first 160).

    Contexts come from the pieces around each hit: the last SIDE characters before it lie in at
    most SIDE earlier hits and gaps, since a hit is never empty.
    """
    span = 2 * SIDE

    def build(s: Column) -> Column:
        m = s.getField("m")
        pieces = F.flatten(F.zip_with(s.getField("parts"), m, lambda p, x: F.array(p, F.coalesce(x, F.lit("")))))

        def with_edges(e: Column) -> Column:
            def hit(x: Column, i: Column) -> Column:
                at = 2 * i + 1                                   # 1-based place of the gap before hit i
                first = F.greatest(F.lit(1), at - span)
                left = F.right(F.array_join(F.slice(e.getField("tail"), first, at - first + 1), ""), F.lit(SIDE))
                right = F.left(F.array_join(F.slice(e.getField("head"), at + 2, F.lit(span + 1)), ""), F.lit(SIDE))
                context = clean(F.translate(F.concat(left, x, right), "\n", " "))
                return F.struct(i.alias("hit_no"), F.left(x, F.lit(120)).alias("matched_text"),
                                F.left(context, F.lit(160)).alias("context"))
            return F.transform(m, hit)
        return let(F.struct(F.transform(pieces, lambda p: F.right(p, F.lit(SIDE))).alias("tail"),
                            F.transform(pieces, lambda p: F.left(p, F.lit(SIDE))).alias("head")), with_edges)
    found = F.regexp_extract_all(text, regex, F.lit(0))
    return F.when(F.rlike(text, regex), let(F.struct(F.split(text, regex, -1).alias("parts"), found.alias("m")), build))


def rule_hits(text: Column, rules: list[Rule]) -> Column:
    """Findings array of a text: every hit of every pattern, in rule, pattern and text order.

    The catalogue is a constant array.  Two substring gates (a short piece shared by many patterns,
    then the literal a match must contain) pick the few patterns worth running as regular
    expressions.
    """
    gates = {p: required_literal(p) for rule in rules for p in rule.patterns}
    pieces = shared_pieces(sorted(set(gates.values())))
    groups: dict[str, list[Column]] = {}
    for rule_no, rule in enumerate(rules):
        for pattern_no, pattern in enumerate(rule.patterns):
            groups.setdefault(pieces[gates[pattern]], []).append(F.struct(
                F.lit(rule_no).alias("rule_no"), F.lit(pattern_no).alias("pattern_no"),
                F.lit(gates[pattern]).alias("gate"),
                F.lit(pattern).alias("regex"), F.lit(rule.name).alias("rule_name"),
                F.lit(rule.technique_id).alias("technique_id"), F.lit(rule.mitre_id).alias("mitre_id"),
                F.lit(rule.severity).alias("severity")))
    catalogue = F.array(*[F.struct(F.lit(piece).alias("piece"), F.array(*entries).alias("entries"))
                          for piece, entries in groups.items()])
    # Letters outside ASCII that a case-insensitive match takes for i, s or k.
    ascii_only = F.octet_length(text) == F.length(text)
    folded = F.when(ascii_only | ~text.rlike("[İıſK]"), F.lower(text)).otherwise(
        F.lower(F.translate(text, "İıſK", "iisk")))
    # Pure ASCII texts need no Unicode classes, which are much slower.
    flags = F.when(ascii_only, "(?imd)").otherwise("(?imdU)")

    def run(p: Column) -> Column:
        found = let(F.concat(flags, p.getField("regex")), lambda regex: _hits(text, regex))
        return F.transform(F.coalesce(found, F.array().cast(
            "array<struct<hit_no:int,matched_text:string,context:string>>")), lambda h: F.struct(
                p.getField("rule_no").alias("rule_no"), p.getField("pattern_no").alias("pattern_no"),
                h.getField("hit_no").alias("hit_no"), p.getField("rule_name").alias("rule_name"),
                p.getField("technique_id").alias("technique_id"), p.getField("mitre_id").alias("mitre_id"),
                p.getField("severity").alias("severity"), h.getField("matched_text").alias("matched_text"),
                h.getField("context").alias("context"), F.lit(1.0).alias("confidence")))
    def gated(low: Column) -> Column:
        near = F.filter(catalogue, lambda g: F.contains(low, g.getField("piece")))
        return F.sort_array(F.flatten(F.transform(near, lambda g: F.filter(
            g.getField("entries"), lambda p: F.contains(low, p.getField("gate"))))))
    return F.flatten(F.transform(let(folded, gated), run)).cast(f"array<{FINDING}>")


def entropy_fallback(text: Column, entropy: Column, above: float = 6.0) -> Column:
    """One low-confidence finding for a long, high-entropy text that no rule matched."""
    one = F.array(F.struct(
        F.lit(-1).alias("rule_no"), F.lit(0).alias("pattern_no"), F.lit(0).alias("hit_no"),
        F.lit("entropy_heuristic").alias("rule_name"), F.lit("HIGH_ENTROPY_BLOB").alias("technique_id"),
        F.lit("T1059.001").alias("mitre_id"), F.lit(40).alias("severity"),
        F.format_string("entropy=%.2f", entropy).alias("matched_text"),
        F.left(text, F.lit(80)).alias("context"), F.lit(0.5).alias("confidence"))).cast(f"array<{FINDING}>")
    return F.when((entropy > above) & (F.length(text) > 300), one).otherwise(
        F.array().cast(f"array<{FINDING}>"))


def classify(blocks: DataFrame, rules: list[Rule] | None = None, blob_entropy: float = 6.0,
             bonus_entropy: float = 5.5) -> DataFrame:
    """Add ``findings`` and ``severity`` to blocks; one map-side pass, no shuffle."""
    rules = builtin_rules() if rules is None else rules
    text = F.when(F.length("decoded_text") > 0, F.col("decoded_text")).otherwise(F.col("raw_text"))
    entropy = F.col("entropy")
    out = blocks.withColumn("_text", text).withColumn("_hits", rule_hits(F.col("_text"), rules))
    out = out.withColumn("findings", F.when(F.size("_hits") > 0, F.col("_hits")).otherwise(
        entropy_fallback(F.col("_text"), entropy, blob_entropy)))
    return (out.withColumn("severity", block_severity(
        F.col("findings"), entropy, F.col("decoded_text"), bonus_entropy))
            .drop("_text", "_hits"))


def explode_findings(blocks: DataFrame, *keys: str) -> DataFrame:
    """One row per finding with the given key columns."""
    keys = keys or ("block_id", "block_number")
    return (blocks.select(*keys, F.explode_outer("findings").alias("f"))
            .filter(F.col("f").isNotNull()).select(*keys, "f.*"))


def block_features(blocks: DataFrame) -> DataFrame:
    """Narrow per-block row: everything later stages need, without the texts."""
    raw, dec = F.col("raw_text"), F.col("decoded_text")
    return blocks.select(
        "block_id", "block_number", "host_id", "process_id", "ts", "path", "entropy", "severity", "findings",
        F.array_distinct(F.transform("findings", lambda f: f.getField("technique_id"))).alias("techniques"),
        (dec != raw).alias("changed"),
        block_hash(dec).alias("content_hash"),
        indicators(dec).alias("iocs"),
        credentials(dec).alias("creds"),
        terms(dec).alias("terms"),
        F.length(raw).alias("raw_chars"),
        style.char_codes(raw).alias("char_codes"),
        style.b64_run_lengths(raw).alias("b64_runs"),
        style.call_count(raw).alias("calls"),
        style.paren_profile(raw).alias("parens"),
        style.join_style_rank(raw).alias("join_rank"),
        style.backticks(raw).alias("ticks"),
        style.format_slots(raw).alias("slots"))
