"""Registered queries of this package and their SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from huskwatch.llm import bpe, chat, decontaminate, html, linededup, lm, negatives, packing, quality, simhash, substring, trie, warc
from huskwatch.llm.common import table



def vocabulary() -> str:
    """Path of the vocabulary file that the BPE queries use; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.digest(table(spark, folder, "documents"))


def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.digest(table(spark, folder, "pages"))


def op3_substring(spark: SparkSession, folder: str) -> DataFrame:
    return substring.digest(table(spark, folder, "documents"))


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.digest(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.digest(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op6_html(spark: SparkSession, folder: str) -> DataFrame:
    return html.extracted(table(spark, folder, "pages"))


def op7_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digest(table(spark, folder, "documents"), vocabulary())


def op8_chat(spark: SparkSession, folder: str) -> DataFrame:
    return chat.digest(chat.with_probe(table(spark, folder, "conversations")))


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return linededup.digest(table(spark, folder, "documents"))


def op10_lm(spark: SparkSession, folder: str) -> DataFrame:
    return lm.digest(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"), vocabulary())


def op12_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return negatives.mined(table(spark, folder, "embeddings"))


def op13_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.digest(table(spark, folder, "conversations"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_simhash, op2_warc, op3_substring, op4_quality, op5_decontamination, op6_html, op7_bpe, op8_chat, op9_line_dedup, op10_lm, op11_packing, op12_negatives, op13_trie, pipeline)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op2_warc": """
with rows as (select page_id, coalesce(html, '') as html from pages),
firsts as (select html, min(page_id) as f from rows where octet_length(encode(html)) >= 100 group by html having count(*) > 1),
joined as (select r.page_id, r.html, f, f is not null and r.page_id is distinct from f as again from rows r left join firsts using (html))
select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes, sha256(html) as payload_digest,
       case when again then 'revisit' else 'response' end as record_type, case when again then f end as refers_to from joined""",
    "op5_decontamination": f"""
with items as (select item_id, {_ITEM_WORDS} as w from benchmark),
places as (select item_id, w, least(len(w), 10) as size, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from items where len(w) > 0),
windows as (select distinct item_id, size, array_to_string(w[i:i + size - 1], ' ') as win from places),
sizes as (select distinct size from windows),
docs as (select row_number() over () as r, doc_id, {_ITEM_WORDS} as w from documents),
spots as (select r, w, size, unnest(range(1, len(w) - size + 2)) as i from docs, sizes where len(w) >= size),
found as (select r, a.size, i, item_id from (select r, size, i, array_to_string(w[i:i + size - 1], ' ') as win from spots) a join windows using (size, win)),
hits as (select r, count(distinct p) as n_hit from (select distinct r, unnest(range(i, i + size)) as p from found) group by r),
named as (select r, count(*) as n_items, sha256(string_agg(s, ',' order by s)) as items_sha256 from (select distinct r, cast(item_id as varchar) as s from found) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hits using (r) left join named using (r)""",
    "op8_chat": r"""
with turns as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
counted as (select *, length(role) + length(text) as plain,
  length(role || '|' || text) - length(replace(role || '|' || text, chr(92), '')) as slashes,
  len(regexp_extract_all(role || '|' || text, '</?s>|<</?SYS>>|\[/?INST\]')) as marks from turns)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
       sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
       cast(sum(plain + slashes + marks + 23) as bigint) as formatted_chars
from counted group by conv_id""",
    "op9_line_dedup": r"""
with docs as (select row_number() over () as r, doc_id, text from documents),
parts as (select r, doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as p from docs where text is not null),
lines as (select *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) as s from parts),
full_lines as (select *, row_number() over (partition by r order by p) as n from lines where s <> ''),
numbers as (select r, count(*) as n_lines from full_lines group by r),
three as (select r, doc_id, n, s as a, lead(s, 1) over w as b, lead(s, 2) over w as c, len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) as words from full_lines window w as (partition by r order by n)),
sized as (select *, lead(words) over (partition by r order by n) as more from three),
windows as (select r, doc_id, n, 3 as size, a, b, c from sized where c is not null
  union all select r, doc_id, n, 1, a, null, null from sized where words >= 50
  union all select r, doc_id, n, 2, a, b, null from sized where words < 50 and words + more >= 50
  union all select r, doc_id, n, -n_lines, a, b, null from sized join numbers using (r) where n = 1 and n_lines < 3),
firsts as (select *, min(row(doc_id, n)) over (partition by size, a, b, c) as f from windows),
gone as (select distinct r, unnest(range(n, n + abs(size))) as n from firsts where row(doc_id, n) > f),
marked as (select l.r, l.p, l.line, g.n is not null as gone from lines l left join full_lines u using (r, p) left join gone g on g.r = u.r and g.n = u.n),
left_over as (select r, string_agg(line, chr(10) order by p) as kept from marked where not gone group by r),
removed as (select r, count(*) as n_removed from gone group by r)
select doc_id, cast(coalesce(n_lines, 0) as bigint) as n_lines, cast(coalesce(n_removed, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from docs left join left_over using (r) left join numbers using (r) left join removed using (r)""",
    "op12_negatives": """
with clean as (select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select a.r as a, a.vec_id as anchor_id, b.r as b, b.vec_id as id, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score
  from clean a join clean b on a.r <> b.r where a.vec_id % 100 = 0),
positives as (select a, anchor_id, b as p, id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by a order by score desc, id) <= 5),
ranked as (select p.anchor_id, positive_id, row_number() over (partition by p.a, p.p order by score desc, id) as rank, id as negative_id, positive_score, score as negative_score
  from positives p join scored s on s.a = p.a and not s.same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from ranked where rank <= 5""",
    "op13_trie": r"""
with ids as (select distinct conv_id, cast(conv_id as varchar) as s from conversations where conv_id is not null),
crcs as (select conv_id, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, len(s) + 1), lambda i: ord(s[i])::bigint)),
    lambda crc, c: list_reduce(list_prepend(xor(crc, c), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 4 as h from ids),
turns as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as n
  from conversations where conv_id is not null),
parts as (select conv_id, 0 as own, n, role, text from turns join crcs using (conv_id) where n > h
  union all select c.conv_id, -1, n, role, text from crcs c join turns t on t.conv_id = c.conv_id - c.conv_id % 20 where n <= h),
placed as (select conv_id, row_number() over (partition by conv_id order by own, n) as d, md5(length(role) || ':' || role || text) as m,
    len(regexp_extract_all(text, '[^ 	-
]+')) as words from parts),
lists as (select c.conv_id, coalesce(list(p.m order by p.d) filter (p.d is not null), []) as path, coalesce(list(p.words order by p.d) filter (p.d is not null), []) as words
  from crcs c left join placed p using (conv_id) group by 1),
prefixes as (select conv_id, d, len(path) = d as ended, case when d = 0 then 0 else words[d] end as words, path[1:d] as node, case when d > 0 then path[1:d - 1] end as up
  from (select *, unnest(range(len(path) + 1)) as d from lists)),
nodes as (select node, any_value(d) as depth, any_value(up) as up, min(conv_id) as conv_id, count(*) as n_convs, any_value(words) as words,
    coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (ended), '') as ends from prefixes group by node),
children as (select up as node, count(*) as n_children from nodes where up is not null group by up),
full_nodes as (select n.*, coalesce(n_children, 0) as n_children from nodes n left join children using (node)),
sums as (select top as node, sum(case when n_children = 0 then 1 else 0 end) as n_leaves, sum((n_convs - 1) * words) as saved_tokens
  from (select *, node[1:unnest(range(depth + 1))] as top from full_nodes) group by top)
select n.conv_id, cast(n.depth as bigint) as depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children, cast(n_leaves as bigint) as n_leaves,
       cast(saved_tokens as bigint) as saved_tokens, sha256(n.ends) as ends_sha256
from full_nodes n join sums using (node) left join nodes p on p.node = n.up""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
