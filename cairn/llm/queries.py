"""The operators applied to their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import (
    ann,
    chat,
    codec,
    extraction,
    hard_negatives,
    maxent,
    near,
    order_minhash,
    packing,
    pii_crf,
    quality,
    structure,
    warc,
)
from cairn.llm.common import importable, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def add(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable(spark)
            return build(spark, sf_dir)

        QUERIES[name] = run
        return build

    return add


@query("op1_skip_chain_crf")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii_crf.detect(docs, pii_crf.fit(docs))


@query("op2_seekable_warc")
def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_bundles(table(spark, sf_dir, "pages"))
    records = warc.read_bundles(index, with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op3_lsh_forest_join")
def near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.similarity_classes(table(spark, sf_dir, "documents"))


@query("op4_tree_scoring")
def main_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


@query("op5_best_fit_packing")
def packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), size=1024)


@query("op6_maxent_scores")
def language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(table(spark, sf_dir, "documents"))


@query("op7_order_minhash")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints(table(spark, sf_dir, "documents"))


@query("op8_word_table_bpe")
def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.encode(table(spark, sf_dir, "documents"))


@query("op9_weak_label_quality")
def good_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "keep", F.round("score", 6).alias("score"), "votes", "n_words")


@query("op10_robust_graph_search")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


@query("op11_survivor_viterbi")
def repaired_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.repaired_damage(table(spark, sf_dir, "conversations"))


@query("op12_chat_machine")
def formatted_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.format_chats(chat.with_probe(table(spark, sf_dir, "conversations"))))


@query("op13_threshold_negatives")
def negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine_table(table(spark, sf_dir, "embeddings"))


def _repair_sql() -> str:
    """The repair as a recursion over the rows of all conversations: cost and letters of the best way to each state.

    A way is its cost in nine digits followed by its letters, so that the least text is the best way.
    """

    def plus(way: str, cost: str, letter: str) -> str:
        return f"lpad(cast(cast(left({way}, 9) as bigint) + {cost} as varchar), 9, '0') || substr({way}, 10) || '{letter}'"

    def least(*ways: str) -> str:
        return f"least({', '.join(ways)})" if len(ways) > 1 else ways[0]

    def on(test: str, way: str) -> str:
        return f"case when {test} then {way} end"

    to_user = ("s0", "s1", "s3")
    user_kept = [on("not r.unwanted and r.initial = 'u'", plus(s, "r.late", "K")) for s in to_user]
    user_made = [on("not r.unwanted", plus(s, "2 + r.late", "R")) for s in to_user]
    n0 = plus("s0", "3", "D")
    n1 = least(plus("s1", "3", "D"), on("not r.unwanted and r.initial = 's'", plus("s0", "r.late", "K")))
    m2 = least(plus("s2", "3", "D"), *user_kept, *user_made)
    m3 = least(
        plus("s3", "3", "D"),
        on("not r.unwanted and r.initial = 'a'", plus("s2", "r.late", "K")),
        on("not r.unwanted", plus("s2", "2 + r.late", "R")),
    )
    return rf"""
with recursive base as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    xor(list_reduce([ascii(x) for x in string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), '')],
      lambda c, b: list_reduce(range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b::bigint)), 4294967295), 4294967295) % 20 as draw
  from conversations
), damaged as (
  select conv_id, turn, case when draw = 4 then 'user' else role end as role,
    case when draw = 1 then '' when draw = 2 then translate(text, '.!?', '') else text end as text,
    unnest(range(case when draw = 0 then 0 when draw = 3 then 2 else 1 end)) as copy
  from base
), seen as (
  select *, row_number() over (partition by conv_id, role, text order by turn nulls first) > 1 as again from damaged
), placed as (
  select conv_id, turn, role, text, left(role, 1) as initial, again,
    row_number() over (partition by conv_id order by turn nulls first, role, text, again) as i,
    right(regexp_replace(text, '[ 	-
]+$', ''), 1) as last
  from seen
), rows_ as (
  select coalesce(conv_id, -9223372036854775808) as c, conv_id, turn, role, text, initial, i, last = '' as blank, last <> '' and again as dup,
    last <> '' and not again and last not in ('.', '!', '?') as trunc, last = '' or again as unwanted,
    case when not (last = '' or again) and last not in ('.', '!', '?') then 1 else 0 end as late,
    coalesce(lag(initial) over (partition by conv_id order by i) || initial not in ('su', 'ua', 'au'), false) as bad
  from placed
), walk(c, i, s0, s1, s2, s3) as (
  select distinct c, 0::bigint, '000000000', null::varchar, '000000002I', '000000004II' from rows_
  union all
  select c, i, n0, n1, least(p2, {plus("n3", "2", "I")}), n3 from (
    select c, i, n0, n1, p2, least(m3, {plus("p2", "2", "I")}) as n3 from (
      select c, i, n0, n1, m3, least(m2, {plus("n0", "2", "I")}, {plus("n1", "2", "I")}) as p2 from (
        select w.c, r.i, {n0} as n0, {n1} as n1, {m2} as m2, {m3} as m3
        from walk w join rows_ r on r.c = w.c and r.i = w.i + 1)))
), best as (
  select c, least(arg_max(s0, i), arg_max(s3, i)) as way from walk group by c
), letters as (
  select c, k, substr(way, (9 + k)::bigint, 1) as e from (select c, way, unnest(range(1, length(way) - 8)) as k from best)
), counted as (
  select c, k, e, sum(case when e = 'I' then 0 else 1 end) over w as i, sum(case when e = 'D' then 0 else 1 end) over w as p
  from letters window w as (partition by c order by k)
), kept as (
  select l.c, l.k, l.e, l.p, r.role, r.initial, case when l.e = 'I' then '' else r.text end as text,
    max(case when l.p = 1 and l.e = 'K' and r.initial = 's' then 1 else 0 end) over (partition by l.c) as led
  from counted l left join rows_ r on r.c = l.c and r.i = l.i where l.e <> 'D'
), joined as (
  select c, string_agg(case when e = 'K' then role when (p - led) % 2 = 1 then 'user' else 'assistant' end || ':' || text, chr(10) order by k) as t
  from kept group by c
), counts as (
  select c, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank,
    count(*) filter (dup) as duplicate, count(*) filter (trunc) as truncated, count(*) filter (bad) as illegal
  from rows_ group by c
)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
  coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(left(way, 9)::bigint, 0) as cost,
  coalesce(substr(way, 10), '') as audit, sha256(coalesce(t, '')) as repaired_sha256
from (select distinct conv_id, coalesce(conv_id, -9223372036854775808) as c from conversations) o
left join counts on counts.c = o.c left join best on best.c = o.c left join joined on joined.c = o.c
"""


def _chat_sql() -> str:
    """Turns and loss texts straight from the table; lengths with escapes counted by the same rule."""
    t = chat.CHAT
    rest = "|".join(re.escape(c[1:]) for c in t.controls())
    around = " ".join(f"when '{r}' then {len(a) + len(b)}" for r, (a, b) in t.marks.items())

    def size(text: str) -> str:
        return rf"length(regexp_replace(replace({text}, '\', '\\'), '([<\[])({rest})', '\1\\\2', 'g'))"

    return rf"""
with all_ as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), placed as (
  select *, row_number() over w as i, lag(role) over w as before,
    row_number() over (partition by conv_id order by turn desc nulls last, role desc, text desc) = 1 as final
  from all_ window w as (partition by conv_id order by turn nulls first, role, text)
), checked as (
  select *, coalesce(before, 'begin') || chr(10) || role not in ({", ".join(f"'{a}' || chr(10) || '{b}'" for a, b in t.follows)}) as fault from placed
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '')) as loss_sha256,
  sum({len(t.start) + len(t.end)} + {size("text")} + case role {around} else {len(t.other) + len(t.named)} + {size("role")} end)::bigint as formatted_chars,
  count(*) filter (fault) as n_faults, min(i) filter (fault) - 1 as first_fault, bool_or(final and role = 'assistant') as complete
from checked group by conv_id
"""


SQL = {
    "op11_survivor_viterbi": _repair_sql(),
    "op12_chat_machine": _chat_sql(),
    "op13_threshold_negatives": """
with rows_ as (
  select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    [floor(256 * x::double) for x in embedding] as v
  from embeddings where vec_id is not null and label is not null and embedding is not null
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), scored as (
  select a.vec_id as anchor_id, a.label = b.label as same, b.vec_id as id, list_inner_product(a.v, b.v)::bigint as score
  from rows_ a join rows_ b on len(a.v) = len(b.v) where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
), positives as (
  select * from scored where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
)
select p.anchor_id, p.id as positive_id, row_number() over (partition by p.anchor_id, p.id order by n.score desc, n.id)::integer as rank,
  n.id as negative_id, p.score as positive_score, n.score as negative_score
from positives p join scored n on n.anchor_id = p.anchor_id and not n.same and 80 * p.score <= 100 * n.score and n.score <= p.score
qualify rank <= 5
""",
    "op2_seekable_warc": """
with facts as (
  select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as h from pages
), first as (
  select h, min(page_id) as first_id from facts group by h
)
select page_id, payload_bytes,
  array_to_string([array_to_string([
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((('0x' || substr(facts.h, (i * 5 + 1)::bigint, 5))::bigint >> (15 - 5 * k)::bigint) & 31) + 1, 1)
      for k in range(4)], '') for i in range(8)], '')
    as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id = first_id then null else first_id end as refers_to
from facts join first on facts.h = first.h
""",
    "op3_lsh_forest_join": r"""
with recursive words as (
  select doc_id, [x for x in regexp_split_to_array(lower(coalesce(text, '')), '\s+') if x <> ''] as w from documents
), shingles as (
  select distinct doc_id, unnest(case when len(w) >= 5
    then [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]
    when len(w) > 0 then [array_to_string(w, ' ')] else ['<empty>'] end) as s
  from words
), sizes as (
  select doc_id, count(*) as n from shingles group by doc_id
), shared as (
  select a.doc_id as x, b.doc_id as y, count(*) as k
  from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2
), links as (
  select x, y from shared join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 9 * k >= 4 * (p.n + q.n)
), reach(doc_id, other) as (
  select doc_id, doc_id from documents union select reach.doc_id, links.y from reach join links on links.x = reach.other
)
select d.doc_id, d.class_id, coalesce(l.n, 0) as n_links
from (select doc_id, min(other) as class_id from reach group by doc_id) d
left join (select x, count(*) as n from links group by x) l on l.x = d.doc_id
""",
}
