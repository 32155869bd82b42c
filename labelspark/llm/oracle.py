"""DuckDB SQL for the queries of this folder that SQL can express."""

from __future__ import annotations

OP8 = r"""
with t as (
  select doc_id, length(coalesce(text, '')) as points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
  from documents
)
select doc_id,
       first_value(doc_id) over w as keep_id,
       count(*) over (partition by text_sha256) as group_size,
       row_number() over w = 1 as kept,
       text_sha256
from t
window w as (partition by text_sha256 order by points desc, doc_id)
"""

OP10 = r"""
with words as (
  select 'd' as side, doc_id as id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
  union all
  select 'b', item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark
), items as (
  select id, w, least(10, len(w)) as n from words where side = 'b' and len(w) > 0
), item_windows as (
  select distinct n, hash(array_to_string(w[i:i + n - 1], ' ')) as h, array_to_string(w[i:i + n - 1], ' ') as gram, id as item_id
  from (select id, w, n, unnest(range(1, len(w) - n + 2)) as i from items)
), sizes as (select distinct n from item_windows
), doc_windows as (
  select id, n, i, array_to_string(w[i:i + n - 1], ' ') as gram
  from (select id, w, n, unnest(range(1, len(w) - n + 2)) as i from words, sizes where side = 'd' and len(w) >= n)
), hits as (
  select d.id, d.i, d.n, b.item_id from doc_windows d join item_windows b on b.n = d.n and b.gram = d.gram
), per_word as (
  select id, count(distinct p) as n_hit from (select id, unnest(range(i, i + n)) as p from hits) group by id
), per_item as (
  select id, count(distinct item_id) as n_items,
         string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as names
  from hits group by id
)
select d.id as doc_id, coalesce(len(w), 0) as n_words, coalesce(n_hit, 0) as n_hit,
       coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated
from words d left join per_word using (id) left join per_item using (id)
where d.side = 'd'
"""

OP1 = r"""
with recursive words as (
  select doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), shingles as (
  select distinct doc_id, array_to_string(w[i:i + 2], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as i from words where len(w) > 0)
), sizes as (select doc_id, count(*) as n from shingles group by doc_id
), shared as (
  select a.doc_id as x, b.doc_id as y, count(*) as c
  from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2
), links as (
  select x, y from shared join sizes p on p.doc_id = x join sizes q on q.doc_id = y
  where 100 * c >= 90 * (p.n + q.n - c)
), edges as (select x, y from links union all select y, x from links
), reach(x, y) as (
  select doc_id, doc_id from documents
  union
  select reach.x, edges.y from reach join edges on reach.y = edges.x
)
select d.doc_id, coalesce(n, 0) as n_shingles, min(r.y) as component_id
from documents d left join sizes using (doc_id) join reach r on r.x = d.doc_id
group by 1, 2
"""

OP3 = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all
  select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), named as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as place,
         coalesce(lag(role) over (partition by conv_id order by turn nulls first, role, text), 'start') as before,
         case when role in ('system', 'user', 'assistant') then length(role)
              else 2 + length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) end as title_chars
  from turns
), checked as (
  select *, before || '>' || role in
    ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user') as fine
  from named
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by place)) as turns_sha256,
       sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by place) filter (role = 'assistant'), '')) as loss_sha256,
       sum(4 + title_chars + 2 + length(text) + length(regexp_replace(text, '[^\\#<:]', '', 'g')) + 8)::bigint
         as formatted_chars,
       bool_and(fine) and arg_max(role, place) = 'assistant' as valid_order,
       coalesce(min(place) filter (not fine), -1)::int as first_bad_turn
from checked group by conv_id
"""

OP12 = r"""
with whole as (
  select vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), sized as (
  select * from whole
  where len(v) = (select len(v) from whole group by 1 order by count(*) desc, 1 limit 1)
), scored as (
  select a.vec_id as anchor_id, r.vec_id, a.label = r.label as same, list_inner_product(a.v, r.v)::bigint as score
  from sized a join sized r on a.vec_id % 100 = 0 and a.vec_id <> r.vec_id
), positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select p.anchor_id, positive_id, n.vec_id as negative_id, positive_score, n.score as negative_score,
       row_number() over (partition by p.anchor_id, positive_id order by n.score desc, n.vec_id)::int as rank
from positives p join scored n
  on n.anchor_id = p.anchor_id and not n.same and 80 * positive_score <= 100 * n.score and n.score <= positive_score
qualify rank <= 5
"""

OP13 = r"""
with docs as (
  select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents
), words as (select id, lang, source, unnest(terms) as term from docs
), kept as (select lang, term from words group by 1, 2 having count(distinct id) >= 30
), sizes as (select lang, count(k.term) as v from (select distinct lang from docs) left join kept k using (lang) group by 1
), found as (
  select lang, source, term, count(*) as c from words semi join kept using (lang, term) group by 1, 2, 3
), totals as (
  select d.lang, d.source, coalesce(sum(c), 0) as n
  from (select distinct lang, source from docs) d left join found using (lang, source) group by 1, 2
), shares as (
  select t.lang, t.source, k.term, coalesce(f.c, 0) as c,
    1 + (1000000000::hugeint * (coalesce(f.c, 0) + 5)) // (t.n + 5 * s.v) as p
  from totals t join sizes s using (lang) join kept k using (lang)
    left join found f on f.lang = t.lang and f.source = t.source and f.term = k.term
), lang_shares as (
  select lang, term, 1 + (1000000000::hugeint * (sum(c) + 5)) // (any_value(n) + 5 * any_value(v)) as q
  from shares join sizes using (lang) join (select lang, sum(n) as n from totals group by 1) using (lang) group by 1, 2
), pairs as (
  select a.lang, a.source, b.source as item, coalesce(sum(abs(x.p - y.p)), 0)::bigint as value
  from totals a join totals b on a.lang = b.lang and a.source <> b.source
    left join shares x on x.lang = a.lang and x.source = a.source
    left join shares y on y.lang = b.lang and y.source = b.source and y.term = x.term
  where x.term is null or y.term is not null group by 1, 2, 3
), terms as (
  select lang, source, term as item, (p - q)::bigint as value
  from shares join lang_shares using (lang, term) where c > 0 and p > q
), ranked as (
  select *, 'pair' as part, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
  union all
  (select *, 'term' as part, row_number() over (partition by lang, source order by value desc, item) as rank from terms
   qualify rank <= 50)
)
select lang, source, part, item, value, rank::int as rank from ranked
"""

ORACLE: dict[str, str] = {
    "op1_ngram_jaccard_join": OP1, "op3_chat_format": OP3, "op8_exact_dedup": OP8, "op10_decontamination": OP10,
    "op12_hard_negatives": OP12, "op13_source_divergence": OP13,
}
