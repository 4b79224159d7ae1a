"""SQL of another engine for the queries that SQL can express."""

TOPK = """
with whole as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as parts from embeddings
  where embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0
), sized as (
  select vec_id, list_resize(parts, (select max(len(parts)) from whole), 0.0) as parts from whole
), scored as (
  select q.vec_id as query_id, v.vec_id, list_inner_product(q.parts, v.parts)::bigint as score
  from sized q join sized v on q.vec_id % 20 = 0 and v.vec_id <> q.vec_id
)
select query_id, rank::int as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored
) where rank <= 20
"""

URL_LISTS = r"""
with known as (
  select page_id, nullif(regexp_replace(lower(regexp_extract(
           url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '\.$', ''), '') as host,
         date '2024-01-01' + ((page_id * 7919) % 730)::int as fetch_date
  from pages
), labels as (
  select page_id, host, fetch_date, string_split(host, '.') as parts from known
), matched as (
  select page_id, host, fetch_date, array_to_string(parts[k:], '.') as rule
  from (select *, unnest(range(1, len(parts) + 1)) as k from labels where host is not null)
), rules as (
  select rule, min(page_id) as least, count(*) as pages from matched group by rule
), entries as (
  select rule, least * 4 + k as entry_id,
         case when (least + pages + k) % 2 = 0 then 'block' else 'allow' end as verdict,
         date '2024-01-01' + ((least * 31 + k * 181 + length(rule) * 17) % 730)::int as entry_date
  from rules, (values (0), (1), (2), (3)) v(k)
), active as (
  select m.page_id, e.rule, e.entry_id, e.verdict, row_number() over (
    partition by m.page_id order by length(e.rule) desc, e.rule desc, e.entry_date desc, e.entry_id desc) as place
  from matched m join entries e on m.rule = e.rule and e.entry_date <= m.fetch_date
)
select k.page_id, k.host, k.fetch_date, a.rule, a.entry_id, a.verdict
from known k left join active a on a.page_id = k.page_id and a.place = 1
"""

LINE_DEDUP = r"""
with split as (
  select doc_id, text, string_split(coalesce(text, ''), chr(10)) as parts from documents
), spread as (
  select doc_id, k - 1 as unit, parts[k] as body,
         coalesce(list_sum(list_transform(parts[1:k - 1], lambda p: length(p) + 1)), 0)::bigint as start
  from (select *, unnest(range(1, len(parts) + 1)) as k from split)
), plain as (
  select *, trim(regexp_replace(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[\x20\x09-\x0D]+', ' ', 'g'), ' ') as norm from spread
), ranked as (
  select *, norm <> '' and row_number() over (partition by norm order by doc_id, unit) > 1 as repeated from plain
), runs as (
  select *, count(*) filter (norm <> '' and not repeated) over (partition by doc_id order by unit) as run from ranked
), judged as (
  select *, repeated and sum(case when repeated then len(string_split(norm, ' ')) end)
    over (partition by doc_id, run) >= 15 as gone from runs
)
select doc_id, count(*) filter (norm <> '') as n_units, count(*) filter (gone) as n_removed,
       coalesce(sum(length(body)) filter (gone), 0)::bigint as removed_chars,
       coalesce(string_agg(start || '-' || (start + length(body)), ',' order by unit) filter (gone), '')
         as removed_spans,
       sha256(coalesce(string_agg(body, chr(10) order by unit) filter (not gone), '')) as kept_sha256
from judged group by doc_id
"""

WARC = """
with held as (
  select page_id, coalesce(html, '') as html from pages
), firsts as (
  select *, min(page_id) over (partition by html) as first from held
)
select page_id, strlen(html)::bigint as payload_bytes,
       (select string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ('0b' || bits[5 * k + 1:5 * k + 5])::int, 1),
                          '' order by k) from (select unnest(range(32)) as k)) as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to
from (select *, array_to_string(list_transform(range(0, 40), lambda i: lpad(bin(('0x' || sha1(html)[i + 1])::int), 4, '0')),
                                '') as bits from firsts)
"""

NEAR_DUPLICATES = r"""
with recursive words as (
  select doc_id, list_filter(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents
), sets as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) end) as s from words
), spread as (
  select doc_id, len(s) as n, unnest(s) as g from sets
), shared as (
  select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as common
  from spread a join spread b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2
), links as (
  select a, b from shared where 100 * common >= 75 * (na + nb - common)
), reach(doc_id, other) as (
  select doc_id, doc_id from sets union select r.doc_id, l.b from reach r join links l on r.other = l.a
), least as (
  select doc_id, min(other) as component_id from reach group by doc_id
)
select doc_id, len(s)::bigint as n_shingles, component_id, doc_id = component_id as kept
from sets join least using (doc_id)
"""

HARD_NEGATIVES = """
with whole as (
  select row_number() over () as row_no, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as parts from embeddings
  where embedding is not null and label is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0
), sized as (
  select row_no, vec_id, label, list_resize(parts, (select max(len(parts)) from whole), 0.0) as parts from whole
), scored as (
  select a.row_no as anchor_row, a.vec_id as anchor_id, b.row_no, b.vec_id, a.label = b.label as alike,
         list_inner_product(a.parts, b.parts)::bigint as score
  from sized a join sized b on a.vec_id % 100 = 0 and a.row_no <> b.row_no
), positives as (
  select anchor_row, anchor_id, row_no as positive_row, vec_id as positive_id, score as positive_score from (
    select *, row_number() over (partition by anchor_row order by score desc, vec_id, row_no) as place
    from scored where alike) where place <= 5
)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from (
  select p.anchor_id, p.positive_id, s.vec_id as negative_id, p.positive_score, s.score as negative_score,
         row_number() over (partition by p.anchor_row, p.positive_row order by s.score desc, s.vec_id, s.row_no) as rank
  from positives p join scored s on s.anchor_row = p.anchor_row and not s.alike
    and 80 * p.positive_score <= 100 * s.score and s.score <= p.positive_score
) where rank <= 5
"""

EXACT_COPIES = r"""
with plain as (
  select row_number() over () as row_no, doc_id, length(coalesce(text, '')) as chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as content from documents
), judged as (
  select doc_id, content, count(*) over (partition by content) as group_size,
         first_value(doc_id) over best as keep_id, row_number() over best = 1 as kept
  from plain window best as (partition by content order by chars desc, doc_id nulls last, row_no)
)
select doc_id, keep_id, group_size, kept, sha256(content) as text_sha256 from judged
"""

SQL = {
    "op1_exact_topk": TOPK,
    "op3_url_lists": URL_LISTS,
    "op5_near_duplicates": NEAR_DUPLICATES,
    "op7_warc_bundles": WARC,
    "op10_line_dedup": LINE_DEDUP,
    "op12_hard_negatives": HARD_NEGATIVES,
    "op13_exact_copies": EXACT_COPIES,
}
