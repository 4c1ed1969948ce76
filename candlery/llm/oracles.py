"""SQL that the corpus queries have to equal, where SQL can say it."""

ORACLES: dict[str, str] = {}

ORACLES["op7_warc"] = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, octet_length(encode(html)) as payload_bytes, sha1(html) as payload_digest from p),
b as (select payload_digest, max(page_id) as best from d where payload_bytes >= 1000 group by 1)
select page_id, cast(payload_bytes as bigint) as payload_bytes, d.payload_digest,
       case when best is not null and page_id <> best then 'revisit' else 'response' end as record_type,
       case when best is not null and page_id <> best then best end as refers_to
from d left join b using (payload_digest)
"""

ORACLES["op11_source_divergence"] = r"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ts
           from documents),
w as (select r, lang, source, unnest(ts) as term from d),
kept as (select lang, term from w group by all having count(distinct r) >= 10),
c as (select lang, source, term, count(*) as n from w semi join kept using (lang, term) group by all),
g as (select distinct lang, source from d),
v as (select lang, count(*) as v from kept group by lang),
ng as (select lang, source, sum(n) as held from c group by all),
nl as (select lang, sum(n) as held from c group by lang),
full_ as (select g.lang, g.source, kept.term, coalesce(c.n, 0) as n,
                 1 + (cast(1000000000 as hugeint) * (coalesce(c.n, 0) + 2)) // (coalesce(ng.held, 0) + 2 * v.v) as p
          from g join kept using (lang) join v using (lang) left join ng using (lang, source)
          left join c on c.lang = g.lang and c.source = g.source and c.term = kept.term),
q as (select c.lang, c.term, 1 + (cast(1000000000 as hugeint) * (sum(c.n) + 2)) // (any_value(nl.held) + 2 * any_value(v.v)) as q
      from c join nl using (lang) join v using (lang) group by c.lang, c.term),
pairs as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
          from full_ a join full_ b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
allpairs as (select a.lang, a.source, b.source as item, coalesce(pairs.value, 0) as value
             from g a join g b on a.lang = b.lang and a.source <> b.source
             left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source),
terms as (select f.lang, f.source, f.term as item, ((f.p - q.q) * (f.p - q.q)) // (f.p + q.q) as value
          from full_ f join q on q.lang = f.lang and q.term = f.term where f.n > 0 and f.p > q.q),
ranked as (select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, encode(item)) as rank from allpairs
           union all
           select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, encode(item)) from terms)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from ranked where part = 'pair' or rank <= 10
"""

ORACLES["op12_quality_rules"] = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text, coalesce(source, '') as host from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from d),
wins as (select r, i, ws[i:i + 7] as win from (select r, ws, unnest(range(1, len(ws) - 6)) as i from w where len(ws) >= 8)),
twice as (select r, win from wins group by all having count(*) > 1),
rep as (select r, count(distinct i + k) as n_repeat_words from wins semi join twice using (r, win), (select unnest(range(0, 8)) as k) group by r),
l as (select r, host, text, unnest(string_split(text, chr(10))) as line from d),
lw as (select *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') as ws from l),
ln as (select *, array_to_string(list_transform(ws, lambda x: regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g')), ' ') as norm from lw where len(ws) > 0),
dup as (select r, count(*) - count(distinct line) as n_dup_lines from ln group by r),
hosts as (select host, count(distinct text) as docs from d group by host),
hot as (select host, norm from ln join hosts using (host) group by host, norm, docs having count(distinct text) > 10 and 100 * count(distinct text) > docs),
cut as (select r, sum(len(ws)) as n_cut from ln semi join hot using (host, norm) group by r),
b as (select doc_id, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars,
             cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
             cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words, cast(coalesce(n_cut, 0) as bigint) as n_cut
      from w left join dup using (r) left join rep using (r) left join cut using (r))
select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
       not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and 100 * (n_words - n_cut) >= 30 * n_words as kept
from b
"""

ORACLES["op13_hard_negatives"] = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                  list_transform(embedding, lambda x: floor(256 * cast(x as double))) as x
           from embeddings
           where label is not null and embedding is not null
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor, b.vec_id as id, a.label = b.label as same, cast(list_inner_product(a.x, b.x) as bigint) as score
      from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select anchor, id, score from s where same qualify row_number() over (partition by anchor order by score desc, id) <= 5)
select p.anchor as anchor_id, p.id as positive_id,
       cast(row_number() over (partition by p.anchor, p.id order by n.score desc, n.id) as integer) as rank,
       n.id as negative_id, p.score as positive_score, n.score as negative_score
from p join s n on n.anchor = p.anchor and not n.same and 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score
qualify row_number() over (partition by p.anchor, p.id order by n.score desc, n.id) <= 10
"""
