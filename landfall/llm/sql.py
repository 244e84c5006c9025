"""DuckDB SQL over the same tables, for the queries that SQL can express."""

from __future__ import annotations

from . import mixing as m
from . import quality as q
from . import vectors, warc

_WORDS = "list_filter(string_split_regex({0}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_N = "len(" + _WORDS + ")"
_LINE_FAILS = f"""({_N.format("l")} > 0 and (
    (len(regexp_extract_all(l, '{q.SEPARATORS}')) >= 2 and len(regexp_extract_all(l, '{q.SEPARATORS}')) * 4 >= {_N.format("l")})
    or (len(regexp_extract_all(l, '{q.NOISE}')) >= 2 and len(regexp_extract_all(l, '{q.NOISE}')) * 5 >= {_N.format("l")})
    or ({_N.format("l")} >= {q.PLAIN_WORDS} and not regexp_matches(l, '{q.SENTENCE}'))
    or ({_N.format("l")} <= {q.BOILERPLATE_WORDS} and regexp_matches(l, '{q.BOILERPLATE}'))))"""

#: One row a document with the measures of the quality rules.
QUALITY = f"""
with d as (select row_number() over () as row_id, doc_id, coalesce(text, '') as t from {{docs}}),
w as (select row_id, unnest({_WORDS.format("t")}) as w, generate_subscripts({_WORDS.format("t")}, 1) as i from d),
g as (select row_id, i, w as a, lead(w, 1) over (partition by row_id order by i) as b, lead(w, 2) over (partition by row_id order by i) as c from w),
r as (select row_id, i from (select *, count(*) over (partition by row_id, a, b, c) as n from g where c is not null) where n >= 2),
p as (select row_id, count(distinct k) as n_repeat_words from (select row_id, unnest([i, i + 1, i + 2]) as k from r) group by row_id),
m as (
  select d.row_id, doc_id, {_N.format("t")} as n_words,
    length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) as word_chars,
    len(regexp_extract_all(t, '{q.SYMBOLS}')) as n_symbols,
    len(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')))
      - len(list_distinct(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')))) as n_dup_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words,
    length(regexp_replace(list_aggregate(list_filter(string_split(t, chr(10)), lambda l: not {_LINE_FAILS}), 'string_agg', ''), '[\\x20\\x09-\\x0D]+', '', 'g')) as left_chars
  from d left join p on d.row_id = p.row_id),
quality as (
  select row_id, doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
    cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words,
    n_words < {q.BASE_WORDS} or 100 * n_repeat_words > {q.BASE_REPEAT_PERCENT} * n_words as base_failed,
    not (n_words < {q.BASE_WORDS} or 100 * n_repeat_words > {q.BASE_REPEAT_PERCENT} * n_words)
      and (word_chars - coalesce(left_chars, 0)) * 100 <= word_chars * {q.LOST_PERCENT} as kept
  from m)
"""

op1_quality_rules = QUALITY.replace("{docs}", "documents") + "select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept from quality"

#: Capped water-filling over a relation with doc_id, source and text.
MIXING = f"""
d as (select doc_id, source, case when text is null then 0 else {_N.format("text")} end as size,
    md5('{m.SEED}:' || coalesce(cast(doc_id as varchar), 'null')) as tag from {{docs}}),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
u as (select *, ([{", ".join(map(str, m.WEIGHTS))}])[((row_number() over (order by source asc nulls last) - 1) % {len(m.WEIGHTS)}) + 1] as weight, source_size * {m.MAX_EPOCHS} as cap from s),
v as (select *, row_number() over o as place,
    (sum(source_size) over () - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0))
    / (sum(weight) over () - coalesce(sum(weight) over (o rows between unbounded preceding and 1 preceding), 0)) as level
  from u window o as (order by cap / weight asc, source asc nulls last)),
x as (select *, cap <= weight * level as is_full from v),
y as (select source, source_size, case when is_full then cast(cap as double) else weight * (select arg_min(level, place) from x where not is_full) end as target from x),
z as (select d.*, source_size, target, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as whole,
    coalesce(sum(size) over (partition by d.source order by tag, size rows between unbounded preceding and 1 preceding), 0) as before_it
  from d join y on d.source is not distinct from y.source),
mixed as (select doc_id, cast(size as bigint) as size, source_size, cast(target as double) as target,
    cast(whole + case when before_it * 2 + size <= (target - whole * source_size) * 2 then 1 else 0 end as bigint) as copies from z)
"""

op9_mixing = "with " + MIXING.replace("{docs}", "documents") + "select doc_id, size, source_size, target, size * copies as taken from mixed"

op5_warc = f"""
with p as (select page_id, coalesce(html, '') as t, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as d from pages),
g as (select d, n, max(page_id) as head from p where n >= {warc.REVISIT_BYTES} group by d, n having count(*) > 1)
select page_id, cast(p.n as bigint) as payload_bytes, p.d as payload_digest,
  case when head is not null and page_id is distinct from head then 'revisit' else 'response' end as record_type,
  case when head is not null and page_id is distinct from head then head end as refers_to
from p left join g on p.d = g.d and p.n = g.n
"""

op4_embeddings = f"""
with recursive v as (
  select distinct vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as u, b.vec_id as v from v a join v b on a.label = b.label and (a.vec_id <> b.vec_id or a.e <> b.e) and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= {vectors.COSINE}),
r as (select u as node, u as seen from l union select r.node, l.v from r join l on r.seen = l.u),
c as (select node, min(seen) as component from r group by node),
n as (select u, count(*) as n from l group by u)
select vec_id, cast(coalesce(n, 0) as bigint) as n_links, coalesce(component, vec_id) as component_id, vec_id = coalesce(component, vec_id) as kept
from embeddings left join c on vec_id = node left join n on vec_id = u
"""
