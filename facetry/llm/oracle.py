"""DuckDB SQL of the dealt queries that SQL can express."""

REVISITS = r"""
with base as (
  select page_id, url, html, substr(md5(html), 1, 12) as tag, (page_id * 7919) % 5000 as hour,
    regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as plain
  from pages),
named as (
  select *,
    regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(plain, '^([^/?]*)', 1)), '^.*@', ''),
      ':(80|443)?$', ''), '^www\.', '')
    || regexp_replace(regexp_extract(plain, '^[^/?]*([^?]*)', 1), '/+$', '') as place,
    regexp_replace(regexp_replace(regexp_extract(plain, '^[^?]*\?(.*)$', 1), '(^|&)utm_[^&]*', '', 'g'), '^&+', '') as query
  from base),
records as (
  select page_id, html, tag, hour, place || case when query = '' then '' else '?' || query end as c,
    strftime(make_timestamp(1704067200000000 + hour * 3600000000), '%Y-%m-%d %H:%M:%S') as d0,
    strftime(make_timestamp(1704067200000000 + (hour + 24) * 3600000000), '%Y-%m-%d %H:%M:%S') as d1,
    strftime(make_timestamp(1704067200000000 + (hour - 48) * 3600000000), '%Y-%m-%d %H:%M:%S') as d2
  from named),
asked as (
  select page_id * 3 + 1 as revisit_id, c, hour + 24 as hour, tag as etag, 'W/' || tag as raw_tag, d1 as date, null as cache from records
  union all
  select page_id * 3 + 2, c, hour - 48,
    case when page_id % 7 = 0 then null when page_id % 5 = 0 then 'other' else tag end,
    case when page_id % 7 = 0 then null when page_id % 5 = 0 then 'other' else tag end, d2,
    case when page_id % 7 = 0 or page_id % 5 = 0 then null else 'no-cache' end from records),
given as (
  select c, hour, min(page_id) as page_id from records group by c, hour),
latest as (
  select a.revisit_id, arg_max(g.page_id, g.hour) as page_id
  from asked a join given g on a.c = g.c and g.hour < a.hour group by a.revisit_id)
select a.revisit_id, a.c as url,
  case when l.page_id is null then 'no_response' when a.etag is null then 'unchecked'
       when a.etag = r.tag then 'resolved' else 'mismatch' end as status,
  l.page_id * 3 as response_id,
  case when l.page_id is not null and (a.etag is null or a.etag = r.tag) then
    'cache-control: ' || coalesce(a.cache, 'max-age=60') || chr(10)
    || 'content-length: ' || octet_length(encode(r.html)) || chr(10) || 'content-type: text/html' || chr(10)
    || 'date: ' || a.date || chr(10) || 'etag: ' || coalesce(a.raw_tag, r.tag) end as headers
from asked a left join latest l using (revisit_id) left join records r on r.page_id = l.page_id
"""

SUFFIX_TREES = r"""
with words as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
spots as (
  select doc_id, w, unnest(range(len(w) - 12)) as i from words where len(w) >= 13),
windows as (
  select doc_id, i, md5(array_to_string(w[i + 1 : i + 13], ' ')) as h from spots),
first as (select h, min(doc_id) as d from windows group by h),
gone as (
  select distinct doc_id, unnest(range(i, i + 13)) as p from windows join first using (h) where doc_id > d),
cut as (select doc_id, count(*) as n, list(p) as ps from gone group by doc_id)
select words.doc_id, len(w) as n_words, coalesce(n, 0) as n_removed,
  sha256(coalesce(array_to_string(case when n is null then w
    else list_filter(w, lambda x, j: not list_contains(ps, j - 1)) end, ' '), '')) as kept_sha256
from words left join cut using (doc_id)
"""

TOP_K = r"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id,
    list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint as score
  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id)
select query_id, rank::int as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
where rank <= 10
"""

def crc32(value: str) -> str:
    """CRC-32 of an ASCII text: each byte, then eight shifts."""
    steps = f"flatten(list_transform(string_split({value}, ''), lambda b: [ascii(b)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return (
        f"xor(list_reduce(list_concat([4294967295::bigint], {steps}), lambda c, x: "
        "case when x >= 0 then xor(c, x) else xor(c >> 1, 3988292384 * (c & 1)) end), 4294967295::bigint)"
    )


BURST_TRIE = f"""
with given as (
  select conv_id, turn, octet_length(encode(coalesce(text, ''))) as n,
    substr(sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) as t
  from conversations where conv_id is not null),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, t, n) - 1 as pos from given),
convs as (
  select conv_id, conv_id - conv_id % 5 as base, {crc32("conv_id::varchar")} % 9 as h
  from (select distinct conv_id from given)),
whole as (
  select c.*, coalesce(least(h, b.n), 0) as b
  from convs c left join (select conv_id as base, count(*) as n from given group by 1) b using (base)),
rebuilt as (
  select w.conv_id, p.pos + 1 as d, t, n from whole w join placed p on p.conv_id = w.base and p.pos < w.h
  union all
  select w.conv_id, p.pos - h + b + 1, t, n from whole w join placed p on p.conv_id = w.conv_id and p.pos >= w.h),
members as (
  select conv_id, 0 as d, '' as t, 0 as n from convs union all select * from rebuilt),
named as (
  select *, sha256(string_agg(t, '') over (partition by conv_id order by d)) as key,
    d = max(d) over (partition by conv_id) as last from members),
linked as (
  select *, lag(key) over (partition by conv_id order by d) as above from named),
nodes as (
  select d, key, min(conv_id) as c, count(*) as n_convs, any_value(above) as above, any_value(n) as n,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (last), '')) as ends
  from linked group by d, key),
kids as (select d - 1 as d, above as key, count(*) as n_children from nodes where d > 0 group by all),
full_nodes as (
  select x.*, coalesce(n_children, 0) as n_children from nodes x left join kids using (d, key)),
sums as (
  select m.d, m.key, count(*) filter (x.n_children = 0) as n_leaves, sum((x.n_convs - 1) * x.n) as saved
  from full_nodes x join linked m on m.conv_id = x.c and m.d <= x.d group by all)
select x.c as conv_id, x.d::bigint as depth, p.c as parent_conv_id, x.n_convs, x.n_children, n_leaves,
  saved::bigint as saved_tokens, x.ends as ends_sha256
from full_nodes x join sums using (d, key) left join nodes p on p.d = x.d - 1 and p.key = x.above
"""


def _repair_sql() -> str:
    """Dynamic programming over the rows: by state, nine digits of cost, then the edits."""
    add = lambda x, k, letter: f"lpad((left({x}, 9)::int + {k})::varchar, 9, '0') || substr({x}, 10) || '{letter}'"
    inserted = lambda e, s, u, a: (
        f"least({u}, {', '.join(add(x, 3, 'I') for x in (e, s, a))})"
    )
    def closed(e, s, u, a):
        due = inserted(e, s, u, a)
        return f"{e}, {s}, {due}, least({a}, {add(f'({due})', 3, 'I')})"

    cut = "(case when l = upper(l) then 3 else 0 end)"
    edit = lambda xs, same: ", ".join(
        [f"case when lower(l) <> 'x' then {add(x, f'3 + {cut}', 'R')} end" for x in xs]
        + [f"case when lower(l) = '{same}' then {add(x, cut, 'K')} end" for x in xs]
    )
    return f"""
with recursive kinds as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    {crc32("(conv_id::varchar || ':' || coalesce(turn::varchar, ' '))")} % 20 as kind
  from conversations where conv_id is not null),
damaged as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(range(case when kind = 3 then 2 else 1 end)) as copy
  from kinds where kind <> 0),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) - 1 as pos,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) as tail from damaged),
faults as (
  select *, lead(left(role, 1)) over (partition by conv_id order by pos) as nxt,
    case when tail = '' then 'blank'
      when row_number() over (partition by conv_id, role, text order by pos) > 1 then 'duplicate'
      when tail not in ('.', '!', '?') then 'truncated' end as fault from placed),
coded as (
  select conv_id, count(*) as n, string_agg(
      case when fault in ('blank', 'duplicate') then 'x' when fault = 'truncated' then upper(r) else r end, '' order by pos) as codes,
    count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (nxt is not null and left(role, 1) || nxt not in ('su', 'ua', 'au')) as illegal,
    coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps
  from (select *, case when left(role, 1) in ('s', 'u', 'a') then left(role, 1) else 'o' end as r from faults) group by conv_id),
dp(conv_id, codes, i, e, s, u, a) as (
  select conv_id, codes, 0::bigint as i, {closed("e", "s", "u", "a")}
  from coded, (select '000000000' as e, '900000000' as s, '900000000' as u, '900000000' as a)
  union all
  select conv_id, codes, i + 1, {closed("e2", "s2", "u2", "a2")} from (
    select *, {add("e", 4, "D")} as e2,
      least({add("s", 4, "D")}, case when lower(l) = 's' then {add("e", cut, "K")} end) as s2,
      least({add("u", 4, "D")}, {edit(["e", "s", "a"], "u")}) as u2,
      least({add("a", 4, "D")}, {edit(["u"], "a")}) as a2
    from (select *, substr(codes, i::int + 1, 1) as l from dp where i < length(codes)))),
best as (
  select conv_id, left(b, 9)::bigint as cost, substr(b, 10) as audit
  from (select conv_id, least(e, a) as b from dp where i = length(codes))),
letters as (
  select conv_id, unnest(string_split(audit, '')) as l, generate_subscripts(string_split(audit, ''), 1) as o
  from best where audit <> ''),
steps as (
  select *, count(*) filter (l <> 'I') over w - 1 as pos, count(*) filter (l <> 'D') over w as turn_no
  from letters window w as (partition by conv_id order by o)),
outcome as (
  select s.conv_id, s.o, s.l, f.role, f.text, s.turn_no
    - max(case when s.turn_no = 1 and s.l = 'K' and left(f.role, 1) = 's' then 1 else 0 end) over (partition by s.conv_id) as no
  from steps s left join faults f on f.conv_id = s.conv_id and f.pos = s.pos and s.l <> 'I' where s.l <> 'D'),
repaired as (
  select conv_id, sha256(string_agg(
    case when l = 'K' then role when no % 2 = 1 then 'user' else 'assistant' end || ':' || coalesce(text, ''), chr(10) order by o)) as h
  from outcome group by conv_id)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
  coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost,
  coalesce(audit, '') as audit, coalesce(h, sha256('')) as repaired_sha256
from (select distinct conv_id from kinds) c left join coded using (conv_id) left join best using (conv_id)
  left join repaired using (conv_id)
"""


ORACLE = {
    "op1_revisits": REVISITS, "op2_suffix_trees": SUFFIX_TREES, "op6_topk": TOP_K,
    "op11_burst_trie": BURST_TRIE, "op12_repair": _repair_sql(),
}
