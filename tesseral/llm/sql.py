"""DuckDB SQL for the queries that SQL expresses."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op4_urls"] = r"""
with parts as (
  select page_id, regexp_replace(substr(url, instr(url, '://') + 3), '[?#].*$', '', 's') as rest
  from pages where url is not null and instr(url, '://') > 0
  union all select page_id, '' from pages where url is null or instr(url, '://') = 0),
cut as (
  select page_id,
    translate(case when instr(rest, '/') > 0 then substr(rest, 1, instr(rest, '/') - 1) else rest end, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    case when instr(rest, '/') > 0 then substr(rest, instr(rest, '/')) else '' end as path
  from parts),
rules(rhost, rpath, said) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
ruled as (
  select *, (select max(struct_pack(n := length(rhost || rpath), r := rhost || rpath, v := said)) from rules
    where (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)) as best
  from cut)
select page_id, host, path, best.r as rule,
  coalesce(best.v, case
    when regexp_matches(host, '(^|[.-])(cheap|buy|online)-pills?[.-]|(^|[.-])free-bets?[.-]|(^|[.-])casinos?[0-9]*[.-]|(^|[.-])(xxx|porn)[0-9]*\.') then 'block'
    when regexp_matches(host, '^(ads?|track|pixel)\.[^ ]+$|(^|[.-])(spam|link)-farms?[.-]') then 'block'
    when starts_with(path, '/wp-login.php') or starts_with(path, '/cgi-bin/') or regexp_matches(path, '\.(exe|apk|torrent)$') then 'block'
    else 'allow' end) as verdict
from ruled"""

ORACLES["op10_warc"] = """
with rows as (
  select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as n from pages),
last as (select html, max(page_id) as last from rows where n >= 1000 group by html)
select page_id, n::bigint as payload_bytes, sha1(encode(rows.html)) as payload_digest,
  case when last.last > page_id then 'revisit' else 'response' end as record_type,
  case when last.last > page_id then last.last end as refers_to
from rows left join last on rows.n >= 1000 and rows.html = last.html"""


ORACLES["op9_decontamination"] = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null),
bw as (select item_id, least(8, len(w)) as n, unnest(range(1, len(w) - least(8, len(w)) + 2)) as k, w from b where len(w) > 0),
windows as (select distinct item_id, n, array_to_string(w[k:k + n - 1], ' ') as g from bw),
lens as (select distinct n from windows),
dw as (select r, lens.n, unnest(range(1, len(w) - lens.n + 2)) as k, w from d, lens where len(w) >= lens.n),
found as (select r, k, windows.n, item_id from dw join windows on dw.n = windows.n and array_to_string(w[k:k + dw.n - 1], ' ') = g),
hit as (select r, count(distinct p) as n_hit from (select r, unnest(range(k, k + n)) as p from found) group by r),
items as (select r, count(*) as n_items, string_agg(s, ',' order by s) as s from (select distinct r, cast(item_id as varchar) as s from found) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(s, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
from d left join hit using (r) left join items using (r)"""


ORACLES["op6_mixing"] = r"""
with d as (select doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, case when source is null then 'n' else 's' || source end as name from documents),
k as (select *, md5('mix|' || name || '|' || coalesce(cast(doc_id as varchar), md5(text), '')) as place from d),
b as (select *, substr(place, 1, (select 2 + (count(*) > 32768 * 256)::int + (count(*) > 32768 * 4096)::int from documents)) as block from k),
src as (select source, name, sum(size)::double as s from b group by all),
ranked as (select *, [3.0, 1.0, 2.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as w from src),
lev as (select *, 2 * s as full_, (sum(s) over () * 1.5 - coalesce(sum(2 * s) over (order by 2 * s / w, source nulls last rows between unbounded preceding and 1 preceding), 0)) / (sum(w) over () - coalesce(sum(w) over (order by 2 * s / w, source nulls last rows between unbounded preceding and 1 preceding), 0)) as level from ranked),
tgt as (select name, s, least(full_, coalesce((select level from lev where level * w <= full_ order by full_ / w limit 1) * w, full_)) as target from lev),
blocks as (select name, block, sum(size) as bs from b group by all),
p as (select blocks.*, s, target, case when s > 0 then floor(target / s) else 0 end as passes from blocks join tgt using (name)),
c as (select *, target - passes * s as rest, sum(bs) over (partition by name order by md5('mix|block|' || name || '|' || block) rows between unbounded preceding and current row) as upto from p),
part as (select *, upto - bs as before_, case when rest <= 0 then 'none' when upto <= rest then 'all' when upto - bs < rest then 'some' else 'none' end as part from c),
rows_ as (select b.*, s, target, passes, rest, before_, part, sum(size) over (partition by b.name, b.block order by place, doc_id, size rows between unbounded preceding and current row) as upto from b join part on b.name = part.name and b.block = part.block)
select doc_id, size, s::bigint as source_size, target, (size * (passes + case when part = 'all' or (part = 'some' and before_ + upto - size / 2 <= rest) then 1 else 0 end))::bigint as taken from rows_"""

ORACLES["op1_minhash"] = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (select doc_id, list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from d),
flat as (select doc_id, hash(unnest(s)) as h from sets),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as common from flat a join flat b on a.h = b.h and a.doc_id < b.doc_id group by all),
links as (select a, b from pairs join sets x on x.doc_id = a join sets y on y.doc_id = b where 100 * common >= 85 * (len(x.s) + len(y.s) - common)),
edges as (select a, b from links union select b, a from links),
reach(a, b) as (select doc_id, doc_id from sets union select reach.a, edges.b from reach join edges on reach.b = edges.a),
least_ as (select a, min(b) as c from reach group by a)
select doc_id, cast(len(s) as bigint) as n_shingles, c as component_id, doc_id = c as kept from sets join least_ on doc_id = a"""
