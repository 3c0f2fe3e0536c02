"""The queries' results in DuckDB SQL."""

ORACLE: dict[str, str] = {}

ORACLE["op1_substring_dedup"] = r"""
with d as (
    select row_number() over () as r, doc_id,
           coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as ws
    from documents),
g as (select r, doc_id, ws, unnest(range(1, len(ws) - 11)) as i from d where len(ws) >= 13),
k as (select r, doc_id, i, array_to_string(ws[i:i + 12], ' ') as k from g),
m as (select k, min(doc_id) as least from k group by k),
c as (select distinct r, unnest(range(i, i + 13)) as p from k join m using (k) where least < doc_id),
w as (select r, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as p from d),
s as (
    select r, string_agg(word, ' ' order by p) as kept, count(*) as n_kept
    from w anti join c using (r, p) group by r)
select doc_id, cast(len(ws) as bigint) as n_words,
       cast(len(ws) - coalesce(n_kept, 0) as bigint) as n_removed,
       sha256(coalesce(kept, '')) as kept_sha256
from d left join s using (r)
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE["op3_jaccard_join"] = rf"""
with recursive d as (
    select doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+'), []) as ws
    from documents),
s as (
    select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
        else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as shingle
    from d),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (
    select a.doc_id as x, b.doc_id as y, count(*) as c
    from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by all),
l as (
    select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y
    where 100 * c >= 75 * (nx.n + ny.n - c)),
r as (select doc_id, doc_id as other from d union select r.doc_id, l.y from r join l on l.x = r.other),
m as (select doc_id, min(other) as component_id from r group by doc_id)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, component_id
from d join m using (doc_id) left join n using (doc_id)
"""

_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLE["op10_decontaminate"] = rf"""
with d as (
    select row_number() over () as r, doc_id,
           list_filter(regexp_split_to_array(coalesce(translate(text, '{_UPPER}', '{_LOWER}'), ''), '{_BETWEEN}'), lambda w: w <> '') as ws
    from documents),
i as (
    select cast(item_id as varchar) as item_id,
           list_filter(regexp_split_to_array(coalesce(translate(text, '{_UPPER}', '{_LOWER}'), ''), '{_BETWEEN}'), lambda w: w <> '') as ws
    from benchmark),
n as (
    select distinct item_id, least(len(ws), 10) as n,
           unnest(list_transform(range(1, len(ws) - least(len(ws), 10) + 2),
                                 lambda a: array_to_string(ws[a:a + least(len(ws), 10) - 1], ' '))) as gram
    from i where len(ws) > 0),
g as (
    select r, n, unnest(range(1, len(ws) - n + 2)) as a, ws from d, (select distinct n from n) where len(ws) >= n),
h as (
    select r, a, g.n, item_id from g join n on n.n = g.n and n.gram = array_to_string(ws[a:a + g.n - 1], ' ')),
c as (select r, count(distinct p) as n_hit from (select r, unnest(range(a, a + n)) as p from h) group by r),
t as (select r, list_sort(list(distinct item_id)) as items from h group by r)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(len(items), 0) as bigint) as n_items,
       sha256(coalesce(array_to_string(items, ','), '')) as items_sha256, n_hit is not null as contaminated
from d left join c using (r) left join t using (r)
"""

ORACLE["op2_line_dedup"] = r"""
with d as (select row_number() over () as r, doc_id, text, string_split(text, chr(10)) as ls from documents),
l as (select r, doc_id, unnest(range(1, len(ls) + 1)) as p, unnest(ls) as line from d),
w as (
    select r, doc_id, p, regexp_replace(line, '^[ \t-\r]+|[ \t-\r]+$', '', 'g') as line,
           row_number() over (partition by r order by p) as k
    from l where regexp_matches(line, '[^ \t-\r]')),
v as (
    select a.r, a.doc_id, a.k, [a.p, b.p, c.p] as ps, a.line as x, b.line as y, c.line as z
    from w a join w b on b.r = a.r and b.k = a.k + 1 join w c on c.r = a.r and c.k = a.k + 2),
o as (select r, ps, row_number() over (partition by x, y, z order by doc_id, k) as n from v),
c as (select distinct r, unnest(ps) as p from o where n > 1),
s as (select r, string_agg(line, chr(10) order by p) as kept from l anti join c using (r, p) group by r),
g as (select r, count(*) as n_removed from c group by r)
select doc_id, cast(coalesce(n_removed, 0) as bigint) as n_removed,
       sha256(case when text is null then null when n_removed is null then text else coalesce(kept, '') end) as kept_sha256
from d left join s using (r) left join g using (r)
"""

ORACLE["op5_line_quality"] = r"""
with d as (
    select row_number() over () as r, doc_id, source, coalesce(text, '') as text,
           coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as ws from documents),
l as (select r, source, text, unnest(string_split(text, chr(10))) as line from d),
f as (
    select r, source, text, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n,
           regexp_replace(trim(translate(lower(line), chr(9) || chr(11) || chr(12) || chr(13), '    ')), ' +', ' ', 'g') as norm
    from l where regexp_matches(line, '[^ \t-\r]')),
u as (select r, count(*) - count(distinct line) as n_dup_lines from f group by r),
h as (select source, count(distinct text) as docs from f group by source),
a as (
    select source, norm from f join h using (source) group by source, norm
    having count(distinct text) > 4 and 100 * count(distinct text) > 2 * any_value(docs) or count(distinct text) > 1000),
x as (select r, sum(n) as n_line_words from f semi join a using (source, norm) group by r),
g as (select r, unnest(range(1, len(ws) - 3)) as i, ws from d where len(ws) >= 5),
k as (select r, i, count(*) over (partition by r, array_to_string(ws[i:i + 4], ' ')) as n from g),
p as (select r, count(distinct q) as n_repeat_words from (select r, unnest(range(i, i + 5)) as q from k where n > 1) group by r),
b as (
    select r, doc_id, cast(len(ws) as bigint) as n_words,
           cast(coalesce(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')), 0) as bigint) as word_chars,
           cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
           cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines,
           cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
           cast(coalesce(n_line_words, 0) as bigint) as n_line_words
    from d left join u using (r) left join p using (r) left join x using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_line_words,
       n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
       not (n_words < 10 or 100 * n_repeat_words > 20 * n_words)
           and 100 * (n_words - n_line_words) >= 30 * n_words as kept
from b
"""


def _ring_rounds(rounds: int) -> str:
    """The rounds in which runs of waiting rows ask shards for room; one shard at least is
    full after each."""
    parts = []
    for k in range(rounds):
        parts.append(f"""
a{k} as materialized (
    select origin, start, n, place, shard,
           greatest(0, least(n, room - (sum(n) over (partition by shard order by place, origin, start) - n))) as taken
    from w{k} join ring on ring.k = w{k}.place join room{k} using (shard)),
room{k + 1} as materialized (
    select shard, any_value(room) - coalesce(sum(taken), 0) as room from room{k} left join a{k} using (shard) group by shard),
w{k + 1} as materialized (
    select origin, start + taken as start, n - taken as n,
           (place + (select min((ring.k - place + p) % p) from ring join room{k + 1} using (shard), size where room > 0)) % p as place
    from a{k}, size where taken < n)""")
    return ",".join(parts)


_CRC = """crc as (
    select list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i:
               case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, b)) as t)"""


def _crc32(text: str) -> str:
    """The checksum of a text, where the table ``t`` of ``crc`` is joined."""
    return f"""xor(4294967295, list_reduce(
               list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: cast('0x' || x as bigint)),
               lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295))"""


def _ring_sql(shards: int, virtual: int) -> str:
    placed = " union all ".join(f"select origin, start, taken as n, shard from a{k} where taken > 0" for k in range(shards))
    return rf"""
with ring as materialized (
    select spot, shard, row_number() over (order by spot) - 1 as k
    from (select s as shard, cast('0x' || substr(md5('shard ' || s || ' place ' || v), 1, 15) as bigint) as spot
          from range({shards}) a(s), range({virtual}) b(v))),
size as (select {shards * virtual} as p),
places as (select list(spot order by spot) as ps from ring),
{_CRC},
d as (
    select doc_id, strlen(coalesce(text, '')) + 1 as size,
           cast('0x' || substr(md5(cast(doc_id as varchar)), 1, 15) as bigint) as place,
           {_crc32("coalesce(text, '')")} as text_crc32
    from documents, crc),
r as (
    select *, row_number() over (partition by origin order by place, doc_id) - 1 as rank
    from (select d.*, len(list_filter(ps, lambda c: c < place)) % p as origin from d, places, size)),
room0 as materialized (
    select s as shard, n // {shards} + cast(s < n % {shards} as int) as room
    from range({shards}) a(s), (select count(*) as n from documents)),
w0 as materialized (select origin, 0 as start, count(*) as n, origin as place from r group by origin),
{_ring_rounds(shards).strip()},
q as (
    select *, sum(n) over (partition by shard order by origin, start) - n - start as base from ({placed}))
select doc_id, cast(size as bigint) as size, cast(text_crc32 as bigint) as text_crc32, 'rows' as law,
       cast(shard as int) as shard, cast(base + rank as bigint) as slot, cast(null as int) as grown_shard
from r join q on r.origin = q.origin and rank >= start and rank < start + n
"""


ORACLE["op9_ring_shards"] = _ring_sql(16, 64)

# the search is nearly exact: a row that differs would be a neighbour it missed
ORACLE["op11_collision_search"] = """
with v as (
    select vec_id, max(cast(embedding as double[])) as x from embeddings
    where vec_id is not null and len(embedding) = len(list_filter(embedding, lambda e: isfinite(e)))
      and len(list_filter(embedding, lambda e: e <> 0)) > 0
    group by vec_id),
s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.x, c.x) as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
from s qualify rank <= 20
"""

ORACLE["op12_periodic_runs"] = rf"""
with {_CRC},
d as (
    select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws,
           {_crc32("cast(doc_id as varchar)")} as h
    from documents, crc),
e as (select r, doc_id, ws, len(ws) as n, h // 10 as g, case when h % 10 = 0 and len(ws) > 0 then (h // 10) % len(ws) end as a from d),
f as (select *, 1 + (n - a) // (3 + g % 8) as p from e),
t as materialized (
    select r, doc_id, n,
           case when a is null then ws else ws[1:a] || list_transform(range(a, n), lambda i: ws[1 + a + (i - a) % p]) end as ws
    from f),
w as materialized (select r, n, unnest(range(n)) as i, unnest(ws) as w from t),
m as (
    select x.r, x.i, y.i - x.i as q
    from w x join w y on x.r = y.r and x.w = y.w and y.i > x.i and 4 * (y.i - x.i) <= x.n),
s as (select r, q, i, i - row_number() over (partition by r, q order by i) as island from m),
o as (select r, q, min(i) as start, count(*) + q as length from s group by r, q, island having count(*) + q >= greatest(6, 4 * q)),
runs as materialized (select r, start, length, min(q) as period from o group by r, start, length),
best as (
    select * from runs a where not exists (
        select 1 from runs b where a.r = b.r and (b.length * a.period > a.length * b.period
            or (b.length * a.period = a.length * b.period and (b.start, b.period) < (a.start, a.period))))),
told as (
    select r, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines
    from runs group by r),
gone as (select distinct r, unnest(range(start + period, start + length)) as i from runs),
kept as (select r, string_agg(w, ' ' order by i) as words from w anti join gone using (r, i) group by r)
select doc_id, cast(coalesce(n_runs, 0) as bigint) as n_runs, cast(start as bigint) as start, cast(length as bigint) as length,
       cast(period as bigint) as period, cast(1000 * length // period as bigint) as exponent_milli,
       sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(words, '')) as collapsed_sha256
from t left join best using (r) left join told using (r) left join kept using (r)
"""

ORACLE["op13_prefix_trie"] = rf"""
with {_CRC},
c as (
    select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
           row_number() over (partition by conv_id order by turn nulls first,
                              sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 as j
    from conversations where conv_id is not null),
ids as (select conv_id, {_crc32("cast(conv_id as varchar)")} % 4 as h from (select distinct conv_id from c), crc),
rebuilt as (
    select i.conv_id, j, role, text from ids i join c on c.conv_id = i.conv_id - i.conv_id % 20 where j < h
    union all
    select i.conv_id, j, role, text from ids i join c using (conv_id) where j >= h),
member as materialized (
    select conv_id, row_number() over (partition by conv_id order by j) as d,
           string_agg(md5(strlen(role) || ':' || role || text), '') over (partition by conv_id order by j) as prefix,
           len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words
    from rebuilt
    union all select conv_id, 0, '', 0 from ids),
size as (select conv_id, max(d) as size from member group by conv_id),
node as materialized (
    select d, prefix, min(conv_id) as conv_id, count(*) as n_convs, any_value(words) as words,
           coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where d = size), '') as ends
    from member join size using (conv_id) group by d, prefix),
child as (select d - 1 as d, prefix[1:32 * (d - 1)] as prefix, count(*) as n_children from node where d > 0 group by all),
up as (
    select n.prefix, unnest(range(n.d + 1)) as above, words * (n_convs - 1) as saved, cast(n_children is null as int) as leaf
    from node n left join child using (d, prefix)),
below as (select above as d, prefix[1:32 * above] as prefix, sum(leaf) as n_leaves, sum(saved) as saved_tokens from up group by all)
select n.conv_id, cast(n.d as bigint) as depth, p.conv_id as parent_conv_id, n.n_convs,
       coalesce(n_children, 0) as n_children, cast(n_leaves as bigint) as n_leaves,
       cast(saved_tokens as bigint) as saved_tokens, sha256(n.ends) as ends_sha256
from node n left join child using (d, prefix) join below using (d, prefix)
     left join node p on p.d = n.d - 1 and p.prefix = n.prefix[1:32 * (n.d - 1)]
"""
