"""SQL with the same results as the queries, for another engine that has the tables under their names."""

from __future__ import annotations


def crc32(text: str) -> str:
    """Unsigned crc32 of an ASCII text expression, bit by bit (reflected polynomial 0xEDB88320)."""
    step = ("list_reduce([xor(c, b), 0, 1, 2, 3, 4, 5, 6, 7], "
            "lambda r, i: xor(r >> 1, 3988292384 * (r & 1)))")
    codes = f"list_transform(string_split({text}, ''), lambda x: cast(ascii(x) as bigint))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: {step}), 4294967295)"


def _framed(value: str) -> str:
    text = f"cast({value} as varchar)"
    return f"coalesce(strlen({text}) || ':' || {text}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_framed(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


OP11 = f"""
with recursive docs as (
  select doc_id, source, {_leaf('text')} as leaf,
    case when {crc32('cast(doc_id as varchar)')} % 2 = 0 then {_leaf("replace(text, chr(10), '')")} end as found
  from documents),
places as (
  select *, row_number() over () as rid,
    row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as idx from docs),
low(lvl, source, idx, hash, n) as (
  select 0, source, idx, leaf, count(*) over (partition by source) from places
  union all
  select lvl + 1, source, idx // 3, sha256(string_agg(hash, '' order by idx)), (any_value(n) + 2) // 3
  from low where n > 1 group by lvl, source, idx // 3),
subroots as (
  select source, hash as subroot, row_number() over (order by source nulls first) - 1 as place, count(*) over () as n
  from low where n = 1),
high(lvl, idx, hash, n) as (
  select 0, place, subroot, n from subroots
  union all
  select lvl + 1, idx // 3, sha256(string_agg(hash, '' order by idx)), (any_value(n) + 2) // 3
  from high where n > 1 group by lvl, idx // 3),
own as (
  select rid, 0 as part, l.lvl, l.source, p.idx // cast(pow(3, l.lvl) as bigint) as idx
  from places p join (select distinct lvl, source from low where n > 1) l on l.source is not distinct from p.source
  union all
  select rid, 1, h.lvl, cast(null as varchar), s.place // cast(pow(3, h.lvl) as bigint)
  from places p join subroots s on s.source is not distinct from p.source
  cross join (select distinct lvl from high where n > 1) h),
tree as (
  select 0 as part, lvl, source, idx, hash from low where n > 1
  union all select 1, lvl, cast(null as varchar), idx, hash from high where n > 1),
steps as (
  select o.rid, o.part, o.lvl,
    coalesce(string_agg(t.hash, '' order by t.idx) filter (t.idx < o.idx), '') as before_own,
    coalesce(string_agg(t.hash, '' order by t.idx) filter (t.idx > o.idx), '') as after_own
  from own o join tree t on t.part = o.part and t.lvl = o.lvl and t.source is not distinct from o.source
    and t.idx // 3 = o.idx // 3
  group by o.rid, o.part, o.lvl),
paths as (
  select rid, sha256(string_agg(before_own || after_own, '' order by part, lvl)) as proof_sha256,
    list(before_own || '|' || after_own order by part, lvl) as path from steps group by rid),
folded as (
  select p.doc_id, p.leaf, s.subroot, (select hash from high where n = 1) as root,
    coalesce(x.proof_sha256, sha256('')) as proof_sha256,
    list_reduce(list_prepend(coalesce(p.found, p.leaf), coalesce(x.path, cast([] as varchar[]))),
      lambda h, s: sha256(split_part(s, '|', 1) || h || split_part(s, '|', 2))) as folded_root
  from places p join subroots s on s.source is not distinct from p.source left join paths x on x.rid = p.rid)
select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified from folded
"""

OP4 = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
usable as (
  select * from v where vec_id is not null and label is not null and len(e) > 0
    and len(list_filter(e, lambda x: x is not null and isfinite(x))) = len(e) and len(list_filter(e, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from usable a join usable b
    on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) as (
  select vec_id, vec_id from v union select r.a, l.b from reach r join links l on l.a = r.b)
select vec_id, (select count(*) from links where a = vec_id) as n_links, min(b) as component_id,
  vec_id = min(b) as kept
from v join reach on a = vec_id group by vec_id
"""

OP6 = r"""
with recursive worded as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select doc_id, case when w is null or len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) end as s
  from worded),
held as (select doc_id, len(s) as size, hash(unnest(s)) as shingle from sets),
shared as (
  select x.doc_id as a, y.doc_id as b, count(*) as n, x.size + y.size as both_sizes
  from held x join held y on x.shingle = y.shingle and x.doc_id < y.doc_id
    and 100 * x.size >= 80 * y.size and 100 * y.size >= 80 * x.size
  group by x.doc_id, y.doc_id, x.size + y.size),
near as (select a, b from shared where 100 * n >= 80 * (both_sizes - n)),
links as (select a, b from near union all select b, a from near),
reach(a, b) as (
  select doc_id, doc_id from sets union select r.a, l.b from reach r join links l on l.a = r.b)
select sets.doc_id, len(s) as n_shingles, min(b) as component_id
from sets join reach on a = sets.doc_id group by sets.doc_id, len(s)
"""

# lengths of the template's parts: "### ", ": ", "</turn>" and a line break
OP9 = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select -7, t, r, '\### Assistant: </turn> ok' from (values (0, 'user'), (1, 'assistant')) as marked(t, r))
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(14 + length(regexp_replace(role, '([\\:#\n])', '\\\1', 'g'))
    + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g'))) as bigint) as formatted_chars
from turns group by conv_id
"""

_KEY = "coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

# states 1 to 4: nothing, system, user, assistant; lists of costs have one entry per state
OP12 = f"""
with recursive hit as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc32(_KEY)} % 20 as rule
  from conversations),
damaged as (
  select conv_id, turn, case when rule = 4 then 'user' else role end as role,
    case rule when 1 then '' when 2 then translate(text, '.!?', '') else text end as text
  from hit, unnest(case when rule = 0 then [] when rule = 3 then [0, 1] else [0] end) as copies(c)),
keyed as (
  select conv_id, dense_rank() over (order by conv_id nulls first) as k, turn, role, text, left(role, 1) as ini,
    rtrim(text, {_SPACES}) as bare from damaged),
placed as (
  select *, row_number() over (partition by k order by turn nulls first, role, sha256(text)) as i from keyed),
judged as (
  select *, lag(ini) over (partition by k order by i) as earlier,
    case when bare = '' then 'b' when row_number() over (partition by k, role, text order by i) > 1 then 'd'
      when right(bare, 1) not in ('.', '!', '?') then 't' else '-' end as fault from placed),
turns as (
  select *, case fault when '-' then 0 when 't' then 3 else 1000000000 end as live from judged),
sizes as (select k, max(i) as n from turns group by k),
behind(k, i, b) as (
  select k, n + 1, [0, 6, 3, 0] from sizes
  union all
  select k, i, [least(we, 3 + wu, 6 + wa), least(ws, 3 + wu, 6 + wa), least(wu, 3 + wa), least(wa, 3 + wu)] from (
    select t.k, t.i,
      least(4 + b[1], live + 3 + b[3], case ini when 's' then live + b[2] when 'u' then live + b[3] else live + 3 + b[3] end) as we,
      least(4 + b[2], live + (case ini when 'u' then 0 else 3 end) + b[3]) as ws,
      least(4 + b[3], live + (case ini when 'a' then 0 else 3 end) + b[4]) as wu,
      least(4 + b[4], live + (case ini when 'u' then 0 else 3 end) + b[3]) as wa
    from behind join turns t on t.k = behind.k and t.i = behind.i - 1) as w),
traced(k, i, q, audit, cost, lines) as (
  select k, 1, 1, '', 0, cast([] as varchar[]) from sizes
  union all
  select k, case edit when 'I' then i else i + 1 end, case edit when 'D' then q when 'K' then keep else other end,
    audit || edit, cost + case edit when 'D' then 4 when 'I' then 3 when 'K' then live else 3 + live end,
    case edit when 'D' then lines when 'K' then list_append(lines, role || ':' || text)
      else list_append(lines, case other when 3 then 'user' else 'assistant' end || ':' ||
        case edit when 'I' then '' else text end) end
  from (
    select *, case when i <= n and 4 + nxt[q] = b[q] then 'D' when 3 + b[other] = b[q] then 'I'
      when i <= n and live + nxt[keep] = b[q] then 'K' when i <= n then 'R' end as edit
    from (
      select r.*, s.n, h.b, a.b as nxt, t.live, t.role, t.text, case q when 3 then 4 else 3 end as other,
        case when t.ini = 's' and q = 1 then 2 when t.ini = 'u' and q <> 3 then 3 when t.ini = 'a' and q = 3 then 4 end as keep
      from traced r join sizes s on s.k = r.k join behind h on h.k = r.k and h.i = r.i
      left join behind a on a.k = r.k and a.i = r.i + 1
      left join turns t on t.k = r.k and t.i = r.i) as choices) as edits
  where edit is not null),
ends as (
  select k, arg_max(audit, (length(audit), i)) as audit, arg_max(cost, (length(audit), i)) as cost,
    arg_max(lines, (length(audit), i)) as lines from traced group by k),
counts as (
  select k, any_value(conv_id) as conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
    count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate,
    count(*) filter (fault = 't') as truncated,
    count(*) filter (earlier is not null and earlier || ini not in ('su', 'ua', 'au')) as illegal
  from turns group by k)
select c.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
  coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, cast(coalesce(cost, 0) as bigint) as cost,
  coalesce(audit, '') as audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join counts n on n.conv_id is not distinct from c.conv_id
left join ends e on e.k = n.k
"""

ORACLES = {"op4_near_vectors": OP4, "op6_jaccard_join": OP6, "op9_chat_format": OP9, "op11_merkle_manifest": OP11, "op12_conversation_repair": OP12}
