"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from packetloom.llm import sharding


def _draw(node: sharding.Node) -> str:
    return f"-ln((('0x' || substr(md5(k || '/{node.name}'), 1, 13))::bigint + 0.5) / 4503599627370496.0) / {node.weight}"


def _descend(node: sharding.Node) -> str:
    if node.shard is not None:
        return str(node.shard)
    if len(node.children) == 1:
        return _descend(node.children[0])
    arms = " ".join(f"when {i} then {_descend(c)}" for i, c in enumerate(node.children))
    draws = ", ".join(f"struct_pack(d := {_draw(c)}, i := {i})" for i, c in enumerate(node.children))
    return f"(case list_min([{draws}]).i {arms} end)"


def _sharding_sql() -> str:
    tree = sharding.base_tree(16)
    return f"""
with tab as (select list(v order by i) as tab from (select i, list_reduce([i::bigint] || range(8),
  lambda a, b: case when a & 1 = 1 then xor(3988292384, a >> 1) else a >> 1 end) as v from range(256) r(i))),
d as (select doc_id, coalesce(doc_id::varchar, '') as k, encode(coalesce(text, '')) as raw from documents),
s as (select doc_id, k, octet_length(raw) + 1 as size,
  case when octet_length(raw) = 0 then 0 else xor(4294967295, list_reduce([4294967295::bigint] ||
    list_transform(regexp_extract_all(hex(raw), '..'), lambda j: ('0x' || j)::bigint),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) end as text_crc32,
  {_descend(tree)} as shard, {_descend(sharding.grown(tree))} as grown_shard
  from d, tab),
b as (select *, ('0x' || substr(md5(k || '#' || text_crc32::bigint || '#' || size || '#'), 1, 8))::bigint % {sharding.SLOT_BUCKETS} as bucket from s)
select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'key' as law, shard::int as shard,
  (row_number() over (partition by shard order by bucket, doc_id nulls first, text_crc32, size) - 1)::bigint as slot,
  grown_shard::int as grown_shard from b"""


CHAT = r"""
with t as (
  select conv_id, turn, role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e as (select *, replace(replace(text, '&', '&amp;'), '<|', '&lt;|') as body,
  replace(replace(replace(coalesce(role, ''), '&', '&amp;'), '<|', '&lt;|'), chr(10), '&nl;') as head from t)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' order by turn, role nulls first, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role nulls first, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length('<|im_start|>' || head || chr(10) || body || '<|im_end|>' || chr(10)))::bigint as formatted_chars
from e group by conv_id"""

NEAR = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as s from w),
o as (select doc_id, list_sort(s) as s from s),
f as (select min(doc_id) as rep, o.s as s, len(o.s) as n from o where len(o.s) > 0 group by o.s),
x as (select rep, n, unnest(s) as sh from f),
p as (select a.rep as a, b.rep as b from x a join x b on a.sh = b.sh and a.rep < b.rep
  group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e as (select a, b from p union select b, a from p),
r(a, b) as (select rep, rep from f union select r.a, e.b from r join e on r.b = e.a),
c as (select a as rep, min(b) as component_id from r group by a)
select o.doc_id, len(o.s)::bigint as n_shingles, coalesce(c.component_id, o.doc_id)::bigint as component_id,
  o.doc_id = coalesce(c.component_id, o.doc_id) as kept
from o left join f on o.s = f.s left join c on f.rep = c.rep"""

ORACLES: dict[str, str] = {"op1_sharding": _sharding_sql(), "op2_near_dedup": NEAR, "op8_chat_format": CHAT}
