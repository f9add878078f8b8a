"""DuckDB SQL of those operators whose results plain SQL can say."""

from __future__ import annotations

FANOUT_LEVELS = 6  # 16^6 leaves of a group, and as many groups


def _coded(expr: str) -> str:
    return f"case when {expr} is null then '-' else strlen(cast({expr} as varchar)) || ':' || cast({expr} as varchar) end"


def _levels(name: str, leaves: str) -> tuple[str, str]:
    """CTEs of a tree's levels over ``leaves`` (g, place, digest), and its siblings by leaf place.

    ``{name}_path``: (g, place, path), the siblings before and after the
    followed node, level by level, as lists; ``{name}_top``: (g, digest)."""
    ctes = [f"{name}_0 as (select g, place, digest, count(*) over (partition by g) as n from {leaves})"]
    for k in range(1, FANOUT_LEVELS + 1):
        ctes.append(
            f"{name}_{k} as (select g, place // 16 as place, sha256(string_agg(digest, '' order by place)) as digest, "
            f"(max(n) + 15) // 16 as n from {name}_{k - 1} where n > 1 group by g, place // 16)"
        )
    tops = " union all ".join(f"select g, digest from {name}_{k} where n = 1" for k in range(FANOUT_LEVELS + 1))
    ctes.append(f"{name}_top as ({tops})")
    sides = []
    for k in range(FANOUT_LEVELS):
        sides.append(
            f"select l.g, l.place, {k} as level, coalesce(string_agg(s.digest, '' order by s.place) filter (where s.place < l.place // {16**k}), '') as before, "
            f"coalesce(string_agg(s.digest, '' order by s.place) filter (where s.place > l.place // {16**k}), '') as after "
            f"from {name}_0 l join {name}_{k} s on s.g = l.g and s.n > 1 and s.place // 16 = l.place // {16 ** (k + 1)} group by l.g, l.place"
        )
    ctes.append(f"{name}_sides as ({' union all '.join(sides)})")
    ctes.append(f"{name}_path as (select g, place, list({{'before': before, 'after': after}} order by level) as path from {name}_sides group by g, place)")
    return ",\n".join(ctes), name


_LEAF = " || ".join(_coded(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
_LOWERED = " || ".join(_coded(c) for c in ("doc_id", "source", "lang", "n_chars", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"))
_NO_PATH = "cast([] as struct(before varchar, after varchar)[])"

MERKLE = f"""
with recursive crc_steps as (
  select n, 0 as k, n as c from range(256) r(n)
  union all
  select n, k + 1, case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from crc_steps where k < 8),
crc_table as (select list(c order by n) as t from crc_steps where k = 8),
docs as (
  select doc_id, coalesce('=' || source, '') as g, sha256({_LEAF}) as digest, sha256({_LOWERED}) as lowered,
         xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint))),
                         lambda c, b: xor(c >> 8, t[cast(xor(c & 255, b) as int) + 1])), 4294967295) as crc
  from documents, crc_table),
placed as (select *, row_number() over (partition by g order by doc_id nulls first, digest) - 1 as place from docs),
{_levels('t', 'placed')[0]},
tops as (select g as source_g, '' as g, row_number() over (order by g) - 1 as place, digest from t_top),
{_levels('s', 'tops')[0]},
paths as (
  select p.doc_id, p.digest as leaf, o.digest as subroot, (select digest from s_top) as root,
         case when p.crc % 5 = 0 then p.lowered else p.digest end as shown,
         list_concat(coalesce(t.path, {_NO_PATH}), coalesce(s.path, {_NO_PATH})) as path
  from placed p join tops o on o.source_g = p.g
  left join t_path t on t.g = p.g and t.place = p.place
  left join s_path s on s.place = o.place),
folded as (
  select *, list_reduce(list_prepend({{'before': shown, 'after': ''}}, path),
                        lambda a, x: {{'before': sha256(x.before || a.before || x.after), 'after': ''}}).before as folded_root
  from paths)
select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x.before || x.after), '')) as proof_sha256,
       folded_root, folded_root = root as verified
from folded"""


def _escaped(text: str) -> str:
    from trenchline.llm.reply_trees import CONTROL

    for first in "<[":
        rest = "|".join(c[1:].replace("|", "\\|").replace("[", "\\[").replace("]", "\\]") for c in CONTROL if c[0] == first)
        text = f"regexp_replace({text}, '(\\{first}\\\\*)({rest})', '\\1\\\\\\2', 'g')"
    return text


def conversations() -> str:
    from trenchline.llm.reply_trees import CLOSE, OPEN

    marks = len(OPEN) + 1 + len(CLOSE)
    said = "'</s>[INST] ok [/INST]'"
    role = _escaped("replace(replace(role, '\\', '\\\\'), chr(10), '\\n')")
    return f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', {said} union all select -7, 1, 'assistant', {said}),
keyed as (select *, sha256(length(role) || ':' || role || text) as digest from turns)
select conv_id, cast(count(*) as bigint) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, digest)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, digest) filter (where role = 'assistant'), '')) as loss_sha256,
       cast(sum({marks} + length({role}) + length({_escaped('text')})) as bigint) as formatted_chars
from keyed group by conv_id"""


NEGATIVES = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same,
         cast(list_sum(list_transform(list_zip(a.q, b.q), lambda z: coalesce(z[1] * z[2], 0))) as bigint) as score
  from v a join v b on b.vec_id is distinct from a.vec_id
  where a.vec_id % 50 = 0),
positives as (
  select anchor_id, other_id as positive_id, score as positive_score from scores where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id nulls first) <= 5)
select p.anchor_id, p.positive_id,
       cast(row_number() over (partition by p.anchor_id, p.positive_id order by n.score desc, n.other_id nulls first) as int) as rank,
       n.other_id as negative_id, p.positive_score, n.score as negative_score
from positives p join scores n on n.anchor_id = p.anchor_id and not n.same
where 50 * p.positive_score <= 100 * n.score and 100 * n.score <= 95 * p.positive_score
qualify row_number() over (partition by p.anchor_id, p.positive_id order by n.score desc, n.other_id nulls first) <= 3"""

#: every place of a 35-word window is compared by its words, so this is for small tables
REPEATS = """
with w as (
  select doc_id, rid, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x != '') as ws
  from (select *, row_number() over () as rid from documents)),
starts as (
  select rid, s, hash(list_slice(ws, s, s + 34)) as h1, md5(array_to_string(list_slice(ws, s, s + 34), ' ')) as h2
  from (select rid, ws, unnest(range(1, len(ws) - 33)) as s from w where len(ws) >= 35)),
repeated as (select rid, s from starts qualify count(*) over (partition by h1, h2) > 1),
covered as (select distinct rid, s + k as p from repeated, range(35) r(k)),
gone as (select rid, list(p) as ps, count(*) as n from covered group by rid)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_removed,
       sha256(array_to_string(case when ps is null then ws else list_transform(list_filter(range(1, len(ws) + 1), lambda i: not list_contains(ps, i)), lambda i: ws[i]) end, ' ')) as kept_sha256
from w left join gone using (rid)"""

ORACLE = {"op11_bitmap_merkle": MERKLE, "op12_reply_trees": conversations(), "op13_l2ap_negatives": NEGATIVES, "op9_doubling_dedup": REPEATS}
