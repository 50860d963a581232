"""DuckDB SQL of the queries that SQL can express on small tables."""

from __future__ import annotations

_WORDS = "list_filter(string_split_regex({t}, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"

NEAR_DUPLICATES = f"""with recursive w as (select doc_id, {_WORDS.format(t="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
  else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as sh from w),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by all),
e as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * c >= 85 * (x.n + y.n - c)),
r as (select a as node, a as seen from e union select r.node, e.b from r join e on e.a = r.seen),
m as (select node, min(seen) as component from r group by 1)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(m.component, w.doc_id) as component_id, coalesce(m.component, w.doc_id) = w.doc_id as kept
from w left join n using (doc_id) left join m on m.node = w.doc_id"""

SUBSTRINGS = f"""with w as (select doc_id, {_WORDS.format(t="coalesce(text, '')")} as ws from documents),
g as (select doc_id, unnest(range(1, len(ws) - 18)) as pos, ws from w where len(ws) >= 20),
k as (select doc_id, pos, array_to_string(ws[pos:pos + 19], ' ') as key from g),
d as (select doc_id, pos from (select doc_id, pos, row_number() over (partition by key order by doc_id, pos) as rn from k) where rn > 1),
c as (select distinct doc_id, unnest(range(pos, pos + 20)) as idx from d),
x as (select doc_id, unnest(range(1, len(ws) + 1)) as idx, unnest(ws) as word from w),
o as (select x.doc_id, count(c.idx) as gone, string_agg(x.word, ' ' order by x.idx) filter (c.idx is null) as kept from x left join c using (doc_id, idx) group by 1)
select w.doc_id, len(ws)::bigint as n_words, coalesce(gone, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join o using (doc_id)"""

_ANY = r"\[INST\]|\[/INST\]|<s>|</s>|<<SYS>>|<</SYS>>|\[ROLE\]|\[/ROLE\]|\[/TURN\]"
CHAT = rf"""with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
t as (select *, length(regexp_replace(text, '(\\|{_ANY})', '\\\1', 'g')) as body, length(regexp_replace(role, '(\\|{_ANY})', '\\\1', 'g')) as name from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  (sum(body + case role when 'user' then 15 when 'assistant' then 9 when 'system' then 17 else name + 24 end) + count(*) - 1)::bigint as formatted_chars from t group by 1"""

_DOT = "list_sum(list_transform(list_zip({a}::double[], {b}::double[]), lambda z: z[1] * z[2]))"
EMBEDDINGS = f"""with recursive v as (select vec_id, label, embedding, sqrt({_DOT.format(a="embedding", b="embedding")}) as norm from embeddings where label is not null),
e as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.embedding) = len(b.embedding) where a.norm > 0 and b.norm > 0 and {_DOT.format(a="a.embedding", b="b.embedding")} / (a.norm * b.norm) >= 0.93),
r as (select a as node, a as seen from e union select r.node, e.b from r join e on e.a = r.seen),
m as (select node, min(seen) as component from r group by 1), n as (select a, count(*) as n from e group by 1)
select x.vec_id, coalesce(n.n, 0)::bigint as n_links, coalesce(component, x.vec_id) as component_id, coalesce(component, x.vec_id) = x.vec_id as kept
from embeddings x left join m on m.node = x.vec_id left join n on n.a = x.vec_id"""


def _ball_kmeans(rounds: int) -> str:
    """Lloyd's rounds written out: ``c`` holds the centroids of a round, ``a`` the assignment to them."""
    parts = [
        """v as (select row_number() over () as row_id, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as q from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64)""",
        "c0 as (select row_number() over (order by sha256('1:' || coalesce(vec_id::varchar, '')), vec_id) - 1 as c, q from v order by c limit 16)",
    ]
    for k in range(rounds + 1):
        distance = "list_sum(list_transform(list_zip(v.q, p.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint"
        parts.append(f"a{k} as (select row_id, vec_id, q, best.c as c, best.d as d from (select row_id, any_value(vec_id) as vec_id, any_value(q) as q, min({{'d': d, 'c': c}}) as best from (select v.row_id, v.vec_id, v.q, p.c, {distance} as d from v, c{k} p) group by row_id))")
        if k < rounds:
            parts.append(f"m{k} as (select c, i, sum(x) as s, count(*) as n from (select c, unnest(q) as x, unnest(range(64)) as i from a{k}) group by c, i)")
            parts.append(f"c{k + 1} as (select p.c, coalesce(n.q, p.q) as q from c{k} p left join (select c, list(((s - (s % n + n) % n) // n)::bigint order by i) as q from m{k} group by c) n using (c))")
    return f"""with {", ".join(parts)}
select a.vec_id, a.c::int as cluster, a.d as distance, (sum(d) over (partition by a.c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, sha256(array_to_string(p.q, ',')) as centroid_sha256
from a{rounds} a join c{rounds} p using (c)"""


ORACLES = {"op1_minhash_dedup": NEAR_DUPLICATES, "op2_chat_formatting": CHAT, "op5_substring_dedup": SUBSTRINGS, "op8_embedding_dedup": EMBEDDINGS, "op11_ball_kmeans": _ball_kmeans(3)}
