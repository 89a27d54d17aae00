"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from pagelens.llm.secret_scan import BASE_RULES, RULES
from pagelens.llm.url_filter import BASE_RULES as URL_BASE, MORE_RULES as URL_MORE


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secret_spans(rank: int, rule) -> str:
    """Matches of one rule with positions: gaps and matches alternate."""
    p = _quoted(rule.pattern)
    keep = f"where length(regexp_extract(m, {p}, 2)) >= {rule.group2}" if rule.group2 else ""
    return f"""
    select doc, {rank} as rank, '{rule.kind}' as kind, stop - length(m) as start, stop from (
      select doc, m, (sum(length(g) + length(m)) over (partition by doc order by i))::bigint as stop from (
        select doc, unnest(regexp_extract_all(t, {p})) as m, unnest(string_split_regex(t, {p})) as g,
               generate_subscripts(string_split_regex(t, {p}), 1) as i
        from docs where regexp_matches(t, {p})) where m is not null) {keep}"""


def _secret_sql() -> str:
    spans = " union all ".join(_secret_spans(i, r) for i, r in enumerate(RULES))
    counts = ", ".join(f"(count(*) filter (kind = '{r.kind}'))::bigint as n_{r.kind}" for r in BASE_RULES)
    one = "kind || ':' || start || ':' || stop"
    return f"""
with docs as (select row_number() over () as doc, doc_id, coalesce(text, '') as t from documents),
spans as ({spans}),
per as (
  select doc, {counts},
         coalesce(string_agg({one}, ',' order by start, rank) filter (rank < {len(BASE_RULES)}), '') as base,
         string_agg({one}, ',' order by start, rank) as spans
  from spans group by doc)
select doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) as n_{r.kind}" for r in BASE_RULES)},
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join per using (doc)"""


TOPK_SQL = """
with v as (
  select row_number() over () as n, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select q.n, q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from v q join v c on q.vec_id % 100 = 0 and c.n <> q.n),
ranked as (
  select *, (row_number() over (partition by n order by score desc, vec_id))::integer as rank from pairs)
select query_id, rank, vec_id, score from ranked where rank <= 10"""


def _url_sql() -> str:
    base = " union all ".join(
        f"select {_quoted(r.rule)} as rule, {_quoted(r.pattern)} as pattern, {_quoted(r.verdict)} as verdict" for r in URL_BASE)
    more = " or ".join(f"regexp_matches(host || path, {_quoted(r.pattern)})" for r in URL_MORE)
    return f"""
with p as (
  select row_number() over () as n, page_id,
         translate(regexp_extract(coalesce(url, ''), '^[\\s\\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '^[\\s\\S]*?://[^/?#]*([^?#]*)', 1) as path from pages),
rules as ({base}),
fit as (
  select n, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict
  from p, rules where regexp_matches(host || path, pattern) group by n)
select page_id, host, path, rule, coalesce(verdict, case when {more} then 'block' else 'allow' end) as verdict
from p left join fit using (n)"""


LINES_SQL = """
with d as (select row_number() over () as n, doc_id, coalesce(text, '') as text from documents),
l as (
  select n, doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from d),
k as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
frequent as (
  select key, max(doc_id) as top from k where length(key) >= 40 group by key having count(distinct n) >= 5),
judged as (
  select k.*, coalesce(k.doc_id < f.top, f.top is not null) as gone from k left join frequent f using (key))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from judged group by n, doc_id"""


# CRC-32 of the digits of an id, bit by bit.
_CRC = """xor(list_reduce(
  list_prepend(4294967295::ubigint, list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::ubigint)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0::ubigint for _ in range(8)]),
    lambda x, _: case when x & 1 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end)), 4294967295::ubigint)"""

TRIE_SQL = f"""
with t as (
  select conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as h,
         strlen(coalesce(text, ''))::bigint as bytes
  from conversations where conv_id is not null),
own as (
  select conv_id, list({{'h': h, 'bytes': bytes}} order by turn nulls first, h) as turns, conv_id - conv_id % 5 as base,
         ({_CRC} % 9)::bigint as n
  from t group by conv_id),
paths as (
  select o.conv_id, list_concat(coalesce(b.turns[1:o.n], []), o.turns[o.n + 1:]) as p
  from own o left join own b on b.conv_id = o.base),
named as (select conv_id, list_transform(p, lambda x: x.h) as p, list_transform(p, lambda x: x.bytes) as b from paths),
cut as (select conv_id, p, b, unnest(range(len(p) + 1)) as depth from named),
prefixes as (select conv_id, p[1:depth] as p, depth, b[depth] as bytes, len(p) = depth as ends from cut),
nodes as (
  select p, depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(bytes) as bytes,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) as ends_sha256
  from prefixes group by p, depth),
families as (select p[1:depth - 1] as p, count(*) as n from nodes where depth > 0 group by 1),
sized as (
  select nodes.*, coalesce(n, 0) as n_children, case when depth = 0 then 0 else (n_convs - 1) * bytes end as saved
  from nodes left join families using (p)),
above as (select p, n_children, saved, unnest(range(depth + 1)) as d from sized),
trees as (
  select p[1:d] as p, count(*) filter (n_children = 0) as n_leaves, sum(saved)::bigint as saved_tokens
  from above group by 1)
select s.conv_id, s.depth, u.conv_id as parent_conv_id, s.n_convs, s.n_children, t.n_leaves, t.saved_tokens, s.ends_sha256
from sized s join trees t using (p) left join nodes u on s.depth > 0 and u.p = s.p[1:s.depth - 1]"""


ORACLES: dict[str, str] = {
    "op1_secret_scan": _secret_sql(),
    "op3_exact_topk": TOPK_SQL,
    "op6_url_filter": _url_sql(),
    "op12_line_dedup": LINES_SQL,
    "op13_prefix_trie": TRIE_SQL,
}
