"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

from . import secret_scan

ORACLES: dict[str, str] = {}

_ALPHABET = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLES["op1_decontamination"] = f"""
with d as (
  select row_number() over () as k, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_ALPHABET}), '{_WORD}') as w from documents
), b as (
  select cast(item_id as varchar) as item_id, regexp_extract_all(translate(coalesce(text, ''), {_ALPHABET}), '{_WORD}') as w
  from benchmark where item_id is not null
), n as (
  select item_id, w, least(13, len(w)) as n from b where len(w) > 0
), windows as (
  select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as x
  from (select item_id, n, w, unnest(range(1, len(w) - n + 2)) as i from n)
), sizes as (select distinct n from windows), grams as (
  select k, n, i, array_to_string(w[i:i + n - 1], ' ') as x
  from (select k, n, w, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)
), hits as (select g.k, g.n, g.i, v.item_id from grams g join windows v on g.n = v.n and g.x = v.x
), hit as (
  select k, count(distinct p) as n_hit from (select distinct k, unnest(range(i, i + n)) as p from hits) group by k
), items as (
  select k, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct k, item_id from hits) group by k
)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit using (k) left join items using (k)
"""


def _secrets() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    each = "\nunion all ".join(
        f"select k, {rank} as rank, {quoted(r.name)} as kind, {r.least} as least, string_split_regex(t, {quoted(r.pattern)}) as pieces, "
        f"regexp_extract_all(t, {quoted(r.pattern)}) as m, regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) as g from d"
        for rank, r in enumerate(secret_scan.RULES)
    )
    line = "kind || ':' || s || ':' || e"
    n = lambda kind: f"cast(count(*) filter (kind = '{kind}') as bigint) as n_{kind}"
    return f"""
with d as (select row_number() over () as k, doc_id, coalesce(text, '') as t from documents),
every as ({each}),
steps as (
  select k, rank, kind, least, i, length(pieces[i]) as gap, length(m[i]) as size, length(g[i]) as judged
  from (select *, unnest(range(1, len(m) + 1)) as i from every)
), spans as (
  select k, rank, kind, judged, least, size, sum(gap + size) over (partition by k, rank order by i) as e from steps
), kept as (select k, rank, kind, cast(e - size as bigint) as s, cast(e as bigint) as e from spans where judged >= least)
, found as (
  select k, {n("assign")}, {n("access")}, {n("hex")},
    string_agg({line}, ',' order by s, rank) filter (rank < {len(secret_scan.BASE)}) as base, string_agg({line}, ',' order by s, rank) as spans
  from kept group by k
)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join found using (k)
"""


ORACLES["op2_secret_scan"] = _secrets()

ORACLES["op7_chat_format"] = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), bodies as (
  select *, case
    when not contains(text, '\') and not contains(text, ' </turn>' || chr(10)) then text
    when not contains(text, ' </turn>' || chr(10)) then replace(text, '\', '\\')
    else replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '#', '\#') end as body
  from rows
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(length('### ' || url_encode(role) || ': ' || body || ' </turn>' || chr(10))) as bigint) as formatted_chars
from bodies group by conv_id
"""
