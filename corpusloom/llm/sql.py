"""DuckDB SQL for the queries of this subpackage that SQL can express over whole tables."""

from __future__ import annotations

from .quality_rules import BUCKETS, MIX, THRESHOLD

SPACE = r"[ \t\n\x0B\f\r]"
WORDS = r"[^ \t\n\x0B\f\r]+"

OP1 = f"""
with d as (select row_number() over () as row_key, doc_id, coalesce(text, '') as text from documents),
w as (select row_key, doc_id, text, regexp_extract_all(text, '{WORDS}') as words from d),
t as (select row_key, unnest(words) as word, generate_subscripts(words, 1) as pos from w),
h as (select row_key, pos, word, ('0x' || substr(md5(word), 1, 8))::bigint as h from t),
n as (
  select row_key, h % {BUCKETS} as bucket from h
  union all
  select row_key, (a * {MIX} + h) % {BUCKETS} from (select row_key, h, lag(h) over (partition by row_key order by pos) as a from h) where a is not null),
good as (select distinct doc_id from labels where quality = 1),
c as (select bucket, count(*) as raw, count(*) filter (w.doc_id in (from good)) as target from n join w using (row_key) group by bucket),
z as (select sum(raw) as raw, sum(target) as target from c),
r as (select bucket, ln((c.target + 1)::double / (z.target + {BUCKETS})) - ln((c.raw + 1)::double / (z.raw + {BUCKETS})) as ratio from c, z),
s as (select row_key, avg(ratio) as score from n join r using (bucket) group by row_key),
win as (
  select row_key, pos, array_to_string(list(word) over (partition by row_key order by pos rows between current row and 7 following), ' ') as win,
    count(*) over (partition by row_key order by pos rows between current row and 7 following) as len from h),
twice as (select row_key, pos, count(*) over (partition by row_key, win) > 1 as again from win where len = 8),
hit as (select count(distinct (row_key, p)) as n, row_key from (select row_key, unnest(range(pos, pos + 8)) as p from twice where again) group by row_key),
lines as (select row_key, unnest(string_split(text, chr(10))) as line from d),
dup as (select row_key, count(*) - count(distinct line) as n from lines where regexp_matches(line, '{WORDS}') group by row_key),
base as (
  select row_key, doc_id, len(words)::bigint as n_words, length(regexp_replace(text, '{SPACE}', '', 'g'))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(hit.n, 0)::bigint as n_repeat_words
  from w left join dup using (row_key) left join hit using (row_key))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and coalesce(score, 0) >= {THRESHOLD} as kept
from base left join s using (row_key)
"""

OP4 = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length('<|im_start|>') + length(role) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length('<|im_end|>') + 1)::bigint as formatted_chars
from t group by conv_id
"""

OP3 = r"""
with items as (
  select item_id::varchar as item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
wins as (
  select distinct item_id, array_to_string(ws[i:i + 9], ' ') as win, least(len(ws), 10) as size
  from (select item_id, ws, unnest(range(1, greatest(2, len(ws) - 8))) as i from items where len(ws) > 0)),
d as (
  select row_number() over () as row_key, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
  from documents),
sizes as (select distinct size from wins),
grams as (
  select row_key, i, size, array_to_string(ws[i:i + size - 1], ' ') as win
  from (select row_key, ws, size, unnest(range(1, len(ws) - size + 2)) as i from d, sizes where len(ws) >= size)),
hits as (select row_key, i, g.size, item_id from grams g join wins w on g.win = w.win and g.size = w.size),
n as (select row_key, count(distinct p) as n from (select row_key, unnest(range(i, i + size)) as p from hits) group by row_key),
m as (select row_key, count(distinct item_id) as k, string_agg(distinct item_id, ',' order by item_id) as ids from hits group by row_key)
select doc_id, len(ws)::bigint as n_words, coalesce(n, 0)::bigint as n_hit, coalesce(k, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n, 0) > 0 as contaminated
from d left join n using (row_key) left join m using (row_key)
"""

ORACLE_SQL: dict[str, str] = {"op1_quality_rules": OP1, "op3_benchmark_decontamination": OP3, "op4_chat_formatting": OP4}
