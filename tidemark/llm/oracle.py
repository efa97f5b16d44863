"""DuckDB SQL that states what queries return."""

EXACT_DEDUP = r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') x from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, sha256(x) as text_sha256
from t window w as (partition by x)
"""

QUALITY_RULES = r"""
with d as (select doc_id, source, coalesce(text, '') t from documents),
w as (
  select doc_id, source, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda s: s <> '') words,
         list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) lines
  from d
),
windows as (
  select doc_id, i, list_aggregate(words[i : i + 7], 'string_agg', ' ') as win
  from (select doc_id, words, unnest(range(1, len(words) - 6)) i from w)
),
twice as (select doc_id, i from windows qualify count(*) over (partition by doc_id, win) > 1),
covered as (select doc_id, count(distinct i + o) n from twice, range(8) r(o) group by doc_id),
line as (
  select doc_id, source, md5(t) txt, trim(regexp_replace(lower(l), '[\x20\x09-\x0D]+', ' ', 'g')) flat
  from (select doc_id, source, t, unnest(lines) l from w)
),
size as (select source, count(distinct md5(t)) n from d group by source),
common as (
  select l.source, flat from line l join size s on l.source is not distinct from s.source
  group by l.source, flat having count(distinct txt) >= 5 and 100 * count(distinct txt) > 5 * any_value(s.n)
),
removed as (
  select doc_id, sum(len(l.flat) - len(replace(l.flat, ' ', '')) + 1)::bigint removed_words
  from line l join common c on l.source is not distinct from c.source and l.flat = c.flat group by doc_id
),
base as (
  select w.doc_id, len(words)::bigint n_words, coalesce(list_sum(list_transform(words, lambda s: len(s))), 0)::bigint word_chars,
         len(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint n_symbols, (len(lines) - len(list_distinct(lines)))::bigint n_dup_lines,
         coalesce(c.n, 0)::bigint n_repeat_words
  from w left join covered c using (doc_id)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
       not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and 100 * (n_words - coalesce(removed_words, 0)) >= 50 * n_words
         and n_words - coalesce(removed_words, 0) >= 20 as kept,
       coalesce(removed_words, 0)::bigint as removed_words
from base left join removed using (doc_id)
"""

SOURCE_DIVERGENCE = r"""
with d as (
  select row_number() over () r, coalesce(lang, '') lang, coalesce(source, '') as source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t
  from documents
),
w as (select r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term from d),
kept as (select lang, term, count(*) c from w group by lang, term having count(distinct r) >= 3),
size as (select lang, count(*) v, sum(c) n from kept group by lang),
grp as (select distinct lang, source from d),
own as (select lang, source, term, count(*) c from w semi join kept using (lang, term) group by lang, source, term),
total as (select lang, source, sum(c) n from own group by lang, source),
p as (
  select lang, source, term, coalesce(o.c, 0) c, 1 + (1000000000::hugeint * (coalesce(o.c, 0) + 1)) // (coalesce(t.n, 0) + s.v) p, 1 + (1000000000::hugeint * (k.c + 1)) // (s.n + s.v) q
  from grp join kept k using (lang) join size s using (lang) left join own o using (lang, source, term) left join total t using (lang, source)
),
sums as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0)::bigint as value
  from grp a join grp b on a.lang = b.lang and a.source <> b.source left join sums s on a.lang = s.lang and a.source = s.source and b.source = s.item
),
terms as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // q)::bigint as value from p where c > 0 and p > q)
select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from (select * from pairs union all select * from terms)
qualify part = 'pair' or rank <= 200
"""

FILTER_AUDIT = r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') t from documents),
w as (select doc_id, part, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda s: s <> '') words from d),
label as (select doc_id, max(coalesce((quality = 1)::int, 0)) good, max(coalesce((toxic = 1)::int, 0)) toxic from labels group by doc_id),
f as (
  select part, coalesce(good, 0) good, coalesce(toxic, 0) toxic, 1::bigint as one,
         (len(words) < 50)::int + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::int
         + 4 * (100 * len(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * len(t))::int + 8 * regexp_matches(t, '[#$%&*|]')::int
         + 16 * coalesce(min(w.doc_id) over (partition by t) < w.doc_id, false)::int as m
  from w left join label using (doc_id)
),
cell as (select part, m, sum(one) n, sum(good) good, sum(toxic) toxic from f group by part, m),
letter as (select unnest(['A', 'B', 'C', 'D', 'E']) c, unnest([1, 2, 4, 8, 16]) bit),
orders as (
  select a.c || b.c || c.c || d.c || e.c as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] bits
  from letter a, letter b, letter c, letter d, letter e
  where a.bit | b.bit | c.bit | d.bit | e.bit = 31
),
steps as (select filter_order, k::int as step, bits[k] as bit, coalesce(list_sum(bits[1 : k - 1]), 0)::int as before from orders, range(1, 6) r(k)),
shares as (
  select part, bit, sum(n)::bigint as shapley
  from (select part, filter_order, bit, sum(case when m & bit > 0 and m & before = 0 then n else 0 end) n from cell, steps group by all) group by part, bit
),
done as (
  select part, filter_order, step, bit, sum(case when m & (before | bit) = 0 then n else 0 end)::bigint as kept,
         sum(case when m & bit > 0 and m & before = 0 then n else 0 end)::bigint as removed,
         sum(case when m & bit > 0 and m & before > 0 then n else 0 end)::bigint as redundant,
         sum(case when m = bit then n else 0 end)::bigint as unique_fails,
         sum(case when m & bit > 0 and m & before = 0 then good else 0 end)::bigint as good_lost,
         sum(case when m & bit > 0 and m & before = 0 then toxic else 0 end)::bigint as toxic_lost
  from cell, steps group by part, filter_order, step, bit
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley from done join shares using (part, bit)
"""
