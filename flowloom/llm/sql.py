"""The SQL that queries of this package are checked against."""

from __future__ import annotations

from flowloom.llm.quality import RULES, Risk

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_RISK = Risk()
_CUTS = ", ".join(f"('{rule}', {i}, {cut}::double)" for rule, cuts in RULES.items() for i, cut in enumerate(cuts))

QUALITY = rf"""
with d as (select row_number() over () as r, doc_id, lang, coalesce(text, '') as text, {_WORDS} as w from documents),
base as (
  select r, doc_id, lang, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::bigint as capitals,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from d),
grams as (
  select r, i, array_to_string(w[i:i + 4], ' ') as g
  from (select r, w, unnest(range(1, len(w) - 3)) as i from d where len(w) >= 5)),
twice as (select r, i from (select r, i, count(*) over (partition by r, g) as n from grams) where n > 1),
covered as (select r, count(distinct i + k)::bigint as n from twice, (select unnest(range(5)) as k) group by r),
m as (
  select b.*, coalesce(c.n, 0) as n_repeat_words, len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines
  from base b left join covered c using (r)),
f as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
    case when n_words > 0 then n_symbols / n_words else 0.0 end as m_symbols,
    case when n_lines > 0 then n_dup_lines / n_lines else 0.0 end as m_dup_lines,
    case when n_words > 0 then n_repeat_words / n_words else 0.0 end as m_repeats,
    case when word_chars > 0 then capitals / word_chars else 0.0 end as m_capitals
  from m),
long as (
  select r, lang, base_failed, doc_id, rule, value from f
  unpivot (value for rule in (m_symbols, m_dup_lines, m_repeats, m_capitals))),
cuts as (select * from (values {_CUTS}) t(rule, step, cut)),
good as (select doc_id from labels group by doc_id having max(quality) = 1),
held as (select * from long where not base_failed and doc_id in (select doc_id from good)),
counted as (
  select lang, c.rule, c.step, c.cut, count(*) as n, count(*) filter (where value > cut) as k
  from held join cuts c on held.rule = 'm_' || c.rule group by all),
tails as (
  select lang, rule, step, cut, n, k,
    case when k > n * {_RISK.alpha} then 1.0 else (
      select sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({_RISK.alpha}) + (n - j) * ln(1 - {_RISK.alpha})))
      from (select unnest(range(0, k + 1)) as j)) end as p
  from counted),
cutoffs as (
  select lang, rule, max_by(cut, step) as cut from tails
  where p <= {_RISK.level} / ((select count(distinct coalesce(lang, '')) from held) * {len(RULES)}) group by all),
bad as (
  select distinct r from long join cutoffs c on long.lang is not distinct from c.lang and long.rule = 'm_' || c.rule and value > cut)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and r not in (select r from bad) as kept
from f
"""

_PLAIN = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

DECONTAMINATE = rf"""
with d as (select row_number() over () as r, doc_id, {_PLAIN} as w from documents),
items as (select item_id, {_PLAIN} as w from benchmark),
windows as (
  select distinct item_id, len(g) as n, array_to_string(g, ' ') as g from (
    select item_id, w[i:i + 9] as g from (select item_id, w, unnest(range(1, len(w) - 8)) as i from items where len(w) >= 10)
    union all select item_id, w from items where len(w) between 1 and 9)),
sizes as (select distinct n from windows),
grams as (
  select r, n, i, array_to_string(w[i:i + n - 1], ' ') as g
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
found as (select r, item_id, i, n from grams join windows using (n, g)),
words as (select r, count(distinct i + k)::bigint as n_hit from found, (select unnest(range(10)) as k) where k < n group by r),
named as (
  select r, count(*)::bigint as n_items, string_agg(item, ',' order by item) as items
  from (select distinct r, item_id::varchar as item from found where item_id is not null) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (r) left join named using (r)
"""

MIXING = rf"""
with d as (
  select row_number() over () as r, doc_id, source, len({_WORDS})::bigint as size, md5(coalesce(doc_id::varchar, '')) as tag from documents),
totals as (select source, sum(size)::bigint as source_size from d group by source),
weighed as (
  select *, [3, 1, 2][(row_number() over (order by source nulls last) - 1) % 3 + 1] as w from totals),
filled as (
  select *, sum(source_size) over () as all_size, sum(w) over () as all_w,
    coalesce(sum(source_size) over f, 0) as size_before, coalesce(sum(w) over f, 0) as w_before
  from weighed window f as (order by source_size / w, source nulls last rows between unbounded preceding and 1 preceding)),
levels as (select *, (all_size * 1.5::double - 2 * size_before)::double / (all_w - w_before)::double as level from filled),
opened as (select min(struct_pack(w_before := w_before, level := level)) filter (where level * w <= 2 * source_size) as o from levels),
goals as (
  select source, source_size, case when w_before >= o.w_before then o.level * w else 2 * source_size end::double as target from levels, opened),
ranked as (select *, row_number() over (partition by source order by size, tag, doc_id) as rank from d),
aimed as (
  select k.*, source_size, target, case when source_size > 0 then target / source_size else 0 end as each,
    ('0x' || substr(md5('mix:' || coalesce('=' || k.source, 'null')), 1, 8))::bigint / 4294967296.0::double as u
  from ranked k join goals g on k.source is not distinct from g.source)
select doc_id, size, source_size, target, ((floor(u + each * rank) - floor(u + each * (rank - 1))) * size)::bigint as taken from aimed
"""

LINE_DEDUP = r"""
with raw as (select row_number() over () as r, doc_id, text from documents),
key as (select min(r) as r, doc_id, text from raw group by doc_id, text),
line as (
  select r, doc_id, i, x, regexp_matches(x, '[^\x20\x09-\x0D]') as has_word
  from (select r, doc_id, unnest(string_split(text, chr(10))) as x, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from key)),
solid as (select r, doc_id, i, x, row_number() over (partition by r order by i) as pos from line where has_word),
win as (
  select r, doc_id, pos, x, b, c
  from (select *, lead(x) over f as b, lead(x, 2) over f as c from solid window f as (partition by r order by pos)) where c is not null),
ordered as (
  select *, row_number() over (partition by x, b, c order by doc_id nulls last, r, pos) as nth,
    first_value(r) over (partition by x, b, c order by doc_id nulls last, r, pos) as r0,
    first_value(pos) over (partition by x, b, c order by doc_id nulls last, r, pos) as pos0
  from win),
gone as (
  select distinct r, pos + k as pos from ordered, (select unnest(range(3)) as k) where nth > 1 and (r <> r0 or pos + k >= pos0 + 3)),
kept as (
  select l.r, l.i, l.x, l.has_word, g.pos is not null as cut
  from line l left join solid s on l.r = s.r and l.i = s.i left join gone g on s.r = g.r and s.pos = g.pos),
text as (
  select r, count(*) filter (where has_word)::bigint as n_lines, count(*) filter (where cut)::bigint as n_removed,
    coalesce(string_agg(x, chr(10) order by i) filter (where not cut), '') as text
  from kept group by r)
select w.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, t.text
from raw w join key k on w.doc_id is not distinct from k.doc_id and w.text is not distinct from k.text left join text t on k.r = t.r
"""

_ESCAPED = "replace(replace({}, '␛', '␛e'), '<|', '<␛|')"

CHAT = rf"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(length('<|im_start|>' || replace({_ESCAPED.format('role')}, chr(10), '␛n') || chr(10) || {_ESCAPED.format('text')} || '<|im_end|>' || chr(10)))::bigint
    as formatted_chars
from t group by conv_id
"""

BACKOFF = r"""
with d as (
  select row_number() over () as r, doc_id,
    trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') as x
  from documents),
tok as (select r, unnest(regexp_extract_all(x, '(?s).')) as c, unnest(range(length(x))) as i from d),
gram as (
  select r, coalesce(lag(c, 2) over w, '') as a, coalesce(lag(c) over w, '') as b, c from tok window w as (partition by r order by i)),
m as (select r, a, b, c, count(*) as abc from gram group by all),
own as (
  select *, sum(abc) over (partition by r, a, b) as ab, sum(abc) over (partition by r, b, c) as bc,
    sum(abc) over (partition by r, b) as b1, sum(abc) over (partition by r, c) as c1 from m),
t as (select a, b, c, sum(abc) as abc from m group by all),
corpus as (
  select *, sum(abc) over (partition by a, b) as ab, sum(abc) over (partition by b, c) as bc,
    sum(abc) over (partition by b) as b1, sum(abc) over (partition by c) as c1, sum(abc) over () as n from t),
rest as (
  select r, o.abc as k, p.abc - o.abc as abc, p.ab - o.ab as ab, p.bc - o.bc as bc, p.b1 - o.b1 as b1, p.c1 - o.c1 as c1, n
  from own o join corpus p using (a, b, c)),
scored as (
  select r, sum(k)::bigint as n_tokens, sum(k * log10(case when abc > 0 then abc / ab when bc > 0 then 0.4::double * bc / b1
    when c1 > 0 then 0.16::double * c1 / n else 0.064::double / (n + 1) end)) / sum(k) as score
  from rest group by r)
select doc_id, coalesce(n_tokens, 0) as n_tokens, round(score, 6) as score from d left join scored using (r)
"""

#: The same over words.
BACKOFF_WORDS = BACKOFF.replace(
    "unnest(regexp_extract_all(x, '(?s).')) as c, unnest(range(length(x))) as i from d",
    "unnest(string_split(x, ' ')) as c, unnest(range(len(string_split(x, ' ')))) as i from d where x <> ''",
)

EXACT_DEDUP = r"""
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
  row_number() over (partition by coalesce(text, '') order by doc_id desc nulls last) = 1 as kept, sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))
"""


def _merkle(levels: int = 5) -> str:
    """Trees of up to 16 ** `levels` leaves, one step of each level written out."""
    field = lambda x: f"coalesce(strlen({x}::varchar) || ':' || {x}::varchar, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"

    def tree(name: str) -> str:
        """From {name}0 (g, pos, h, size) the levels above it, and {name}s0 ... with what lies left and right of each node."""
        parts = []
        for i in range(levels):
            run = "partition by g, pos // 16 order by pos rows between"
            parts.append(f"""{name}s{i} as (
  select g, pos, size, coalesce(string_agg(h, '') over ({run} unbounded preceding and 1 preceding), '') as l,
    coalesce(string_agg(h, '') over ({run} 1 following and unbounded following), '') as r from {name}{i} where size > 1),
{name}{i + 1} as (
  select g, pos // 16 as pos, case when size > 1 then sha256(string_agg(h, '' order by pos)) else any_value(h) end as h, (size + 15) // 16 as size
  from {name}{i} group by g, pos // 16, size)""")
        return ",\n".join(parts)

    def folded(name: str, start: str, pos: str, group: str) -> str:
        parts = []
        for i in range(levels):
            before = start if i == 0 else f"{name}f{i - 1}"
            parts.append(f"""{name}f{i} as (
  select f.* replace (case when s.g is null then acc else sha256(l || acc || r) end as acc, sibs || coalesce(l || r, '') as sibs)
  from {before} f left join {name}s{i} s on s.g = f.{group} and s.pos = f.{pos} // {16 ** i})""")
        return ",\n".join(parts)

    return f"""
with crcs as (
  select list(list_reduce([n]::bigint[] || [0, 0, 0, 0, 0, 0, 0, 0]::bigint[],
    lambda c, k: case when (c & 1) = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end) order by n) as tab from range(256) t(n)),
leafs as (
  select doc_id, coalesce('=' || source, '') as g, {leaf("text")} as leaf,
    {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as lowered,
    xor(list_reduce([4294967295]::bigint[] || list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::bigint) as crc
  from documents, crcs),
placed as (
  select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by g) as n from leafs),
a0 as (select g, pos, leaf as h, n as size from placed),
{tree("a")},
sources as (select g as source, h, row_number() over (order by g) - 1 as pos, count(*) over () as n from a{levels}),
b0 as (select '' as g, pos, h, n as size from sources),
{tree("b")},
start as (
  select p.doc_id, p.leaf, p.g, p.pos, s.pos as at, '' as top, s.h as subroot, case when crc % 5 = 0 then lowered else leaf end as acc, '' as sibs
  from placed p join sources s on p.g = s.source),
{folded("a", "start", "pos", "g")},
{folded("b", f"af{levels - 1}", "at", "top")}
select doc_id, leaf, subroot, (select h from b{levels}) as root, sha256(sibs) as proof_sha256, acc as folded_root, acc = (select h from b{levels}) as verified
from bf{levels - 1}
"""


MERKLE = _merkle()


def _centroids(k: int = 40, rounds: int = 5, seed: int = 2) -> str:
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} as materialized (
  select rn, min(struct_pack(d := list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint, c := c.c)) as m
  from kept k, c{i} c group by rn)""")
        if i < rounds:
            steps.append(f"""s{i} as (
  select c, list((s - ((s % n) + n) % n) // n order by j) as v from (
    select c, j, sum(x) as s, count(*) as n from (select m.c as c, unnest(v) as x, unnest(range(len(v))) as j from a{i} join kept using (rn)) group by c, j) group by c),
c{i + 1} as materialized (select c{i}.c, coalesce(s{i}.v, c{i}.v)::bigint[] as v from c{i} left join s{i} using (c))""")
    return f"""
with kept as materialized (
  select row_number() over () as rn, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
c0 as materialized (
  select row_number() over (order by sha256('{seed}:' || vec_id) nulls last, v) - 1 as c, v from kept order by sha256('{seed}:' || vec_id) nulls last, v limit {k}),
{", ".join(steps)}
select vec_id, m.c::int as cluster, m.d as distance, sum(m.d) over (partition by m.c)::bigint as cluster_inertia, sum(m.d) over ()::bigint as inertia,
  sha256(array_to_string(c{rounds}.v, ',')) as centroid_sha256
from a{rounds} join kept using (rn) join c{rounds} on c{rounds}.c = m.c
"""


CENTROIDS = _centroids()
