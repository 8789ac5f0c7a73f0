"""DuckDB SQL of those queries that SQL can express."""

from __future__ import annotations

# words of a text that a null text has none of
_PLAIN = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"
# only A-Z are lower-cased
_LOWERED = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"regexp_extract_all(coalesce(" + _LOWERED + r", ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = f"""
with docs as (select doc_id, {_ALNUM.format(text="text")} w from documents),
items as (select item_id, {_ALNUM.format(text="text")} w from benchmark),
sized as (select item_id, w, least(10, len(w)) m from items where len(w) > 0),
windows as (
  select distinct item_id, m, array_to_string(w[i:i + m - 1], ' ') g
  from (select item_id, w, m, unnest(range(1, len(w) - m + 2)) i from sized)),
places as (
  select doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') g
  from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) i
        from docs, (select distinct m from windows) where len(w) >= m)),
hits as (select doc_id, i, m, item_id from places join windows using (m, g)),
covered as (
  select doc_id, count(distinct p) n_hit
  from (select doc_id, unnest(range(i, i + m)) p from hits) group by doc_id),
named as (
  select doc_id, count(*) n_items, string_agg(id, ',' order by id) ids
  from (select distinct doc_id, cast(item_id as varchar) id from hits) group by doc_id)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit,
  cast(coalesce(n_items, 0) as bigint) n_items, sha256(coalesce(ids, '')) items_sha256,
  coalesce(n_hit, 0) > 0 contaminated
from docs left join covered using (doc_id) left join named using (doc_id)
"""

NEAR = f"""
with recursive docs as (
  select doc_id, {_PLAIN.format(text=_LOWERED.format(text="text"))} w from documents),
shingles as (
  select distinct doc_id, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') g
  from (select doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) i from docs where len(w) > 0)),
sizes as (select doc_id, count(*) n from shingles group by doc_id),
shared as (
  select a.doc_id u, b.doc_id v, count(*) s
  from shingles a join shingles b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
links as (
  select u, v from shared join sizes a on a.doc_id = u join sizes b on b.doc_id = v
  where 100 * s >= 80 * (a.n + b.n - s)),
reach as (select doc_id node, doc_id root from docs union select links.v, root from reach join links on u = node)
select doc_id, cast(coalesce(n, 0) as bigint) n_shingles, min(root) component_id, min(root) = doc_id kept
from docs join reach on node = doc_id left join sizes using (doc_id) group by doc_id, n
"""

SUBSTRINGS = f"""
with docs as (select doc_id, {_PLAIN.format(text="text")} w from documents),
windows as (
  select doc_id, i, array_to_string(w[i:i + 19], ' ') g
  from (select doc_id, w, unnest(range(1, len(w) - 18)) i from docs where len(w) >= 20)),
repeats as (
  select doc_id, i from (select doc_id, i, row_number() over (partition by g order by doc_id, i) nth from windows)
  where nth > 1),
covered as (select distinct doc_id, unnest(range(i, i + 20)) p from repeats),
placed as (select doc_id, unnest(w) word, unnest(range(1, len(w) + 1)) p from docs),
kept as (
  select doc_id, string_agg(word, ' ' order by p) t, count(*) n
  from placed anti join covered using (doc_id, p) group by doc_id)
select doc_id, cast(len(w) as bigint) n_words, cast(len(w) - coalesce(n, 0) as bigint) n_removed,
  sha256(coalesce(t, '')) kept_sha256
from docs left join kept using (doc_id)
"""

ROTATE = r"""
with turns as (
  select conv_id, turn, coalesce(role, 'unknown') speaker, replace(coalesce(text, ''), '<|', '< |') content,
    row_number() over () line
  from conversations),
people as (select distinct conv_id, speaker participant from turns where speaker <> 'system'),
seen as (
  select t.conv_id, participant, turn, speaker, content, line,
    case when speaker = 'system' then 'system' when speaker = participant then 'assistant' else 'user' end chat_role
  from turns t join people p on t.conv_id is not distinct from p.conv_id),
headed as (
  select *, '<|im_start|>' || chat_role || case when chat_role = 'user'
    then ' name=' || translate(replace(speaker, '<|', '< |'), chr(10) || chr(13), '  ') else '' end || chr(10) head
  from seen),
placed as (
  select *, row_number() over w - 1 as position,
    cast(sum(length(head) + length(content) + 11) over (w rows unbounded preceding) as bigint) as done
  from headed
  window w as (partition by conv_id, participant order by turn nulls first, speaker, content, line))
select conv_id, participant, position, turn, speaker, chat_role, head || content || '<|im_end|>' || chr(10) piece,
  done - length(head) - length(content) - 11 as start, done as "end", chat_role = 'assistant' as loss,
  case when chat_role = 'assistant' then done - length(content) - 11 end as loss_start,
  case when chat_role = 'assistant' then done - 1 end as loss_end
from placed
"""

MIXTURE = f"""
with sized as (
  select doc_id, source, cast(len({_PLAIN.format(text="text")}) as bigint) size,
    md5(cast(doc_id as varchar)) shuffled
  from documents),
sources as (
  select source, sum(size)::bigint source_size, row_number() over (order by source nulls last) - 1 nth
  from sized group by source),
weighed as (select *, nth % 3 + 1 weight, 3 * source_size cap from sources),
steps as (
  select *, sum(source_size) over () - coalesce(sum(cap) over filling, 0) words_left,
    sum(weight) over () - coalesce(sum(weight) over filling, 0) weight_left,
    row_number() over (order by cap / weight, nth) step
  from weighed
  window filling as (order by cap / weight, nth rows between unbounded preceding and 1 preceding)),
shares as (
  select words_left::double / weight_left::double share, step, cap >= words_left::double / weight_left::double * weight stops
  from steps),
aims as (
  select source, source_size, nth, case when cap < share * weight then cap::double else share * weight end target
  from weighed, (select share from shares where stops order by step limit 1)),
placed as (
  select *, sum(size) over (partition by source order by shuffled nulls first, doc_id nulls first, size
    rows unbounded preceding) - size here
  from sized),
due as (
  select doc_id, size, source_size, target, nth, epoch, here here_of,
    least(size, round(target)::bigint - epoch * source_size - here) words,
    case when target > 0 then (epoch * source_size + here)::double / target end share
  from placed join aims using (source), range(3) e(epoch)
  union all
  select doc_id, size, source_size, target, nth, epoch, here here_of,
    least(size, round(target)::bigint - epoch * source_size - here) words,
    case when target > 0 then (epoch * source_size + here)::double / target end share
  from placed join aims on placed.source is null and aims.source is null, range(3) e(epoch)),
knots as (
  select *, case when share <= done then 0e0 else 5e-1 end knot, case when share <= done then share else share - done end rest,
    case when share <= done then early else 1e0 end rate
  from (select *, case nth % 3 when 0 then 0.625e0 when 1 then 5e-1 else 0.375e0 end done,
    case nth % 3 when 0 then 1.5e0 when 1 then 1e0 else 5e-1 end early,
    case nth % 3 when 0 then -2e0 when 1 then 0e0 else 2e0 end twice from due)),
timed as (
  select *, case when share > 1 then 1e0 else
    knot + case when rest > 0 then 2 * rest / (rate + sqrt(greatest(rate * rate + twice * rest, 0e0))) else 0e0 end end t
  from knots)
select doc_id, size, source_size, target, coalesce(sum(words) filter (words > 0), 0)::bigint taken,
  count(*) filter (words > 0)::integer passes, min(t) filter (words > 0) as position
from timed group by doc_id, size, source_size, target, here_of
"""

# the unsigned CRC-32 of an ASCII string
_CRC = (
    "xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({text}, ''), "
    "lambda ch: ascii(ch)::bigint)), lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), "
    "lambda reg, bit: xor(reg >> 1, 3988292384 * (reg & 1)))))"
)

TRIE = f"""
with said as (
  select conv_id, turn, coalesce(role, '') r, coalesce(text, '') x from conversations where conv_id is not null),
turns as (
  select conv_id, r, x, row_number() over (
    partition by conv_id order by turn nulls first, left(r, 32), left(x, 32), md5(r) || md5(x)) p
  from said),
counted as (select conv_id, count(*) n from turns group by conv_id),
convs as (
  select conv_id c, conv_id - conv_id % 5 b, {_CRC.format(text="conv_id::varchar")} % 9 h from counted),
rebuilt as (
  select c, p d, r, x from convs join turns on conv_id = b and p <= h
  union all
  select c, least(h, coalesce(n, 0)) + p - h, r, x
  from convs join turns on turns.conv_id = c and p > h left join counted on counted.conv_id = b),
whole as (
  select c, coalesce(list({{'r': r, 'x': x}} order by d) filter (d is not null), []) s
  from convs left join rebuilt using (c) group by c),
prefixes as (
  select c, d, len(s) = d ends, case when d > 0 then strlen(s[d].x) else 0 end bytes,
    md5(to_json(s[1:d])::varchar) k, case when d > 0 then md5(to_json(s[1:d - 1])::varchar) end up
  from (select c, s, unnest(range(len(s) + 1)) d from whole)),
nodes as (
  select k, any_value(up) up, any_value(d) d, min(c) conv_id, count(*) n_convs, any_value(bytes) bytes,
    sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (ends), '')) ends_sha256
  from prefixes group by k),
children as (select up k, count(*) n_children from nodes group by up),
below as (
  select p.k, count(*) filter (n_children is null) n_leaves, sum((n_convs - 1) * n.bytes) saved
  from nodes n join prefixes p on p.c = n.conv_id and p.d <= n.d left join children on children.k = n.k group by p.k)
select n.conv_id, n.d as depth, u.conv_id parent_conv_id, n.n_convs, coalesce(n_children, 0)::bigint n_children,
  n_leaves, saved::bigint saved_tokens, n.ends_sha256
from nodes n join below using (k) left join children using (k) left join nodes u on u.k = n.up
"""

VARIANTS = r"""
with table_of as (
  select list(list_reduce(list_prepend(i, range(8)), lambda reg, bit: xor(reg >> 1, 3988292384 * (reg & 1))) order by i) t
  from range(256) r(i)),
runs as (
  select doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) run
  from documents),
counted as (select doc_id, run, count(*) n from runs group by doc_id, run),
marked as (
  select run, n, xor(4294967295, list_reduce(
    list_prepend(4294967295::bigint, flatten(list_transform(
      string_split(coalesce(doc_id::varchar, '') || ':' || run, ''),
      lambda ch: case when ord(ch) < 128 then [ord(ch)::bigint] else [195, 128 + (ord(ch) & 63)] end))),
    lambda crc, byte: xor(t[(xor(crc, byte) & 255) + 1], crc >> 8))) h
  from counted, table_of),
cut as (
  select case when h % 97 = 0 then left(run, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2)
    else run end word, n
  from marked),
words as (
  select word, sum(n)::bigint n from cut where length(word) >= 5 group by word having sum(n) >= 3),
holes as (
  select word, n, i, left(word, i - 1) || substr(word, i + 1) rest
  from (select word, n, unnest(range(1, length(word) + 1)) i from words)),
pairs as (
  select a.word, b.word other, b.n other_n from holes a join holes b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union
  select a.word, b.word, b.n from holes a join words b on a.rest = b.word
  union
  select b.word, a.word, a.n from holes a join words b on a.rest = b.word),
best as (
  select word, count(*) n_near, first(other order by other_n desc, other) other, max(other_n) other_n
  from pairs group by word),
forms as (
  select word, n, coalesce(n_near, 0) n_near, case when other_n >= 2 * n then other end form,
    case when other_n >= 2 * n then other_n end form_n
  from words left join best using (word)),
roots as (
  with recursive up as (
    select word as start, word, form from forms
    union all
    select up.start, forms.word, forms.form from up join forms on forms.word = up.form)
  select start word, word root from up where form is null)
select word, form, root, n, n_near, form_n from forms join roots using (word)
"""

SQL = {
    "op1_substring_dedup": SUBSTRINGS,
    "op2_decontaminate": DECONTAMINATE,
    "op6_near_duplicates": NEAR,
    "op8_rotate": ROTATE,
    "op11_prefix_trie": TRIE,
    "op12_mixture": MIXTURE,
    "op13_variants": VARIANTS,
}
