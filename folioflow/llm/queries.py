"""Registered queries of the operators and their SQL twins."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioflow.llm import (
    collocations, decontaminate, licenses, mixing, near_dedup, packing, pii, prefix_trie, quality_model, quality_rules, secrets, sharding,
    token_files,
)
from folioflow.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_sharding(spark, sf):
    placed = sharding.assign(table(spark, sf, "documents").select("doc_id", "text"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )


@query
def op2_decontamination(spark, sf):
    found = decontaminate.find_contamination(
        table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark")
    )
    return decontaminate.digest(found)


ORACLES["op2_decontamination"] = r"""
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
i as (
  select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
iw as (
  select distinct item, least(len(w), 10) as n, array_to_string(w[s:s + 9], ' ') as t
  from i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as u(s) where len(w) > 0),
dw as (
  select doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') as t
  from w, (select distinct n from iw) sizes, unnest(range(1, len(w) - n + 2)) as u(s) where len(w) >= n),
h as (select doc_id, s, n, item from dw join iw using (n, t)),
hit as (select doc_id, count(distinct p) as n_hit from h, unnest(range(s, s + n)) as u(p) group by doc_id),
named as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, item from h) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join hit using (doc_id) left join named using (doc_id)
""".replace("\\", "\\")


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file; ``TOKENIZER_DIR`` overrides where they lie."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op3_best_fit_packing(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"))


@query
def op4_token_files(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return token_files.encode_and_read(docs, tokenizer_file("word_bpe_49k.json"))


@query
def op5_license_scan(spark, sf):
    """Files are the documents, in directories by source, ten thousands, thousands and hundreds of ids. A document
    that states a licence stands for a LICENSE file, from which the others inherit: of ids ending in 0 for its ten
    thousand, in 1 to 3 for its thousand, else for its hundred."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    docs = docs.withColumn("states", F.size(licenses.statements(F.coalesce("text", F.lit("")))) > 0)
    step = lambda size: F.floor(F.col("doc_id") / size).cast("string")
    states, last = F.col("states"), F.col("doc_id") % 10
    folder = F.concat_ws(
        "/", "source", step(10_000),
        F.when(~states | (last > 0), step(1_000)),
        F.when(~states | (last > 3), step(100)),
    )
    name = F.when(states, F.lit("LICENSE")).otherwise(F.lit("file"))
    files = docs.withColumn("path", F.concat_ws("/", folder, F.concat_ws("-", name, F.col("doc_id").cast("string"))))
    return licenses.scan_licenses(files)


@query
def op6_quality_model(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return quality_model.score_documents(docs, table(spark, sf, "labels"))


@query
def op7_pii_scan(spark, sf):
    return pii.digest(pii.scan_pii(table(spark, sf, "documents").select("doc_id", "text")))


@query
def op8_secret_scan(spark, sf):
    return secrets.digest(secrets.scan_secrets(table(spark, sf, "documents").select("doc_id", "text")))


@query
def op9_near_dedup(spark, sf):
    return near_dedup.near_duplicates(table(spark, sf, "documents").select("doc_id", "text"))


ORACLES["op9_near_dedup"] = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select distinct doc_id, array_to_string(w[i:i + 2], ' ') as t
  from w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as u(i) where len(w) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
common as (
  select a.doc_id as a, b.doc_id as b, count(*) as i
  from s a join s b on a.t = b.t and a.doc_id < b.doc_id group by 1, 2),
link as (
  select a, b from common join n na on na.doc_id = a join n nb on nb.doc_id = b
  where 100 * i >= 85 * (na.n + nb.n - i)),
both_ways as (select a, b from link union select b, a from link),
reach(a, b) as (
  select doc_id, doc_id from documents
  union select reach.a, both_ways.b from reach join both_ways on reach.b = both_ways.a)
select w.doc_id, coalesce(n.n, 0) as n_shingles, c.c as component_id, w.doc_id = c.c as kept
from w left join n using (doc_id) join (select a, min(b) as c from reach group by a) c on c.a = w.doc_id
"""


@query
def op10_quality_rules(spark, sf):
    judged = quality_rules.apply_rules(table(spark, sf, "documents").select("doc_id", "text"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *[f"quality.{c}" for c in counts], "base_failed", "kept")


_STOP_LIST = ", ".join(f"'{w}', '{w.capitalize()}'" for w in dict.fromkeys(quality_rules.STOP_WORDS))
ORACLES["op10_quality_rules"] = rf"""
with w as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
    row_number() over () as r
  from documents),
windows as (select r, i, array_to_string(w[i:i + 2], ' ') as t from w, unnest(range(1, len(w) - 1)) as u(i)),
twice as (select r, t from windows group by r, t having count(*) > 1),
repeated as (
  select r, count(distinct p) as n from windows join twice using (r, t), unnest([i, i + 1, i + 2]) as u(p) group by r),
m as (
  select doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines,
    coalesce(n, 0) as n_repeat_words, len(lines) as n_lines, length(t) - length(replace(t, '!', '')) as n_exclaims,
    len(list_filter(w, lambda x: x in ({_STOP_LIST}))) as n_stops,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*\x{{2022}}]'))) as n_bullets,
    len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|\x{{2026}})[\x20\x09-\x0D]*$'))) as n_ellipses
  from w left join repeated using (r)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars,
  cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines, n_repeat_words, base_failed,
  not base_failed and word_chars / n_words between 2.5 and 12 and n_symbols / n_words <= 0.2
    and n_exclaims / n_words <= 0.5 and n_stops / n_words >= 0.02 and n_dup_lines / n_lines <= 0.5
    and n_bullets / n_lines <= 0.9 and n_ellipses / n_lines <= 0.5 as kept
from b
"""


@query
def op11_prefix_trie(spark, sf):
    return prefix_trie.rebuilt_trie(table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"))


ORACLES["op11_prefix_trie"] = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null),
own as (
  select conv_id, list({'role': role, 'text': text}
    order by turn nulls first, md5(concat(length(role), ':', role, text))) as turns
  from t group by conv_id),
-- crc32 of the decimal id, byte by byte and bit by bit
crc as (
  select conv_id, turns, xor(list_reduce(
    list_prepend(4294967295::bigint, list_transform(range(1, length(cast(conv_id as varchar)) + 1),
      lambda i: ascii(substr(cast(conv_id as varchar), i, 1))::bigint)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
      lambda x, i: xor(x >> 1, 3988292384::bigint * (x & 1)))), 4294967295::bigint) % 6 as h
  from own),
r as (
  select c.conv_id, list_concat(coalesce(f.turns, [])[1:c.h], c.turns[c.h + 1:]) as turns
  from crc c left join own f on f.conv_id = c.conv_id - c.conv_id % 100),
p as (select conv_id, d, turns[1:d] as k, len(turns) = d as ends from r, unnest(range(0, len(turns) + 1)) as u(d)),
n as (
  select k, d, min(conv_id) as conv_id, count(*) as n_convs,
    coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (ends), '') as ends
  from p group by k, d),
c as (select k[1:d - 1] as k, d - 1 as d, count(*) as n_children from n where d > 0 group by all),
v as (
  select n.*, coalesce(n_children, 0) as n_children,
    case when d > 0 then (n_convs - 1) * length(k[d].text) else 0 end as own
  from n left join c using (k, d)),
s as (
  select p.k, p.d, count(*) filter (v.n_children = 0) as n_leaves, sum(v.own) as saved
  from v join p on p.conv_id = v.conv_id and p.d <= v.d group by p.k, p.d)
select v.conv_id, v.d as depth, up.conv_id as parent_conv_id, v.n_convs, v.n_children, s.n_leaves,
  cast(s.saved as bigint) as saved_tokens, sha256(v.ends) as ends_sha256
from v join s using (k, d) left join n up on up.d = v.d - 1 and up.k = v.k[1:v.d - 1]
"""


@query
def op12_collocations(spark, sf):
    return collocations.mine_phrases(table(spark, sf, "documents").select("text", "lang"))


ORACLES["op12_collocations"] = r"""
with pieces as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from (
    select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents)),
total as (select lang, cast(sum(len(w)) as bigint) as n from pieces group by lang),
g as (
  select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase, count(*) as f
  from pieces, unnest(range(1, 6)) as u(k), unnest(range(1, len(w) - k + 2)) as v(i)
  group by all having count(*) >= 100),
c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from g where k > 1),
cuts as (
  select c.lang, c.phrase, c.a, j, l.f as l, r.f as r, n, (1000::hugeint * a * n) // (l.f::hugeint * r.f) as score
  from c join total using (lang), unnest(range(1, c.k)) as u(j)
    join g l on l.lang = c.lang and l.phrase = array_to_string(c.w[1:j], ' ')
    join g r on r.lang = c.lang and r.phrase = array_to_string(c.w[j + 1:], ' ')),
lowest as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, j) = 1),
within as (
  select distinct c.lang, c.phrase from c join c longer
    on longer.lang = c.lang and longer.a = c.a and longer.k > c.k
      and contains(' ' || longer.phrase || ' ', ' ' || c.phrase || ' '))
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n,
  cast(score as bigint) as score
from lowest anti join within using (lang, phrase)
qualify rank <= 2000
"""


@query
def op13_source_mix(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    return mixing.mix_documents(docs).drop("copies")


ORACLES["op13_source_mix"] = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    substr(md5(concat_ws(':', cast(doc_id as varchar), coalesce(text, ''))), 1, 16) as place
  from documents),
s as (
  select source, sum(size) as whole, (row_number() over (order by source nulls last) - 1) % 3 + 1 as w
  from d group by source),
-- the sources in the order in which they stop at three times their size
o as (select *, row_number() over (order by 3 * whole / w, source) as k from s),
rates as (
  select k, (select sum(whole) from s) - coalesce(sum(3 * whole) over (order by k rows between unbounded preceding and 1 preceding), 0) as words,
    sum(w) over (order by k rows between current row and unbounded following) as weight
  from o),
rate as (
  select min(k) as k, arg_min(cast(words as double) / cast(weight as double), k) as r
  from rates where not exists (
    select 1 from o where o.k >= rates.k and 3 * whole < cast(words as double) / cast(weight as double) * w)),
t as (
  select source, whole, case when rate.k is null or o.k < rate.k then cast(3 * whole as double) else rate.r * w end as target
  from o, rate),
q as (
  select doc_id, size, source,
    coalesce(sum(size) over (
      partition by source order by place, doc_id, size rows between unbounded preceding and 1 preceding), 0) as ahead
  from d)
select doc_id, size, cast(whole as bigint) as source_size, target,
  cast(greatest(0, least(size, floor(target) - ahead)) + greatest(0, least(size, floor(target) - whole - ahead))
    + greatest(0, least(size, floor(target) - 2 * whole - ahead)) as bigint) as taken
from q join t on q.source is not distinct from t.source
"""
