"""Bound queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.llm import (decontaminate, importance, jaccard_join, licenses, mix_sources, near_vectors, quality, quotations, runs, secret_scan,
                         token_counts, token_output, toxicity)
from tessera.llm.common import table

BYTE_VOCABULARY, WORD_VOCABULARY = "byte_bpe_50k.json", "word_bpe_49k.json"
TOKEN_LIMIT = 2048


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_near_vectors(spark, d):
    return near_vectors.near_vectors(table(spark, d, "embeddings"))


def op2_license_scan(spark, d):
    return licenses.license_scan(table(spark, d, "documents"))


def op3_quotation_links(spark, d):
    return quotations.reply_order(table(spark, d, "conversations"))


def op4_token_counts(spark, d):
    return token_counts.token_counts(table(spark, d, "documents"), tokenizer_path(WORD_VOCABULARY), TOKEN_LIMIT)


def op5_quality(spark, d):
    return quality.quality(table(spark, d, "documents"), table(spark, d, "labels"))


def op6_decontaminate(spark, d):
    return decontaminate.contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op7_mix_sources(spark, d):
    return mix_sources.mix_report(table(spark, d, "documents"))


def op8_jaccard_join(spark, d):
    return jaccard_join.jaccard_components(table(spark, d, "documents"))


def op9_toxicity(spark, d):
    return toxicity.toxicity(table(spark, d, "documents"), table(spark, d, "labels"))


def op10_token_output(spark, d):
    return token_output.token_output(table(spark, d, "documents").select("doc_id", "text"), tokenizer_path(BYTE_VOCABULARY))


def op11_periodic_runs(spark, d):
    return runs.periodic_runs(table(spark, d, "documents"))


def op12_importance(spark, d):
    return importance.importance(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op13_secret_scan(spark, d):
    return secret_scan.secrets(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (op1_near_vectors, op2_license_scan, op3_quotation_links, op4_token_counts, op5_quality, op6_decontaminate,
                                   op7_mix_sources, op8_jaccard_join, op9_toxicity, op10_token_output, op11_periodic_runs, op12_importance,
                                   op13_secret_scan)}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_PHRASES = {"apache": ["apache", "license"], "cc-by": ["cc", "by"], "gpl": ["gnu", "general", "public", "license"], "mit": ["mit", "license"]}
_WORD = r"[^ ]+ "
_NOTICES = {
    "apache-header": rf" you may not use this ({_WORD}){{1,2}}except in compliance with the license (you may obtain a copy of the license at ({_WORD}){{0,8}})?unless required by applicable law or agreed to in writing ",
    "apache-notice": " licensed under the apache license ",
    "bsd-conditions": " redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met ",
    "cc-by-notice": rf" licensed under (a )?(the )?(creative commons )?(attribution )?cc by ({_WORD}){{0,2}}4 0 ",
    "gpl-free-software": " free software you can redistribute it and or modify it under the terms of the gnu (lesser )?(affero )?general public license as published by the free software foundation ",
    "gpl-notice": " licensed under the gnu general public license ",
    "isc-text": " permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies ",
    "mit-notice": " released under the mit license ",
    "mit-text": rf" permission is hereby granted free of charge to any person obtaining a copy of this ({_WORD}){{1,2}}and associated documentation files (the software )?to deal in the software without restriction ",
}


def _license_sql() -> str:
    def starts(ws):
        return "list_filter(range(len(w)), lambda i: " + " and ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(ws)) + ")"

    base = ", ".join(f"case when len({starts(ws)}) > 0 then '{name}' end" for name, ws in _PHRASES.items())
    full = ", ".join(f"case when regexp_matches(s, '{pattern}') then '{name}' end" for name, pattern in _NOTICES.items())
    places = "flatten([" + ", ".join(starts(ws) for ws in _PHRASES.values()) + "])"
    return f"""
with words as (select doc_id, {_WORDS} as w from documents),
t as (select doc_id, w, ' ' || array_to_string(w, ' ') || ' ' as s from words),
f as (select doc_id, w, {places} as p, list_sort(list_filter([{base}], lambda x: x is not null)) as b, list_filter([{full}], lambda x: x is not null) as n from t)
select doc_id, len(w)::bigint as n_words, len(p)::bigint as n_base, list_min(p)::bigint as first_word, list_max(p)::bigint as last_word,
       coalesce(array_to_string(b, ','), '') as base_labels, coalesce(array_to_string(list_sort(list_distinct(list_concat(b, n))), ','), '') as labels,
       case when len(n) > 0 then 1.0::double when len(b) > 0 then 0.5::double else 0.0::double end as score
from f"""


_DECONTAMINATION_SQL = rf"""
with d as (select row_number() over () as k, doc_id, {_WORDS} as w from documents),
b as (select item_id::varchar as item, w, least(10, len(w)) as n from (select item_id, {_WORDS} as w from benchmark) where len(w) > 0),
windows as (select distinct item, n, array_to_string(w[i : i + n - 1], ' ') as g from b, unnest(range(1, len(w) - n + 2)) as r(i)),
grams as (select k, i, s.n, array_to_string(w[i : i + s.n - 1], ' ') as g from d, (select distinct n from windows) as s, unnest(range(1, len(w) - s.n + 2)) as r(i)),
hits as (select k, i, g.n, item from grams g join windows v on g.n = v.n and g.g = v.g),
places as (select distinct k, i + j as place from (select distinct k, i, n from hits), unnest(range(0, n)) as r(j)),
n_hit as (select k, count(*) as n from places group by k),
items as (select k, count(*) as n, string_agg(item, ',' order by item) as s from (select distinct k, item from hits where item is not null) group by k)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit.n, 0)::bigint as n_hit, coalesce(items.n, 0)::bigint as n_items, sha256(coalesce(items.s, '')) as items_sha256,
       coalesce(n_hit.n, 0) > 0 as contaminated
from d left join n_hit using (k) left join items using (k)"""

#: sizes, hash order and targets of the mix; used by the pipeline's SQL too
MIX_SQL = r"""
sized as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
                 ('0x' || substr(md5(coalesce(doc_id::varchar, 'text:' || text, 'null')), 1, 15))::bigint as h from {docs}),
sources as (select source, sum(size)::bigint as source_size, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight from sized group by source),
capped as (  -- were all sources of a smaller cap by weight full, this much would be left for so much weight
  select a.source, a.source_size, a.weight,
         (select sum(b.source_size) from sources b) - coalesce((select sum(3 * b.source_size) from sources b where b.source_size * a.weight < a.source_size * b.weight), 0) as rest,
         (select sum(b.weight) from sources b where b.source_size * a.weight >= a.source_size * b.weight) as open
  from sources a),
waterline as (select rest::bigint as rest, open::bigint as open from capped where 3 * source_size * open >= rest * weight order by source_size / weight limit 1),
targets as (select source, source_size, case when w.rest * weight <= 3 * source_size * w.open then w.rest::double * weight / w.open else (3 * source_size)::double end as target
            from sources, waterline w),
plan as (select source, source_size, target, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as whole from targets),
running as (select source, h, sum(size) as n, sum(sum(size)) over (partition by source order by h) as upto from sized group by source, h),
ends as (select r.source, arg_min(case when 2 * (p.target - p.whole * p.source_size - (r.upto - r.n)) >= r.n then r.h else r.h - 1 end, r.h) as threshold
         from running r join plan p on r.source is not distinct from p.source
         where r.upto >= p.target - p.whole * p.source_size group by r.source),
mixed as (select s.*, p.source_size, p.target, p.whole + case when s.h <= coalesce(e.threshold, 9223372036854775807) then 1 else 0 end as copies
          from sized s join plan p on s.source is not distinct from p.source left join ends e on s.source is not distinct from e.source)"""

_QUOTATION_SQL = r"""
with lines as (
  select conv_id, turn, i, length(regexp_replace(regexp_extract(x, '^([ \t]*>)+'), '[^>]', '', 'g')) as level,
         trim(regexp_replace(translate(regexp_replace(x, '^([ \t]*>)+', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+', ' ', 'g'), ' ') as line
  from (select conv_id, turn, l[i] as x, i from (select conv_id, turn, regexp_split_to_array(coalesce(text, ''), '\r?\n') as l from conversations), unnest(range(1, len(l) + 1)) as r(i))),
filled as (select *, row_number() over (partition by conv_id, turn order by i) - row_number() over (partition by conv_id, turn, level order by i) as run from lines where line <> ''),
groups as (select conv_id, turn, level, run, string_agg(line, chr(10) order by i) as passage from filled group by all),
parts as (select conv_id, turn, level, passage as part from groups union select conv_id, turn, level, line from filled),
links as (select q.conv_id, q.turn, q.level, max(o.turn) as original from parts q join parts o on q.conv_id is not distinct from o.conv_id and q.part = o.part and o.turn < q.turn
          where q.level > 0 and o.level = 0 group by q.conv_id, q.turn, q.level, q.part),
summary as (select conv_id, turn, count(distinct original) as n, max(case when level = 1 then original end) as quoted from links group by conv_id, turn),
own as (select conv_id, turn, role, regexp_replace(array_to_string(list_filter(regexp_split_to_array(coalesce(text, ''), '\r?\n'), lambda x: not regexp_matches(x, '^([ \t]*>)+')), chr(10)),
               '^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$', '', 'g') as body from conversations),
replies as (select o.conv_id, o.turn, o.role, coalesce(s.n, 0) as n_quoted, coalesce(s.quoted, (select max(p.turn) from conversations p where p.conv_id is not distinct from o.conv_id and p.turn < o.turn)) as reply_to, o.body
            from own o left join summary s on o.conv_id is not distinct from s.conv_id and o.turn = s.turn)
select conv_id, turn, role, n_quoted::bigint as n_quoted, reply_to,
       (row_number() over (partition by conv_id order by reply_to nulls first, turn nulls first, role nulls first, body) - 1)::bigint as place, body
from replies"""



def _secret_sql() -> str:
    either = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    assign = rf"""(?:{either})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    patterns = (assign, "AKIA[A-Z0-9]+", "[0-9a-f]+", "[A-Za-z0-9+/_-]{16,}={0,2}")
    least = (f"length(regexp_extract(s.v, '{assign}', 1)) >= 8", "length(s.v) >= 16", "length(s.v) >= 32", "true")

    def places(kind, pattern, keep):
        return f"""select k, {kind} as kind, s.start as start, s.start + length(s.v) as stop, s.v as v from
          (select k, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'v': m[i], 'start': coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0)
             + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)}})) as s
           from (select k, regexp_extract_all(text, '{pattern}') as m, regexp_split_to_array(text, '{pattern}') as g from d)) where {keep}"""

    spans = " union all ".join(places(kind, p, w) for kind, (p, w) in enumerate(zip(patterns, least)))
    base16_64 = "[0-9a-f]{32,}|AKIA[A-Z0-9]{12,}"
    return rf"""
with d as (select row_number() over () as k, doc_id, coalesce(text, '') as text from documents),
tokens as (select distinct unnest(regexp_extract_all(regexp_replace(text, '{assign}', ' ', 'g'), '[A-Za-z0-9+/_=-]{{8,}}')) as t from d),
digests as (select sha256(coalesce(doc_id::varchar, '')) as h from d),
samples as (select case when regexp_matches(t, '{base16_64}') then regexp_extract(t, '{base16_64}') else t end as t, regexp_matches(t, '{base16_64}')::int as label from tokens
  union select case when h < '3' then h when h < '6' then upper(h) else to_base64(unhex(h)) end, 1 from digests
  union select v, 1 from (select unnest(regexp_extract_all(text, '{assign}', 1)) as v from d) where length(v) >= 8),
pairs as (select label, substr(t, i, 1) as a, substr(t, i, 2) as ab, count(*) as n
  from (select t, label, unnest(range(1, length(t))) as i from samples) where regexp_full_match(substr(t, i, 2), '[A-Za-z0-9+/_=-]{{2}}') group by all),
share as (select label, a, ab, n, sum(n) over (partition by label, a) as after from pairs),
symbols as (select unnest(string_split('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=', '')) as c),
sums as (select label, a, max(after) as after from share group by label, a),
scores as (select x.c || y.c as ab, floor(1000 * (ln((coalesce(r.n, 0) + 1) / (coalesce(rs.after, 0) + 67)) - ln((coalesce(o.n, 0) + 1) / (coalesce(os.after, 0) + 67))) + 0.5) as s
  from symbols x, symbols y left join share r on r.label = 1 and r.ab = x.c || y.c left join share o on o.label = 0 and o.ab = x.c || y.c
  left join sums rs on rs.label = 1 and rs.a = x.c left join sums os on os.label = 0 and os.a = x.c),
found as ({spans}),
judged as (select v from (select v, unnest(range(1, length(v))) as i from (select distinct v from found where kind = 3 and regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Za-z]')))
  join scores on ab = substr(v, i, 2) group by v having sum(s) >= 10000),
kept as (select k, kind, start, ['assign', 'access', 'hex', 'random'][kind + 1] || ':' || start::bigint || ':' || stop::bigint as span from found where kind < 3 or v in (select v from judged))
select any_value(doc_id) as doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
       sha256(coalesce(string_agg(span, ',' order by start, kind) filter (kind < 3), '')) as base_sha256, coalesce(string_agg(span, ',' order by start, kind), '') as spans
from d left join kept using (k) group by k"""


ORACLES = {
    "op2_license_scan": _license_sql(),
    "op3_quotation_links": _QUOTATION_SQL,
    "op6_decontaminate": _DECONTAMINATION_SQL,
    "op13_secret_scan": _secret_sql(),
    "op7_mix_sources": "with " + MIX_SQL.format(docs="documents") + " select doc_id, size, source_size, target, (size * copies)::bigint as taken from mixed",
}
