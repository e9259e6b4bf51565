"""The results of operators that DuckDB can state, as plain brute force over the same tables."""

from __future__ import annotations

#: Words, as in the contracts of op6 and op10.
_WORD = r"[^\x20\x09-\x0D]+"

#: Expects ``hit`` (doc_id, i): starts, from 0, of windows of ``{width}`` units to remove.
_RUNS = """
marked as (
    select doc_id, i, coalesce(i - lag(i) over (partition by doc_id order by i) > {width}, true) as opens from hit),
numbered as (
    select doc_id, i, sum(opens::int) over (partition by doc_id order by i) as run from marked),
runs as (
    select doc_id, run, min(i) as lo, max(i) + {width} as hi from numbered group by doc_id, run),
gaps as (
    select doc_id, lo, hi, coalesce(lag(hi) over (partition by doc_id order by lo), 0) as since from runs)
"""

OP5 = f"""
with docs as (
    select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
blocks as (
    select doc_id, 1000 * b as base, substr(h, 2000 * b + 1, 2098) as part
    from (select doc_id, h, unnest(range(0, len(h) // 2000 + 1)) as b from docs)),
places as (
    select doc_id, base + j as i, substr(part, 2 * j + 1, 100) as piece
    from (select doc_id, base, part, unnest(range(0, least(1000, len(part) // 2 - 49))) as j from blocks)),
low as (
    select piece, min(doc_id) as first, max(doc_id) as last from places group by piece having min(doc_id) < max(doc_id)),
hit as (
    select distinct doc_id, i from places join low using (piece) where doc_id > first),
{_RUNS.format(width=50)},
cut as (
    select doc_id, sum(hi - lo) as n_removed, count(*) as n_spans, max(hi) as last,
           string_agg(substr(h, 2 * since + 1, 2 * (lo - since)), '' order by lo) as kept
    from gaps join docs using (doc_id) group by doc_id)
select doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed,
       coalesce(n_spans, 0)::bigint as n_spans,
       sha256(unhex(case when last is null then h else kept || substr(h, 2 * last + 1) end)) as kept_sha256
from docs left join cut using (doc_id)
"""

OP6 = f"""
with recursive docs as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') as words from documents),
shingles as (
    select distinct doc_id, array_to_string(words[i:i + 4], ' ') as shingle
    from (select doc_id, words, unnest(range(1, greatest(len(words) - 3, least(len(words), 1) + 1))) as i from docs)),
sizes as (
    select doc_id, count(*) as n from shingles group by doc_id),
shared as (
    select a.doc_id as a, b.doc_id as b, count(*) as n_both
    from shingles a join shingles b on a.shingle = b.shingle and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
linked as (
    select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b
    where 100 * n_both >= 75 * (x.n + y.n - n_both)),
links as (
    select a, b from linked union all select b, a from linked),
reach as (
    select a, b from links union select r.a, l.b from reach r join links l on l.a = r.b),
low as (
    select a, min(b) as low from reach group by a)
select doc_id, coalesce(n, 0)::bigint as n_shingles, least(coalesce(low, doc_id), doc_id) as component_id
from docs left join sizes using (doc_id) left join low on a = doc_id
"""

OP9 = """
with recursive vectors as (
    select vec_id, label, embedding::double[] as given from embeddings),
sound as (
    select vec_id, label, list_transform(given, lambda x: coalesce(x, 0)) as v from vectors
    where label is not null and given is not null and len(list_filter(given, lambda x: x is null or not isfinite(x))) = 0
      and len(list_filter(given, lambda x: x <> 0)) > 0),
linked as (
    select a.vec_id as a, b.vec_id as b from sound a join sound b on a.label = b.label and a.vec_id < b.vec_id and len(a.v) = len(b.v)
    where list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= 0.98),
links as (
    select a, b from linked union all select b, a from linked),
reach as (
    select a, b from links union select r.a, l.b from reach r join links l on l.a = r.b),
low as (
    select a, min(b) as low from reach group by a),
near as (
    select a, count(*) as n from links group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, least(coalesce(low, vec_id), vec_id) as component_id,
       coalesce(low, vec_id) >= vec_id as kept
from vectors left join low on low.a = vec_id left join near on near.a = vec_id
"""

OP10 = f"""
with docs as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') as words from documents),
places as (
    select doc_id, i, array_to_string(words[i + 1:i + 50], ' ') as piece
    from (select doc_id, words, unnest(range(0, len(words) - 49)) as i from docs)),
low as (
    select piece, min(doc_id) as first from places group by piece having min(doc_id) < max(doc_id)),
hit as (
    select distinct doc_id, i from places join low using (piece) where doc_id > first),
{_RUNS.format(width=50)},
cut as (
    select doc_id, sum(hi - lo) as n_removed, max(hi) as last,
           flatten(list(words[since + 1:lo] order by lo)) as kept
    from gaps join docs using (doc_id) group by doc_id)
select doc_id, len(words)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed,
       sha256(array_to_string(case when last is null then words else list_concat(kept, words[last + 1:]) end, ' ')) as kept_sha256
from docs left join cut using (doc_id)
"""


#: Shares of terms in whole numbers, of a count in a total over ``size`` terms.
_SHARE = "(1 + (1000000000::hugeint * ({0} + 5)) // ({1} + 5 * size))::bigint"

OP11 = f"""
with docs as (
    select row_number() over () as place, coalesce(lang, '') as lang, coalesce(source, '') as source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as terms from documents),
words as materialized (
    select place, lang, source, unnest(terms) as term from docs),
kept as materialized (
    select lang, term from words group by lang, term having count(distinct place) >= 30),
sizes as (
    select lang, count(*) as size from kept group by lang),
counted as materialized (
    select lang, source, term, count(*) as n from words semi join kept using (lang, term) group by lang, source, term),
groups as materialized (
    select distinct lang, source from docs),
every as materialized (
    select lang, source, term, coalesce(n, 0) as n, sum(coalesce(n, 0)) over (partition by lang, source) as total,
           sum(coalesce(n, 0)) over (partition by lang, term) as lang_n, sum(coalesce(n, 0)) over (partition by lang) as lang_total, size
    from groups join kept using (lang) join sizes using (lang) left join counted using (lang, source, term)),
shares as materialized (
    select lang, source, term, n, {_SHARE.format("n", "total")} as p, {_SHARE.format("lang_n", "lang_total")} as q from every),
pairs as (
    select a.lang, a.source, b.source as item, coalesce(value, 0)::bigint as value
    from groups a join groups b on a.lang = b.lang and a.source <> b.source
    left join (select x.lang, x.source, y.source as item, sum(abs(x.p - y.p)) as value
               from shares x join shares y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all) s
      on s.lang = a.lang and s.source = a.source and s.item = b.source),
found as (
    select lang, source, 'pair' as part, item, value from pairs
    union all
    select lang, source, 'term', term, p - q from shares where n > 0 and p > q)
select *, (row_number() over (partition by lang, source, part order by value desc, encode(item)))::int as rank
from found qualify part = 'pair' or rank <= 50
"""

#: One round of op13: all vectors against all centroids, then the means.
_ROUND = """
a{n} as materialized (
    select place, vec_id, v, cluster, far from (
        select place, vec_id, x.v, cluster, list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as far
        from kept x, c{n} c)
    qualify row_number() over (partition by place order by far, cluster) = 1)"""
_MEANS = """
m{n} as (
    select cluster, list((total - (total % n + n) % n) // n order by i)::bigint[] as v
    from (select cluster, i, sum(x) as total, count(*)::hugeint as n from (select cluster, unnest(v) as x, unnest(range(64)) as i from a{n}) group by cluster, i)
    group by cluster),
c{next} as materialized (
    select cluster, coalesce(m{n}.v, c{n}.v) as v from c{n} left join m{n} using (cluster))"""

OP13 = f"""
with kept as materialized (
    select row_number() over () as place, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
    where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as materialized (
    select (row_number() over (order by sha256('2:' || vec_id), v) - 1)::int as cluster, v from kept
    qualify row_number() over (order by sha256('2:' || vec_id), v) <= 40),
{",".join(_ROUND.format(n=n) + "," + _MEANS.format(n=n, next=n + 1) for n in range(5))},
{_ROUND.format(n=5)}
select vec_id, cluster, far as distance, (sum(far) over (partition by cluster))::bigint as cluster_inertia,
       (sum(far) over ())::bigint as inertia, sha256(array_to_string(c5.v, ',')) as centroid_sha256
from a5 join c5 using (cluster)
"""


#: Columns of op1, op7 and op8 that depend on no model and no order of taking, for tests.
BASE = {
    "op1_pii": r"""
with t as (
    select doc_id, coalesce(text, '') as text from documents),
found as (
    select doc_id, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') as emails,
           regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)') as ips,
           list_transform(regexp_extract_all(text, '[0-9](?:[\x20-]?[0-9])+'), lambda m: regexp_replace(m, '[^0-9]', '', 'g')) as cards,
           list_transform(regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]'), lambda m: regexp_replace(m, '[^0-9]', '', 'g')) as phones
    from t)
select doc_id, len(emails)::bigint as n_email,
       len(list_filter(ips, lambda m: len(list_filter(string_split(m, '.'), lambda p: coalesce(try_cast(p as hugeint), 256) > 255)) = 0))::bigint as n_ip,
       len(list_filter(cards, lambda m: len(m) between 14 and 19 and
           list_sum(list_transform(range(len(m)), lambda i: case when i % 2 = 0 then substr(m, (len(m) - i)::int, 1)::int
                                                                 else (2 * substr(m, (len(m) - i)::int, 1)::int) // 10 + (2 * substr(m, (len(m) - i)::int, 1)::int) % 10 end)) % 10 = 0))::bigint as n_card,
       len(list_filter(phones, lambda m: len(m) between 10 and 15))::bigint as n_phone
from found""",
    "op7_mixing": f"""
with sizes as (
    select doc_id, coalesce(source, '') as key, source is null as none, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::bigint as size from documents)
select doc_id, size, (sum(size) over (partition by key, none))::bigint as source_size from sizes""",
    "op8_license_scans": r"""
with words as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
places as (
    select doc_id, w, list_filter(range(len(w)), lambda i: w[i + 1:i + 2] = ['cc', 'by']) as cc,
           list_filter(range(len(w)), lambda i: w[i + 1:i + 3] = ['general', 'public', 'license']) as gpl,
           list_filter(range(len(w)), lambda i: w[i + 1:i + 3] = ['all', 'rights', 'reserved']) as reserved from words)
select doc_id, len(w)::bigint as n_words, (len(cc) + len(gpl) + len(reserved))::bigint as n_base,
       list_min(cc || gpl || reserved)::bigint as first_word, list_max(cc || gpl || reserved)::bigint as last_word,
       concat_ws(',', case when len(cc) > 0 then 'cc-by' end, case when len(gpl) > 0 then 'gpl' end, case when len(reserved) > 0 then 'reserved' end) as base_labels
from places""",
}


def oracle_sql() -> dict[str, str]:
    return {"op5_suffix_array": OP5, "op6_ngram_jaccard": OP6, "op9_lattice_embeddings": OP9, "op10_suffix_trees": OP10, "op11_divergence": OP11, "op13_ball_kmeans": OP13}
