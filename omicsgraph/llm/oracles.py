"""DuckDB SQL with the same rows as the queries that SQL can express."""

from __future__ import annotations

from .license_scan import PHRASES, TEMPLATES, half_block, needed

_SETS = {k: (half_block(t), sorted(set(t.split()))) for k, t in TEMPLATES.items()}
_TOKENS = ", ".join(f"('{k}', {step}, {len(ws)}, {needed(len(ws), 0.8)}, '{w}')" for k, (step, ws) in _SETS.items() for w in ws)
_PHRASE = " or ".join(f"({' and '.join(f"w{k}='{w}'" for k, w in enumerate(p.split()))})" for p in PHRASES)
_LABEL = " ".join(f"when {' and '.join(f"w{k}='{w}'" for k, w in enumerate(p.split()))} then '{label}'" for p, label in PHRASES.items())

OP1 = """
with d as (select doc_id, encode(coalesce(text, '')) b from documents),
pos_ as (select doc_id, i, md5(b[i+1:i+400]) h from (select doc_id, b, unnest(range(0, octet_length(b)-399)) i from d where octet_length(b)>=400)),
hit as (select doc_id, i from pos_ where h in (select h from pos_ group by h having count(*)>1)),
run as (select doc_id, i, sum(fresh) over (partition by doc_id order by i) r from (select doc_id, i, case when i-lag(i) over (partition by doc_id order by i)<=400 then 0 else 1 end fresh from hit)),
span as (select doc_id, min(i) s, max(i)+400 e from run group by doc_id, r),
edge as (select doc_id, s, e from span union all select doc_id, octet_length(b), null from d),
gap as (select doc_id, coalesce(lag(e) over (partition by doc_id order by s, e nulls last), 0) a, s b from edge),
kept as (select g.doc_id, string_agg(substr(hex(d.b), 2*g.a+1, 2*(g.b-g.a)), '' order by g.a) x from gap g join d on d.doc_id=g.doc_id group by g.doc_id)
select d.doc_id, octet_length(d.b) n_bytes, cast(coalesce(s.n, 0) as bigint) n_removed, coalesce(s.k, 0) n_spans, sha256(unhex(k.x)) kept_sha256,
    decode(unhex(regexp_replace(k.x, '([0-7].|[CD].[89AB].|E.[89AB].[89AB].|F.[89AB].[89AB].[89AB].)|..', '\\1', 'g'))) "text"
from d join kept k on k.doc_id=d.doc_id left join (select doc_id, sum(e-s) n, count(*) k from span group by doc_id) s on s.doc_id=d.doc_id"""

OP6 = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64*cast(x as double))) q from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x)))=0)
select query_id, cast(r as int) "rank", vec_id, score from (select a.vec_id query_id, b.vec_id, cast(list_inner_product(a.q, b.q) as bigint) score,
    row_number() over (partition by a.vec_id order by list_inner_product(a.q, b.q) desc, b.vec_id) r from v a join v b on a.vec_id<>b.vec_id where a.vec_id%20=0) where r<=20"""

OP7 = f"""
with w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x<>'') ws from documents),
pos_ as (select doc_id, unnest(ws) w0, unnest(range(0, len(ws))) i from w),
next as (select doc_id, i, w0, lead(w0) over o w1, lead(w0, 2) over o w2 from pos_ window o as (partition by doc_id order by i)),
place as (select doc_id, i, case {_LABEL} end label from next where {_PHRASE}),
base as (select doc_id, count(*) n, min(i) a, max(i) b, string_agg(distinct label, ',' order by label) labels from place group by doc_id),
t(label, step, n, need, tok) as (values {_TOKENS}),
block as (select distinct doc_id, tok, step, i//step-k block from (select doc_id, i, w0 from pos_ where w0 in (select tok from t)) join (select distinct tok, step from t) on tok=w0 cross join (select unnest([0, 1]) k)),
share as (select b.doc_id, b.block, t.label, count(*)/any_value(t.n)::double x from block b join t on t.tok=b.tok and t.step=b.step group by b.doc_id, b.block, t.label having count(*)>=any_value(t.need)),
found as (select doc_id, label, max(x) x from share group by doc_id, label),
every as (select doc_id, string_agg(distinct label, ',' order by label) labels from (select doc_id, label from found union all select doc_id, label from place) group by doc_id),
best as (select doc_id, max(x) x from found group by doc_id)
select w.doc_id, len(w.ws) n_words, coalesce(b.n, 0) n_base, b.a first_word, b.b last_word, coalesce(b.labels, '') base_labels, coalesce(e.labels, '') labels, case when b.n>0 then 1.0::double else coalesce(x.x, 0.0::double) end score
from w left join base b on b.doc_id=w.doc_id left join every e on e.doc_id=w.doc_id left join best x on x.doc_id=w.doc_id"""

_RULES = ("short", "repeats", "symbols", "dup_lines")
_PRIOR = ", ".join(f"avg({r}/n::double) m_{r}, var_samp({r}/n::double) v_{r}" for r in _RULES)
_WEIGHT = ", ".join(f"case when v_{r}>0 and m_{r}*(1-m_{r})/v_{r}-1>0 then m_{r}*(1-m_{r})/v_{r}-1 else 10.0 end k_{r}" for r in _RULES)
_RATES = ", ".join(f"({r}+m_{r}*k_{r})/(n+k_{r})" for r in _RULES)

OP10 = f"""
with w as (select doc_id, source, coalesce(text, '') t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x<>'') ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) ls from documents),
win as (select doc_id, i, array_to_string(ws[i+1:i+5], ' ') g from (select doc_id, ws, unnest(range(0, len(ws)-4)) i from w where len(ws)>=5)),
twice as (select doc_id, g from win group by doc_id, g having count(*)>1),
cover as (select doc_id, count(distinct i+k) n from (select win.doc_id, i, unnest(range(0, 5)) k from win join twice on twice.doc_id=win.doc_id and twice.g=win.g) group by doc_id),
m as (select w.doc_id, source, len(ws) n_words, length(array_to_string(ws, '')) word_chars, length(t)-length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) n_symbols, len(ls)-len(list_distinct(ls)) n_dup_lines, coalesce(c.n, 0) n_repeat_words from w left join cover c on c.doc_id=w.doc_id),
f as (select *, n_words<10 short, 100*n_repeat_words>20*n_words repeats, 10*n_symbols>3*word_chars symbols, 3*n_dup_lines>n_words dup_lines from m),
host as (select source, count(*) n, {", ".join(f"count(case when {r} then 1 end) {r}" for r in _RULES)} from f group by source),
prior as (select *, {_WEIGHT} from (select {_PRIOR} from host)),
verdict as (select source, greatest({_RATES})>0.5 bad from host cross join prior)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short or repeats base_failed, not (short or repeats) and not bad kept, bad host_failed
from f join verdict v on v.source is not distinct from f.source"""



def _rounds(n: int) -> str:
    """n rounds of clustering, written out: nearest centroids a<r>, then moved centroids c<r + 1>; a<n> is the last assignment."""
    square = "list_sum(list_transform(range(1, 65), lambda i: (x.v[i]-c.v[i])*(x.v[i]-c.v[i])))"
    out = []
    for r in range(n + 1):
        out.append(f"a{r} as materialized (select rid, c, d from (select rid, c, d, row_number() over (partition by rid order by d, c) place from (select x.rid, c.c, cast({square} as bigint) d from x cross join c{r} c)) where place=1)")
        if r < n:
            floor_ = "cast((s-((s%n)+n)%n)//n as bigint)"
            out.append(f"""c{r + 1} as materialized (select o.c, coalesce(m.v, o.v) v from c{r} o left join (select c, list({floor_} order by i) v from
    (select c, i, sum(e) s, count(*) n from (select a.c, unnest(x.v) e, unnest(range(0, 64)) i from a{r} a join x on x.rid=a.rid) group by c, i) group by c) m on m.c=o.c)""")
    return ",\n".join(out)


OP13 = f"""
with x as materialized (select row_number() over () rid, vec_id, list_transform(embedding, lambda x: cast(floor(1024*cast(x as double)) as bigint)) v from embeddings
    where embedding is not null and len(embedding)=64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x)))=0),
c0 as materialized (select row_number() over (order by h, v)-1 c, v from (select sha256('3:' || vec_id) h, v from x order by h, v limit 8)),
{_rounds(10)}
select x.vec_id, cast(a.c as int) "cluster", a.d distance, cast(sum(a.d) over (partition by a.c) as bigint) cluster_inertia, cast(sum(a.d) over () as bigint) inertia, sha256(array_to_string(c.v, ',')) centroid_sha256
from a10 a join x on x.rid=a.rid join c10 c on c.c=a.c"""

ORACLE_SQL = {"op13_clustering": OP13, "op1_suffix_dedup": OP1, "op6_topk": OP6, "op7_license_scan": OP7, "op10_quality_rules": OP10}
