"""Vectors, readouts, gene and edge scores, and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import evaluation, graph, ranking, scoring
from .base import register, sql, view

#: A small head over 64 dimensions: weights from a rule, so that SQL can state them too.
HIDDEN = 3
HEAD = scoring.Head([[((i * 7 + h * 3) % 5 - 2) / 10 for i in range(64)] for h in range(HIDDEN)], [0.01, -0.02, 0.03], [1.0, -0.5, 2.0])
ATTENTION = ([((i * 3) % 7 - 3) / 10 for i in range(64)], 0.1)

LONG = "(select sample_ix, node_ix, node_type, unnest(z) zd, unnest(range(0,64)) i from fx_node)"
SCALED = "(select sample_ix, node_ix, node_type, i, zd*(1+0.1e0*sample_ix) zd from " + LONG + ")"


def _z(spark, d):
    """z scaled by 1 + 0.1 * sample."""
    return view(spark, d, "fx_node").withColumn("z", F.transform(F.col("z").cast("array<double>"), lambda v: v * (1 + F.lit(0.1) * F.col("sample_ix"))))


def _flat(df, keys, x="x"):
    return df.select(*keys, F.posexplode(x).alias("i", "v")).select(*keys, "i", F.round("v", 6).alias("v"))


@register("a2_mean_vector", "fx_node", f"select node_type, cast(i as int) i, round(avg(cast(zd as double)), 6) v from {LONG} group by node_type, i")
def a2(spark, d):
    return _flat(V.mean_vector(view(spark, d, "fx_node").withColumnRenamed("z", "x"), ["node_type"]), ["node_type"])


@register("a3_pool_vectors", "fx_node", f"""select sample_ix, node_type, 'max' pooled, cast(i as int) i, round(max(zd), 6) v from {SCALED} group by sample_ix, node_type, i
    union all select sample_ix, node_type, 'last', cast(i as int), round(max_by(zd, node_ix), 6) from {SCALED} group by sample_ix, node_type, i""")
def a3(spark, d):
    x = _z(spark, d).withColumnRenamed("z", "x")
    made = [_flat(V.pool_vectors(x, ["sample_ix", "node_type"], "node_ix", m).withColumn("pooled", F.lit(m)), ["sample_ix", "node_type", "pooled"]) for m in ("max", "last")]
    return made[0].unionByName(made[1])


@register("a4_combine_strands", "fx_node", f"select node_ix, cast(i as int) i, round(sum(cast(zd as double)), 6) v from {SCALED} group by node_ix, i")
def a4(spark, d):
    return _flat(V.combine_strands(_z(spark, d).withColumnRenamed("z", "x"), ["node_ix"]), ["node_ix"])


@register("a24_pool_tokens", "fx_node", f"select sample_ix, node_type, cast(i as int) i, round(sum(case when node_ix%3<>0 then zd else 0 end)/greatest(1,count(case when node_ix%3<>0 then 1 end)), 6) v from {SCALED} group by sample_ix, node_type, i")
def a24(spark, d):
    tokens = _z(spark, d).select("sample_ix", "node_type", F.col("node_ix").alias("token_ix"), F.col("z").alias("x"), (F.col("node_ix") % 3 == 0).alias("is_pad"))
    return _flat(V.pool_tokens(tokens, ["sample_ix", "node_type"]), ["sample_ix", "node_type"])


SCORE = f"(select sample_ix, node_ix, sum(zd*((i*3)%7-3)/10.0e0)+0.1e0 s from {SCALED} where node_type='gene' group by sample_ix, node_ix)"
WEIGHTS = f"(select sample_ix, node_ix, exp(s-mx)/sum(exp(s-mx)) over (partition by sample_ix) w from (select *, max(s) over (partition by sample_ix) mx from {SCORE}))"


@register("w5_segment_softmax", "fx_node", f"select sample_ix, node_ix, round(w, 9) weight from {WEIGHTS}")
def w5(spark, d):
    z = _z(spark, d).where("node_type='gene'").withColumn("score", V.dot(F.col("z"), ATTENTION[0]) + ATTENTION[1])
    return V.segment_softmax(z, ["sample_ix"]).select("sample_ix", "node_ix", F.round("weight", 9).alias("weight"))


READ = {"mean": f"(select sample_ix, i, avg(zd) g from {SCALED} where node_type='gene' group by sample_ix, i)", "attention": f"(select z.sample_ix, z.i, sum(z.zd*w.w) g from {SCALED} z join {WEIGHTS} w on z.sample_ix=w.sample_ix and z.node_ix=w.node_ix where z.node_type='gene' group by z.sample_ix, z.i)"}


@register("a11_readout_mean", "fx_node", f"select sample_ix, cast(i as int) i, round(g, 6) v from {READ['mean']}")
def a11(spark, d):
    return _flat(V.readout(_z(spark, d).where("node_type='gene'"), ["sample_ix"]), ["sample_ix"], "g")


@register("a11_readout_attention", "fx_node", f"select sample_ix, cast(i as int) i, round(g, 6) v from {READ['attention']}")
def a11a(spark, d):
    return _flat(V.readout(_z(spark, d).where("node_type='gene'"), ["sample_ix"], "attention", ATTENTION), ["sample_ix"], "g")


def _gradient(read):
    """SQL of v by sample and dimension: the hidden units that are on at the readout g, weighed."""
    unit = "(select 0 h, 0.01e0 b, 1.0e0 w2 union all select 1, -0.02e0, -0.5e0 union all select 2, 0.03e0, 2.0e0)"
    on = f"(select g.sample_ix, u.h, u.w2, sum(g.g*((g.i*7+u.h*3)%5-2)/10.0e0)+u.b a from {read} g cross join {unit} u group by g.sample_ix, u.h, u.w2, u.b)"
    return f"(select o.sample_ix, k.i, sum(case when o.a>0 then o.w2 else 0 end*((k.i*7+o.h*3)%5-2)/10.0e0) v from {on} o cross join (select unnest(range(0,64)) i) k group by o.sample_ix, k.i)"


GENES = f"(select * from {SCALED} where node_type='gene')"
MEAN_SCORES = f"(select z.sample_ix, z.node_ix, sum(abs(z.zd*v.v))/n.n score from {GENES} z join {_gradient(READ['mean'])} v on z.sample_ix=v.sample_ix and z.i=v.i join (select sample_ix, count(distinct node_ix) n from {GENES} group by sample_ix) n on n.sample_ix=z.sample_ix group by z.sample_ix, z.node_ix, n.n)"
ATT_V = _gradient(READ["attention"])
ATT_SCORES = f"""(with zz as (select * from {GENES}), ww as (select * from {WEIGHTS}), vv as (select * from {ATT_V}), gg as (select * from {READ['attention']}),
    vg as (select gg.sample_ix, sum(gg.g*vv.v) vg from gg join vv on gg.sample_ix=vv.sample_ix and gg.i=vv.i group by gg.sample_ix),
    vz as (select zz.sample_ix, zz.node_ix, sum(zz.zd*vv.v) vz from zz join vv on zz.sample_ix=vv.sample_ix and zz.i=vv.i group by zz.sample_ix, zz.node_ix)
    select zz.sample_ix, zz.node_ix, sum(abs(zz.zd*ww.w*(vv.v+(vz.vz-vg.vg)*((zz.i*3)%7-3)/10.0e0))) score from zz join vv on zz.sample_ix=vv.sample_ix and zz.i=vv.i join ww on ww.sample_ix=zz.sample_ix and ww.node_ix=zz.node_ix
    join vg on vg.sample_ix=zz.sample_ix join vz on vz.sample_ix=zz.sample_ix and vz.node_ix=zz.node_ix group by zz.sample_ix, zz.node_ix)"""  # fmt: skip


def _gene_scores(spark, d, mode="mean"):
    z = _z(spark, d).where("node_type='gene'").select(F.col("sample_ix").alias("sample_id"), F.col("node_ix").alias("gene_id"), "z")
    return scoring.gradient_x_input(z, HEAD, mode, ATTENTION if mode == "attention" else None)


@register("a12_gradient_x_input_mean", "fx_node", f"select sample_ix sample_id, node_ix gene_id, round(score, 9) score from {MEAN_SCORES}")
def a12(spark, d):
    return _gene_scores(spark, d).withColumn("score", F.round("score", 9))


@register("a12_gradient_x_input_attention", "fx_node", f"select sample_ix sample_id, node_ix gene_id, round(score, 9) score from {ATT_SCORES}")
def a12a(spark, d):
    return _gene_scores(spark, d, "attention").withColumn("score", F.round("score", 9))


IMPORTANCE = f"(select node_ix id, sum(score)/3 score from {MEAN_SCORES} group by node_ix)"


@register("a13_gene_importance", "fx_node", f"select id, round(score, 9) score from {IMPORTANCE}")
def a13(spark, d):
    return scoring.gene_importance(_gene_scores(spark, d)).select("id", F.round("score", 9).alias("score"))


@register("w2_rank_genes", "", "select c_custkey id, c_acctbal score, row_number() over (order by c_acctbal desc, c_custkey) \"rank\" from customer")
def w2(spark, d):
    return ranking.rank_genes(sql(spark, d, "", "select c_custkey id, c_acctbal score from customer"))


@register("t2_top_ids", "", "select c_custkey id from customer order by c_acctbal desc, c_custkey limit 100")
def t2(spark, d):
    return ranking.top_ids(ranking.rank_genes(sql(spark, d, "", "select c_custkey id, c_acctbal score from customer")), 100)


TYPED = """select e.edge_ix, a.node_type src_type, 'e' rel, b.node_type dst_type, e.src_ix src_id, e.dst_ix dst_id from fx_edge e
    join (select distinct node_ix, node_type from fx_node) a on a.node_ix=e.src_ix join (select distinct node_ix, node_type from fx_node) b on b.node_ix=e.dst_ix"""  # fmt: skip
MASKED = f"select * from ({TYPED}) where (src_type<>'gene' and dst_type<>'gene') or (src_type='gene' and src_id%5=0) or (dst_type='gene' and dst_id%5=0)"


def _masked(spark, d):
    top = sql(spark, d, "fx_node", "select distinct node_ix id from fx_node where node_ix%5=0")
    return scoring.mask_edges_by_top_genes(sql(spark, d, "fx_edge fx_node", TYPED), top)


@register("j13_mask_edges_by_top_genes", "fx_edge fx_node", f"select edge_ix, src_type, rel, dst_type, src_id, dst_id from ({MASKED})")
def j13(spark, d):
    return _masked(spark, d)


SCORED = f"""select edge_ix, src_type, rel, dst_type, src_id, dst_id, avg(s) score from (select m.*, a.sample_ix, list_sum(list_transform(list_zip(a.z, b.z), lambda p: abs(cast(p[1] as double)*p[2])))*(1+0.1e0*a.sample_ix)*(1+0.1e0*a.sample_ix) s
    from ({MASKED}) m join fx_node a on a.node_ix=m.src_id join fx_node b on b.node_ix=m.dst_id and b.sample_ix=a.sample_ix) group by edge_ix, src_type, rel, dst_type, src_id, dst_id"""  # fmt: skip


def _scored(spark, d):
    z = _z(spark, d).select(F.col("sample_ix").alias("sample_id"), "node_type", F.col("node_ix").alias("node_id"), "z")
    return scoring.interaction_scores(_masked(spark, d), z)


@register("a14_interaction_scores", "fx_edge fx_node", f"select edge_ix, src_type, dst_type, src_id, dst_id, round(score, 5) score from ({SCORED})")
def a14(spark, d):
    return _scored(spark, d).select("edge_ix", "src_type", "dst_type", "src_id", "dst_id", F.round("score", 5).alias("score"))


#: The samples 1 and 2 differ from the reference, sample 0, at a quarter of the nodes each; sample 3 nowhere.
SPARSE_Z = "(select s.sample_ix, n.node_ix, n.node_type, list_transform(n.z, lambda v: cast(v as double)*case when s.sample_ix<3 and n.node_ix%4=s.sample_ix then 1+0.5e0*s.sample_ix else 1 end) z from fx_node n cross join (select unnest([1, 2, 3]) sample_ix) s where n.sample_ix=0)"
SPARSE = f"""(with zz as (select * from {SPARSE_Z}) select edge_ix, src_type, rel, dst_type, src_id, dst_id, avg(list_sum(list_transform(list_zip(a.z, b.z), lambda p: abs(p[1]*p[2])))) score
    from ({MASKED}) m join zz a on a.node_ix=m.src_id join zz b on b.node_ix=m.dst_id and b.sample_ix=a.sample_ix group by edge_ix, src_type, rel, dst_type, src_id, dst_id)"""  # fmt: skip


def _sparse(spark, d):
    z = view(spark, d, "fx_node").withColumn("z", F.col("z").cast("array<double>"))
    own = z.where("sample_ix in (1, 2) and node_ix%4=sample_ix").withColumn("z", F.transform("z", lambda v: v * (1 + F.lit(0.5) * F.col("sample_ix"))))
    named = lambda df, *keys: df.select(*keys, "node_type", F.col("node_ix").alias("node_id"), "z")
    return named(z.where("sample_ix=0")), named(own, F.col("sample_ix").alias("sample_id"))


@register("a14_sparse_scores", "fx_edge fx_node", f"select edge_ix, src_type, dst_type, src_id, dst_id, round(score, 5) score from {SPARSE}")
def a14s(spark, d):
    out = scoring.sparse_interaction_scores(_masked(spark, d), *_sparse(spark, d), 3)
    return out.select("edge_ix", "src_type", "dst_type", "src_id", "dst_id", F.round("score", 5).alias("score"))


@register("t1_top_interactions", "fx_edge fx_node", f'select edge_ix, src_type, dst_type, score, "rank" from (select edge_ix, src_type, dst_type, round(score, 5) score, row_number() over (partition by src_type, rel, dst_type order by score desc, edge_ix) "rank" from {SPARSE}) where "rank"<=20')
def t1s(spark, d):
    top, _ = scoring.top_interactions(_masked(spark, d), *_sparse(spark, d), 3, 20)
    return top.select("edge_ix", "src_type", "dst_type", F.round("score", 5).alias("score"), "rank")


@register("a13_sparse_importance", "fx_node", f"""select id, score from (with zz as materialized (select sample_ix, node_ix, unnest(z) zd, unnest(range(0,64)) i from {SPARSE_Z} where node_type='gene'), g as (select sample_ix, i, avg(zd) g from zz group by sample_ix, i),
    v as materialized (select * from {_gradient('g')}) select node_ix id, round(sum(abs(zz.zd*v.v))/(3*(select count(distinct node_ix) from zz)), 9) score from zz join v on v.sample_ix=zz.sample_ix and v.i=zz.i group by node_ix)""")
def a13s(spark, d):
    base, own = (df.where("node_type='gene'").withColumnRenamed("node_id", "gene_id") for df in _sparse(spark, d))
    return scoring.sparse_importance(base, own, 3, HEAD).select("id", F.round("score", 9).alias("score"))


@register("a13_sparse_attention", "fx_node", f"""select id, round(score, 9) score from (with zz as materialized (select sample_ix, node_ix, unnest(z) zd, unnest(range(0,64)) i from {SPARSE_Z} where node_type='gene'),
    t as (select sample_ix, node_ix, sum(zd*((i*3)%7-3)/10.0e0)+0.1e0 s from zz group by sample_ix, node_ix), ww as materialized (select sample_ix, node_ix, exp(s-mx)/sum(exp(s-mx)) over (partition by sample_ix) w from (select *, max(s) over (partition by sample_ix) mx from t)),
    g as materialized (select zz.sample_ix, zz.i, sum(zz.zd*ww.w) g from zz join ww on zz.sample_ix=ww.sample_ix and zz.node_ix=ww.node_ix group by zz.sample_ix, zz.i), vv as materialized (select * from {_gradient('g')}),
    vg as (select g.sample_ix, sum(g.g*vv.v) vg from g join vv on g.sample_ix=vv.sample_ix and g.i=vv.i group by g.sample_ix),
    vz as (select zz.sample_ix, zz.node_ix, sum(zz.zd*vv.v) vz from zz join vv on zz.sample_ix=vv.sample_ix and zz.i=vv.i group by zz.sample_ix, zz.node_ix)
    select zz.node_ix id, sum(abs(zz.zd*ww.w*(vv.v+(vz.vz-vg.vg)*((zz.i*3)%7-3)/10.0e0)))/3 score from zz join vv on zz.sample_ix=vv.sample_ix and zz.i=vv.i join ww on ww.sample_ix=zz.sample_ix and ww.node_ix=zz.node_ix
    join vg on vg.sample_ix=zz.sample_ix join vz on vz.sample_ix=zz.sample_ix and vz.node_ix=zz.node_ix group by zz.node_ix)""")
def a13a(spark, d):
    base, own = (df.where("node_type='gene'").withColumnRenamed("node_id", "gene_id") for df in _sparse(spark, d))
    return scoring.sparse_importance(base, own, 3, HEAD, "attention", ATTENTION).select("id", F.round("score", 9).alias("score"))


@register("t1_top_edges", "fx_region_edge", "select edge_ix, src_type, rel, dst_type, score, \"rank\" from (select *, row_number() over (partition by src_type, rel, dst_type order by score desc, edge_ix) \"rank\" from (select edge_ix, chrom src_type, rel, 'gene' dst_type, max(weight) score from fx_region_edge group by edge_ix, chrom, rel)) where \"rank\"<=25")
def t1(spark, d):
    return ranking.top_edges(sql(spark, d, "fx_region_edge", "select edge_ix, chrom src_type, rel, 'gene' dst_type, max(weight) score from fx_region_edge group by edge_ix, chrom, rel"), 25)


@register("p16_decode_index", "fx_edge", "select edge_ix, dst_ix, case when v.vec_id is not null then 'n'||cast(v.vec_id as string) else 'TF_IDX_OUT_OF_RANGE:'||cast(src_ix*3 as string) end src from fx_edge left join embeddings v on v.vec_id=src_ix*3")
def p16(spark, d):
    edges = sql(spark, d, "fx_edge", "select edge_ix, dst_ix, src_ix*3 src from fx_edge")
    nodes = sql(spark, d, "", "select vec_id node_ix, 'n'||cast(vec_id as string) node_id from embeddings")
    return graph.decode_index(edges, "src", nodes, "TF").select("edge_ix", "dst_ix", "src")


@register("j9_tf_nodes", "fx_edge fx_node", f"""select cast(t.tf as string) node_id, cast(k.i as int) i, round(coalesce(g.zd, m.zd), 6) v from (select distinct src_ix tf from fx_edge) t cross join (select unnest(range(0,64)) i) k
    left join (select node_ix, i, cast(zd as double) zd from {LONG} where sample_ix=0 and node_type='gene') g on g.node_ix=t.tf and g.i=k.i join (select i, avg(cast(zd as double)) zd from {LONG} where sample_ix=0 and node_type='gene' group by i) m on m.i=k.i""")
def j9(spark, d):
    genes = view(spark, d, "fx_node").where("sample_ix=0 and node_type='gene'").select(F.col("node_ix").cast("string").alias("node_id"), F.col("z").alias("x"))
    return _flat(graph.tf_nodes(sql(spark, d, "fx_edge", "select cast(src_ix as string) src from fx_edge"), genes), ["node_id"])


def _overlaid(spark, d):
    nodes = view(spark, d, "fx_node").where("sample_ix=0").select("node_type", F.col("node_ix").alias("node_id"), F.col("z").cast("array<double>").alias("x"))
    own = _z(spark, d).where("sample_ix>0 and node_ix%4=sample_ix").select(F.col("sample_ix").alias("sample_id"), "node_type", F.col("node_ix").alias("node_id"), F.col("z").alias("x"))
    samples = sql(spark, d, "", "select 1 sample_id union all select 2 sample_id")
    return graph.overlay_deltas(nodes, own, samples)


OVERLAID = f"""(select s.sample_id, n.node_type, n.node_ix, n.i, case when n.node_ix%4=s.sample_id then n.zd*(1+0.1e0*s.sample_id) else cast(n.zd as double) end v from {LONG} n cross join (select 1 sample_id union all select 2) s where n.sample_ix=0)"""


@register("j10_overlay_deltas", "fx_node", f"select sample_id, node_type, node_ix node_id, round(sum(abs(v)), 6) total from {OVERLAID} group by sample_id, node_type, node_ix")
def j10(spark, d):
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + F.abs(v))
    return _overlaid(spark, d).select("sample_id", "node_type", "node_id", F.round(total, 6).alias("total"))


@register("j11_sync_tf", "fx_node", f"""select sample_id, node_type, node_ix node_id, round(sum(abs(v)), 6) total from (select * from {OVERLAID} where node_type<>'tf'
    union all select sample_id, 'tf' node_type, node_ix, i, v from {OVERLAID} where node_type='gene' and node_ix%3=0) group by sample_id, node_type, node_ix""")
def j11(spark, d):
    """Every third gene is a TF too."""
    nodes = _overlaid(spark, d).where("node_type<>'tf'")
    tf = nodes.where("node_type='gene' and node_id%3=0").select("sample_id", F.lit("tf").alias("node_type"), "node_id", F.transform("x", lambda v: v * 0).alias("x"))
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + F.abs(v))
    return graph.sync_tf(nodes.unionByName(tf)).select("sample_id", "node_type", "node_id", F.round(total, 6).alias("total"))


@register("j12_match_labels", "fx_pred", "select p.sample_id, round(p.y_pred, 6) y_pred, o.n label from fx_pred p join (select o_custkey sample_id, count(*) n from orders group by o_custkey) o on o.sample_id=p.sample_id")
def j12(spark, d):
    labels = sql(spark, d, "", "select o_custkey sample_id, count(*) label from orders group by o_custkey")
    return evaluation.match_labels(view(spark, d, "fx_pred").select("sample_id", F.round("y_pred", 6).alias("y_pred")), labels)


@register("w4_train_val_split", "fx_pred", "select sample_id, case when row_number() over (order by md5(cast(sample_id as string)||':42'), sample_id)<=floor(count(*) over ()*0.8) then 'train' else 'val' end part from fx_pred")
def w4(spark, d):
    return evaluation.train_val_split(view(spark, d, "fx_pred"), 0.8, 42)


@register("a22_regression_metrics", "fx_pred", """select round(mse, 3) mse, round(n*c/(sqrt(n*vt)*sqrt(n*vp)+1e-8), 6) r, round(1-mse/(vs+1e-8), 6) r2 from
    (select avg((y_true-y_pred)*(y_true-y_pred)) mse, covar_pop(y_true,y_pred) c, var_pop(y_true) vt, var_pop(y_pred) vp, count(*) n, var_samp(y_true) vs from fx_pred)""")
def a22(spark, d):
    return evaluation.regression_metrics(view(spark, d, "fx_pred")).select(F.round("mse", 3).alias("mse"), F.round("r", 6).alias("r"), F.round("r2", 6).alias("r2"))


@register("a23_epoch_log", "", "select user_id%20 epoch, round(sum(\"value\"*(event_id%8))/greatest(1, sum(event_id%8)), 6) train_mse from events group by user_id%20")
def a23(spark, d):
    return evaluation.epoch_log(sql(spark, d, "", "select user_id%20 epoch, value loss, event_id%8 bs from events")).select("epoch", F.round("train_mse", 6).alias("train_mse"))


@register("a23_best_epoch", "", "select min_by(epoch, struct_pack(v:=v, e:=epoch)) epoch, round(min(v), 6) val_mse from (select cast(ts as date) epoch, avg(\"value\") v from events group by 1)")
def a23b(spark, d):
    log = sql(spark, d, "", "select cast(ts as date) epoch, avg(value) val_mse from events group by 1 union all select date'1999-01-01' epoch, cast('NaN' as double) val_mse")
    return evaluation.best_epoch(log).select("epoch", F.round("val_mse", 6).alias("val_mse"))
