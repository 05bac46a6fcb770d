"""Regions, windows, edges and the graph's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import chains, genome, graph
from .base import register, sql, view


@register("p1_parse_region_id", "fx_region_edge", "select edge_ix, chrom, rstart region_start, rend region_end from fx_region_edge")
def p1(spark, d):
    """Ends are swapped in every other id."""
    rows = sql(spark, d, "fx_region_edge", "select edge_ix, case when edge_ix%2=0 then region_id else ' '||chrom||':'||cast(rend as string)||'-'||cast(rstart as string)||' ' end region_id from fx_region_edge")
    r = S.parse_region_id(F.col("region_id"))
    return rows.select("edge_ix", r["chrom"].alias("chrom"), r["start"].alias("region_start"), r["end"].alias("region_end"))


WINDOW = "chrom||':'||cast(ws as string)||'-'||cast(ws+3999 as string)"
WINDOWS = f"select region_id, chrom, ws, {WINDOW} window_id from (select region_id, chrom, cast(floor((floor((rstart+rend)/2.0)-1)/2000.0) as bigint)*2000+1 ws from fx_region)"


@register("p4_window_id", "fx_region", f"select region_id, window_id from ({WINDOWS})")
def p4(spark, d):
    return view(spark, d, "fx_region").select("region_id", S.window_id(F.col("region_id")).alias("window_id"))


@register("p5_build_windows", "fx_region", f"select distinct window_id, chrom, ws wstart, ws+3999 wend from ({WINDOWS})")
def p5(spark, d):
    return genome.build_windows(view(spark, d, "fx_region"))[0]


@register("p9_fixed_len_for_type", "fx_region", "select region_id, case rtype when 'promoter_1000' then 1000 when 'promoter_500' then 500 when 'motif_site' then 100 else 600 end fixed_len from fx_region")
def p9(spark, d):
    n = S.fixed_len_for_type(F.col("rtype"), {"promoter_1000": 1000, "promoter_500": 500, "motif_site": 100, "chip_peak": 600})
    return view(spark, d, "fx_region").select("region_id", n.alias("fixed_len"))


def _regions(spark, d):
    edges = view(spark, d, "fx_region_edge")
    return graph.collect_regions({k: edges.where(F.col("rel") == k) for k in graph.EDGE_REGION_TYPE})


@register("a1_collect_regions", "fx_region", "select region_id, chrom, rstart, rend, rtype from fx_region")
def a1(spark, d):
    return _regions(spark, d)


@register("p15_region_type_code", "fx_region", "select region_id, cast(dense_rank() over (order by rtype)-1 as int) type_code from fx_region")
def p15(spark, d):
    return graph.region_type_code(view(spark, d, "fx_region")).select("region_id", "type_code")


NODES = "select 'gene' node_type, gene_id node_id from fx_gene union all select distinct 'region' node_type, region_id node_id from fx_region_edge where weight>0.02 union all select distinct 'tf' node_type, tf_id node_id from fx_region_edge"


@register("p15_assign_node_index", "fx_gene fx_region_edge", f"select node_type, node_id, row_number() over (partition by node_type order by node_id)-1 node_ix from ({NODES})")
def p15n(spark, d):
    return graph.assign_node_index(sql(spark, d, "fx_gene fx_region_edge", NODES))


EDGES = """select edge_ix, case rel when 'motif' then 'tf' else 'region' end src_type, rel, case rel when 'motif' then 'region' else 'gene' end dst_type,
    case rel when 'motif' then tf_id else region_id end src_id, case rel when 'motif' then region_id when 'chip' then tf_id else gene_id end dst_id, weight from fx_region_edge where rel<>'promoter500'"""
VALID = f"select e.* from ({EDGES}) e where exists (select 1 from ({NODES}) n where n.node_type=e.src_type and n.node_id=e.src_id) and exists (select 1 from ({NODES}) n where n.node_type=e.dst_type and n.node_id=e.dst_id)"
BOTH = "fx_gene fx_region_edge"


def _edges(spark, d):
    return graph.valid_edges(sql(spark, d, BOTH, EDGES), sql(spark, d, BOTH, NODES))


@register("j8_valid_edges", BOTH, VALID)
def j8(spark, d):
    return _edges(spark, d).select("edge_ix", "src_type", "rel", "dst_type", "src_id", "dst_id", "weight")


@register("a8_graph_summary_nodes", BOTH, f"select node_type, count(*) n from ({NODES}) group by node_type")
def a8n(spark, d):
    return graph.graph_summary(sql(spark, d, BOTH, NODES), sql(spark, d, BOTH, EDGES))[0]


@register("a8_graph_summary_edges", BOTH, f"select src_type, rel, dst_type, count(*) n from ({EDGES}) group by src_type, rel, dst_type")
def a8e(spark, d):
    return graph.graph_summary(sql(spark, d, BOTH, NODES), sql(spark, d, BOTH, EDGES))[1]


@register("a10_reverse_edges", BOTH, f"select edge_ix, src_type, rel, dst_type, src_id, dst_id, weight from ({EDGES}) union all select edge_ix, dst_type src_type, 'rev_'||rel rel, src_type dst_type, dst_id src_id, src_id dst_id, weight from ({EDGES})")
def a10(spark, d):
    return graph.reverse_edges(sql(spark, d, BOTH, EDGES))


@register("j7_filter_ppi", "fx_ppi fx_gene", """select gene1, gene2, round(combined_score/1000.0e0, 6) score from fx_ppi where gene1<>gene2 and combined_score>=400
    and exists (select 1 from fx_gene where gene_id=gene1) and exists (select 1 from fx_gene where gene_id=gene2)""")
def j7(spark, d):
    edges = view(spark, d, "fx_ppi").select("gene1", "gene2", F.col("combined_score").alias("score"))
    return graph.filter_ppi(edges, view(spark, d, "fx_gene"), 400, "divide_1000").withColumn("score", F.round("score", 6))


@register("p12_ppi_normalize", "fx_ppi", "select edge_ix, gene1, combined_score/1000.0e0 divided, round(ln(1+combined_score)/ln(1001.0e0), 6) logged from fx_ppi")
def p12(spark, d):
    s = F.col("combined_score")
    return view(spark, d, "fx_ppi").select("edge_ix", "gene1", S.ppi_normalize(s, "divide_1000").alias("divided"), F.round(S.ppi_normalize(s, "log1p"), 6).alias("logged"))


@register("a9_directed_ppi", "fx_ppi", "select gene1, gene2, combined_score, edge_ix from fx_ppi union all select gene2 gene1, gene1 gene2, combined_score, edge_ix from fx_ppi")
def a9(spark, d):
    return graph.directed_ppi(view(spark, d, "fx_ppi"))


@register("u3_ppi_endpoints", "fx_ppi", "select gene1 gene_id from fx_ppi union select gene2 gene_id from fx_ppi")
def u3(spark, d):
    return graph.ppi_endpoints(view(spark, d, "fx_ppi"))


@register("u4_undirected_edges", "fx_ppi", "select distinct least(gene1, gene2) gene1, greatest(gene1, gene2) gene2 from fx_ppi")
def u4(spark, d):
    return graph.undirected_edges(view(spark, d, "fx_ppi"))


@register("u5_background_genes", BOTH, f"select distinct node_id gene_id from ({NODES}) where node_type='gene'")
def u5(spark, d):
    return graph.background_genes(sql(spark, d, BOTH, NODES))


TOP = "select tf_id src_id, region_id dst_id, weight score, row_number() over (order by weight desc, edge_ix, tf_id, region_id) \"rank\" from fx_region_edge where rel='motif'"
LINKS = "select region_id, gene_id, edge_ix from fx_region_edge where rel='{}'"
CHAINS = f"""select tf, region, link_type, target_gene, tf_region_score from
    (select src_id tf, dst_id region, score tf_region_score from ({TOP}) where "rank"<=500) t join
    (select region_id, gene_id target_gene, 'promoter1000' link_type from ({LINKS.format('promoter1000')}) union all select region_id, gene_id, 'chip' from ({LINKS.format('chip')})) l on t.region=l.region_id"""  # fmt: skip


def _chains(spark, d):
    top = sql(spark, d, "fx_region_edge", TOP.replace('"', ""))
    # promoter edges as they are, chip edges only in reverse
    edges = sql(spark, d, "fx_region_edge", """select edge_ix, 'region' src_type, 'promoter1000' rel, 'gene' dst_type, region_id src_id, gene_id dst_id from fx_region_edge where rel='promoter1000'
        union all select edge_ix, 'gene' src_type, 'rev_promoter1000' rel, 'region' dst_type, gene_id src_id, region_id dst_id from fx_region_edge where rel='promoter1000'
        union all select edge_ix, 'gene' src_type, 'rev_chip' rel, 'region' dst_type, gene_id src_id, region_id dst_id from fx_region_edge where rel='chip'""")
    return chains.tf_region_gene_chains(top, edges, view(spark, d, "fx_region"), 500)


@register("j15_region_gene_links", "fx_region_edge", LINKS.format("chip"))
def j15(spark, d):
    edges = sql(spark, d, "fx_region_edge", "select edge_ix, 'gene' src_type, 'rev_chip' rel, 'region' dst_type, gene_id src_id, region_id dst_id from fx_region_edge where rel='chip'")
    return chains.region_gene_links(edges, "chip")


@register("j14_tf_region_gene_chains", "fx_region_edge", CHAINS)
def j14(spark, d):
    return _chains(spark, d)


@register("a15_target_gene_hits", "fx_region_edge", f"select target_gene gene_id, count(case when link_type='promoter1000' then 1 end) hit_promoter, count(*) hit_all from ({CHAINS}) group by target_gene")
def a15(spark, d):
    return chains.target_gene_hits(_chains(spark, d))


PROM, ALL = "select distinct gene_id from fx_region_edge where rel='promoter1000' and weight>0.07", "select distinct gene_id from fx_region_edge where rel in ('promoter1000','chip')"


@register("u1_gene_set_ops", "fx_region_edge", f"select 'promoter' set_name, count(*) n from ({PROM}) union all select 'all' set_name, count(*) n from ({ALL}) union all select 'intersection', count(*) from ({PROM} intersect {ALL}) union all select 'added_by_chip', count(*) from ({ALL} except {PROM})")
def u1(spark, d):
    return chains.gene_set_ops(sql(spark, d, "fx_region_edge", PROM), sql(spark, d, "fx_region_edge", ALL))["counts"]


@register("u1_added_by_chip", "fx_region_edge", f"{ALL} except {PROM}")
def u1b(spark, d):
    return chains.gene_set_ops(sql(spark, d, "fx_region_edge", PROM), sql(spark, d, "fx_region_edge", ALL))["added_by_chip"]


@register("u2_overlap", "fx_region_edge fx_ppi", f"{PROM} intersect select gene1 gene_id from fx_ppi where combined_score>700 intersect select tf_id gene_id from fx_region_edge")
def u2(spark, d):
    return chains.overlap(sql(spark, d, "fx_region_edge", PROM), sql(spark, d, "fx_ppi", "select gene1 gene_id from fx_ppi where combined_score>700"), sql(spark, d, "fx_region_edge", "select tf_id gene_id from fx_region_edge"))
