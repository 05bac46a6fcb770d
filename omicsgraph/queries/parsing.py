"""Sources: lines made of the views, and the parsers over them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.scalars import extract_locus_id, safe_sample_id
from ..operators import graph, variants
from ..operators.enrichment import build_gene2go, build_go_names
from ..sources import tables, text
from ..sources.shared import shared_dir
from .base import register, sql, view


@register("s1_tile_genome", "fx_genome", """select chrom, i tile_ix, i*1000+1 tile_start, substr(seq, cast(i*1000+1 as int), 1000) seq
    from (select chrom, seq, unnest(range(0, cast(ceil(length(seq)/1000.0) as bigint))) i from fx_genome where seq<>'')""")
def s1(spark, d):
    return text.tile_genome(view(spark, d, "fx_genome"), 1000)


@register("s1_read_fasta", "fx_genome", "select chrom, seq from fx_genome")
def s1r(spark, d):
    """Written as FASTA with lines of 60 letters, and read again."""
    path = f"{shared_dir(spark)}/fasta-{uuid.uuid4().hex}"
    lines = F.concat(F.lit(">"), F.col("chrom"), F.lit(" text\n"), F.regexp_replace("seq", "(.{60})", "$1\n"))
    view(spark, d, "fx_genome").select(lines.alias("value")).write.text(path)
    return text.read_fasta(spark, path)


@register("s1_fasta_tiles", "fx_genome", """select chrom, i tile_ix, i*1000+1 tile_start, substr(seq, cast(i*1000+1 as int), 1000) seq
    from (select chrom, seq, unnest(range(0, cast(ceil(length(seq)/1000.0) as bigint))) i from fx_genome where seq<>'')""")
def s1f(spark, d):
    """Written as FASTA with lines of 60 letters, and tiled by lines; chunks of 100 lines, so that records go over many."""
    path = f"{shared_dir(spark)}/fasta-{uuid.uuid4().hex}"
    lines = F.concat(F.lit(">"), F.col("chrom"), F.lit(" text\n"), F.regexp_replace("seq", "(.{60})", "$1\n"))
    view(spark, d, "fx_genome").select(lines.alias("value")).write.text(path)
    return text.read_fasta_tiles(spark, path, 1000, chunk=100)


@register("s2_parse_gff", "fx_gene", "select gene_id, chrom, gstart, gend, strand from fx_gene where gene_key%7<>0")
def s2(spark, d):
    line = r"case when gene_key%7=0 then '# '||gene_id else concat_ws('\t',chrom,'src','gene',gstart,gend,'.',strand,'.','Name=x;ID='||gene_id||';Note=y') end"
    genes = sql(spark, d, "fx_gene", f"select gene_key line_no, {line} line from fx_gene union all select gene_key line_no, concat_ws('\t',chrom,'src','mRNA',gstart,gend,'.',strand,'.','ID='||gene_id) line from fx_gene")
    return text.parse_gff_genes(genes)


VCF = r"""select o_orderkey line_no, concat_ws('\t', chrom, pos, '.', ref, case when o_orderkey%5=0 then alt||',G' else alt end, '.', '.', '.', 'DP:GT', '7:'||ga, '8:'||gb) line from
    (select o_orderkey, 'Chr'||cast(o_orderkey%50+1 as string) chrom, (o_orderkey*37)%5000+1 pos, substr('ACGT',cast(o_orderkey%4+1 as int),1) ref, substr('CGTA',cast(o_orderkey%4+1 as int),1) alt,
     case o_orderkey%4 when 0 then '0/1' when 1 then '1|1' when 2 then './.' else '1' end ga, case o_orderkey%3 when 0 then '0/0' when 1 then './1' else '2/1' end gb from orders)
    union all select -1 line_no, concat_ws('\t','#CHROM','POS','ID','REF','ALT','QUAL','FILTER','INFO','FORMAT','SA','SB') line union all select -2 line_no, '##fileformat=VCFv4.2' line"""  # fmt: skip


@register("s3_parse_vcf_sites", "", """select o_orderkey rec_ix, 'Chr'||cast(o_orderkey%50+1 as string) chrom, (o_orderkey*37)%5000+1 pos, substr('ACGT',cast(o_orderkey%4+1 as int),1) ref,
    substr('CGTA',cast(o_orderkey%4+1 as int),1)||case when o_orderkey%5=0 then '/G' else '' end alts from orders""")
def s3(spark, d):
    site, _ = text.parse_vcf(sql(spark, d, "", VCF))
    return site.select("rec_ix", "chrom", "pos", "ref", F.array_join("alt", "/").alias("alts"))


@register("s3_parse_vcf_genotypes", "", """select o_orderkey rec_ix, 'SA' sample_id, case o_orderkey%4 when 0 then 0 when 1 then 1 when 2 then -1 else 1 end a1, case o_orderkey%4 when 2 then -1 else 1 end a2 from orders
    union all select o_orderkey rec_ix, 'SB' sample_id, case o_orderkey%3 when 0 then 0 when 1 then -1 else 2 end a1, case o_orderkey%3 when 0 then 0 else 1 end a2 from orders""")
def s3g(spark, d):
    return text.parse_vcf(sql(spark, d, "", VCF))[1]


#: Two files put together: the second half of the records has another header, with the samples the other way round.
HEADS = VCF.replace("from orders)", "from orders where o_orderkey%2=0)", 1) + r""" union all select 1000000000000+o_orderkey line_no, concat_ws('\t', chrom, pos, '.', ref, alt, '.', '.', '.', 'GT', gb, ga) line from
    (select o_orderkey, 'Chr'||cast(o_orderkey%50+1 as string) chrom, (o_orderkey*37)%5000+1 pos, substr('ACGT',cast(o_orderkey%4+1 as int),1) ref, substr('CGTA',cast(o_orderkey%4+1 as int),1) alt,
     case o_orderkey%4 when 0 then '0/1' when 1 then '1|1' when 2 then './.' else '1' end ga, case o_orderkey%3 when 0 then '0/0' when 1 then './1' else '2/1' end gb from orders where o_orderkey%2=1)
    union all select 1000000000000 line_no, concat_ws('\t','#CHROM','POS','ID','REF','ALT','QUAL','FILTER','INFO','FORMAT','SB','SA') line"""  # fmt: skip
BY_HEAD = """(select case when o_orderkey%2=1 then 1000000000000 else 0 end+o_orderkey rec_ix, 'Chr'||cast(o_orderkey%50+1 as string) chrom, (o_orderkey*37)%5000+1 pos, substr('CGTA',cast(o_orderkey%4+1 as int),1) alt, s.sample_id,
    case s.sample_id when 'SA' then case o_orderkey%4 when 0 then 0 when 1 then 1 when 2 then -1 else 1 end else case o_orderkey%3 when 0 then 0 when 1 then -1 else 2 end end a1,
    case s.sample_id when 'SA' then case o_orderkey%4 when 2 then -1 else 1 end else case o_orderkey%3 when 0 then 0 else 1 end end a2 from orders cross join (select 'SA' sample_id union all select 'SB') s)"""  # fmt: skip


@register("s3_parse_vcf_heads", "", f"select rec_ix, sample_id, a1, a2 from {BY_HEAD}")
def s3h(spark, d):
    return text.parse_vcf(sql(spark, d, "", HEADS))[1]


@register("a5_carried_snps", "", f"select sample_id, chrom, pos, max_by(alt, rec_ix) alt from {BY_HEAD} where a1>=0 and a2>=0 and (a1=1 or a2=1) group by sample_id, chrom, pos")
def a5s(spark, d):
    return variants.carried_snps(*text.parse_vcf_carriers(sql(spark, d, "", HEADS)))


@register("a6_carried_stats", "", f"""select sample_id, chrom, count(*) seen, count(*) snp, count(case when a1>=0 and a2>=0 and (a1=1 or a2=1) then 1 end) gt_alt, count(case when a1>=0 and a2>=0 and (a1=1 or a2=1) and pos%3=0 then 1 end) ref_mismatch
    from {BY_HEAD} group by sample_id, chrom""")
def a6s(spark, d):
    site, names = text.parse_vcf_carriers(sql(spark, d, "", HEADS))
    return variants.carried_stats(site.withColumn("ref_ok", F.col("pos") % 3 != 0), names)


GAF = r"""select l_orderkey*10+l_linenumber line_no, concat_ws('\t','TAIR','locus:'||cast(l_orderkey as string), case when l_linenumber%2=0 then lower(gene_id)||'.1' else 'X' end,
    case when l_linenumber=3 then 'NOT|enables' else 'enables' end, case when l_linenumber=7 then 'PO:1' else go_id end, 'r','IEA','','P', case when l_linenumber=1 then '' else 'n'||cast(l_orderkey as string) end,
    case when l_linenumber%2=1 then 'syn|'||gene_id||'|AT2G00001' else '' end,'protein','taxon:3702','20200101','TAIR') line from
    (select *, 'AT'||cast(l_partkey%5+1 as string)||'G'||lpad(cast(l_partkey as string),5,'0') gene_id, 'GO:'||lpad(cast(l_suppkey*10+l_linenumber as string),7,'0') go_id from lineitem)
    union all select -1 line_no, '!gaf-version: 2.2' line"""  # fmt: skip
GAF_ROWS = "(select l_orderkey*10+l_linenumber seq_no, 'AT'||cast(l_partkey%5+1 as string)||'G'||lpad(cast(l_partkey as string),5,'0') gene_id, 'GO:'||lpad(cast(l_suppkey*10+l_linenumber as string),7,'0') go_id, case when l_linenumber=1 then '' else 'n'||cast(l_orderkey as string) end obj_name, l_linenumber from lineitem where l_linenumber<>7)"


@register("s4_parse_gaf", "", f"select gene_id, go_id, obj_name, seq_no from {GAF_ROWS} where l_linenumber<>3")
def s4(spark, d):
    return text.parse_gaf(sql(spark, d, "", GAF), drop_not=True)


@register("a16_build_gene2go", "", f"select distinct gene_id, go_id from {GAF_ROWS}")
def a16(spark, d):
    return build_gene2go(text.parse_gaf(sql(spark, d, "", GAF)))


@register("a17_build_go_names", "", f"select go_id, min_by(obj_name, seq_no) name from {GAF_ROWS} where obj_name<>'' group by go_id")
def a17(spark, d):
    return build_go_names(text.parse_gaf(sql(spark, d, "", GAF)))


EDGES = r"select edge_ix line_no, case edge_ix%4 when 0 then ' '||tf_id||'\t'||region_id when 1 then concat_ws('\t',tf_id,region_id,'x1d') when 2 then concat_ws('\t',tf_id,region_id,'1d') else concat_ws('\t',tf_id,region_id,cast(weight as string),'0.5') end line from fx_region_edge"


@register("s5_parse_weighted_edges", "fx_region_edge", "select tf_id src, region_id dst, case when edge_ix%4=3 then weight else 1.0e0 end weight, edge_ix from fx_region_edge")
def s5(spark, d):
    return text.parse_weighted_edges(sql(spark, d, "fx_region_edge", EDGES))


@register("s6_parse_ppi", "fx_ppi", "select gene1, gene2, cast(combined_score as double) score from fx_ppi where edge_ix%5<>0")
def s6(spark, d):
    line = r"select edge_ix line_no, case when edge_ix%5=0 then gene1||'\t'||gene2 else concat_ws('\t',gene1,gene2,combined_score) end line from fx_ppi union all select -1 line_no, concat_ws('\t','g1','g2','combined_score') line"
    return text.parse_ppi(sql(spark, d, "fx_ppi", line))


@register("s7_parse_labels", "", "select 'S'||cast(o_custkey as string) sample_id, max_by(cast(o_orderkey%1000 as double), o_orderkey) label from orders group by o_custkey")
def s7(spark, d):
    lines = r"select o_orderkey line_no, concat_ws('\t','f',cast(o_orderkey%1000 as string),'S'||cast(o_custkey as string))||'\r' line from orders union all select -1 line_no, concat_ws('\t','fid','label','sample_id')||'\r' line"
    return text.parse_labels(sql(spark, d, "", lines))


@register("s8_parse_gene_list", "fx_ppi", "select gene1 gene_id, case when count(case when edge_ix%3<>0 then 1 end)>0 then greatest(0.0e0, max(case when edge_ix%3<>0 then cast(combined_score-500 as double) end)) end weight from fx_ppi group by gene1")
def s8(spark, d):
    lines = r"select edge_ix line_no, case when edge_ix%3=0 then gene1 else gene1||' '||cast(combined_score-500 as string) end line from fx_ppi union all select -1 line_no, '# genes' line"
    return text.parse_gene_list(sql(spark, d, "fx_ppi", lines))


@register("s9_parse_gene2go", "fx_gene2go", "select gene_id, go_id from fx_gene2go")
def s9(spark, d):
    return text.parse_gene2go(sql(spark, d, "fx_gene2go", r"select 1 line_no, gene_id||'\t'||go_id||' x' line from fx_gene2go union all select 2 line_no, gene_id||'  '||go_id line from fx_gene2go"))


@register("s9_parse_go_names", "", "select 'GO:'||lpad(cast(l_suppkey*10+l_linenumber as string),7,'0') go_id, max_by('n'||cast(l_orderkey as string), l_orderkey*10+l_linenumber) name from lineitem group by l_suppkey, l_linenumber")
def s9n(spark, d):
    return text.parse_go_names(sql(spark, d, "", r"select l_orderkey*10+l_linenumber line_no, 'GO:'||lpad(cast(l_suppkey*10+l_linenumber as string),7,'0')||'\tn'||cast(l_orderkey as string) line from lineitem"))


@register("s10_embedding_store", "", "select vec_id node_id, 'S'||cast(label%3 as string) sample_id, case when label%2=0 then 'gene' else 'region' end node_type, round(list_sum(embedding), 4) total from embeddings")
def s10(spark, d):
    """Written by sample and node type, and read again."""
    rows = sql(spark, d, "", "select vec_id node_id, 'S'||cast(label%3 as string) sample_id, case when label%2=0 then 'gene' else 'region' end node_type, embedding x from embeddings")
    path = f"{shared_dir(spark)}/embeddings-{uuid.uuid4().hex}"
    tables.write_embeddings(rows, path)
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    return tables.read_embeddings(spark, path).select("node_id", "sample_id", "node_type", F.round(total, 4).alias("total"))


@register("j10_overlay_stored", "", """select s.sample_id, 'gene' node_type, e.vec_id node_id, round(list_sum(e.embedding)*case when e.vec_id%4=s.k then 2 else 1 end, 4) total from embeddings e cross join (select 'S0' sample_id, 0 k union all select 'S1', 1 union all select 'S2', 2) s""")
def j10s(spark, d):
    """Reference and changed vectors stored in buckets, and laid over each other."""
    nodes = sql(spark, d, "", "select 'gene' node_type, vec_id node_id, embedding x from embeddings")
    own = sql(spark, d, "", "select 'S'||cast(vec_id%4 as string) sample_id, 'gene' node_type, vec_id node_id, transform(embedding, v -> v*2) x from embeddings")
    stored = []
    for name, df in (("nodes", nodes), ("own", own)):
        table = f"{name}_{uuid.uuid4().hex}"
        tables.store_embeddings(df, table, 8, f"{shared_dir(spark)}/{table}")
        stored.append(spark.table(table))
    samples = spark.createDataFrame([("S0",), ("S1",), ("S2",)], "sample_id string")
    total = F.aggregate(F.col("x").cast("array<double>"), F.lit(0.0), lambda a, v: a + v)
    return graph.overlay_stored(*stored, samples).select("sample_id", "node_type", "node_id", F.round(total, 4).alias("total"))


@register("s11_discover_samples", "", "select 'c'||cast(c_custkey as string) sample_id, 'file:/x/sample_c'||cast(c_custkey as string)||'_mutant_graph.pt' path from customer where c_custkey%3<>0")
def s11(spark, d):
    listing = sql(spark, d, "", "select case when c_custkey%3=0 then 'file:/x/other_'||cast(c_custkey as string)||'.pt' else 'file:/x/sample_c'||cast(c_custkey as string)||'_mutant_graph.pt' end path from customer")
    return tables.discover_samples(listing)


@register("s11_complete_samples", "", "select sample_id from (select 'S'||cast(o_custkey as string) sample_id, case o_orderkey%4 when 0 then 'gene' when 1 then 'region' when 2 then 'window' else 'tf' end t from orders) where t<>'tf' group by sample_id having count(distinct t)=3")
def s11c(spark, d):
    return tables.complete_samples(sql(spark, d, "", "select 'S'||cast(o_custkey as string) sample_id, case o_orderkey%4 when 0 then 'gene' when 1 then 'region' when 2 then 'window' else 'tf' end node_type from orders"))


@register("s12_ranked_text", "", "select c_custkey id, printf('%.6e', c_acctbal) score, printf('%.3e', (c_acctbal+0.001234)/1e7) pvalue from customer")
def s12(spark, d):
    """Written as tab-separated text in order of score, and read again."""
    rows = sql(spark, d, "", "select c_custkey id, c_acctbal score, (c_acctbal+0.001234e0)/1e7 pvalue from customer")
    path = f"{shared_dir(spark)}/ranked-{uuid.uuid4().hex}"
    tables.write_tsv(rows, path, [F.col("score").desc(), "id"])
    return spark.read.option("sep", "\t").option("header", True).schema("id long, score string, pvalue string").csv(path)


@register("s13_parse_pairs", "fx_region_edge", "select region_id, 'w'||region_id window_id from fx_region_edge")
def s13(spark, d):
    return text.parse_pairs(sql(spark, d, "fx_region_edge", r"select edge_ix line_no, ' '||region_id||'\tw'||region_id||'\tx' line from fx_region_edge union all select -1 line_no, 're\twindow' line"))


@register("p10_extract_locus_id", "fx_gene", "select gene_key, case when gene_key%4=3 then null else gene_id end locus_id from fx_gene")
def p10(spark, d):
    rows = sql(spark, d, "fx_gene", "select gene_key, case when gene_key%4=0 then lower(gene_id)||'.2' else 'locus:9' end a, case when gene_key%4=1 then 'Y '||gene_id||'a' else null end b, case when gene_key%4=2 then 'ZAT1G00001|'||gene_id||'|AT1G99999' else '' end c from fx_gene")
    return rows.select("gene_key", extract_locus_id(F.col("a"), F.col("b"), F.col("c")).alias("locus_id"))


@register("p13_safe_sample_id", "", "select event_id, regexp_replace(props, '[^\\p{L}\\p{N}._-]', '_', 'g') safe from events")
def p13(spark, d):
    return sql(spark, d, "", "select event_id, props from events").select("event_id", safe_sample_id(F.col("props")).alias("safe"))
