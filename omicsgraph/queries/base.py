"""The registry, and the views that the queries share (the same text for Spark and DuckDB)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")


def gene(key: str) -> str:
    return f"'AT'||cast({key}%5+1 as string)||'G'||lpad(cast({key} as string),5,'0')"


#: Numbers of chromosomes, samples and nodes, which grow with the tables.
CHROMS = "(select greatest(50, cast(floor(count(*)/20.0) as bigint)) from documents)"
SAMPLES = "(select greatest(20, cast(floor(count(*)/75.0) as bigint)) from customer)"
NODES = "(select greatest(500, count(*)) from embeddings)"

#: {g} stands for DuckDB's option to replace all matches.
VIEWS = {
    "fx_genome": """select 'Chr'||cast(doc_id+1 as string) chrom,
        translate(upper(regexp_replace(text,'[^A-Za-z]',''{g})),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','ACGTACGTACGTACGTACGTACGTAC') seq from documents""",
    "fx_gene": f"""select {gene("p_partkey")} gene_id, 'Chr'||cast(p_partkey%{CHROMS}+1 as string) chrom, (p_partkey*131)%5000+1 gstart,
        (p_partkey*131)%5000+1+p_size*40 gend, case when p_partkey%2=0 then '+' else '-' end strand, p_partkey gene_key, p_size from part""",
    "fx_region_edge": f"""select case when l_linenumber<=2 then 'motif' when l_linenumber<=4 then 'chip' when l_linenumber=5 then 'promoter500' else 'promoter1000' end rel,
        {gene("l_suppkey")} tf_id, {gene("l_partkey")} gene_id,
        'Chr'||cast(l_suppkey%{CHROMS}+1 as string)||':'||cast((l_partkey%200)*25+1 as string)||'-'||cast((l_partkey%200)*25+100+cast(l_quantity as bigint)%5*50 as string) region_id,
        'Chr'||cast(l_suppkey%{CHROMS}+1 as string) chrom, (l_partkey%200)*25+1 rstart, (l_partkey%200)*25+100+cast(l_quantity as bigint)%5*50 rend,
        l_discount weight, l_orderkey*10+l_linenumber edge_ix from lineitem""",
    "fx_variant": f"""select 'S'||cast(o_custkey%{SAMPLES} as string) sample_id, 'Chr'||cast(o_orderkey%{CHROMS}+1 as string) chrom, (o_orderkey*37)%5000+1 pos,
        case when o_orderpriority='1-URGENT' then 'CA' else substr('ACGT',cast(o_orderkey%4+1 as int),1) end ref, substr('CGTA',cast(o_orderkey%4+1 as int),1) alt,
        case o_orderstatus when 'P' then -1 when 'F' then 0 else 1 end a1, case o_orderstatus when 'P' then -1 else 1 end a2, o_orderkey rec_ix from orders""",
    "fx_ppi": f"""select {gene("l_partkey")} gene1, {gene("(l_suppkey*3)")} gene2, cast(floor(l_extendedprice) as bigint)%1000 combined_score, l_orderkey*10+l_linenumber edge_ix from lineitem""",
    "fx_gene2go": f"""select distinct {gene("l_partkey")} gene_id, 'GO:'||lpad(cast(l_suppkey*10+l_linenumber as string),7,'0') go_id from lineitem""",
    "fx_node": """select s.sample_ix, e.vec_id node_ix, case when label<=3 then 'gene' when label<=6 then 'region' when label<=8 then 'window' else 'tf' end node_type, e.embedding z
        from embeddings e cross join (select 0 sample_ix union all select 1 union all select 2) s""",
    "fx_edge": f"""select distinct l_orderkey*10+l_linenumber edge_ix, l_partkey%{NODES} src_ix, (l_suppkey*5+l_linenumber)%{NODES} dst_ix from lineitem""",
    "fx_pred": """select c_custkey sample_id, c_acctbal y_true, 0.9e0*c_acctbal+c_nationkey y_pred from customer""",
    "fx_snp": """select sample_id, chrom, pos, max_by(alt, rec_ix) alt from fx_variant where length(ref)=1 and a1>=0 and a2>=0 and (a1=1 or a2=1) group by sample_id, chrom, pos""",
    "fx_region": """select region_id, min(chrom) chrom, min(rstart) rstart, min(rend) rend, case max(case rel when 'promoter1000' then 4 when 'promoter500' then 3 when 'chip' then 2 else 1 end)
        when 4 then 'promoter_1000' when 3 then 'promoter_500' when 2 then 'chip_peak' else 'motif_site' end rtype from fx_region_edge group by region_id""",
    "fx_locus": """select 'gene' kind, gene_id locus_id, chrom, gstart "start", gend "end", strand from fx_gene
        union all select 'region' kind, region_id locus_id, chrom, rstart "start", rend "end", cast(null as string) strand from fx_region
        union all select distinct 'window' kind, chrom||':'||cast(ws as string)||'-'||cast(ws+3999 as string) locus_id, chrom, ws "start", ws+3999 "end", cast(null as string) strand
        from (select chrom, cast(floor((floor((rstart+rend)/2.0)-1)/2000.0) as bigint)*2000+1 ws from fx_region)""",
    "fx_fg": """select 'small' set_name, gene_id, cast(p_size as double) weight from fx_gene where p_size<=10
        union all select 'large' set_name, gene_id, cast(p_size as double) weight from fx_gene where p_size>40""",
}
#: Views that a view reads.
USES = {"fx_snp": ["fx_variant"], "fx_region": ["fx_region_edge"], "fx_locus": ["fx_gene", "fx_region_edge", "fx_region"], "fx_fg": ["fx_gene"]}


def with_views(names: str, body: str) -> str:
    """DuckDB SQL: body after the definitions of the views it names and of those that they read."""
    order: list[str] = []
    for n in names.split():
        order += [x for x in [*USES.get(n, []), n] if x not in order]
    head = ",\n".join(f"{n} as ({VIEWS[n].replace('{g}', ", 'g'" if n == 'fx_genome' else '')})" for n in order)
    return (f"with {head}\n" if order else "") + body


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view's rows in Spark."""
    return sql(spark, sf_dir, name, f"select * from {name}")


def sql(spark: SparkSession, sf_dir: str, names: str, body: str) -> DataFrame:
    """Spark SQL over the driver's tables and the named views."""
    text = with_views(names, body).replace(", 'g')", ")").replace('"start"', "start").replace('"end"', "end")
    used = [t for t in TABLES if f" {t}" in text]
    for t in used:
        for sep in (" ", "\n", ")", ","):
            text = text.replace(f"from {t}{sep}", f"from {{{t}}}{sep}")
        if text.endswith(f"from {t}"):
            text = text[: -len(t)] + f"{{{t}}}"
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used if f"{{{t}}}" in text})


def register(name: str, views: str = "", oracle: str | None = None):
    """Registers a query; oracle is SQL over the named views, unless there is none."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if oracle is not None:
            ORACLE_SQL[name] = with_views(views, oracle)
        return f

    return add
