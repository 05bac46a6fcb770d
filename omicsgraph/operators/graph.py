"""The typed graph as node and edge tables.

node: node_type, node_id [, x]; edge: edge_ix, src_type, rel, dst_type, src_id, dst_id, weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import parse_region_id, ppi_normalize, type_priority
from ..functions.vectors import mean_of
from .joins import small
from .ranking import number_rows

#: The relations that get reverse edges, with the names of these and whether weights are kept.
REVERSES = {"motif": ("rev_motif", True), "chip": ("rev_chip", True), "promoter1000": ("rev_promoter1000", True), "contained_in": ("contains", False)}
#: The region type that each kind of edge file gives.
EDGE_REGION_TYPE = {"motif": "motif_site", "chip": "chip_peak", "promoter500": "promoter_500", "promoter1000": "promoter_1000"}


def collect_regions(sources: dict[str, DataFrame]) -> DataFrame:
    """A1: (region_id, chrom, rstart, rend, rtype), one row per region over the edge tables given by kind.

    sources: DataFrames with region_id under motif, chip, promoter500, promoter1000; the type of highest priority wins.
    """
    named = [df.select("region_id", F.lit(EDGE_REGION_TYPE[kind]).alias("rtype")) for kind, df in sources.items()]
    rows = named[0]
    for more in named[1:]:
        rows = rows.unionByName(more)
    types = rows.groupBy("region_id").agg(F.max_by("rtype", type_priority(F.col("rtype"))).alias("rtype"))
    r = parse_region_id(F.col("region_id"))
    return types.select("region_id", r["chrom"].alias("chrom"), r["start"].alias("rstart"), r["end"].alias("rend"), "rtype")


def filter_ppi(edges: DataFrame, genes: DataFrame, min_score: float, mode: str = "none") -> DataFrame:
    """Edges (gene1, gene2, score) between known genes, no loops, raw score at least min_score; then scaled."""
    ids = small(genes.select("gene_id").distinct())
    kept = edges.where((F.col("gene1") != F.col("gene2")) & (F.col("score") >= min_score))
    kept = kept.join(ids.select(F.col("gene_id").alias("gene1")), "gene1", "left_semi").join(ids.select(F.col("gene_id").alias("gene2")), "gene2", "left_semi")
    return kept.withColumn("score", ppi_normalize(F.col("score"), mode)).select(*edges.columns)


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are nodes of their types; repeated edges stay."""
    ids = small(nodes.select("node_type", "node_id").distinct())
    for end in ("src", "dst"):
        edges = edges.join(ids.toDF(f"{end}_type", f"{end}_id"), [f"{end}_type", f"{end}_id"], "left_semi")
    return edges


def directed_ppi(edges: DataFrame, both_ways: bool = True) -> DataFrame:
    """Each edge (gene1, gene2, score, ...) in both directions."""
    if not both_ways:
        return edges
    ends = F.array(F.struct(F.col("gene1").alias("a"), F.col("gene2").alias("b")), F.struct(F.col("gene2").alias("a"), F.col("gene1").alias("b")))
    rest = [c for c in edges.columns if c not in ("gene1", "gene2")]
    return edges.withColumn("__e", F.explode(ends)).select(F.col("__e.a").alias("gene1"), F.col("__e.b").alias("gene2"), *rest)


def reverse_edges(edges: DataFrame) -> DataFrame:
    """A10: edges with the reverse ones of motif, chip, promoter1000 (weights kept) and contained_in (no weight)."""
    name, weight = F.lit(None).cast("string"), F.lit(None).cast("double")
    for rel, (rev, kept) in REVERSES.items():
        name = F.when(F.col("rel") == rel, rev).otherwise(name)
        if kept:
            weight = F.when(F.col("rel") == rel, F.col("weight")).otherwise(weight)
    back = edges.select("edge_ix", F.col("dst_type").alias("src_type"), name.alias("rel"), F.col("src_type").alias("dst_type"), F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"), weight.alias("weight")).where("rel is not null")
    return edges.select(*back.columns).unionByName(back)


def tf_nodes(tf_edges: DataFrame, genes: DataFrame) -> DataFrame:
    """(node_id, x) of each TF (column src); the gene's vector, or the mean of all genes' vectors."""
    ids = tf_edges.select(F.trim("src").alias("node_id")).distinct()
    mean = genes.agg(mean_of(F.col("x")).alias("__mean"))
    found = ids.join(genes.select("node_id", F.col("x").cast("array<double>").alias("__x")), "node_id", "left")
    return found.crossJoin(F.broadcast(mean)).select("node_id", F.coalesce("__x", "__mean").alias("x"))


def graph_summary(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes per type, and edges per (src_type, rel, dst_type)."""
    return nodes.groupBy("node_type").agg(F.count("*").alias("n")), edges.groupBy("src_type", "rel", "dst_type").agg(F.count("*").alias("n"))


def region_type_code(regions: DataFrame) -> DataFrame:
    """Regions with type_code, the place of rtype among the distinct types in order."""
    codes = regions.select("rtype").distinct().withColumn("type_code", (F.row_number().over(Window.orderBy("rtype")) - 1).cast("int"))
    return regions.join(small(codes), "rtype")


def assign_node_index(nodes: DataFrame, order: str = "node_id") -> DataFrame:
    """Nodes with node_ix from 0 within their type, in order of `order`."""
    return number_rows(nodes, ["node_type"], [F.col(order)], "__n").withColumn("node_ix", F.col("__n") - 1).drop("__n")


def decode_index(df: DataFrame, col: str, nodes: DataFrame, label: str) -> DataFrame:
    """Df with indices in `col` (bigint) as ids; others as label_IDX_OUT_OF_RANGE:i. nodes: node_ix, node_id."""
    known = small(nodes.select(F.col("node_ix").alias(col), F.col("node_id").alias("__id")))
    return df.join(known, col, "left").withColumn(col, F.coalesce("__id", F.concat(F.lit(f"{label}_IDX_OUT_OF_RANGE:"), F.col(col).cast("string")))).drop("__id")


def background_genes(nodes: DataFrame) -> DataFrame:
    """All gene ids of the graph."""
    return nodes.where("node_type = 'gene'").select(F.col("node_id").alias("gene_id")).distinct()


def ppi_endpoints(edges: DataFrame) -> DataFrame:
    """The distinct genes at either end."""
    return edges.select(F.explode(F.array("gene1", "gene2")).alias("gene_id")).distinct()


def undirected_edges(edges: DataFrame) -> DataFrame:
    """U4: distinct pairs with the smaller end first; loops stay."""
    return edges.select(F.least("gene1", "gene2").alias("gene1"), F.greatest("gene1", "gene2").alias("gene2")).distinct()


def overlay_deltas(nodes: DataFrame, delta: DataFrame, samples: DataFrame) -> DataFrame:
    """(sample_id, node_type, node_id, x): a sample's vector where it has one, else the reference's.

    Rows are made when asked for; restrict nodes first. Vectors of unknown nodes are ignored.
    """
    every = nodes.crossJoin(small(samples.select("sample_id").distinct()))
    own = delta.select("sample_id", "node_type", "node_id", F.col("x").alias("__x"))
    return every.join(own, ["sample_id", "node_type", "node_id"], "left").withColumn("x", F.coalesce("__x", "x")).drop("__x")


def overlay_stored(nodes: DataFrame, delta: DataFrame, samples: DataFrame) -> DataFrame:
    """J10 for tables of store_embeddings(): as overlay_deltas(), joined on node_type and node_id alone.

    With equal buckets neither nodes nor delta is shuffled. A node's rows of delta meet its row of nodes; the samples without
    one, which are counted for each node beforehand in ids only, get the reference's vector.
    """
    used = small(samples.select("sample_id").distinct())
    own = delta.join(used, "sample_id", "left_semi").select("node_type", "node_id", "sample_id", "x")
    changed = nodes.select("node_type", "node_id").join(own, ["node_type", "node_id"]).select("sample_id", "node_type", "node_id", "x")
    who = own.groupBy("node_type", "node_id").agg(F.collect_set("sample_id").alias("__who"))
    rest = nodes.join(who, ["node_type", "node_id"], "left").crossJoin(used)
    rest = rest.where(F.col("__who").isNull() | ~F.array_contains("__who", F.col("sample_id"))).select("sample_id", "node_type", "node_id", "x")
    return changed.unionByName(rest)


def sync_tf(nodes: DataFrame, strict: bool = True) -> DataFrame:
    """TF vectors of each sample replaced by the sample's vectors of the same genes.

    A TF without a gene is an error, or keeps its vector if not strict.
    """
    genes = nodes.where("node_type = 'gene'").select("sample_id", "node_id", F.col("x").alias("__x"))
    tf = nodes.where("node_type = 'tf'").join(genes, ["sample_id", "node_id"], "left")
    missing: Column = F.raise_error(F.concat(F.lit("TF without gene: "), F.col("node_id"))).cast(nodes.schema["x"].dataType) if strict else F.col("x")
    tf = tf.withColumn("x", F.when(F.col("__x").isNotNull(), F.col("__x")).otherwise(missing)).select(*nodes.columns)
    return nodes.where("node_type <> 'tf'").unionByName(tf)


def sync_tf_deltas(nodes: DataFrame, delta: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """J11 on sparse vectors: the reference's nodes with TF vectors of their genes, and delta with a TF row for each changed gene.

    Their overlay is that of sync_tf(overlay_deltas(nodes, delta, samples)), without a row for each node and sample.
    """
    gene = nodes.where("node_type = 'gene'").select("node_id", F.col("x").alias("__x"))
    tf = nodes.where("node_type = 'tf'").join(gene, "node_id", "left")
    missing: Column = F.raise_error(F.concat(F.lit("TF without gene: "), F.col("node_id"))).cast(nodes.schema["x"].dataType) if strict else F.col("x")
    tf = tf.withColumn("x", F.when(F.col("__x").isNotNull(), F.col("__x")).otherwise(missing)).select(*nodes.columns)
    known = delta.join(nodes.select("node_type", "node_id"), ["node_type", "node_id"], "left_semi").select(*delta.columns)
    has_gene = nodes.where("node_type = 'tf'").select("node_id").distinct().join(gene.select("node_id"), "node_id", "left_semi")
    follows = known.where("node_type = 'gene'").join(small(has_gene), "node_id", "left_semi").withColumn("node_type", F.lit("tf")).select(*delta.columns)
    alone = known.where("node_type <> 'tf'") if strict else known.join(small(has_gene.withColumn("node_type", F.lit("tf"))), ["node_type", "node_id"], "left_anti").select(*delta.columns)
    return nodes.where("node_type <> 'tf'").unionByName(tf), alone.unionByName(follows)
