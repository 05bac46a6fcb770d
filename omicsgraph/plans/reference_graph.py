"""Files to graph: regions, windows, sequences with vectors, and typed nodes and edges."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import fixed_len_for_type, reverse_complement
from ..operators import genome as G
from ..operators import graph
from ..operators.embed import embed_sequences
from ..operators.variants import build_loci
from ..sources import text
from ..sources.shared import materialize

#: Sequence lengths by region type.
LENGTHS = {"promoter_1000": 1000, "promoter_500": 500, "chip_peak": 600, "motif_site": 600, "re": 600}


@dataclass(frozen=True)
class Sizes:
    window: int = 4000
    stride: int = 2000
    tile: int = 65_536
    gene_short: int = 6000
    gene_window: int = 6000
    gene_stride: int = 3000
    lengths: dict[str, int] = field(default_factory=lambda: dict(LENGTHS))
    window_pooling: str = "mean"  # of a long gene's windows: mean, max, first or last
    strands: str | None = "sum"  # both strands added, or their mean; None: forwards only
    max_length: int | None = None  # letters of a piece that the embedder takes
    batch_size: int = 64


def _edge(df: DataFrame, src_type: str, rel: str, dst_type: str, src: str, dst: str, weight) -> DataFrame:
    return df.select("edge_ix", F.lit(src_type).alias("src_type"), F.lit(rel).alias("rel"), F.lit(dst_type).alias("dst_type"), F.col(src).alias("src_id"), F.col(dst).alias("dst_id"), weight.alias("weight"))


def reference_loci(lines: dict[str, DataFrame], genome: DataFrame, sizes: Sizes | None = None, gene_flank: int = 0) -> tuple[DataFrame, DataFrame]:
    """(loci, region_window) of edge files and an annotation given as lines.

    lines: gff, and any of motif (TF, region), chip, promoter500, promoter1000 (region, gene).
    """
    sizes = sizes or Sizes()
    edges = {k: text.parse_weighted_edges(v) for k, v in lines.items() if k in graph.EDGE_REGION_TYPE}
    regions = materialize(graph.collect_regions({k: v.select(F.col("dst" if k == "motif" else "src").alias("region_id")) for k, v in edges.items()}), "regions")
    windows, pairs = G.build_windows(regions, sizes.window, sizes.stride)
    names = genome.select(F.col("chrom").alias("name"), F.col("chrom").alias("seq_no"))
    genes = G.map_chrom_names(text.parse_gff_genes(lines["gff"]), "chrom", names)
    return materialize(build_loci(genes, regions, windows, flank=gene_flank), "loci"), pairs


def embed_kinds(seqs: DataFrame, embedder, dim: int, keys: list[str], sizes: Sizes) -> DataFrame:
    """(keys, x) of sequences (keys with kind, seq, fixed_len): genes in windows that are pooled, others at a fixed length."""
    how = {"strands": sizes.strands, "max_length": sizes.max_length, "batch_size": sizes.batch_size}
    fixed = embed_sequences(seqs.where("kind <> 'gene'"), embedder, dim, keys, "fixed", **how)
    genes = embed_sequences(seqs.where("kind = 'gene'"), embedder, dim, keys, "adaptive", sizes.gene_short, sizes.gene_window, sizes.gene_stride, sizes.window_pooling, **how)
    return fixed.unionByName(genes)


def embed_loci(loci: DataFrame, tiles: DataFrame, embedder, dim: int, sizes: Sizes | None = None) -> DataFrame:
    """(node_type, node_id, x) of all loci: regions and windows at a fixed length, genes in windows that are pooled."""
    sizes = sizes or Sizes()
    seqs = G.extract_locus_seq(loci, tiles, sizes.tile).select("kind", "locus_id", "rtype", F.when((F.col("kind") == "gene") & (F.col("strand") == "-"), reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"))
    length = F.when(F.col("kind") == "window", sizes.window).otherwise(fixed_len_for_type(F.col("rtype"), sizes.lengths))
    x = embed_kinds(seqs.withColumn("fixed_len", length), embedder, dim, ["kind", "locus_id"], sizes)
    return materialize(x.select(F.col("kind").alias("node_type"), F.col("locus_id").alias("node_id"), "x"), "vectors")


def build_graph(lines: dict[str, DataFrame], vectors: DataFrame, region_window: DataFrame, min_ppi: float = 0.0, ppi_mode: str = "none", reverse: bool = True, ppi_already_directed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the typed graph; vectors as from embed_loci, lines as for reference_loci with ppi."""
    weight, none = F.col("weight"), F.lit(None).cast("double")
    edges = []
    genes = vectors.where("node_type = 'gene'")
    if "ppi" in lines:
        known = genes.select(F.col("node_id").alias("gene_id"))
        ppi = materialize(graph.filter_ppi(text.parse_ppi(lines["ppi"]), known, min_ppi, ppi_mode).withColumn("edge_ix", F.struct(F.lit("ppi").alias("file"), F.lit(0).cast("bigint").alias("block"), F.monotonically_increasing_id().alias("row"))), "ppi")
        edges.append(_edge(graph.directed_ppi(ppi, not ppi_already_directed), "gene", "ppi", "gene", "gene1", "gene2", F.col("score")))
    nodes = vectors
    if "motif" in lines:
        motif = text.parse_weighted_edges(lines["motif"])
        edges.append(_edge(motif, "tf", "motif", "region", "src", "dst", weight))
        nodes = nodes.unionByName(graph.tf_nodes(motif, genes).select(F.lit("tf").alias("node_type"), "node_id", "x"))
    for rel in ("chip", "promoter1000"):
        if rel in lines:
            edges.append(_edge(text.parse_weighted_edges(lines[rel]), "region", rel, "gene", "src", "dst", weight))
    inside = region_window.withColumn("edge_ix", F.struct(F.lit("windows").alias("file"), F.lit(0).cast("bigint").alias("block"), F.monotonically_increasing_id().alias("row")))
    edges.append(_edge(inside, "region", "contained_in", "window", "region_id", "window_id", none))
    every = edges[0]
    for more in edges[1:]:
        every = every.unionByName(more)
    nodes = materialize(nodes, "nodes")
    valid = materialize(graph.valid_edges(materialize(every, "edges"), nodes), "edges")
    return nodes, graph.reverse_edges(valid) if reverse else valid
