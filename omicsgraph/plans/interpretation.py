"""Scores to genes and terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chains, enrichment, graph, ranking, scoring
from ..operators.joins import small
from ..sources import tables
from ..sources.shared import materialize


def chosen_samples(samples: DataFrame, only: list[str] | DataFrame | None = None, max_samples: int | None = None) -> DataFrame:
    """The distinct sample_id to use: all, or those of a list; of these the first max_samples by id."""
    rows = samples.select("sample_id").distinct()
    if only is not None:
        wanted = only.select("sample_id").distinct() if isinstance(only, DataFrame) else samples.sparkSession.createDataFrame([(s,) for s in only], rows.schema)
        rows = rows.join(wanted, "sample_id", "left_semi")
    return rows if max_samples is None else rows.orderBy("sample_id").limit(max_samples)


def score_interactions(
    nodes: DataFrame,
    delta: DataFrame,
    samples: DataFrame,
    edges: DataFrame,
    head: scoring.Head,
    top_genes: int = 2000,
    top_edges: int = 10_000,
    mode: str = "mean",
    attention=None,
    strict_tf: bool = True,
    only: list[str] | DataFrame | None = None,
    max_samples: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(importance, top edges): gene scores averaged over samples, and the best edges of each type that touch the top genes.

    nodes: the reference's vectors; delta: what each sample changes. Vectors stay sparse: no row is made for each node
    and sample. only, max_samples: the samples to use.
    """
    used = materialize(chosen_samples(samples, only, max_samples), "samples")
    n = used.count()
    if not n:
        raise ValueError("no samples")
    own = delta.join(small(used), "sample_id", "left_semi").select("sample_id", "node_type", "node_id", "x")
    reference, own = (materialize(df, "sparse_vectors") for df in graph.sync_tf_deltas(nodes.select("node_type", "node_id", "x"), own, strict_tf))
    gene = lambda df, *keys: df.where("node_type = 'gene'").select(*keys, F.col("node_id").alias("gene_id"), F.col("x").alias("z"))
    importance = scoring.sparse_importance(gene(reference), gene(own, "sample_id"), n, head, mode, attention)
    importance = materialize(importance, "importance")
    masked = scoring.mask_edges_by_top_genes(edges, ranking.top_ids(importance, top_genes))
    keys = masked.select("edge_ix", "src_type", "rel", "dst_type", "src_id", "dst_id")
    top, _ = scoring.top_interactions(keys, reference.withColumnRenamed("x", "z"), own.withColumnRenamed("x", "z"), n, top_edges)
    return importance, materialize(top, "top_edges")


def write_results(folder: str, importance: DataFrame, top: DataFrame, hits: DataFrame | None = None, result: DataFrame | None = None) -> None:
    """The ranked lists as text below a folder: gene_importance, top_edges, target_gene_hits, enrichment."""
    tables.write_tsv(importance.select("id", "score", "rank"), f"{folder}/gene_importance", ["rank"])
    tables.write_tsv(top.select("src_type", "rel", "dst_type", "rank", "src_id", "dst_id", "score"), f"{folder}/top_edges", ["src_type", "rel", "dst_type", "rank"])
    if hits is not None:
        tables.write_tsv(hits, f"{folder}/target_gene_hits", [F.col("hit_all").desc(), "gene_id"])
    if result is not None:
        tables.write_tsv(result, f"{folder}/enrichment", ["set_name", "fdr", "pvalue", "go_id"])


def interpret(nodes: DataFrame, edges: DataFrame, importance: DataFrame, tf_region: DataFrame, top_ppi: DataFrame, gene2go: DataFrame, names: DataFrame | None = None, top_regions: int = 2000, top_importance: int = 2000, min_bg: int = 5, min_overlap: int = 3, top_terms: int | None = None, max_genes_listed: int = 50) -> dict[str, DataFrame]:
    """Chains, hits, gene sets and the enrichment of all sets in one job.

    The least overlap of the set added by chip is between 2 and 5; that of the interaction partners 2 at least.
    """
    regions = nodes.where("node_type = 'region'").select(F.col("node_id").alias("region_id"))
    found = materialize(chains.tf_region_gene_chains(tf_region, edges, regions, top_regions), "chains")
    hits = materialize(chains.target_gene_hits(found), "hits")
    promoter = hits.where("hit_promoter > 0").select("gene_id", F.col("hit_promoter").cast("double").alias("weight"))
    every = hits.select("gene_id", F.col("hit_all").cast("double").alias("weight"))
    ops = chains.gene_set_ops(promoter, every)
    important = ranking.top_ids(importance, top_importance).select(F.col("id").alias("gene_id"))
    partners = graph.ppi_endpoints(top_ppi.select(F.col("src_id").alias("gene1"), F.col("dst_id").alias("gene2")))
    plain = lambda df: df.select("gene_id", F.lit(None).cast("double").alias("weight"))
    sets = {
        "promoter": (promoter, min_overlap),
        "all": (every, min_overlap),
        "added_by_chip": (plain(ops["added_by_chip"]), max(2, min(min_overlap, 5))),
        "ppi": (plain(partners), max(2, min_overlap)),
    }
    fg = None
    for name, (df, least) in sets.items():
        rows = df.select(F.lit(name).alias("set_name"), "gene_id", "weight", F.lit(least).alias("min_overlap"))
        fg = rows if fg is None else fg.unionByName(rows)
    result = enrichment.go_enrichment(fg, graph.background_genes(nodes), gene2go, names, min_bg, max_genes=max_genes_listed)
    return {
        "chains": found,
        "hits": hits,
        "counts": ops["counts"],
        "importance_promoter": chains.overlap(important, promoter),
        "importance_all": chains.overlap(important, every),
        "ppi_importance": chains.overlap(partners, important),
        "ppi_promoter": chains.overlap(partners, promoter),
        "ppi_all": chains.overlap(partners, every),
        "ppi_promoter_importance": chains.overlap(partners, promoter, important),
        "ppi_tf_importance": chains.overlap(partners, every, important),
        "enrichment": result if top_terms is None else ranking.top_terms(result, top_terms).drop("rank"),
    }
