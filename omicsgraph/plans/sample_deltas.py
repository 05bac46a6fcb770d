"""Variants to vectors: what the SNPs of each sample change, laid over the reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import fixed_len_for_type
from ..operators import genome as G
from ..operators import graph, variants
from ..operators.joins import small
from ..sources import text
from ..sources.shared import materialize
from .reference_graph import Sizes, embed_kinds


def sites_of(vcf_lines: DataFrame, genome: DataFrame, tiles: DataFrame, loci: DataFrame, sizes: Sizes | None = None, samples: list[str] | DataFrame | None = None, gap: int = 0) -> tuple[DataFrame, DataFrame]:
    """The variant records inside the merged loci, with their carriers and ref_ok, and the samples' names by header.

    The lines, of one file or several, are parsed once; names are those of all samples, of a list, or of a table.
    """
    sizes = sizes or Sizes()
    site, names = text.parse_vcf_carriers(vcf_lines)
    if samples is not None:
        wanted = samples.select("sample_id").distinct() if isinstance(samples, DataFrame) else genome.sparkSession.createDataFrame([(s,) for s in samples], "sample_id string")
        names = names.join(small(wanted), "sample_id", "left_semi")
    chroms = genome.select(F.col("chrom").alias("name"), F.col("chrom").alias("seq_no"))
    site = variants.snps_in_intervals(G.map_chrom_names(site, "chrom", chroms, "key"), variants.merge_intervals(loci, gap))
    return materialize(variants.check_ref_allele(site, tiles, sizes.tile), "sites"), materialize(names.select("head", "k", "sample_id"), "names")


def snps_of(site: DataFrame, names: DataFrame, strict_ref: bool = True) -> DataFrame:
    """(sample_id, chrom, pos, alt) of the SNPs carried; in strict mode only where the genome has the reference base."""
    return materialize(variants.carried_snps(site.where("ref_ok") if strict_ref else site, names), "snps")


def sample_snp_table(vcf_lines: DataFrame, genome: DataFrame, tiles: DataFrame, loci: DataFrame, sizes: Sizes | None = None, samples: list[str] | DataFrame | None = None, strict_ref: bool = True, gap: int = 0) -> DataFrame:
    """(sample_id, chrom, pos, alt) of the SNPs inside loci; in strict mode only where the genome has the reference base."""
    return snps_of(*sites_of(vcf_lines, genome, tiles, loci, sizes, samples, gap), strict_ref)


def sample_deltas(snps: DataFrame, loci: DataFrame, tiles: DataFrame, embedder, dim: int, sizes: Sizes | None = None) -> DataFrame:
    """(sample_id, node_type, node_id, x) of the loci that a sample's SNPs hit.

    Only loci that are hit are cut; equal haplotypes of a locus are spliced and embedded once, whatever the number of
    samples that have them.
    """
    sizes = sizes or Sizes()
    keys = ["kind", "locus_id", "h1", "h2"]
    sets, seqs = variants.mutated_loci(loci, tiles, snps, sizes.tile)
    typed = seqs.join(loci.select("kind", "locus_id", "rtype"), ["kind", "locus_id"])
    length = F.when(F.col("kind") == "window", sizes.window).otherwise(fixed_len_for_type(F.col("rtype"), sizes.lengths))
    x = embed_kinds(typed.withColumn("fixed_len", length), embedder, dim, keys, sizes)
    return materialize(sets.join(x, keys).select("sample_id", F.col("kind").alias("node_type"), F.col("locus_id").alias("node_id"), "x"), "delta")


def pending_deltas(
    targets: DataFrame,
    done: DataFrame,
    vcf_lines: DataFrame,
    genome: DataFrame,
    tiles: DataFrame,
    loci: DataFrame,
    embedder,
    dim: int,
    sizes: Sizes | None = None,
    strict_ref: bool = True,
    gap: int = 0,
    max_samples: int | None = None,
    kept: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The job for the target samples that aren't done, so that a run goes on where the last one ended.

    samples, snps and delta; extraction: the records inside the loci, SNPs, carried and mismatched, by sample and chromosome;
    changed: how many loci of each kind a sample has changed, 0 for samples without any. max_samples: only the first ones
    by id. kept: SNPs (sample_id, chrom, pos, alt) of an earlier run over the same loci; the variant lines are read only for
    samples that it doesn't have, and extraction covers only these. A sample without SNPs is read again.
    """
    sizes = sizes or Sizes()
    todo = variants.pending_samples(targets, done).select("sample_id").distinct()
    todo = materialize(todo if max_samples is None else todo.orderBy("sample_id").limit(max_samples), "todo")
    old = None if kept is None else materialize(kept.select("sample_id", "chrom", "pos", "alt").join(small(todo), "sample_id", "left_semi"), "kept_snps")
    new = todo if old is None else materialize(variants.pending_samples(todo, old.select("sample_id").distinct()), "unread")
    site, names = sites_of(vcf_lines, genome, tiles, loci, sizes, new, gap)
    snps = snps_of(site, names, strict_ref)
    snps = snps if old is None else snps.unionByName(old)
    delta = sample_deltas(snps, loci, tiles, embedder, dim, sizes)
    changed = todo.join(variants.delta_stats(delta.withColumnRenamed("node_type", "kind")), "sample_id", "left").na.fill(0)
    return {"samples": todo, "snps": snps, "delta": delta, "extraction": variants.carried_stats(site, names), "changed": changed}


def sample_features(nodes: DataFrame, delta: DataFrame, samples: DataFrame, strict_tf: bool = True) -> DataFrame:
    """(sample_id, node_type, node_id, x): the reference with a sample's vectors over it, TFs following their genes."""
    return graph.sync_tf(graph.overlay_deltas(nodes, delta, samples), strict_tf)
