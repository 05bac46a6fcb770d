"""TF to region to gene, and sets of genes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import small


def region_gene_links(edges: DataFrame, rel: str) -> DataFrame:
    """(region_id, gene_id, edge_ix) of region-rel-gene edges; of the reverse ones only if there are none."""
    forward = edges.where((F.col("src_type") == "region") & (F.col("rel") == rel) & (F.col("dst_type") == "gene"))
    back = edges.where((F.col("src_type") == "gene") & (F.col("rel") == f"rev_{rel}") & (F.col("dst_type") == "region"))
    any_forward = F.broadcast(forward.limit(1).agg(F.count("*").alias("n")))  # one row
    inverted = back.crossJoin(any_forward).where("n = 0")
    return forward.select(F.col("src_id").alias("region_id"), F.col("dst_id").alias("gene_id"), "edge_ix").unionByName(inverted.select(F.col("dst_id").alias("region_id"), F.col("src_id").alias("gene_id"), "edge_ix"))


def tf_region_gene_chains(tf_region: DataFrame, edges: DataFrame, regions: DataFrame, top_regions: int = 2000) -> DataFrame:
    """(tf, region, link_type, target_gene, tf_region_score): of the first ranks (src_id, dst_id, score, rank) of known
    regions, one row for each promoter1000 and chip edge."""
    top = tf_region.orderBy("rank").limit(top_regions).select("rank", F.col("src_id").alias("tf"), F.col("dst_id").alias("region"), F.col("score").alias("tf_region_score"))
    top = small(top.join(regions.select(F.col("region_id").alias("region")), "region", "left_semi"))
    links = [region_gene_links(edges, rel).withColumn("link_type", F.lit(rel)) for rel in ("promoter1000", "chip")]
    both = links[0].unionByName(links[1])
    return both.join(top, both["region_id"] == top["region"]).select("tf", "region", "link_type", F.col("gene_id").alias("target_gene"), "tf_region_score")


def target_gene_hits(chains: DataFrame) -> DataFrame:
    """(gene_id, hit_promoter, hit_all): chain rows per gene."""
    return chains.groupBy(F.col("target_gene").alias("gene_id")).agg(F.count_if(F.col("link_type") == "promoter1000").alias("hit_promoter"), F.count("*").alias("hit_all"))


def gene_set_ops(promoter: DataFrame, all_: DataFrame) -> dict[str, DataFrame]:
    """Intersection, genes added by chip (all but promoter), and the four counts."""
    p, a = promoter.select("gene_id").distinct(), all_.select("gene_id").distinct()
    sets = {"promoter": p, "all": a, "intersection": p.intersect(a), "added_by_chip": a.subtract(p)}
    counts = reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("set_name"), "n") for k, df in sets.items()])
    return {"intersection": sets["intersection"], "added_by_chip": sets["added_by_chip"], "counts": counts}


def overlap(*sets: DataFrame) -> DataFrame:
    """The genes in all sets, found in one pass over (set, gene)."""
    rows = reduce(DataFrame.unionByName, [s.select("gene_id", F.lit(k).alias("k")) for k, s in enumerate(sets)])
    return rows.groupBy("gene_id").agg(F.count_distinct("k").alias("n")).where(F.col("n") == len(sets)).select("gene_id")
