"""Chromosome names, windows and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import canonical_chrom, parse_region_id, window_bounds


def map_chrom_names(df: DataFrame, col: str, names: DataFrame, fallback: str = "own") -> DataFrame:
    """Df with `col` as the target source writes it; names (name, seq_no): its names in order of appearance.

    Of names with the same key the first one counts. Without one, `own` keeps the name, `key` puts the key.
    """
    target = names.select(canonical_chrom(F.col("name")).alias("__key"), "name", "seq_no").groupBy("__key").agg(F.min_by("name", "seq_no").alias("__name"))
    keyed = df.withColumn("__key", canonical_chrom(F.col(col)))
    other = F.col(col) if fallback == "own" else F.col("__key")
    return keyed.join(target, "__key", "left").withColumn(col, F.coalesce("__name", other)).select(*df.columns)


def build_windows(regions: DataFrame, size: int = 4000, stride: int = 2000) -> tuple[DataFrame, DataFrame]:
    """P5: distinct windows (window_id, chrom, wstart, wend) that hold regions, and a (region_id, window_id) per region.

    Bounds come from the regions' chrom, rstart and rend where they are there, else from their ids; no id is parsed twice.
    """
    if not {"chrom", "rstart", "rend"} <= set(regions.columns):
        r = regions.select("region_id", parse_region_id(F.col("region_id")).alias("__r"))
        regions = r.select("region_id", F.col("__r.chrom").alias("chrom"), F.col("__r.start").alias("rstart"), F.col("__r.end").alias("rend"))
    bounds = regions.select("region_id", "chrom", window_bounds(F.col("rstart"), F.col("rend"), size, stride).alias("__w"))
    cut = bounds.select("region_id", "chrom", F.col("__w.start").alias("wstart"), F.col("__w.end").alias("wend"))
    name = F.concat("chrom", F.lit(":"), F.col("wstart").cast("string"), F.lit("-"), F.col("wend").cast("string"))
    windows = cut.select("chrom", "wstart", "wend").distinct().select(name.alias("window_id"), "chrom", "wstart", "wend")
    return windows, cut.select("region_id", name.alias("window_id"))


def extract_locus_seq(loci: DataFrame, tiles: DataFrame, tile_len: int = 65_536) -> DataFrame:
    """Loci (locus_id, chrom, start, end, ...) with seq, both ends included, cut off at the chromosome's ends.

    Loci on unknown chromosomes, or with nothing left, are dropped. Tiles come from tile_genome().
    """
    begin, end = F.greatest(F.col("start"), F.lit(1)), F.col("end")
    span = loci.where(begin <= end).withColumn("__b", begin)
    wanted = span.withColumn("tile_ix", F.explode(F.sequence(F.floor((F.col("__b") - 1) / tile_len), F.floor((end - 1) / tile_len))))
    joined = wanted.join(tiles.select("chrom", "tile_ix", "tile_start", F.col("seq").alias("__tile")), ["chrom", "tile_ix"])
    from_ = F.greatest(F.col("__b"), F.col("tile_start")) - F.col("tile_start") + 1
    to = F.least(end - F.col("tile_start") + 1, F.length("__tile"))
    parts = joined.withColumn("__part", F.substring("__tile", from_.cast("int"), (to - from_ + 1).cast("int"))).where(to >= from_)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tile_ix", "__part"))), lambda p: p["__part"]), "")
    return parts.groupBy(*loci.columns).agg(whole.alias("seq"))
