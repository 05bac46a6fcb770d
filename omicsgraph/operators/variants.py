"""Variants against loci: interval joins on bins, SNPs per sample, and mutated sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import carries_alt, gene_flank, is_snp, reverse_complement
from ..sources.shared import materialize
from .genome import extract_locus_seq
from .joins import small

#: The smallest bin, how many times larger those of the next level are, and levels below the whole chromosome.
BIN, FACTOR, LEVELS = 4096, 8, 5


def build_loci(genes: DataFrame, regions: DataFrame, windows: DataFrame, gene_ids: DataFrame | None = None, flank: int = 0, by: tuple[str, ...] = ("gene_id",)) -> DataFrame:
    """(kind, locus_id, chrom, start, end, strand, rtype) of genes, regions and windows.

    Genes (gene_id, chrom, gstart, gend, strand) count only if gene_ids (those with embeddings) has them; `by` names the
    columns that tell them, with a key of their own where several genes have the same id.
    """
    if gene_ids is not None:
        genes = genes.join(gene_ids.select(*by).distinct(), list(by), "left_semi")
    g = gene_flank(F.col("gstart"), F.col("gend"), flank)
    gene = genes.select(F.lit("gene").alias("kind"), F.col("gene_id").alias("locus_id"), "chrom", g["start"].cast("bigint").alias("start"), g["end"].cast("bigint").alias("end"), "strand")
    region = regions.select(F.lit("region").alias("kind"), F.col("region_id").alias("locus_id"), "chrom", F.col("rstart").alias("start"), F.col("rend").alias("end"), "rtype")
    window = windows.select(F.lit("window").alias("kind"), F.col("window_id").alias("locus_id"), "chrom", F.col("wstart").alias("start"), F.col("wend").alias("end"))
    return gene.unionByName(region, allowMissingColumns=True).unionByName(window, allowMissingColumns=True)


def _home(start: Column, end: Column, bin_size: int) -> Column:
    """struct(level, bin) of the smallest bin of the scheme that holds a locus; the last level is the chromosome."""
    out = F.struct(F.lit(LEVELS).alias("level"), F.lit(0).cast("long").alias("bin"))
    for level in reversed(range(LEVELS)):
        size = bin_size * FACTOR**level
        a, b = F.floor(start / size), F.floor(end / size)
        out = F.when(a == b, F.struct(F.lit(level).alias("level"), a.alias("bin"))).otherwise(out)
    return out


def _probes(pos: Column, bin_size: int) -> Column:
    """The bins of the scheme that hold a position, one of each level."""
    bins = [F.struct(F.lit(k).alias("level"), F.floor(pos / (bin_size * FACTOR**k)).alias("bin")) for k in range(LEVELS)]
    return F.array(*bins, F.struct(F.lit(LEVELS).alias("level"), F.lit(0).cast("long").alias("bin")))


def sites_in_loci(sites: DataFrame, loci: DataFrame, bin_size: int = BIN) -> DataFrame:
    """Pairs of a site (chrom, pos, ...) and a locus (chrom, start, end, ...) that holds it.

    Bins are hierarchical: a locus lies in one, however wide it is; a site looks into one of each level. Both meet in an
    equality join on (chrom, level, bin), every pair once.
    """
    homes = loci.where("start <= end").withColumn("__bin", _home(F.col("start"), F.col("end"), bin_size))
    probes = sites.withColumn("__bin", F.explode(_probes(F.col("pos"), bin_size)))
    return probes.join(homes, ["chrom", "__bin"]).where("pos between start and end").drop("__bin")


def loci_hit_by_snps(loci: DataFrame, sample_snp: DataFrame, bin_size: int = BIN) -> DataFrame:
    """Distinct (sample_id, kind, locus_id) of the loci with at least one SNP of the sample.

    Each site meets the loci once, whatever the number of samples that have it.
    """
    sites = sample_snp.select("chrom", "pos").distinct()
    hits = sites_in_loci(sites, loci.select("kind", "locus_id", "chrom", "start", "end"), bin_size)
    return sample_snp.select("sample_id", "chrom", "pos").join(hits, ["chrom", "pos"]).select("sample_id", "kind", "locus_id").distinct()


def merge_intervals(loci: DataFrame, gap: int = 0, stretch: int = 1 << 20) -> DataFrame:
    """(chrom, start, end) of runs of loci in which each starts at most `gap` after all before it have ended.

    Runs are found within stretches of a chromosome. What goes on from one stretch to the next are two numbers: the
    furthest end so far and how many runs have begun; a window over a chromosome has one row per stretch.
    """
    upto = lambda w, last: w.rowsBetween(Window.unboundedPreceding, last)
    along = upto(Window.partitionBy("chrom").orderBy("__stretch"), -1)
    within = Window.partitionBy("chrom", "__stretch").orderBy("start", "end")
    rows = materialize(loci.select("chrom", "start", "end").distinct().withColumn("__stretch", F.floor(F.col("start") / stretch)), "intervals")
    furthest = rows.groupBy("chrom", "__stretch").agg(F.max("end").alias("__end"))
    rows = _with_stretch(rows, furthest.select("chrom", "__stretch", F.max("__end").over(along).alias("__carried")))
    before = F.greatest("__carried", F.max("end").over(upto(within, -1)))
    new = F.coalesce((F.col("start") > before + gap).cast("int"), F.lit(1))
    local = rows.withColumn("__new", new).withColumn("__run", F.sum("__new").over(upto(within, 0)))
    parts = materialize(local.groupBy("chrom", "__stretch", "__run").agg(F.min("start").alias("start"), F.max("end").alias("end")), "runs")
    begun = parts.groupBy("chrom", "__stretch").agg(F.max("__run").alias("__n"))
    parts = _with_stretch(parts, begun.select("chrom", "__stretch", F.coalesce(F.sum("__n").over(along), F.lit(0)).alias("__begun")))
    runs = parts.groupBy("chrom", (F.col("__begun") + F.col("__run")).alias("__run"))
    return runs.agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__run")


def _with_stretch(rows: DataFrame, stretches: DataFrame) -> DataFrame:
    """rows with the columns of their stretch of the chromosome; nulls are equal."""
    s = stretches.withColumnsRenamed({"chrom": "__c", "__stretch": "__s"})
    return rows.join(s, rows["chrom"].eqNullSafe(s["__c"]) & rows["__stretch"].eqNullSafe(s["__s"])).drop("__c", "__s")


def snps_in_intervals(snps: DataFrame, merged: DataFrame, bin_size: int = BIN) -> DataFrame:
    """The SNPs inside any of the intervals. Distinct places meet the intervals, then the SNPs those that are inside."""
    inside = sites_in_loci(snps.select("chrom", "pos").distinct(), merged.select("chrom", "start", "end"), bin_size)
    return snps.join(inside.select("chrom", "pos").distinct(), ["chrom", "pos"], "left_semi").select(*snps.columns)


def check_ref_allele(sites: DataFrame, tiles: DataFrame, tile_len: int = 65_536) -> DataFrame:
    """Sites with ref_ok: whether the genome has the reference base there; false outside the chromosome."""
    at = F.floor((F.col("pos") - 1) / tile_len)
    joined = sites.withColumn("tile_ix", at).join(tiles.select("chrom", "tile_ix", "tile_start", F.col("seq").alias("__tile")), ["chrom", "tile_ix"], "left")
    inside = F.col("pos") - F.col("tile_start") + 1
    base = F.when((F.col("pos") >= 1) & (inside <= F.length("__tile")), F.substring("__tile", inside.cast("int"), F.lit(1)))
    return joined.withColumn("ref_ok", F.coalesce(F.upper(base) == F.upper("ref"), F.lit(False))).select(*sites.columns, "ref_ok")


def _alt(biallelic_only: bool) -> tuple[Column, Column]:
    return is_snp(F.col("ref"), F.col("alt"), biallelic_only), F.upper(F.get("alt", F.lit(0)))


def sample_snps(site: DataFrame, genotype: DataFrame, biallelic_only: bool = False) -> DataFrame:
    """A5: (sample_id, chrom, pos, alt): the SNPs that a sample carries; at one position the last record counts."""
    ok, alt = _alt(biallelic_only)
    snps = site.where(ok).select("rec_ix", "chrom", "pos", alt.alias("alt"))
    carriers = genotype.where(carries_alt(F.col("a1"), F.col("a2"))).select("rec_ix", "sample_id")
    return _last_record(snps.join(carriers, "rec_ix"))


def carried_snps(site: DataFrame, names: DataFrame, biallelic_only: bool = False) -> DataFrame:
    """A5 from sparse sites (see parse_vcf_carriers): carriers become rows once the sites are filtered, without a join of
    genotypes; names (head, k, sample_id) may hold only the samples that are wanted."""
    ok, alt = _alt(biallelic_only)
    rows = site.where(ok).select("rec_ix", "chrom", "pos", alt.alias("alt"), "head", F.explode("carriers").alias("k"))
    return _last_record(rows.join(small(names), ["head", "k"]))


def _last_record(rows: DataFrame) -> DataFrame:
    return rows.groupBy("sample_id", "chrom", "pos").agg(F.max_by("alt", "rec_ix").alias("alt"))


def carried_stats(site: DataFrame, names: DataFrame) -> DataFrame:
    """A6 from sparse sites with ref_ok: per sample and chromosome what snp_extraction_stats() gives.

    Records and SNP records are counted by header and chromosome, as they are the same for all samples of a header; only
    carriers are counted by sample.
    """
    ok, _ = _alt(False)
    every = site.groupBy("head", "chrom").agg(F.count("*").alias("seen"), F.count_if(ok).alias("snp"))
    own = site.where(ok).select("head", "chrom", "ref_ok", F.explode("carriers").alias("k")).groupBy("head", "chrom", "k").agg(F.count("*").alias("gt_alt"), F.count_if(~F.col("ref_ok")).alias("ref_mismatch"))
    rows = every.join(small(names), "head").join(own, ["head", "chrom", "k"], "left").na.fill(0, ["gt_alt", "ref_mismatch"])
    return rows.groupBy("sample_id", "chrom").agg(*[F.sum(c).alias(c) for c in ("seen", "snp", "gt_alt", "ref_mismatch")])


def snp_extraction_stats(site: DataFrame, genotype: DataFrame, tiles: DataFrame | None = None, tile_len: int = 65_536) -> DataFrame:
    """Per sample and chromosome: records, SNP records, those carried, and of these the reference mismatches."""
    ok, _ = _alt(False)
    checked = check_ref_allele(site, tiles, tile_len) if tiles is not None else site.withColumn("ref_ok", F.lit(True))
    rows = checked.withColumn("__snp", ok).select("rec_ix", "chrom", "__snp", "ref_ok").join(genotype, "rec_ix")
    carried = F.col("__snp") & carries_alt(F.col("a1"), F.col("a2"))
    return rows.groupBy("sample_id", "chrom").agg(
        F.count("*").alias("seen"),
        F.count_if("__snp").alias("snp"),
        F.count_if(carried).alias("gt_alt"),
        F.count_if(carried & ~F.col("ref_ok")).alias("ref_mismatch"),
    )


def pending_samples(targets: DataFrame, done: DataFrame) -> DataFrame:
    """The target samples that aren't done."""
    return targets.join(done.select("sample_id"), "sample_id", "left_anti")


def delta_stats(delta: DataFrame, kinds: tuple[str, ...] = ("gene", "region", "window")) -> DataFrame:
    """How many loci of each kind a sample has changed."""
    counts = delta.groupBy("sample_id").pivot("kind", list(kinds)).count()
    return counts.select("sample_id", *[F.coalesce(k, F.lit(0)).cast("bigint").alias(f"n_{k}") for k in kinds])


def _hash(snps: Column) -> list[Column]:
    """128 bits of a set of SNPs."""
    return [F.xxhash64(snps).alias("h1"), F.xxhash64(F.lit(1), snps).alias("h2")]


def haplotypes(loci: DataFrame, sample_snp: DataFrame, bin_size: int = BIN) -> tuple[DataFrame, DataFrame]:
    """Which samples have which haplotype of a locus, (sample_id, kind, locus_id, h1, h2), and the distinct ones,
    (kind, locus_id, h1, h2, snps): SNPs by offset from the locus's start, which is 1 at least.

    Only coordinates are read. A haplotype's key is a hash of 128 bits.
    """
    hits = sites_in_loci(sample_snp.select("chrom", "pos", "alt", "sample_id"), loci.select("kind", "locus_id", "chrom", "start", "end"), bin_size)
    offset = (F.col("pos") - F.greatest(F.col("start"), F.lit(1))).cast("int")
    sets = hits.groupBy("sample_id", "kind", "locus_id").agg(F.array_sort(F.collect_list(F.struct(offset.alias("at"), "alt"))).alias("snps"))
    sets = materialize(sets.select("sample_id", "kind", "locus_id", *_hash(F.col("snps")), "snps"), "haplotypes")
    distinct = sets.groupBy("kind", "locus_id", "h1", "h2").agg(F.first("snps").alias("snps"))
    return sets.drop("snps"), distinct


def splice(seq: Column, snps: Column) -> Column:
    """A sequence in upper case with bases replaced at offsets (from 0, in order, all inside): the stretches between the
    SNPs and the new bases, put together."""
    upper = F.upper(seq)
    begin = lambda k: F.when(k > 0, F.get(snps, k - 1)["at"] + 1).otherwise(0)
    parts = F.transform(snps, lambda x, k: F.concat(F.substring(upper, begin(k) + 1, x["at"] - begin(k)), x["alt"]))
    tail = F.substring(upper, begin(F.size(snps)) + 1, F.length(seq))
    return F.concat(F.array_join(parts, ""), tail)


def spliced(distinct: DataFrame, locus_seq: DataFrame) -> DataFrame:
    """(kind, locus_id, h1, h2, seq) of distinct haplotypes; genes on the minus strand are reverse-complemented afterwards."""
    seqs = distinct.join(locus_seq.select("kind", "locus_id", "strand", "seq"), ["kind", "locus_id"])
    inside = seqs.withColumn("snps", F.filter("snps", lambda x: (x["at"] >= 0) & (x["at"] < F.length("seq"))))
    made = inside.withColumn("seq", splice(F.col("seq"), F.col("snps")))
    turned = F.when((F.col("kind") == "gene") & (F.col("strand") == "-"), reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    return made.select("kind", "locus_id", "h1", "h2", turned.alias("seq"))


def apply_snps(locus_seq: DataFrame, sample_snp: DataFrame, bin_size: int = BIN) -> DataFrame:
    """(sample_id, kind, locus_id, seq) of the loci with SNPs, the bases replaced.

    locus_seq: kind, locus_id, chrom, start, end, strand, seq. SNPs at the same place of samples with the same set of them
    are applied once. Where sequences are still to be cut, mutated_loci() cuts only those that are needed.
    """
    sets, distinct = haplotypes(locus_seq, sample_snp, bin_size)
    return sets.join(spliced(distinct, locus_seq), ["kind", "locus_id", "h1", "h2"]).select("sample_id", "kind", "locus_id", "seq")


def mutated_loci(loci: DataFrame, tiles: DataFrame, sample_snp: DataFrame, tile_len: int = 65_536, bin_size: int = BIN) -> tuple[DataFrame, DataFrame]:
    """J6 over tiles: samples' haplotypes (sample_id, kind, locus_id, h1, h2), and (kind, locus_id, h1, h2, seq) of each.

    Hits come from coordinates; only loci that are hit are cut from the tiles, once.
    """
    sets, distinct = haplotypes(loci, sample_snp, bin_size)
    distinct = materialize(distinct, "distinct_haplotypes")
    hit = loci.select("kind", "locus_id", "chrom", "start", "end", "strand").join(distinct.select("kind", "locus_id").distinct(), ["kind", "locus_id"], "left_semi")
    return sets, materialize(spliced(distinct, extract_locus_seq(hit, tiles, tile_len)), "spliced")
