"""Scalar column functions: ids, chromosome names, sequences, genotypes, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Region ids, gene locus ids, numbers as text.
REGION_ID = r"^(Chr\w+):(\d+)-(\d+)$"
LOCUS_ID = r"^(AT[1-5MC]G\d{5})"
NUMBER = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*$"
#: Other names of the organelles.
MITOCHONDRION = ("M", "CHRM", "MT", "MITO", "MITOCHONDRIA")
PLASTID = ("C", "CHRC", "PT", "PLASTID", "CHLOROPLAST")
#: Bases and ambiguity codes with their complements.
BASES, COMPLEMENTS = "ACGTURYKMBVDHacgturykmbvdh", "TGCAAYRMKVBHDtgcaayrmkvbhd"
#: Region types in the order in which they win.
TYPE_PRIORITY = {"promoter_1000": 4, "promoter_500": 3, "chip_peak": 2, "motif_site": 1, "re": 0}


def to_double(text: Column) -> Column:
    """The number a text stands for, else null; suffixes as in 1d aren't numbers."""
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def parse_region_id(region_id: Column, strict: bool = True) -> Column:
    """struct(chrom, start, end) of an id like Chr1:10-20, ends in order; a bad id is an error, or null if lenient."""
    text = F.trim(region_id)
    part = lambda k: F.regexp_extract(text, REGION_ID, k)
    a, b = part(2).try_cast("bigint"), part(3).try_cast("bigint")
    good = F.struct(part(1).alias("chrom"), F.least(a, b).alias("start"), F.greatest(a, b).alias("end"))
    bad = F.raise_error(F.concat(F.lit("not a region id such as Chr1:10-20: "), F.coalesce(region_id, F.lit("null")))) if strict else F.lit(None)
    return F.when(text.rlike(REGION_ID), good).otherwise(bad)


def canonical_chrom(name: Column) -> Column:
    """One key for all spellings of a chromosome: MT, PT, a number without leading zeros, or the name in upper case."""
    c = F.trim(name)
    bare = F.trim(F.regexp_replace(c, "^(chr|Chr|CHR)", ""))
    number = F.regexp_replace(bare, r"^0+(?=\d)", "")
    return F.when(F.upper(c).isin(*MITOCHONDRION), "MT").when(F.upper(c).isin(*PLASTID), "PT").when(bare.rlike(r"^\d+$"), number).otherwise(F.upper(bare))


def window_bounds(start: Column, end: Column, size: int = 4000, stride: int = 2000) -> Column:
    """struct(start, end) of the stride-aligned window around the middle."""
    mid = F.floor((start + end) / 2)
    begin = F.floor((mid - 1) / stride) * stride + 1
    return F.struct(begin.alias("start"), (begin + size - 1).alias("end"))


def window_id(region_id: Column, size: int = 4000, stride: int = 2000) -> Column:
    """The id of a region's window, of the same form as the region's."""
    r = parse_region_id(region_id)
    w = window_bounds(r["start"], r["end"], size, stride)
    return F.concat(r["chrom"], F.lit(":"), w["start"].cast("string"), F.lit("-"), w["end"].cast("string"))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, BASES, COMPLEMENTS))


def pad_or_center_truncate(seq: Column, length: Column | int) -> Column:
    """seq in upper case, cut around its middle or padded with N on both sides; as it is if length is 0 or less."""
    s = F.upper(F.coalesce(seq, F.lit("")))
    n = F.lit(length) if isinstance(length, int) else length
    have = F.length(s)
    begin = F.greatest(F.lit(0), F.floor(have / 2) - F.floor(n / 2))
    begin = F.least(begin, have - n).cast("int")
    left = F.floor((n - have) / 2).cast("int")
    padded = F.concat(F.repeat(F.lit("N"), left), s, F.repeat(F.lit("N"), (n - have).cast("int") - left))
    return F.when((n <= 0) | (have == n), s).when(have > n, F.substring(s, begin + 1, n.cast("int"))).otherwise(padded)


def split_windows(seq: Column, size: int, stride: int) -> Column:
    """array of windows of a sequence in upper case; the last one ends where the sequence ends."""
    s = F.upper(F.coalesce(seq, F.lit("")))
    n = F.length(s)
    starts = F.sequence(F.lit(0), n - size, F.lit(stride))
    tail = F.when((n - size) % stride != 0, F.array(n - size)).otherwise(F.array().cast("array<int>"))
    cut = F.transform(F.concat(starts, tail), lambda k: F.substring(s, k + 1, F.lit(size)))
    return F.when(n == 0, F.array().cast("array<string>")).when(n <= size, F.array(s)).otherwise(cut)


def fixed_len_for_type(rtype: Column, lengths: dict[str, int], default: str = "chip_peak") -> Column:
    """The sequence length of a region type; unknown types have that of `default`."""
    out = F.lit(lengths[default])
    for kind, n in lengths.items():
        out = F.when(rtype == kind, F.lit(n)).otherwise(out)
    return out


def type_priority(rtype: Column) -> Column:
    out = F.lit(0)
    for kind, p in TYPE_PRIORITY.items():
        out = F.when(rtype == kind, F.lit(p)).otherwise(out)
    return out


def extract_locus_id(*fields: Column) -> Column:
    """The first gene locus id that starts a token of the fields, in upper case; tokens end at | and white space."""

    def first(field: Column) -> Column:
        tokens = F.split(F.regexp_replace(F.upper(field), r"\|", " "), r"\s+")
        return F.get(F.filter(F.transform(tokens, lambda t: F.regexp_extract(t, LOCUS_ID, 1)), lambda t: t != ""), F.lit(0))

    return F.coalesce(*[first(f) for f in fields])


def is_snp(ref: Column, alt: Column, biallelic_only: bool = False) -> Column:
    """One base against one base: a reference of one letter, and a first alternative of one letter."""
    one = (F.length(ref) == 1) & (F.size(alt) > 0) & (F.length(F.get(alt, F.lit(0))) == 1)
    return F.coalesce(one & (F.size(alt) == 1) if biallelic_only else one, F.lit(False))


def carries_alt(a1: Column, a2: Column) -> Column:
    """Both alleles are known and one is the first alternative."""
    return F.coalesce((a1 >= 0) & (a2 >= 0) & ((a1 == 1) | (a2 == 1)), F.lit(False))


def ppi_normalize(score: Column, mode: str = "none") -> Column:
    if mode == "none":
        return score
    if mode == "divide_1000":
        return score / 1000.0
    if mode == "log1p":
        return F.log1p(score) / F.log1p(F.lit(1000.0))
    raise ValueError(f"unknown mode {mode}")


def safe_sample_id(name: Column) -> Column:
    """Letters, numbers and ._- stay; anything else becomes _."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}._-]", "_")


def gene_flank(start: Column, end: Column, bp: int) -> Column:
    """struct(start, end) of a gene with `bp` bases on both sides."""
    begin = F.greatest(F.lit(1), start - bp)
    return F.struct(begin.alias("start"), F.greatest(begin, end + bp).alias("end"))
