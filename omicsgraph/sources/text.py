"""Parsers of tab- or space-separated text. They take a DataFrame of lines (line_no, line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import carries_alt, extract_locus_id, to_double
from ..operators.joins import small
from .shared import materialize


def read_lines(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """(line_no, line) of text files; line_no orders lines as the files do, also over several splits.

    partitions: deal lines out again, for files that can't be split, such as gzip.
    """
    lines = spark.read.text(path).select(
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("line_no"),
        F.col("value").alias("line"),
    )
    return lines.repartition(partitions) if partitions else lines


def split_columns(lines: DataFrame) -> DataFrame:
    """lines with their tab-separated columns, split once."""
    return lines.withColumn("__cells", F.split("line", "\t"))


def columns() -> Column:
    return F.col("__cells")


def cell(k: int) -> Column:
    """A line's column from 0; null if it has fewer."""
    return F.get(columns(), F.lit(k))


def _calls() -> Column:
    """The columns from the tenth on, as many as there are."""
    return F.slice(columns(), F.lit(10), F.greatest(F.lit(0), F.size(columns()) - 9))


def _words() -> Column:
    return F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")


def _filled(lines: DataFrame, comment: str | None = None) -> DataFrame:
    keep = F.trim(F.regexp_replace("line", r"\s", " ")) != ""
    return split_columns(lines.where(keep & ~F.startswith(F.col("line"), F.lit(comment)) if comment else keep))


def _file(lines: DataFrame) -> Column:
    """The file of a line where line_no tells it; all lines are of one file where it is a plain number."""
    kind = lines.schema["line_no"].dataType
    return F.col("line_no.file") if isinstance(kind, T.StructType) and "file" in kind.names else F.lit("")


def _after_header(lines: DataFrame, head: list[Column]) -> DataFrame:
    """The lines after the first one of their file, split, with columns of that first line; a header is a row per file."""
    lines = lines.withColumn("__file", _file(lines))
    first = lines.groupBy("__file").agg(F.min_by("__cells", "line_no").alias("__cells"), F.min("line_no").alias("__first"))
    known = small(materialize(first.select("__file", "__first", *head), "headers"))
    return lines.join(known, "__file").where(F.col("line_no") > F.col("__first"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, seq) of FASTA files whose records fit a row, such as scaffolds; read_fasta_tiles() takes longer ones."""
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("r"))
    parse = records.select(F.regexp_extract("r", r"^(\S*)", 1).alias("chrom"), F.regexp_replace(F.regexp_replace("r", r"^[^\n]*", ""), r"\s", "").alias("seq"))
    return parse.where("chrom <> ''")


def read_fasta_tiles(spark: SparkSession, path: str, tile_len: int = 65_536, chunk: int = 1 << 17) -> DataFrame:
    """(chrom, tile_ix, tile_start, seq) of FASTA files, as tile_genome() gives them; no row or task holds a record."""
    return fasta_tiles(read_lines(spark, path), tile_len, chunk)


def fasta_tiles(lines: DataFrame, tile_len: int = 65_536, chunk: int = 1 << 17) -> DataFrame:
    """Tiles from the lines (line_no of read_lines(), line) of FASTA files.

    Lines are numbered by prefix sums over their lengths, in two levels: within chunks of a file (by split and by `chunk`
    lines), then over the chunks, of which each gives its last header and how many letters follow it. So each line
    knows its chromosome and its place there and goes to the tiles it touches. Lines before a header are left out.
    """
    row = F.col("line_no.row")
    cut = lines.select(F.col("line_no.file").alias("__file"), F.col("line_no.block").alias("__block"), F.floor(row / chunk).alias("__chunk"), row.alias("__row"), F.regexp_replace("line", r"\s+$", "").alias("line"))
    is_head = F.startswith("line", F.lit(">"))
    named = cut.withColumn("__head", F.when(is_head, F.regexp_extract("line", r"^>(\S*)", 1))).withColumn("line", F.when(is_head, "").otherwise(F.regexp_replace("line", r"\s", "")))
    key = ["__file", "__block", "__chunk"]
    own = Window.partitionBy(*key).orderBy("__row").rowsBetween(Window.unboundedPreceding, 0)
    placed = named.withColumn("__sum", F.sum(F.length("line")).over(own)).withColumn("__mark", F.max_by(F.when(F.col("__head").isNotNull(), F.struct("__head", "__sum")), F.when(F.col("__head").isNotNull(), F.col("__row"))).over(own))
    placed = materialize(placed, "fasta_lines")
    ends = placed.groupBy(*key).agg(F.max_by("__mark", "__row").alias("__last"), F.max("__sum").alias("__letters"))
    before = Window.partitionBy("__file").orderBy("__block", "__chunk").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("__file").orderBy("__block", "__chunk").rowsBetween(Window.unboundedPreceding, 0)
    chunks = ends.withColumn("__before", F.sum("__letters").over(upto) - F.col("__letters"))  # letters of the file before the chunk
    chunks = chunks.withColumn("__open", F.last(F.when(F.col("__last").isNotNull(), F.struct(F.col("__last.__head").alias("__head"), (F.col("__before") + F.col("__last.__sum")).alias("__at"))), ignorenulls=True).over(before))
    joined = placed.join(small(chunks.select(*key, "__before", "__open")), key).where("line <> ''")
    chrom = F.coalesce("__mark.__head", "__open.__head")
    origin = F.coalesce(F.col("__before") + F.col("__mark.__sum"), F.col("__open.__at"))
    start = F.col("__before") + F.col("__sum") - F.length("line") - origin  # from 0, on the chromosome
    lines_at = joined.select(chrom.alias("chrom"), start.alias("__start"), F.upper("line").alias("line")).where("chrom <> ''")
    spread = lines_at.withColumn("tile_ix", F.explode(F.sequence(F.floor(F.col("__start") / tile_len), F.floor((F.col("__start") + F.length("line") - 1) / tile_len))))
    low = F.greatest(F.col("tile_ix") * tile_len, F.col("__start"))
    high = F.least((F.col("tile_ix") + 1) * tile_len, F.col("__start") + F.length("line"))
    parts = spread.select("chrom", "tile_ix", low.alias("__low"), F.substring("line", (low - F.col("__start") + 1).cast("int"), (high - low).cast("int")).alias("__part"))
    seq = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__low", "__part"))), lambda x: x["__part"]), "")
    return parts.groupBy("chrom", "tile_ix").agg(seq.alias("seq")).select("chrom", "tile_ix", (F.col("tile_ix") * tile_len + 1).alias("tile_start"), "seq")


def tile_genome(genome: DataFrame, tile_len: int = 65_536) -> DataFrame:
    """(chrom, tile_ix, tile_start, seq): sequences in upper case cut into tiles, tile_start from 1."""
    tiles = F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{tile_len}}}"), F.lit(0))  # one pass, whatever the length
    cut = genome.where("seq <> ''").select("chrom", F.posexplode(tiles).alias("at", "seq"))
    return cut.select("chrom", F.col("at").cast("bigint").alias("tile_ix"), (F.col("at").cast("bigint") * tile_len + 1).alias("tile_start"), F.upper("seq").alias("seq"))


def parse_gff_genes(lines: DataFrame) -> DataFrame:
    """(gene_id, chrom, gstart, gend, strand) of the rows with 9 columns whose feature is gene and that have an id."""
    ids = F.get(F.filter(F.split(cell(8), ";"), lambda x: F.startswith(x, F.lit("ID="))), F.lit(0))
    rows = _filled(lines, "#").where((F.size(columns()) == 9) & (cell(2) == "gene"))
    return rows.select(F.replace(ids, F.lit("ID="), F.lit("")).alias("gene_id"), cell(0).alias("chrom"), cell(3).try_cast("bigint").alias("gstart"), cell(4).try_cast("bigint").alias("gend"), cell(6).alias("strand")).where("gene_id <> ''")


def _vcf(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split record lines with `head`, the number of the header line before them, and the headers (head, names).

    Headers are few: a row per file, or more where files were put together. Each holds until the next one of its file.
    """
    lines = split_columns(lines.withColumn("__file", _file(lines)))
    head = lines.where(F.startswith("line", F.lit("#CHROM"))).select("__file", F.col("line_no").alias("head"), _calls().alias("names"))
    head = materialize(head.withColumn("__next", F.lead("head").over(Window.partitionBy("__file").orderBy("head"))), "headers")
    spans = head.select(F.col("__file").alias("__of"), "head", "__next")
    records = lines.where((F.col("line") != "") & ~F.startswith("line", F.lit("#")))
    within = (F.col("__file") == F.col("__of")) & (F.col("line_no") > F.col("head")) & (F.col("__next").isNull() | (F.col("line_no") < F.col("__next")))
    return records.join(small(spans), within, "left").drop("__of", "__next"), head.select("head", "names")


def _site() -> list[Column]:
    alt = F.when(cell(4) == ".", F.array().cast("array<string>")).otherwise(F.split(cell(4), ","))
    return [F.col("line_no").alias("rec_ix"), cell(0).alias("chrom"), cell(1).try_cast("bigint").alias("pos"), cell(3).alias("ref"), alt.alias("alt")]


def _alleles(call: Column, at: Column) -> tuple[Column, Column]:
    """The two alleles of a call whose genotype is the at-th part; missing ones are -1, a single one counts twice."""
    alleles = F.split(F.get(F.split(call, ":"), at - 1), r"[/|]")
    allele = lambda k: F.coalesce(F.coalesce(F.get(alleles, F.lit(k)), F.get(alleles, F.lit(0))).try_cast("int"), F.lit(-1))
    return allele(0), allele(1)


def _genotype_at() -> Column:
    return F.array_position(F.split(cell(8), ":"), "GT").cast("int")


def parse_vcf(lines: DataFrame, samples: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """S3: site (rec_ix, chrom, pos, ref, alt) and genotype (rec_ix, sample_id, a1, a2); rec_ix is the line's number.

    Alleles that are missing are -1; a genotype of one allele counts as two equal ones. Sample names are those of the
    header before a record in its file, so files may have samples of their own.
    """
    records, heads = _vcf(lines)
    calls = records.select(F.col("line_no").alias("rec_ix"), "head", _genotype_at().alias("at"), _calls().alias("calls")).join(small(heads), "head")
    long = calls.select("rec_ix", "at", "names", F.posexplode("calls").alias("k", "call"))
    a1, a2 = _alleles(F.col("call"), F.col("at"))
    out = long.select("rec_ix", F.get("names", F.col("k")).alias("sample_id"), a1.alias("a1"), a2.alias("a2"))
    return records.select(*_site()), out.where(F.col("sample_id").isin(samples)) if samples else out


def parse_vcf_carriers(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S3, sparse: site (rec_ix, chrom, pos, ref, alt, head, carriers) and names (head, k, sample_id).

    carriers: the places k, from 0, of the samples that carry the first alternative. Genotypes stay in their record's row and
    all others are dropped there, so rows are records and then carriers, never records times samples.
    """
    records, heads = _vcf(lines)

    def carrier(call: Column, k: Column) -> Column:
        a1, a2 = _alleles(call, F.col("__at"))
        return F.when(carries_alt(a1, a2), k)

    rows = records.withColumn("__at", _genotype_at()).withColumn("carriers", F.array_compact(F.transform(_calls(), carrier)))
    return rows.select(*_site(), "head", "carriers"), heads.select("head", F.posexplode("names").alias("k", "sample_id"))


def parse_gaf(lines: DataFrame, drop_not: bool = False) -> DataFrame:
    """(gene_id, go_id, obj_name, seq_no) of annotation rows with a gene locus id and a GO term."""
    rows = _filled(lines, "!").where((F.size(columns()) >= 15) & F.startswith(cell(4), F.lit("GO:")))
    if drop_not:
        rows = rows.where(~F.contains(cell(3), F.lit("NOT")))
    return rows.select(extract_locus_id(cell(1), cell(2), cell(10)).alias("gene_id"), cell(4).alias("go_id"), cell(9).alias("obj_name"), F.col("line_no").alias("seq_no")).where("gene_id is not null")


def parse_weighted_edges(lines: DataFrame) -> DataFrame:
    """(src, dst, weight, edge_ix); a weight that is absent or no number is 1."""
    return _filled(lines).where(F.size(columns()) >= 2).select(F.trim(cell(0)).alias("src"), F.trim(cell(1)).alias("dst"), F.coalesce(to_double(cell(2)), F.lit(1.0)).alias("weight"), F.col("line_no").alias("edge_ix"))


def parse_ppi(lines: DataFrame) -> DataFrame:
    """(gene1, gene2, score) of rows whose third column is a number; a header isn't."""
    return _filled(lines).select(F.trim(cell(0)).alias("gene1"), F.trim(cell(1)).alias("gene2"), to_double(cell(2)).alias("score")).where("score is not null")


def parse_labels(lines: DataFrame) -> DataFrame:
    """(sample_id, label); columns by the names in the header of each file, the last row of a sample counts."""
    lines = _filled(lines.withColumn("line", F.regexp_replace("line", "\r$", "")))
    rows = _after_header(lines, [F.array_position(columns(), "sample_id").alias("s"), F.array_position(columns(), "label").alias("l")])
    value = lambda k: F.get(columns(), F.col(k).cast("int") - 1)
    return rows.select("line_no", F.trim(value("s")).alias("sample_id"), to_double(value("l")).alias("label")).groupBy("sample_id").agg(F.max_by("label", "line_no").alias("label"))


def parse_gene_list(lines: DataFrame) -> DataFrame:
    """(gene_id, weight): the largest weight of a gene, 0 at least; null where no row of the gene has one."""
    t = _words()
    rows = _filled(lines).where(~F.startswith(F.ltrim("line"), F.lit("#"))).select(F.get(t, F.lit(0)).alias("gene_id"), to_double(F.get(t, F.lit(1))).alias("w"))
    return rows.groupBy("gene_id").agg(F.when(F.count("w") > 0, F.greatest(F.max("w"), F.lit(0.0))).alias("weight"))


def parse_gene2go(lines: DataFrame) -> DataFrame:
    """Distinct (gene_id, go_id) from the first two words of lines."""
    t = _words()
    return _filled(lines).where(F.size(t) >= 2).select(F.get(t, F.lit(0)).alias("gene_id"), F.get(t, F.lit(1)).alias("go_id")).distinct()


def parse_go_names(lines: DataFrame) -> DataFrame:
    """(go_id, name); the last name of a term counts."""
    return _filled(lines).where(F.size(columns()) >= 2).select(F.trim(cell(0)).alias("go_id"), F.trim(cell(1)).alias("name"), "line_no").groupBy("go_id").agg(F.max_by("name", "line_no").alias("name"))


def parse_pairs(lines: DataFrame) -> DataFrame:
    """(region_id, window_id); the first line of a file is a header."""
    rows = _after_header(split_columns(lines), [])
    return _filled(rows.drop("__cells")).where(F.size(columns()) >= 2).select(F.trim(cell(0)).alias("region_id"), F.trim(cell(1)).alias("window_id"))
