"""Tables of embeddings by sample and kind, sample listings, and ranked tables as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How scores, ratios and p-values are written.
FORMATS = {"score": "%.6e", "gene_ratio": "%.6g", "bg_ratio": "%.6g", "fold_enrichment": "%.6g", "pvalue": "%.3e", "fdr": "%.3e"}
SAMPLE_FILE = r"sample_([^/]+)_mutant_graph\.pt$"
KINDS = ("gene", "region", "window")


def write_embeddings(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Vectors as arrays of float, one folder per sample (if there is one) and node type."""
    by = [c for c in ("sample_id", "node_type") if c in df.columns]
    df.withColumn("x", F.col("x").cast("array<float>")).write.mode(mode).partitionBy(*by).parquet(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def store_embeddings(df: DataFrame, table: str, buckets: int = 200, path: str | None = None, mode: str = "overwrite") -> None:
    """Vectors as a bucketed table: by node_type and node_id, sorted by them, whatever the number of samples.

    There is a file or more per bucket, not a folder per sample. Tables with the same buckets meet in joins on node_type and node_id
    without a shuffle (see graph.overlay_stored). path: where the files go; else the warehouse.
    """
    keys = ["node_type", "node_id"]
    # dealt as buckets are, so that each bucket is written by one task
    rows = df.withColumn("x", F.col("x").cast("array<float>")).repartition(buckets, *keys)
    out = rows.write.mode(mode).format("parquet").bucketBy(buckets, *keys).sortBy(*keys, *[c for c in ("sample_id",) if c in df.columns])
    (out.option("path", path) if path else out).saveAsTable(table)


def discover_samples(listing: DataFrame, path: str = "path") -> DataFrame:
    """(sample_id, path) of the sample graphs in a file listing."""
    found = F.regexp_extract(path, SAMPLE_FILE, 1)
    return listing.select(found.alias("sample_id"), F.col(path).alias("path")).where("sample_id <> ''")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Paths below a folder, without reading the files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")


def complete_samples(delta: DataFrame) -> DataFrame:
    """sample_id of those that have rows of all three node types."""
    return delta.where(F.col("node_type").isin(*KINDS)).groupBy("sample_id").agg(F.count_distinct("node_type").alias("n")).where(F.col("n") == len(KINDS)).select("sample_id")


def as_text(df: DataFrame) -> DataFrame:
    """Numbers with a fixed format as they are written."""
    put = lambda c: F.format_string(FORMATS[c], F.col(c)).alias(c) if c in FORMATS else F.col(c)
    return df.select(*map(put, df.columns))


def write_tsv(df: DataFrame, path: str, order_by: list[str | Column], mode: str = "overwrite") -> None:
    """A header and tab-separated rows in order, in as many files as the order's ranges."""
    as_text(df.orderBy(*order_by)).write.mode(mode).option("sep", "\t").option("header", True).csv(path)
