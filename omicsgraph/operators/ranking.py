"""Ranks and top rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialize
from .joins import small


def number_rows(df: DataFrame, by: list[str], order: list[Column], out: str = "rank", part: str | None = None) -> DataFrame:
    """df with numbers from 1 within groups, in order. No task holds a whole group. part: also a column with the number of the range.

    Rows are dealt to ranges of (by, order) and written; a number is the count of the group's rows in the ranges
    before plus the place in its own range.
    """
    keys = [*map(F.col, by), *order]
    ranged = materialize(df.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy(*by, "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0))).select(*[F.col(b).alias(f"__{b}") for b in by], F.col("__part").alias("__p"), "__offset")
    place = F.row_number().over(Window.partitionBy(*by, "__part").orderBy(*order))
    same = F.col("__part") == F.col("__p")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"__{b}"))
    joined = ranged.withColumn("__place", place).join(small(offsets), same)  # a row per range and group
    return joined.withColumn(out, F.col("__offset") + F.col("__place")).select(*df.columns, out, *([F.col("__part").alias(part)] if part else []))


def rank_genes(scores: DataFrame) -> DataFrame:
    """(id, score, rank) by score, highest first, then id."""
    return number_rows(scores.select("id", "score"), [], [F.col("score").desc(), F.col("id")])


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group with rank 1..k; Spark drops the others before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def top_edges(scored: DataFrame, k: int) -> DataFrame:
    """The k highest-scored edges of each (src_type, rel, dst_type); ties by edge_ix."""
    return top_per_group(scored, ["src_type", "rel", "dst_type"], [F.col("score").desc(), F.col("edge_ix")], k)


def top_ids(ranked: DataFrame, n: int) -> DataFrame:
    """The ids of the first n ranks."""
    return ranked.orderBy("rank").limit(n).select("id")


def top_terms(result: DataFrame, n: int) -> DataFrame:
    """The first n terms of each gene set by fdr, p, id."""
    return top_per_group(result, ["set_name"], [F.col("fdr"), F.col("pvalue"), F.col("go_id")], n)
