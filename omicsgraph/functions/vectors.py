"""Vectors held as arrays of numbers: aggregates stay in the JVM, row by row products are Arrow functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..operators.joins import small
from ..sources.shared import materialize


def _doubles(x: Column) -> Column:
    return array_to_vector(x.cast("array<double>"))


def mean_of(x: Column) -> Column:
    """Aggregate: the element-wise mean."""
    return vector_to_array(Summarizer.mean(_doubles(x)))


def sum_of(x: Column) -> Column:
    return vector_to_array(Summarizer.sum(_doubles(x)))


def max_of(x: Column) -> Column:
    return vector_to_array(Summarizer.max(_doubles(x)))


def mean_vector(df: DataFrame, by: list[str], x: str = "x") -> DataFrame:
    """A2: one mean vector per group, or one in all if `by` is empty."""
    return df.groupBy(*by).agg(mean_of(F.col(x)).alias(x))


def pool_vectors(df: DataFrame, by: list[str], order: str, mode: str = "mean", x: str = "x") -> DataFrame:
    """A3: one vector per group: mean, max, or the first or last in `order`; other modes mean the mean."""
    x_ = F.col(x)
    made = {"max": max_of(x_), "first": F.min_by(x_.cast("array<double>"), order), "last": F.max_by(x_.cast("array<double>"), order)}.get(mode.lower(), mean_of(x_))
    return df.groupBy(*by).agg(made.alias(x))


def combine_strands(df: DataFrame, by: list[str], mode: str = "sum", x: str = "x") -> DataFrame:
    """A4: the vectors of both strands added or averaged; other modes mean the sum."""
    return df.groupBy(*by).agg((mean_of(F.col(x)) if mode == "mean" else sum_of(F.col(x))).alias(x))


def pool_tokens(tokens: DataFrame, by: list[str], mode: str = "mean", dim: int | None = None) -> DataFrame:
    """One vector per sequence from rows (token_ix, x, is_pad): mean of those that aren't padding, or the first.

    A sequence of padding only has zeros if `dim` is given, else null.
    """
    if mode == "cls":
        return tokens.groupBy(*by).agg(F.min_by(F.col("x").cast("array<double>"), "token_ix").alias("x"))
    real = F.when(~F.col("is_pad"), _doubles(F.col("x")))
    total = vector_to_array(Summarizer.sum(F.coalesce(real, _doubles(F.transform("x", lambda _: F.lit(0.0))))))
    n = F.greatest(F.count_if(~F.col("is_pad")), F.lit(1))
    return tokens.groupBy(*by).agg(total.alias("__t"), n.alias("__n")).select(*by, F.transform("__t", lambda v: v / F.col("__n")).alias("x"))


def segment_softmax(df: DataFrame, by: list[str], score: str = "score", out: str = "weight") -> DataFrame:
    """Softmax of a score within each group, shifted by the group's maximum.

    Groups are added up without the other columns of df, so that vectors aren't sorted or shuffled for two numbers.
    """
    named = [F.col(b).alias(f"__by_{b}") for b in by]
    same = lambda left, right: [left[b].eqNullSafe(right[f"__by_{b}"]) for b in by]
    scores = df.select(*by, F.col(score).alias("__score"))
    top = scores.groupBy(*named).agg(F.max("__score").alias("__top"))
    summed = scores.join(top, same(scores, top)).groupBy(*top.columns).agg(F.sum(F.exp(F.col("__score") - F.col("__top"))).alias("__sum"))
    total = small(materialize(summed, "softmax"))
    joined = df.join(total, same(df, total))
    return joined.withColumn(out, F.exp(F.col(score) - F.col("__top")) / F.col("__sum")).drop(*total.columns)


def dot(x: Column, w: list[float]) -> Column:
    """Inner product with a short constant vector."""
    terms = F.zip_with(x.cast("array<double>"), F.array(*map(F.lit, map(float, w))), lambda a, b: a * b)
    return F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v)


def weighted_sum(x: str, w: str) -> Column:
    """Aggregate: the sum of vectors times their weights."""
    return sum_of(F.transform(F.col(x).cast("array<double>"), lambda v: v * F.col(w)))


def readout(z: DataFrame, by: list[str], mode: str = "mean", attention: tuple[list[float], float] | None = None, x: str = "z") -> DataFrame:
    """One vector g per sample: the mean, or the sum weighted by the softmax of a.z + b."""
    if mode == "mean":
        return z.groupBy(*by).agg(mean_of(F.col(x)).alias("g"))
    if mode != "attention" or attention is None:
        raise ValueError("mode is mean, or attention with its (a, b)")
    a, b = attention
    weighed = segment_softmax(z.withColumn("__s", dot(F.col(x), a) + F.lit(float(b))), by, "__s", "__w")
    return weighed.groupBy(*by).agg(weighted_sum(x, "__w").alias("g"))


@F.pandas_udf(DoubleType())
def abs_dot(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Sum of the absolute products of two vectors, row by row."""
    for a, b in pairs:
        yield pd.Series(np.abs(np.stack(a.to_numpy()).astype(float) * np.stack(b.to_numpy()).astype(float)).sum(axis=1) if len(a) else [], dtype=float)
