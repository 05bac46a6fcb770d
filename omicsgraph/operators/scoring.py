"""Gene and edge scores over samples."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import abs_dot, dot, mean_of, segment_softmax, sum_of, weighted_sum
from ..sources.shared import materialize
from .grid import grid_scores, node_key
from .joins import small, small_vectors
from .ranking import rank_genes, top_edges, top_per_group


@dataclass(frozen=True)
class Head:
    """Two-layer regression head: w2 . relu(w1 g + b1) + b2."""

    w1: list[list[float]]
    b1: list[float]
    w2: list[float]
    b2: float = 0.0

    def gradient(self, g: np.ndarray) -> np.ndarray:
        """Of the output by each row of g."""
        w1, b1, w2 = np.array(self.w1), np.array(self.b1), np.array(self.w2)
        return ((g @ w1.T + b1 > 0) * w2) @ w1


def _gradient_of(head: Head):
    """The head's gradient at readouts, as a column function."""

    @F.pandas_udf("array<double>")
    def gradient(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for g in rows:
            yield pd.Series(list(head.gradient(np.stack(g.to_numpy()).astype(float))) if len(g) else [], dtype=object)

    return gradient


def gradient_x_input(z: DataFrame, head: Head, mode: str = "mean", attention: tuple[list[float], float] | None = None) -> DataFrame:
    """(sample_id, gene_id, score): the sum over dimensions of |z * d(output)/dz| for rows (sample_id, gene_id, z).

    With v the head's gradient at the sample's readout g: v/n for the mean over n genes; w v + w (v.z - v.g) a for
    attention with weights w and vector a. Only v, g and n of a sample meet its genes.
    """

    gradient = _gradient_of(head)
    if mode == "mean":
        g = z.groupBy("sample_id").agg(mean_of(F.col("z")).alias("g"), F.count("*").alias("n"))
        per_sample = small_vectors(materialize(g.select("sample_id", "n", gradient("g").alias("v")), "gradients"), "v")
        return z.join(per_sample, "sample_id").select("sample_id", "gene_id", (abs_dot("z", "v") / F.col("n")).alias("score"))
    if mode != "attention" or attention is None:
        raise ValueError("mode is mean, or attention with its (a, b)")
    a, b = attention
    weighed = segment_softmax(z.withColumn("__s", dot(F.col("z"), a) + F.lit(float(b))), ["sample_id"], "__s", "w")
    g = weighed.groupBy("sample_id").agg(weighted_sum("z", "w").alias("g"))
    rows = weighed.join(small_vectors(materialize(g.withColumn("v", gradient("g")), "gradients"), "g", "v"), "sample_id")
    inner = lambda x: F.aggregate(F.zip_with(F.col("v"), F.col(x).cast("array<double>"), lambda p, q: p * q), F.lit(0.0), lambda acc, t: acc + t)
    shift = inner("z") - inner("g")
    slope = F.zip_with("v", F.array(*map(F.lit, map(float, a))), lambda p, q: F.col("w") * (p + F.col("__shift") * q))
    return rows.withColumn("__shift", shift).select("sample_id", "gene_id", abs_dot("z", slope).alias("score"))


def gene_importance(scores: DataFrame) -> DataFrame:
    """(id, score, rank): gene scores added and divided by the number of samples that have any."""
    used = scores.select("sample_id").distinct().agg(F.count("*").alias("n_used"))
    total = scores.groupBy(F.col("gene_id").alias("id")).agg(F.sum("score").alias("total")).crossJoin(F.broadcast(used))
    return rank_genes(total.select("id", (F.col("total") / F.col("n_used")).alias("score")))


def mask_edges_by_top_genes(edges: DataFrame, top: DataFrame) -> DataFrame:
    """Edges with a gene end only if one gene end is among the top ids; other edges stay."""
    ids = small(top.select(F.col("id").alias("__id")).distinct())
    out = edges
    for end in ("src", "dst"):
        out = out.join(ids.select(F.col("__id").alias(f"__{end}")), (F.col(f"{end}_type") == "gene") & (F.col(f"{end}_id") == F.col(f"__{end}")), "left")
    no_gene = (F.col("src_type") != "gene") & (F.col("dst_type") != "gene")
    return out.where(no_gene | F.col("__src").isNotNull() | F.col("__dst").isNotNull()).select(*edges.columns)


def _numbered(edges: DataFrame) -> DataFrame:
    """edges with edge_row, a number of its own for each row, and the keys of both ends; written."""
    ends = {"edge_row": F.monotonically_increasing_id(), "src": node_key("src_type", "src_id"), "dst": node_key("dst_type", "dst_id")}
    return materialize(edges.withColumns(ends), "numbered_edges")


def _nodes(z: DataFrame) -> list:
    return [node_key("node_type", "node_id").alias("node"), F.col("z").cast("array<double>").alias("z")]


def interaction_scores(edges: DataFrame, z: DataFrame) -> DataFrame:
    """Edges with score: the sum of |z_src * z_dst|, averaged over the samples of z that have both ends.

    z: (sample_id, node_type, node_id, z). Repeated edges stay apart. Mask edges first. Vectors go to the cells of a grid
    (see grid.py), not to edges.
    """
    numbered = _numbered(edges)
    sums = grid_scores(numbered.select("edge_row", "src", "dst"), z.select(F.col("sample_id").alias("sample"), *_nodes(z)))
    return numbered.join(sums.where("n > 0"), "edge_row").select(*edges.columns, (F.col("s") / F.col("n")).alias("score"))


def sparse_interaction_scores(edges: DataFrame, reference: DataFrame, own: DataFrame, n_samples: int) -> DataFrame:
    """A14 for samples that differ from a reference at few nodes: equal to interaction_scores() over the full overlay.

    reference: (node_type, node_id, z); own: (sample_id, node_type, node_id, z), the vectors that differ, of at most n_samples
    samples. Every edge is scored once for the reference; a sample adds what changes at edges with a changed end.
    Vectors of nodes that the reference doesn't have are ignored.
    """
    numbered = _numbered(edges)
    sums = _sparse_sums(numbered, reference, own)
    return numbered.join(sums, "edge_row").select(*edges.columns, (F.col("base") + F.col("s") / n_samples).alias("score"))


def _sparse_sums(numbered: DataFrame, reference: DataFrame, own: DataFrame) -> DataFrame:
    known = own.join(reference.select("node_type", "node_id"), ["node_type", "node_id"], "left_semi")
    sums = grid_scores(numbered.select("edge_row", "src", "dst"), known.select(F.col("sample_id").alias("sample"), *_nodes(known)), reference.select(*_nodes(reference)))
    return sums.where("base is not null")


def top_interactions(edges: DataFrame, reference: DataFrame, own: DataFrame, n_samples: int, k: int, first: int = 4) -> tuple[DataFrame, int]:
    """T1 with bounds: (the k best edges of each type, as top_edges() over sparse_interaction_scores(); how many edges were scored).

    By Cauchy and Schwarz an edge's mean score is at most the product of its ends' root mean squared norms. The edges with
    the first * k highest bounds of a type are scored; of the others only those whose bound reaches the k-th score of these.
    """
    numbered = _numbered(edges)
    square = lambda c: F.aggregate(F.col(c).cast("array<double>"), F.lit(0.0), lambda acc, v: acc + v * v)
    base = reference.select(node_key("node_type", "node_id").alias("node"), square("z").alias("q"))
    mine = own.select(node_key("node_type", "node_id").alias("node"), square("z").alias("own")).groupBy("node").agg(F.sum("own").alias("own"), F.count("*").alias("n"))
    mean = (F.col("q") * (n_samples - F.coalesce("n", F.lit(0))) + F.coalesce("own", F.lit(0.0))) / n_samples
    norms = small(materialize(base.join(mine, "node", "left").select("node", F.sqrt(mean).alias("norm")), "norms"))
    bounded = numbered.join(norms.toDF("src", "__s"), "src").join(norms.toDF("dst", "__d"), "dst")
    bounded = materialize(bounded.withColumn("bound", F.col("__s") * F.col("__d") * (1 + 1e-9)).drop("__s", "__d"), "bounded_edges")
    kind = ["src_type", "rel", "dst_type"]

    def scored(rows: DataFrame) -> DataFrame:
        sums = _sparse_sums(rows, reference, own)
        return materialize(rows.join(sums.drop("n"), "edge_row").withColumn("score", F.col("base") + F.col("s") / n_samples).select(*edges.columns, "edge_row", "score"), "scored_edges")

    likely = materialize(top_per_group(bounded, kind, [F.col("bound").desc(), F.col("edge_ix")], first * k).drop("rank"), "likely_edges")
    done = scored(likely)
    kth = top_per_group(done, kind, [F.col("score").desc(), F.col("edge_ix")], k).where(F.col("rank") == k).select(*kind, F.col("score").alias("__kth"))
    rest = bounded.join(F.broadcast(kth), kind).where(F.col("bound") >= F.col("__kth")).drop("__kth")  # a row per type of edge
    rest = materialize(rest.join(small(likely.select("edge_row")), "edge_row", "left_anti"), "other_edges")
    both = done.unionByName(scored(rest)) if not rest.isEmpty() else done
    return top_edges(both.drop("edge_row"), k), both.count()


def sparse_importance(genes: DataFrame, own: DataFrame, n_samples: int, head: Head, mode: str = "mean", attention: tuple[list[float], float] | None = None) -> DataFrame:
    """A12, A13 for samples that differ from a reference at few genes: equal to gene_importance() over gradient_x_input() of the
    full overlay. genes: (gene_id, z) of the reference; own: (sample_id, gene_id, z).

    A sample's readout is the reference's with its changes. For the mean readout, |z * v| is |z| * |v|, so the sum over samples
    of a reference vector's score is its product with the sum of |v|, one vector in all. For attention each sample has
    its own weights: blocks of genes meet groups of samples' gradients, and only one sum per gene and cell comes out. In
    both a sample corrects the genes that it changes; no row is made for each gene and sample.
    """
    ref = materialize(genes.select("gene_id", F.col("z").cast("array<double>").alias("z")), "reference_genes")
    mine = own.select("sample_id", "gene_id", F.col("z").cast("array<double>").alias("own")).join(ref, "gene_id")
    mine = materialize(mine, "changed_genes")
    if mode == "mean":
        total, fixes, each = _mean_sums(ref, mine, n_samples, head)
    elif mode == "attention" and attention is not None:
        total, fixes, each = _attention_sums(ref, mine, n_samples, head, attention)
    else:
        raise ValueError("mode is mean, or attention with its (a, b)")
    scores = total.join(fixes, "gene_id", "left").select(F.col("gene_id").alias("id"), ((F.col("total") + F.coalesce("fix", F.lit(0.0))) / (each * n_samples)).alias("score"))
    return rank_genes(scores)


def _inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, t: acc + t)


def _mean_sums(ref: DataFrame, mine: DataFrame, n_samples: int, head: Head) -> tuple[DataFrame, DataFrame, int]:
    n, slope = ref.count(), _gradient_of(head)
    less = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    size = lambda c: F.transform(c, F.abs)
    g = F.broadcast(ref.agg(mean_of(F.col("z")).alias("g")))  # one row
    change = mine.groupBy("sample_id").agg(sum_of(less(F.col("own"), F.col("z"))).alias("c"))
    readouts = change.crossJoin(g).select("sample_id", F.zip_with("g", "c", lambda x, y: x + y / F.lit(n)).alias("g"))
    per_sample = materialize(readouts.select("sample_id", size(slope("g")).alias("v")), "gradients")
    n_changed = per_sample.count()
    plain = g.select(size(slope("g")).alias("v")).select(F.transform("v", lambda x: x * (n_samples - n_changed)).alias("v"))
    sums = F.broadcast(materialize(per_sample.select("v").unionByName(plain).agg(sum_of(F.col("v")).alias("v")), "gradient_sum"))  # one row
    fix = _inner(less(size(F.col("own")), size(F.col("z"))), F.col("v"))
    fixes = mine.join(small_vectors(per_sample, "v"), "sample_id").groupBy("gene_id").agg(F.sum(fix).alias("fix"))
    return ref.crossJoin(sums).select("gene_id", _inner(size(F.col("z")), F.col("v")).alias("total")), fixes, n


#: Bytes of gradients of a group of samples.
GROUP_BYTES = 32 << 20


def _weighed_scores(z: np.ndarray, e: np.ndarray, v: np.ndarray, vg: np.ndarray, total: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Attention scores of rows: z, their weights e/total, and the gradient of each row's sample (see gradient_x_input)."""
    return np.abs(z * (v + ((z * v).sum(axis=1) - vg)[:, None] * a)).sum(axis=1) * e / total


def _attention_sums(ref: DataFrame, mine: DataFrame, n_samples: int, head: Head, attention: tuple[list[float], float]) -> tuple[DataFrame, DataFrame, int]:
    a, b = np.array(attention[0], float), float(attention[1])
    spark, slope = ref.sparkSession, _gradient_of(head)
    t = lambda c: dot(F.col(c), attention[0]) + F.lit(b)
    top = ref.agg(F.max(t("z"))).first()[0]
    if top is None:
        top = 0.0
    top = max(top, (mine.agg(F.max(t("own"))).first()[0] or -math.inf) - 600.0)  # so that no exponential overflows
    e = lambda c: F.exp(t(c) - F.lit(float(top)))
    scaled = lambda c, w: F.transform(F.col(c), lambda x: x * F.col(w))
    ref = materialize(ref.withColumn("e", e("z")), "weighed_genes")
    whole = F.broadcast(ref.agg(F.sum("e").alias("e0"), sum_of(scaled("z", "e")).alias("g0")))  # one row
    mine = mine.withColumn("e", e("own")).withColumn("e_ref", e("z"))
    change = mine.groupBy("sample_id").agg(F.sum(F.col("e") - F.col("e_ref")).alias("de"), sum_of(F.zip_with(scaled("own", "e"), scaled("z", "e_ref"), lambda x, y: x - y)).alias("dg"), F.lit(1).alias("times"))
    n_changed = change.count()
    none = whole.select(F.lit(None).cast(mine.schema["sample_id"].dataType).alias("sample_id"), F.lit(0.0).alias("de"), F.transform("g0", lambda x: x * 0.0).alias("dg"), F.lit(n_samples - n_changed).alias("times"))
    every = change.unionByName(none).crossJoin(whole).withColumn("total", F.col("e0") + F.col("de"))
    g = F.zip_with("g0", "dg", lambda x, y: (x + y) / F.col("total"))
    params = every.withColumn("g", g).withColumn("v", slope("g")).select("sample_id", "times", "total", "v", _inner(F.col("v"), F.col("g")).alias("vg"))
    params = materialize(params, "gradients")

    groups = max(1, -(-params.count() * (len(a) + 2) * 8 // GROUP_BYTES))
    blocks = max(1, -(-2 * spark.sparkContext.defaultParallelism // groups))
    ident = ref.schema["gene_id"]

    def cell(rows: pd.DataFrame, samples: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(rows))
        if len(rows):
            z, weight = np.stack(rows["z"].to_numpy()), rows["e"].to_numpy(float)
            for times, of, v, vg in zip(samples["times"], samples["total"], samples["v"], samples["vg"]):
                total += times * _weighed_scores(z, weight, np.asarray(v)[None, :], np.full(len(z), vg), np.full(len(z), of), a)
        return pd.DataFrame({"gene_id": rows["gene_id"], "s": total})

    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = ref.select("gene_id", "z", "e", F.pmod(F.xxhash64("gene_id"), F.lit(blocks)).alias("block"), every_of(groups).alias("group"))
    right = params.select("times", "total", "v", "vg", F.pmod(F.xxhash64("sample_id"), F.lit(groups)).alias("group"), every_of(blocks).alias("block"))
    schema = T.StructType([ident, T.StructField("s", T.DoubleType())])
    sums = left.groupBy("group", "block").cogroup(right.groupBy("group", "block")).applyInPandas(cell, schema).groupBy("gene_id").agg(F.sum("s").alias("total"))

    @F.pandas_udf("double")
    def differs(rows: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for z, e_ref, changed, e_own, v, vg, of in rows:
            if not len(z):
                yield pd.Series([], dtype=float)
                continue
            z, changed, v = (np.stack(x.to_numpy()) for x in (z, changed, v))
            vg, of = vg.to_numpy(float), of.to_numpy(float)
            yield pd.Series(_weighed_scores(changed, e_own.to_numpy(float), v, vg, of, a) - _weighed_scores(z, e_ref.to_numpy(float), v, vg, of, a))

    own = small_vectors(params.where("sample_id is not null").drop("times"), "v")
    fixes = mine.join(own, "sample_id").select("gene_id", differs("z", "e_ref", "own", "e", "v", "vg", "total").alias("fix")).groupBy("gene_id").agg(F.sum("fix").alias("fix"))
    return sums, fixes, 1
