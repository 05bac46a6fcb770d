"""Edge scores over a grid of blocks.

Nodes are dealt to blocks by hash, samples to groups. A cell of the grid is a block of sources, a block of destinations and
a group of samples; it gets the edges between the two blocks and the vectors of their ends in those samples. So a vector is
sent once to each cell that has an edge of its node, not once for each edge, and what leaves a cell is one number per edge.
Cells with many edges are dealt further by edge.

Vectors may be sparse: `base` holds those of the reference, and a sample only the ones that differ. A cell then scores its
edges once for the reference and, for each sample, those with a changed end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import forget, materialize
from .joins import small

#: Bytes of vectors of a cell, about; edges of a cell; edges whose products are taken at once.
CELL_BYTES, CELL_EDGES, STEP = 64 << 20, 1_000_000, 4096
CELL = ["group", "sb", "db", "part"]


def node_key(kind: str, ident: str) -> Column:
    """One text for a node's type and id; null if one of them is."""
    return F.concat(F.col(kind).cast("string"), F.lit("\u0001"), F.col(ident).cast("string"))


def shape(n_edges: int, n_samples: int, own_bytes: int, base_bytes: int, cores: int) -> tuple[int, int]:
    """(blocks, groups of samples): cells within CELL_BYTES, if possible as many as cores, and then the least that is sent."""
    options = []
    for power in range(17):
        blocks = 1 << power
        room = CELL_BYTES * blocks - 2 * base_bytes  # of a row of cells, for the samples' own vectors
        groups = -(-2 * own_bytes // room) if room > 0 else n_samples
        groups = max(1, min(n_samples, max(groups, -(-cores // blocks**2))))
        over = max(0, 2 * (own_bytes / groups + base_bytes) - CELL_BYTES * blocks)
        options.append((over, blocks * blocks * groups < cores, 2 * blocks * (own_bytes + base_bytes * groups) + 24 * n_edges * groups, blocks, groups))
    return min(options)[-2:]


def _products(z: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(np.abs(z[i[k : k + STEP]] * z[j[k : k + STEP]]).sum(axis=1) for k in range(0, len(i), STEP))])


_OUT = pa.schema([("edge_row", pa.int64()), ("s", pa.float64()), ("n", pa.int64()), ("base", pa.float64())])


def _score_cell(edges: pa.Table, vectors: pa.Table) -> pa.Table:
    """By edge the sum over samples of score (less the base's, where there is one), how many, and the base's score."""
    if not edges.num_rows or not vectors.num_rows:
        return _OUT.empty_table()
    keys = pc.dictionary_encode(vectors.column("node").combine_chunks())
    node = keys.indices.to_numpy()
    place = {n: k for k, n in enumerate(keys.dictionary.to_pylist())}
    src, dst = (np.array([place.get(n, -1) for n in edges.column(c).to_pylist()], np.int64) for c in ("src", "dst"))  # -1: no vector
    lists = vectors.column("z").combine_chunks()
    z = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)
    sample = pc.dictionary_encode(vectors.column("sample").combine_chunks()).indices.fill_null(-1).to_numpy()  # -1: base
    row = np.full(len(place) + 1, -1, np.int64)  # the last one stands for ends without a vector
    row[node[sample < 0]] = np.flatnonzero(sample < 0)
    total, times, base = np.zeros(edges.num_rows), np.zeros(edges.num_rows, np.int64), np.full(edges.num_rows, np.nan)
    both = np.flatnonzero((row[src] >= 0) & (row[dst] >= 0))
    base[both] = _products(z, row[src[both]], row[dst[both]])
    order = np.argsort(sample, kind="stable")[np.count_nonzero(sample < 0) :]
    for mine in np.split(order, np.flatnonzero(np.diff(sample[order])) + 1) if len(order) else []:
        own, changed = row.copy(), np.zeros(len(place) + 1, bool)
        own[node[mine]], changed[node[mine]] = mine, True
        at = np.flatnonzero((changed[src] | changed[dst]) & (own[src] >= 0) & (own[dst] >= 0))
        total[at] += _products(z, own[src[at]], own[dst[at]]) - np.nan_to_num(base[at])
        times[at] += 1
    columns = [edges.column("edge_row").combine_chunks(), pa.array(total), pa.array(times), pa.array(base, mask=np.isnan(base))]
    return pa.Table.from_arrays(columns, schema=_OUT).filter(pa.array((times > 0) | ~np.isnan(base)))


def grid_scores(edges: DataFrame, own: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """(edge_row, s, n, base) of the edges (edge_row, src, dst) with vectors at both ends; own: (sample, node, z), base: (node, z).

    s: the sum of |z_src * z_dst| over n samples, less base, the base's own, for each of them. A node has one vector in a sample.
    """
    spark = edges.sparkSession
    own = own.select(F.col("sample").cast("string").alias("sample"), "node", F.col("z").cast("array<double>").alias("z"))
    size = lambda df: (df.agg(F.sum(F.size("z"))).first()[0] or 0) * 8 if df is not None else 0
    n_samples = own.select("sample").distinct().count()
    blocks, groups = shape(edges.count(), max(1, n_samples), size(own), size(base), 2 * spark.sparkContext.defaultParallelism)
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    dealt = edges.withColumns({"sb": block("src"), "db": block("dst")})
    parts = dealt.groupBy("sb", "db").agg(F.ceil(F.count("*") / CELL_EDGES).cast("int").alias("parts"))
    dealt = materialize(dealt.join(small(parts), ["sb", "db"]).withColumn("part", F.pmod(F.xxhash64("edge_row"), F.col("parts")).cast("int")).drop("parts"), "dealt_edges")
    need = materialize(dealt.select(F.explode(F.array("src", "dst")).alias("node"), "sb", "db", "part").distinct(), "cells_of_nodes")
    group = F.pmod(F.xxhash64("sample"), F.lit(groups)).cast("int")
    vectors = own.join(need, "node").withColumn("group", group).select(*CELL, "node", "sample", "z")
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    if base is not None:
        shown = base.select("node", F.col("z").cast("array<double>").alias("z")).join(need, "node").withColumn("group", every)
        vectors = vectors.unionByName(shown.withColumn("sample", F.lit(None).cast("string")).select(*vectors.columns))
    cells = dealt.withColumn("group", every).select(*CELL, "edge_row", "src", "dst")
    scored = cells.groupBy(*CELL).cogroup(vectors.groupBy(*CELL)).applyInArrow(_score_cell, "edge_row long, s double, n long, base double")
    out = materialize(scored.groupBy("edge_row").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.max("base").alias("base")), "edge_sums")
    forget(dealt, need)
    return out
