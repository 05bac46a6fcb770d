"""Exact centroid clustering with an n-simplex filter.

Some centroids serve as pivots. A vector's distances to the pivots, which are exact and kept, place it as the apex of a
simplex over them: its coordinates along the pivots' span and its height above it. A centroid's distances to the pivots
place it the same way. Whatever lies in the other dimensions, the squared distance of the two is at least the squared
difference of these coordinates, and at most the same with the heights added instead of subtracted. Centroids whose lower
bound is above the least upper bound can't be nearest; if several are left, whole-number distances decide.

Pivots are renewed in the rounds of RENEW, when centroids have moved: distances to all centroids are then taken anyway.
Vectors stay in blocks on Spark; only sums by cluster reach the driver.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize
from .vectors import BLOCK, finite, map_blocks, matrix, task_sums

#: Scaled components from this size up take no part, so that squared distances fit a long.
TOO_LARGE = 2.0**26
#: Rounds whose centroids become pivots.
RENEW = (0, 1, 3, 7)
#: A pivot that lies this close (squared, by the largest) to the span of those before it adds nothing.
FLAT = 1e-6
#: What bounds can be off, by the squared distances that they come from.
SLACK = 1e-7


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to centroids."""
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


@dataclass
class Simplex:
    """The simplex over pivots: which of them span it, and the triangular matrix of their coordinates."""

    pivots: np.ndarray

    def __post_init__(self):
        away = (self.pivots[1:] - self.pivots[0]).astype(float)
        used: list[int] = []
        rows: list[np.ndarray] = []
        most = (away**2).sum(axis=1).max(initial=0)
        for k, a in enumerate(away):
            row = np.zeros(len(used))
            for j, (u, r) in enumerate(zip(used, rows)):
                row[j] = (a @ away[u] - row[:j] @ r[:j]) / r[j]
            height = a @ a - row @ row
            if height > FLAT * most:
                used.append(k)
                rows.append(np.append(row, np.sqrt(height)))
        self.used = np.array(used, int)
        self.base = np.zeros((len(rows), len(rows)))
        for j, r in enumerate(rows):
            self.base[j, : len(r)] = r
        self.squares = (self.base**2).sum(axis=1)

    def apexes(self, squared: np.ndarray) -> np.ndarray:
        """Rows of coordinates, the height last, and the squared distance to the first pivot, from squared distances to all pivots."""
        first = squared[:, 0].astype(float)
        along = np.zeros((len(first), len(self.used)))
        for j, k in enumerate(self.used):
            inner = (first - squared[:, 1 + k] + self.squares[j]) / 2
            along[:, j] = (inner - along[:, :j] @ self.base[j, :j]) / self.base[j, j]
        height = np.sqrt(np.maximum(0.0, first - (along**2).sum(axis=1)))
        return np.column_stack([along, height, first])


def may_be_nearest(apexes: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """By row and centroid: whether the bounds leave it as nearest."""
    span = sum((apexes[:, None, j] - centres[None, :, j]) ** 2 for j in range(apexes.shape[1] - 2))
    low, high = apexes[:, None, -2] - centres[None, :, -2], apexes[:, None, -2] + centres[None, :, -2]
    slack = SLACK * (apexes[:, -1:] + centres[:, -1].max(initial=0) + 1)
    return span + low**2 <= (span + high**2).min(axis=1, keepdims=True) + slack


def nearest(x: np.ndarray, centroids: np.ndarray, apexes: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, int]:
    """The nearest centroid of each row (smaller number on ties), and how many exact distances that took."""
    left = may_be_nearest(apexes, centres)
    out = left.argmax(axis=1)
    open_ = np.nonzero(left.sum(axis=1) > 1)[0]
    row, at = np.nonzero(left[open_])
    least = np.full((len(open_), len(centroids)), np.iinfo(np.int64).max)
    least[row, at] = ((x[open_[row]] - centroids[at]) ** 2).sum(axis=1)
    out[open_] = least.argmin(axis=1)
    return out, len(row)


def _sums(x: np.ndarray, cluster: np.ndarray, k: int) -> np.ndarray:
    """By cluster the number of rows and the sums of their components."""
    out = np.zeros((k, x.shape[1] + 1), np.int64)
    for c in np.unique(cluster):
        mine = x[cluster == c]
        out[c, 0], out[c, 1:] = len(mine), mine.sum(axis=0)
    return out


def _moved(found: list[np.ndarray], centroids: np.ndarray) -> np.ndarray:
    """Centroids as floors of exact means; those of empty clusters stay."""
    totals = sum((f.astype(object) for f in found), np.zeros((len(centroids), centroids.shape[1] + 1), object))
    return np.array([[s // t[0] for s in t[1:]] if t[0] else c for t, c in zip(totals.tolist(), centroids.tolist())], np.int64)


def _block(batch: pa.RecordBatch, dim: int):
    for ids, data, apexes in zip(*(batch.column(c).to_pylist() for c in ("ids", "data", "apexes"))):
        x = np.frombuffer(data, np.int32).reshape(-1, dim).astype(np.int64)
        yield ids, data, x, np.frombuffer(apexes).reshape(len(x), -1) if apexes is not None else None


def _renewed(blocks: DataFrame, dim: int, simplex: Simplex) -> DataFrame:
    """Blocks with apexes over new pivots, the current centroids, and the sums of the rows nearest to each."""
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("data", pa.binary()), ("apexes", pa.binary()), ("sums", pa.binary())])

    def run(batches):
        for batch in batches:
            for ids, data, x, _ in _block(batch, dim):
                squared = distances(x, simplex.pivots)
                sums = _sums(x, squared.argmin(axis=1), len(simplex.pivots))
                yield pa.RecordBatch.from_pylist([{"ids": ids, "data": data, "apexes": simplex.apexes(squared).tobytes(), "sums": sums.tobytes()}], schema=schema)

    return materialize(map_blocks(blocks.select("ids", "data", "apexes"), run, "ids array<long>, data binary, apexes binary, sums binary"), "apexes")


def _round(blocks: DataFrame, dim: int, centroids: np.ndarray, centres: np.ndarray | None) -> tuple[list[np.ndarray], int]:
    """Sums by cluster of each task, and exact distances taken; centres None: the sums that _renewed() wrote are read."""
    shape = (len(centroids), dim + 1)

    def run(batches):
        out, taken = np.zeros(shape, np.int64), 0
        for batch in batches:
            if centres is None:
                for sums in batch.column("sums").to_pylist():
                    out += np.frombuffer(sums, np.int64).reshape(shape)
                    taken += int(np.frombuffer(sums, np.int64).reshape(shape)[:, 0].sum()) * len(centroids)
            else:
                for _, _, x, apexes in _block(batch, dim):
                    cluster, n = nearest(x, centroids, apexes, centres)
                    out, taken = out + _sums(x, cluster, len(centroids)), taken + n
        return np.append(out.ravel(), taken).tobytes()

    columns = ["sums"] if centres is None else ["ids", "data", "apexes"]
    found = [np.frombuffer(f, np.int64) for f in task_sums(blocks.select(*columns), run)]
    return [f[:-1].reshape(shape) for f in found], int(sum(f[-1] for f in found))


class Clustering:
    """Centroids after the rounds, blocks with apexes, and by round how many exact distances were taken."""

    def __init__(self, kept: DataFrame, k: int, rounds: int, seed: str, dim: int):
        start = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
        first = kept.select(start.alias("hash"), "v").orderBy("hash", "v").limit(k).collect()
        self.centroids = np.array([r.v for r in first], np.int64).reshape(len(first), dim)
        self.blocks, self.taken = materialize(map_blocks(kept, _packer(dim), "ids array<long>, data binary, apexes binary"), "vector_blocks"), []
        if not first:
            return
        for r in range(rounds):
            if r in RENEW:
                self.simplex = Simplex(self.centroids)
                before, self.blocks = self.blocks, _renewed(self.blocks, dim, self.simplex)
                forget(before)
            sums, n = _round(self.blocks, dim, self.centroids, None if r in RENEW else self.centres())
            self.centroids = _moved(sums, self.centroids)
            self.taken.append(n)

    def centres(self) -> np.ndarray:
        return self.simplex.apexes(distances(self.centroids, self.simplex.pivots))


def _packer(dim: int):
    def run(batches):
        schema = pa.schema([("ids", pa.list_(pa.int64())), ("data", pa.binary()), ("apexes", pa.binary())])
        step = max(1, BLOCK // (4 * dim))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                data = matrix(batch.column(1), dim).astype(np.int32).tobytes()
                yield pa.RecordBatch.from_pylist([{"ids": batch.column(0).to_pylist(), "data": data, "apexes": None}], schema=schema)

    return run


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: float = 1024.0, seed: str = "3", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, n_distances) of each vector that takes part.

    Vectors have exactly dim components, floor(scale * x); those that are null, of another length, or hold null,
    non-finite or too large components (TOO_LARGE, after scaling) take no part. Centroids start as the k vectors with the
    smallest SHA-256 of seed:id (equal ones by their components; a null id is empty; fewer vectors give fewer centroids).
    Each round assigns every vector to the nearest centroid, smaller number on ties, and moves centroids to the floors of
    the exact means; empty ones stay. distance is squared, after the last move. n_distances: exact distances taken in all
    rounds for all vectors. Repeated rows count as often as they are there; columns other than the two are ignored; an
    empty table gives an empty one.
    """
    x = F.col(vec_col)
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("int"))
    fine = (F.size(x) == dim) & finite(x, scale, TOO_LARGE)
    found = Clustering(vectors.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v")), k, rounds, seed, dim)
    schema = "vec_id long, cluster int, distance long"
    if not len(found.centroids):
        return vectors.sparkSession.createDataFrame([], schema + ", cluster_inertia long, inertia long, centroid_sha256 string, n_distances long")
    centroids, centres = found.centroids, found.centres() if rounds else None

    def run(batches):
        out = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])
        for batch in batches:
            for ids, _, x, apexes in _block(batch, dim):
                mine = nearest(x, centroids, apexes, centres)[0] if centres is not None else distances(x, centroids).argmin(axis=1)
                squared = ((x - centroids[mine]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(mine, pa.int32()), pa.array(squared, pa.int64())], schema=out)

    assigned = materialize(map_blocks(found.blocks.select("ids", "data", "apexes"), run, schema), "assigned")
    forget(found.blocks)
    sums = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows at most
    text = [",".join(map(str, row)) for row in centroids.tolist()]
    known = [(c, s, sum(sums.values()), hashlib.sha256(text[c].encode()).hexdigest(), sum(found.taken)) for c, s in sums.items()]
    names = vectors.sparkSession.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, n_distances long")
    return assigned.join(F.broadcast(names), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_distances")
