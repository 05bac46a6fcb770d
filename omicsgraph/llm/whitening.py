"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation.

The rows of the fit list, centred, are a matrix X that stays on Spark in blocks. One pass over the blocks is one step: a
task takes p = Xv for its rows, the products of p with the left vectors so far, and Xᵀp; only these sums reach the
driver. A left vector has an entry for each row and is never gathered: it is X times a short vector that the driver
keeps, and tasks form their rows of it. Left and right vectors are orthogonalised against all earlier ones in every step.
X times the right vectors is then the left vectors times a bidiagonal matrix, whose SVD gives components and deviations.

Steps end when the wanted components have converged and the variance outside the right vectors is below the last wanted
eigenvalue (so no equal one can be missed), or when nothing is left; there are at most as many steps as dimensions.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize
from .vectors import BLOCK, finite, map_blocks, matrix, task_sums

#: Scaled entries from this size up take no part: doubles would not hold their sums.
TOO_LARGE = 2.0**40
#: By the root of the total: left vectors shorter than the first before scaling are left out, as rounding would grow in
#: them; right vectors shorter than the second start anew. Shares of the trace that count as none.
SHORT_LEFT, SHORT_RIGHT, NO_SHARE = 1e-6, 1e-9, 1e-10
#: Converged when the residual of each wanted component is this small beside the largest deviation; what is allowed at the end.
CONVERGED, RESIDUAL = 1e-14, 1e-13

Product = Callable[[np.ndarray, np.ndarray], tuple[float, np.ndarray, np.ndarray]]
Gram = Callable[[np.ndarray], np.ndarray]


# ---------------------------------------------------------------- on the driver


def bidiagonalise(product: Product, gram: Gram, dim: int, wanted: int, total: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Right singular vectors (columns) and singular values of X, largest first, at least the `wanted` largest with variance; steps.

    product(v, C) gives |Xv|², (XC)ᵀXv and XᵀXv; gram(B) gives XᵀXB; total is the sum of squares of X. If the vectors' residuals
    show that rounding or a left vector that was left out matters, they are rotated once more within the right vectors.
    """
    right, sigma, vectors, steps = _steps(product, dim, wanted, total)
    best = vectors[:, :wanted]
    if best.size and np.abs(gram(best) - best * sigma[:wanted] ** 2).max() > RESIDUAL * sigma[0] ** 2:
        inner = right.T @ gram(right)
        values, turned = np.linalg.eigh((inner + inner.T) / 2)
        sigma, vectors = np.sqrt(np.maximum(0.0, values[::-1])), right @ turned[:, ::-1]
    return vectors, sigma, steps


def _steps(product: Product, dim: int, wanted: int, total: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    rng, scale = np.random.default_rng(0), np.sqrt(total)
    right, left, back = (np.zeros((dim, 0)) for _ in range(3))  # v; c with u = Xc; Xᵀu
    upper: list[np.ndarray] = []
    v, fresh = np.zeros(dim), True
    while total > 0:
        if fresh:
            v = _apart(rng.standard_normal(dim), right)
        v = _apart(v / np.linalg.norm(v), right)
        v /= np.linalg.norm(v)
        c, along, y = v, np.zeros(right.shape[1]), np.zeros(dim)
        for _ in range(3):
            s, h, y = product(c, left)
            c, y, along = c - left @ h, y - back @ h, along + h
            rest = s - h @ h
            if rest > 0.5 * s or rest <= (1e-3 * SHORT_LEFT * scale) ** 2:
                break
        alpha = np.sqrt(max(rest, 0.0))
        c, y = (c / alpha, y / alpha) if alpha > SHORT_LEFT * scale else (np.zeros(dim), np.zeros(dim))
        right, left, back = (np.column_stack(x) for x in ((right, v), (left, c), (back, y)))
        upper.append(np.append(along, alpha))
        k = len(upper)
        v = _apart(y, right)
        beta = np.linalg.norm(v)
        fresh = beta <= SHORT_RIGHT * scale
        if k == dim or k % 4 == 0 or fresh:
            square = np.zeros((k, k))
            for j, column in enumerate(upper):
                square[: j + 1, j] = column
            p, sigma, q = np.linalg.svd(square)
            outside = total - (square**2).sum()
            sure = k >= wanted and outside < sigma[wanted - 1] ** 2 and beta * np.abs(p[-1, :wanted]).max() <= CONVERGED * sigma[0]
            if k == dim or sure or outside <= NO_SHARE * 1e-3 * total:
                return right, sigma, right @ q.T, k
    return right, np.zeros(0), right, 0


def _apart(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """v without its part in the basis, taken off twice."""
    for _ in range(2):
        v = v - basis @ (basis.T @ v)
    return v


# ---------------------------------------------------------------- over blocks


class Centre:
    """Means of n whole-number vectors with sums S, in two parts so that centred rows keep all digits."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.whole = n, np.array([s // n for s in sums], np.int64)
        self.rest = [s % n for s in sums]
        self.part = np.array([r / n for r in self.rest])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.part

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sum of (n x - S)² of each row; null where it doesn't fit a long."""
        away = x - self.whole
        if x.shape[1] * (self.n * (int(np.abs(away).max(initial=0)) + 1)) ** 2 < 2**63:
            return ((away * self.n - np.array(self.rest, np.int64)) ** 2).sum(axis=1).tolist()
        sums = (sum((self.n * a - r) ** 2 for a, r in zip(row, self.rest)) for row in away.tolist())
        return [s if s < 2**63 else None for s in sums]


def _rows(batch: pa.RecordBatch, dim: int):
    for data in batch.column("data").to_pylist():
        yield np.frombuffer(data, np.int64).reshape(-1, dim)


def _counts(blocks: DataFrame, dim: int) -> Centre:
    def run(batches):
        n, sums = 0, [0] * dim
        for batch in batches:
            for x in _rows(batch, dim):
                n, sums = n + len(x), [a + b for a, b in zip(sums, x.sum(axis=0).tolist())]
        return json.dumps([n, sums]).encode() if n else None

    found = [json.loads(f) for f in task_sums(blocks, run)]
    return Centre(sum(n for n, _ in found), [sum(s) for s in zip(*(s for _, s in found))])


def _sum(blocks: DataFrame, dim: int, centre: Centre, size: int, one: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over blocks of one(centred rows), a vector of `size` doubles."""

    def run(batches):
        out = np.zeros(size)
        for batch in batches:
            for x in _rows(batch, dim):
                out += one(centre.centred(x))
        return out.tobytes()

    return np.sum([np.frombuffer(f) for f in task_sums(blocks, run)], axis=0)


def _product(blocks: DataFrame, dim: int, centre: Centre) -> Product:
    context = blocks.sparkSession.sparkContext

    def product(v, left):
        k, sent = left.shape[1], context.broadcast(np.column_stack([v, left]))

        def one(x):
            both = x @ sent.value  # rows of Xv and of the left vectors
            p = both[:, 0]
            return np.concatenate([p @ both, p @ x])

        out = _sum(blocks, dim, centre, 1 + k + dim, one)
        sent.destroy()
        return float(out[0]), out[1 : 1 + k], out[1 + k :]

    return product


def _gram(blocks: DataFrame, dim: int, centre: Centre) -> Gram:
    return lambda b: _sum(blocks, dim, centre, b.size, lambda x: (x.T @ (x @ b)).ravel()).reshape(b.shape)


class Fit:
    """Components of the vectors of one length: `axes` project a centred row on whitened components."""

    def __init__(self, blocks: DataFrame, dim: int, components: int):
        self.dim, self.centre = dim, _counts(blocks, dim)
        n = self.centre.n
        total = float(_sum(blocks, dim, self.centre, 1, lambda x: np.array([(x**2).sum()]))[0])
        vectors, sigma, self.steps = bidiagonalise(_product(blocks, dim, self.centre), _gram(blocks, dim, self.centre), dim, min(components, dim), total)
        keep = min(components, int((sigma**2 > NO_SHARE * total).sum()))
        self.vectors, self.values = vectors[:, :keep], sigma[:keep] ** 2 / n
        self.explained = sigma[:keep] ** 2 / total if keep else np.zeros(0)
        axes = self.axes = self.vectors / np.sqrt(self.values)

        def products(x):
            w = x @ axes
            return np.concatenate([(w.T @ w).ravel(), w.sum(axis=0)])

        sums = _sum(blocks, dim, self.centre, keep * keep + keep, products) / n
        mean = sums[keep * keep :]
        cov = sums[: keep * keep].reshape(keep, keep) - np.outer(mean, mean)
        self.identity_error = float(np.abs(cov - np.eye(keep)).max(initial=0))


def _pack(batches):
    """Distinct vectors as blocks of one length each."""
    schema = pa.schema([("dim", pa.int32()), ("data", pa.binary())])
    for batch in batches:
        by_dim: dict[int, list[bytes]] = {}
        for x in batch.column(0).to_pylist():
            by_dim.setdefault(len(x) // 8, []).append(x)
        for dim, rows in by_dim.items():
            step = max(1, BLOCK // (8 * dim))
            data = [b"".join(rows[at : at + step]) for at in range(0, len(rows), step)]
            yield pa.RecordBatch.from_arrays([pa.array([dim] * len(data), pa.int32()), pa.array(data, pa.binary())], schema=schema)


def whole_vectors(vectors: DataFrame, scale: float, shift: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, dim, x): floor(scale * entry) + shift of the rows that take part, as bytes of longs."""
    x = F.col(vec_col)
    rows = vectors.where(finite(x, scale, TOO_LARGE) & (F.size(x) > 0)).select(F.col(id_col).cast("long").alias("vec_id"), F.size(x).alias("dim"), x.cast("array<double>").alias("x"))

    def run(batches):
        schema = pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("x", pa.binary())])
        for batch in batches:
            dims = batch.column(1).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                data = np.floor(scale * matrix(part.column(2), dim)).astype(np.int64) + shift
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array([r.tobytes() for r in data], pa.binary())], schema=schema)

    return map_blocks(rows, run, "vec_id long, dim int, x binary")


def whiten(vectors: DataFrame, components: int = 16, scale: float = 64.0, shift: int = 1_000_000, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, steps) of each row that takes part and each component.

    x = floor(scale * entry) + shift. Components are unit eigenvectors of the covariance of the distinct x vectors, n of
    them, numbered from 1 by falling eigenvalue; those with no variance (a share of the trace up to NO_SHARE) are left
    out, so equal vectors alone give no rows. deviation is exact, null where it doesn't fit a long.

    Vectors that are null, empty, or hold null, non-finite or too large entries (TOO_LARGE, after scaling) take no part.
    Vectors of different length are fitted apart, one length after another. Repeated rows and null ids stay; columns
    other than the two are ignored; an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    rows = materialize(whole_vectors(vectors, scale, shift, id_col, vec_col), "whole_vectors")
    blocks = materialize(map_blocks(rows.select("x").distinct(), _pack, "dim int, data binary"), "fit_blocks")
    parts = []
    for (dim,) in blocks.select("dim").distinct().orderBy("dim").collect():
        fit = Fit(blocks.where(F.col("dim") == dim).select("data"), dim, components)
        parts.append(_whitened(rows.where(F.col("dim") == dim).select("vec_id", "x"), fit))
    forget(blocks)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, steps int"
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def _whitened(rows: DataFrame, fit: Fit) -> DataFrame:
    centre, axes, dim = fit.centre, fit.axes, fit.dim

    def run(batches):
        schema = pa.schema([("vec_id", pa.int64()), ("deviation", pa.int64()), ("w", pa.list_(pa.float64()))])
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64).reshape(-1, dim)
            w = centre.centred(x) @ axes
            lists = pa.ListArray.from_arrays(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1], w.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(centre.deviations(x), pa.int64()), lists], schema=schema)

    out = map_blocks(rows, run, "vec_id long, deviation long, w array<double>")
    out = out.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    share = F.element_at(F.array(*map(F.lit, fit.explained.tolist())).cast("array<double>"), F.col("at") + 1)
    return out.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(centre.n).cast("long").alias("n"), "deviation", "whitened",
        share.alias("explained"), F.lit(fit.identity_error).alias("identity_error"), F.lit(fit.steps).alias("steps"),
    )
