"""Whitening and clustering against plain numpy on whole tables."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from omicsgraph.llm import clustering, whitening

SF = "/root/testdata/sf0.001"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, x string, cluster int").repartition(3)


def edge_vectors(dim=64):
    rng = np.random.default_rng(3)
    rows = [(k, (rng.standard_normal(dim) * np.linspace(2, 0.1, dim) + 0.3).astype(np.float32).tolist()) for k in range(150)]
    rows += [(200 + k, rows[7][1]) for k in range(60)] + [rows[3], (None, rows[4][1])]  # a third are copies
    return rows + [(900, None), (901, []), (902, [None] * dim), (903, [float("nan")] * dim), (904, [float("inf")] * dim), (905, [3.0e38] * dim)]


# ---------------------------------------------------------------- whitening


def brute_whitening(x):
    fit = np.unique(x, axis=0)
    n, mean = len(fit), fit.mean(axis=0)
    values, vectors = np.linalg.eigh((fit - mean).T @ (fit - mean) / n)
    return n, fit.sum(axis=0), values[::-1], vectors[:, ::-1], mean


def check_whitening(rows, got, dim=64, components=16):
    used = [(i, np.floor(64 * np.array(v, float)).astype(np.int64) + 1_000_000) for i, v in rows if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) and abs(c) < 1e9 for c in v)]
    x = np.array([v for _, v in used])
    n, sums, values, vectors, mean = brute_whitening(x)
    assert len(got) == len(x) * components and {r.n for r in got} == {n}
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    assert sorted((str(r.vec_id), r.deviation) for r in got if r.component == 1) == sorted((str(i), int(d)) for (i, _), d in zip(used, deviation))
    assert max(r.identity_error for r in got) < 1e-9
    for k in range(components):
        mine = [r for r in got if r.component == k + 1]
        assert abs(mine[0].explained / (values[k] / values.sum()) - 1) < 1e-9
        want = {}
        for (i, v), w in zip(used, (x - mean) @ vectors[:, k] / np.sqrt(values[k])):
            want[i] = w
        sign = np.sign(sum(r.whitened * want[r.vec_id] for r in mine))
        assert max(abs(sign * r.whitened - want[r.vec_id]) for r in mine) < 1e-7


def test_whitening(spark):
    rows = edge_vectors()
    check_whitening(rows, whitening.whiten(table(spark, rows)).collect())


def test_whitening_of_a_table(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    check_whitening([(r.vec_id, r.embedding) for r in vectors.collect()], whitening.whiten(vectors).collect())


def test_whitening_edges(spark):
    flat = [(k, [float(k % 2), 1.0, 1.0, 0.0]) for k in range(9)]  # two distinct vectors: one component
    got = whitening.whiten(table(spark, flat)).collect()
    assert len(got) == 9 and {(r.component, r.n, round(abs(r.whitened), 9), round(r.explained, 9)) for r in got} == {(1, 2, 1.0, 1.0)}
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # no variance
    assert whitening.whiten(table(spark, []).limit(0)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "steps"]
    both = whitening.whiten(table(spark, [*flat, *[(50 + k, [float(k), float(k * k)]) for k in range(5)]])).collect()  # two lengths
    assert {(r.n, r.component) for r in both} == {(2, 1), (5, 1), (5, 2)}


@pytest.mark.parametrize("values", [[4.0] * 10, [9, 9, 9, 4, 4, 1e-3, 0, 0, 0, 0], list(np.geomspace(1e4, 1e-4, 10)), [5, 1, 0, 0, 0, 0, 0, 0, 0, 0], [7, 7, 7, 7, 1e-5, 0, 0, 0, 0, 0]])
def test_bidiagonalisation(values):
    """Repeated and missing singular values, also when steps stop early."""
    rng = np.random.default_rng(1)
    q = [np.linalg.qr(rng.standard_normal((n, 10)))[0] for n in (50, 10)]
    x = (q[0] * np.array(values)) @ q[1].T
    product = lambda v, left: (float((x @ v) @ (x @ v)), (x @ left).T @ (x @ v), x.T @ (x @ v))
    vectors, sigma, steps = whitening.bidiagonalise(product, lambda b: x.T @ (x @ b), 10, 3, float((x**2).sum()))
    assert steps <= 10 and np.allclose(sigma[:3], sorted(values)[::-1][:3], rtol=1e-12, atol=1e-9)
    residual = x.T @ (x @ vectors[:, :3]) - vectors[:, :3] * sigma[:3] ** 2
    assert np.abs(residual).max() < 1e-10 * sigma[0] ** 2 and np.allclose(vectors[:, :3].T @ vectors[:, :3], np.eye(3), atol=1e-12)


def test_deviations_of_any_size():
    centre = whitening.Centre(10**9, [3 * 10**9 + 1, -7])
    got = centre.deviations(np.array([[3, 0], [2**38, 5]]))
    assert got == [1 + 49, None]


# ---------------------------------------------------------------- clustering


def brute_clusters(rows, k=8, rounds=10, dim=64):
    used = [(i, np.floor(1024 * np.array(v, float)).astype(np.int64)) for i, v in rows if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) and abs(c) < 60_000 for c in v)]
    x = np.array([v for _, v in used])
    first = sorted(used, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1].tolist()))[:k]
    centroids = np.array([v for _, v in first])
    for r in range(rounds + 1):
        squared = ((x[:, None] - centroids) ** 2).sum(axis=2)
        mine = squared.argmin(axis=1)
        if r < rounds:
            centroids = np.array([x[mine == c].sum(axis=0) // (mine == c).sum() if (mine == c).any() else centroids[c] for c in range(len(centroids))])
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    d = squared[np.arange(len(x)), mine]
    return sorted((str(i), int(c), int(e), int(d[mine == c].sum()), int(d.sum()), names[c]) for (i, _), c, e in zip(used, mine, d))


def clusters(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def test_clustering(spark):
    rows = edge_vectors() + [(950, [1.0] * 63), (951, [1.0] * 65)]
    got = clustering.cluster(table(spark, rows))
    assert clusters(got) == brute_clusters(rows)
    n = len(brute_clusters(rows))
    assert got.first().n_distances < 0.95 * 10 * 8 * n  # the filter leaves fewer than all


def test_clustering_of_a_table(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert clusters(clustering.cluster(vectors)) == brute_clusters([(r.vec_id, r.embedding) for r in vectors.collect()])


def test_clusters_that_lie_apart(spark):
    """Where clusters are real, few exact distances are left."""
    rng = np.random.default_rng(9)
    middles = rng.standard_normal((8, 64))
    rows = [(k, (middles[k % 8] + 0.05 * rng.standard_normal(64)).astype(np.float32).tolist()) for k in range(400)]
    got = clustering.cluster(table(spark, rows))
    assert clusters(got) == brute_clusters(rows)
    assert got.first().n_distances < 0.75 * 10 * 8 * 400


def test_clustering_edges(spark):
    same = [(k, [0.5] * 64) for k in range(20)]  # equal vectors: ties to the smallest number, empty clusters stay
    assert clusters(clustering.cluster(table(spark, same))) == brute_clusters(same)
    few = edge_vectors()[:5]
    assert clusters(clustering.cluster(table(spark, few))) == brute_clusters(few)
    assert clusters(clustering.cluster(table(spark, few), rounds=0)) == brute_clusters(few, rounds=0)
    assert clustering.cluster(table(spark, []).limit(0)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(2)
    for flat in (False, True):
        pivots = rng.integers(-500, 500, (8, 64))
        if flat:
            pivots[3], pivots[5] = pivots[1], (pivots[0] + pivots[2]) // 2
        x, c = rng.integers(-500, 500, (300, 64)), rng.integers(-100, 100, (8, 64))
        simplex = clustering.Simplex(pivots)
        left = clustering.may_be_nearest(simplex.apexes(clustering.distances(x, pivots)), simplex.apexes(clustering.distances(c, pivots)))
        best = clustering.distances(x, c)
        assert left[best == best.min(axis=1, keepdims=True)].all()
        at = clustering.may_be_nearest(simplex.apexes(clustering.distances(x, pivots)), simplex.apexes(clustering.distances(pivots, pivots)))
        assert at.sum() < 1.3 * len(x)  # pivots themselves are told apart by their distances


def test_vector_queries(spark):
    from omicsgraph.llm.queries import QUERIES

    got = QUERIES["op11_whitening"](spark, SF)
    assert got.dtypes[:7] == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    assert got.where(F.col("whitened").isNull()).count() == 0
    assert QUERIES["op13_clustering"](spark, SF).dtypes == [("vec_id", "bigint"), ("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string")]
