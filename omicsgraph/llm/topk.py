"""Exact top-k by inner product with vector-approximation files.

The approximation file has one byte per component: a cell number between the vector's smallest and largest component.
Queries and cells are dealt to blocks of about BLOCK_BYTES; a task scans a block of cells for a block of queries and
gives the pairs whose upper bound isn't below k lower bounds, so at most k of those whose bounds are exact. The first
blocks (as many as the root of all) give each query a floor that the scan of the others starts from. Of all pairs those
above the k-th lower bound are left. Their exact vectors are read in order of the bounds, highest upper bound first (for
products what the lowest lower bound is for distances), in rounds of k, 4k, 16k ... for a query; it is done when no unread
upper bound reaches its k-th exact product.

Components are floor(scale * x) with x as double. Vectors that are null or hold null or non-finite components (also
after scaling) take no part, and vectors of different length don't meet. Rows that repeat are candidates of each
other; ids may be null and come last. Of equal vectors the k + 1 with the smallest ids can be results, so no others are
scanned. Products are exact whole numbers of any size; a score that doesn't fit a long is given as the nearest long,
while its rank follows the exact product. An empty table gives an empty one. Columns other than the two are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, forget, map_arrow, materialize

#: Bytes of a block of cells and of a block of queries; rows compared at once in a task.
BLOCK_BYTES, STEP, QUERIES_AT_ONCE = 32 << 20, 4096, 256
#: Tables of numbers of blocks are broadcast up to so many vector lengths.
MAX_DIMS = 10_000
#: Approximations are scaled by this, so that bounds of the largest doubles don't overflow.
SMALL = 2.0**-64
LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1


# ---------------------------------------------------------------- bounds


def approximate(v: np.ndarray) -> tuple[np.ndarray, ...]:
    """Cells of whole-number vectors, and of each vector low and width of its cells, largest error, largest component."""
    v = v * SMALL
    low = v.min(axis=1)
    width = np.maximum(SMALL, v.max(axis=1) / 255 - low / 255)
    cells = np.clip(np.rint((v - low[:, None]) / width[:, None]), 0, 255)
    error = np.abs(v - (low[:, None] + cells * width[:, None])).max(axis=1)
    return cells.astype(np.uint8), low, width, error, np.abs(v).max(axis=1)


class Scan:
    """The approximations of a block of candidates, in order of id."""

    def __init__(self, cells: np.ndarray, low: np.ndarray, width: np.ndarray, error: np.ndarray, most: np.ndarray):
        self.cells, self.low, self.width, self.error, self.most = cells, low, width, error, most
        self.slack = most * (cells.shape[1] + 8) * 2.0**-50  # what sums of doubles can be off

    def bounds(self, queries: np.ndarray, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """Middle of the inner products with the vectors in `rows` and how far off these can be, by query, each query
        scaled by a power of two. Off by 0 means that the middle is the product."""
        largest = np.abs(queries).max(axis=1)
        scale = np.ldexp(1.0, -np.frexp(np.where(largest > 0, largest, 1.0))[1])
        q = queries * scale[:, None]
        middle = np.outer(q.sum(axis=1), self.low[rows]) + (q @ self.cells[rows].T.astype(float)) * self.width[rows]
        total = np.abs(q).sum(axis=1)
        exact = (self.error[rows] == 0) & (np.outer(total / scale, self.most[rows] / SMALL) < 2.0**51)
        off = np.where(exact | (total == 0)[:, None], 0.0, np.outer(total, self.error[rows] + self.slack[rows]))
        return middle, off

    def survivors(self, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, numbers: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """(query, place, lower, upper) of the pairs that may be among the k best; own: the queries' row numbers."""
        best = np.full((len(queries), k), -np.inf)
        found: list[tuple[np.ndarray, ...]] = []
        for at in range(0, len(self.cells), STEP):
            part = slice(at, min(at + STEP, len(self.cells)))
            middle, off = self.bounds(queries, part)
            middle[own[:, None] == numbers[part][None, :]] = -np.inf
            lower = middle - off
            best = np.partition(np.concatenate([best, lower], axis=1), -k, axis=1)[:, -k:]
            floor = np.maximum(floor, best.min(axis=1))
            may = (middle + off >= floor[:, None]) & (middle > -np.inf)
            q, place = np.nonzero(may)
            found.append(_cut_ties(q, place + at, lower[q, place], middle[q, place] + off[q, place], k))
        q, place, lower, upper = (np.concatenate(x) for x in zip(*found))
        left = upper >= floor[q]
        return _cut_ties(q[left], place[left], lower[left], upper[left], k)


def _cut_ties(q: np.ndarray, place: np.ndarray, lower: np.ndarray, upper: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Pairs in order of query, lower bound and id, without the exact ones that k others precede."""
    order = np.lexsort((place, -lower, q))
    q, place, lower, upper = q[order], place[order], lower[order], upper[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    left = (upper > lower) | (rank < k)
    return q[left], place[left], lower[left], upper[left]


# ---------------------------------------------------------------- the job


def _matrix(col: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in (col.chunks if isinstance(col, pa.ChunkedArray) else [col])]
    return np.concatenate(flat).reshape(-1, dim) if flat else np.zeros((0, dim))


def _approximations(batches):
    numbers = [pa.field(c, pa.float64()) for c in ("low", "width", "error", "most")]
    schema = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("dim", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("cells", pa.binary()), *numbers])
    for batch in batches:
        dims = batch.column(2).to_numpy(zero_copy_only=False)
        for dim in np.unique(dims).tolist():
            part = batch.filter(pa.array(dims == dim))
            cells, *rest = approximate(_matrix(part.column(5), dim))
            yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array([c.tobytes() for c in cells], pa.binary()), *map(pa.array, rest)], schema=schema)


def _scan_block(k: int):
    schema = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("lower", pa.float64()), ("upper", pa.float64())])

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        right = right.sort_by([("id", "ascending"), ("row", "ascending")])
        cells = np.frombuffer(b"".join(right.column("cells").to_pylist()), np.uint8).reshape(right.num_rows, -1)
        scan = Scan(cells, *(right.column(c).to_numpy() for c in ("low", "width", "error", "most")))
        numbers, out = right.column("row").to_numpy(), []
        for at in range(0, left.num_rows, QUERIES_AT_ONCE):
            part = left.slice(at, QUERIES_AT_ONCE)
            q, place, lower, upper = scan.survivors(_matrix(part.column("v"), key[0].as_py()), part.column("row").to_numpy(), part.column("floor").to_numpy(), numbers, k)
            of, c = part.take(pa.array(q)), right.take(pa.array(place))
            out.append(pa.table([of.column("row"), of.column("id"), c.column("row"), c.column("id"), pa.array(lower), pa.array(upper)], schema=schema))
        return pa.concat_tables(out)

    return run, "query_row long, query_id long, row long, vec_id long, lower double, upper double"


def _products(batches):
    """Exact inner products: the nearest long, whether it is below (-1) or above (1), and then a key that sorts them; and the
    product on the scale of the query's bounds, rounded down."""
    schema = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("beyond", pa.int32()), ("key", pa.binary()), ("low", pa.float64())])
    for batch in batches:
        scores, beyond, keys, lows = [], [], [], []
        for q, v in zip(batch.column(3), batch.column(4)):
            q, v = q.values.to_numpy(), v.values.to_numpy()
            product = q @ v if np.abs(q).sum() * np.abs(v).max(initial=0) < 2.0**53 else sum(int(a) * int(b) for a, b in zip(q.tolist(), v.tolist()))
            product = int(product)
            scores.append(min(max(product, LONG_MIN), LONG_MAX))
            beyond.append((product > LONG_MAX) - (product < LONG_MIN))
            keys.append((product + (1 << 2150)).to_bytes(270, "big") if beyond[-1] else None)
            largest = np.abs(q).max(initial=0.0)
            shift = int(np.frexp(largest if largest > 0 else 1.0)[1]) + 64  # as Scan.bounds() scales: by the query and by SMALL
            low = float(product / (1 << shift)) if shift >= 0 else float(product << -shift)
            lows.append(low - abs(low) * 2.0**-50)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(scores, pa.int64()), pa.array(beyond, pa.int32()), pa.array(keys, pa.binary()), pa.array(lows, pa.float64())], schema=schema)


def _above(pairs: DataFrame, k: int) -> DataFrame:
    """The pairs that k lower bounds don't exclude, with `kth`, the k-th lower bound of the query (null if fewer)."""
    own = Window.partitionBy("query_row")
    place = F.row_number().over(own.orderBy(F.col("lower").desc(), F.col("vec_id").asc_nulls_last(), "row"))
    kth = F.max(F.when(F.col("place") == k, F.col("lower"))).over(own)
    left = pairs.withColumn("place", place).withColumn("kth", kth)
    return left.where((F.col("kth").isNull() | (F.col("upper") >= F.col("kth"))) & ((F.col("upper") > F.col("lower")) | (F.col("place") <= k)))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row where is_query holds, its own row left out.

    Highest score first, ties to the smaller id. Fewer than k rows where there are fewer candidates.
    """
    x = F.col(vec_col)
    scaled = F.transform(x, lambda c: F.lit(scale) * c.cast("double"))
    fine = x.isNotNull() & F.forall(scaled, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & (F.size(x) > 0)
    whole = F.transform(scaled, lambda c: F.when(F.abs(c) < 2.0**53, F.floor(c).cast("double")).otherwise(c))  # larger ones are whole
    rows = vectors.where(fine).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"), F.size(x).alias("dim"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    queries = rows.where("asks").select("row", "id", "dim", "v")
    hashed = rows.select("row", "id", "dim", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"), "v")
    cells = map_arrow(hashed, _approximations, "row long, id long, dim int, h1 long, h2 long, cells binary, low double, width double, error double, most double")
    alike = Window.partitionBy("dim", "h1", "h2").orderBy(F.col("id").asc_nulls_last(), "row")
    cells = materialize(cells.withColumn("place", F.row_number().over(alike)).where(F.col("place") <= k + 1).drop("h1", "h2", "place"), "cells")

    # blocks by bytes, of each vector length
    lines = vectors.sparkSession.sparkContext.defaultParallelism
    n_cells, n_queries = F.count_if(~F.col("asks")), F.count_if("asks")
    blocks = cells.select("dim", F.lit(False).alias("asks")).union(queries.select("dim", F.lit(True).alias("asks"))).groupBy("dim").agg(
        F.greatest(F.ceil(n_cells * F.col("dim") / BLOCK_BYTES), F.least(F.lit(lines), F.ceil(n_cells / STEP))).cast("int").alias("n_c"),
        F.ceil(n_queries * F.col("dim") * 8 / BLOCK_BYTES).cast("int").alias("n_q"),
    )
    blocks = materialize(blocks.where("n_q > 0").withColumn("first", F.ceil(F.sqrt("n_c")).cast("int")), "blocks")
    known = broadcast_if_small(blocks, MAX_DIMS)
    mine = lambda n: F.pmod(F.xxhash64("row"), n).cast("int")
    numbers = F.sequence(F.lit(0), F.col("n_q") - 1)
    dealt = cells.join(known, "dim").withColumn("cb", mine(F.col("n_c"))).withColumn("qb", F.explode(numbers))
    run, schema = _scan_block(k)

    def scanned(asking: DataFrame, first: bool) -> DataFrame:
        low, high = (F.lit(0), F.col("first") - 1) if first else (F.col("first"), F.col("n_c") - 1)
        left = asking.join(known, "dim").where(low <= high).withColumn("qb", mine(F.col("n_q"))).withColumn("cb", F.explode(F.sequence(low, high)))
        right = dealt.where((F.col("cb") < F.col("first")) == F.lit(first)).drop("n_c", "n_q", "first")
        left = left.select("dim", "qb", "cb", "row", "id", "v", "floor")
        return left.groupBy("dim", "qb", "cb").cogroup(right.groupBy("dim", "qb", "cb")).applyInArrow(run, schema)

    none = F.lit(float("-inf"))
    pairs = materialize(_above(scanned(queries.withColumn("floor", none), True), k), "pairs")
    if not blocks.where("n_c > first").isEmpty():
        floors = pairs.groupBy(F.col("query_row").alias("row")).agg(F.max("kth").alias("floor"))
        asking = queries.join(floors, "row", "left").withColumn("floor", F.coalesce("floor", none))
        columns = ["query_row", "query_id", "row", "vec_id", "lower", "upper"]
        pairs = materialize(_above(pairs.select(*columns).union(scanned(asking, False)), k), "pairs")
    return _read_in_order(pairs, rows, queries, k).select("query_id", "rank", "vec_id", "score")


def _read_in_order(pairs: DataFrame, rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best pairs of each query by exact product, with rank and `n_read`, how many vectors were read for the query."""
    exact = rows.select("row", "v")
    asked = queries.select(F.col("row").alias("query_row"), F.col("v").alias("q"))
    own = Window.partitionBy("query_row")
    best = own.orderBy(F.col("beyond").desc(), F.col("score").desc(), F.col("key").desc(), F.col("vec_id").asc_nulls_last())
    by_bound = own.orderBy(F.col("upper").desc(), F.col("lower").desc(), F.col("vec_id").asc_nulls_last(), "row")
    todo = materialize(pairs.select("query_row", "query_id", "row", "vec_id", "upper", F.row_number().over(by_bound).alias("place")), "todo")
    found, many = None, k
    while True:
        read = todo.where(F.col("place") <= many).join(exact, "row").join(asked, "query_row").select("query_row", "query_id", "vec_id", "q", "v")
        got = map_arrow(read, _products, "query_row long, query_id long, vec_id long, score long, beyond int, key binary, low double").withColumn("n_read", F.lit(1).cast("long"))
        every = got if found is None else got.unionByName(found)
        ranked = every.withColumn("n_read", F.sum("n_read").over(own)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        before, found = found, materialize(ranked.withColumn("n_read", F.when(F.col("rank") == 1, F.col("n_read")).otherwise(0)).drop("rank"), "found")
        if before is not None:
            forget(before)
        kth = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("query_row", F.col("low").alias("kth"))
        left = todo.where(F.col("place") > many).join(kth, "query_row", "left").where(F.col("kth").isNull() | (F.col("upper") >= F.col("kth"))).drop("kth")
        left = materialize(left, "todo")
        forget(todo)
        todo, many = left, 4 * many
        if todo.isEmpty():
            return found.withColumn("rank", F.row_number().over(best)).withColumn("n_read", F.max("n_read").over(own))
