"""Vectors in blocks: whole-number matrices as bytes, so that passes over them read and multiply without conversions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, BATCH_LIMIT

#: Bytes of a block, about.
BLOCK = 2 << 20


def finite(x: Column, scale: float, below: float) -> Column:
    """Whether an array column is there, with no null or non-finite entry and, times scale, all of smaller size than `below`."""
    return x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) < below))


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    """A list column whose lists all have dim entries."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def map_blocks(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow(run, schema) with Arrow batches of a few MB."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_LIMIT, "67108864b") == "67108864b":
        conf.set(BATCH_LIMIT, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def task_sums(blocks: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], bytes | None]) -> list[bytes]:
    """run's bytes of each task. Tasks are as many as twice the cluster's cores, so what reaches the driver doesn't grow
    with the rows."""

    def task(batches):
        found = run(batches)
        if found is not None:
            yield pa.RecordBatch.from_pydict({"sums": pa.array([found], pa.binary())})

    tasks = 2 * blocks.sparkSession.sparkContext.defaultParallelism
    return [bytes(r.sums) for r in map_blocks(blocks.coalesce(tasks), task, "sums binary").collect()]
