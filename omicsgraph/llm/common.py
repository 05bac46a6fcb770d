"""Helpers that the text operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import forget, materialize, shared_dir

__all__ = ["broadcast_if_small", "by_bytes", "doc_key", "forget", "kept", "map_arrow", "materialize", "shared_dir", "text_bytes"]

#: Bytes of an Arrow batch, set where the session has Spark's own limit.
BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows (counted), else df as it is."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 offsets into them; null counts as empty."""
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def by_bytes(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about `limit` bytes of the text column each (one row at least)."""
    if batch.num_rows == 0:
        return
    _, off = text_bytes(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(off, off[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def doc_key() -> list:
    """Columns that identify a document row: its id and a hash of its text (rows may repeat)."""
    return [F.col("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key")]


#: What this Python worker keeps from one task to the next, by name.
_KEPT: dict[str, tuple] = {}


def kept(name: str, key: object, make: Callable[[], object]) -> object:
    """make(), made once by this worker as long as `key` stays."""
    if name not in _KEPT or _KEPT[name][0] != key:
        _KEPT[name] = (key, make())
    return _KEPT[name][1]


def start_task(name: str | None) -> None:
    """Drop what other operators have kept in this worker."""
    for other in [k for k in _KEPT if k != name]:
        del _KEPT[other]


def end_task() -> None:
    """Give free memory back, so that a worker's size is that of its current task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, keeps: str | None = None) -> DataFrame:
    """df.mapInArrow(run, schema); workers keep only what `keeps` names between tasks.

    The session's limit of bytes per Arrow batch is lowered for good where it is Spark's own: it is read when a plan
    runs, so it can't be set back here.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_LIMIT, "67108864b") == "67108864b":
        conf.set(BATCH_LIMIT, str(BATCH_BYTES))

    def lean(batches):
        start_task(keeps)
        try:
            yield from run(batches)
        finally:
            end_task()

    return df.mapInArrow(lean, schema)
