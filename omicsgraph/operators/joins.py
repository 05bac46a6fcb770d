"""How small sides of joins are broadcast: only after their rows, or the numbers in their vectors, are counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of ids that are broadcast at most (some tens of MB).
MAX_ROWS = 500_000
#: Bytes of vectors that are broadcast at most.
MAX_BYTES = 64 << 20


def small(df: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows; larger ones are left to a shuffle join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def small_vectors(df: DataFrame, *columns: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """df with a broadcast hint if these columns, arrays of doubles, have at most max_bytes in all. Read twice: write df first."""
    numbers = F.lit(0).cast("long")
    for c in columns:
        numbers = numbers + F.coalesce(F.size(c), F.lit(0)) + 1
    return F.broadcast(df) if (df.agg(F.sum(numbers)).first()[0] or 0) * 8 <= max_bytes else df
