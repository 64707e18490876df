"""Joins against dimension tables whose size is checked first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: a dimension of up to this many rows and bytes is sent to every task; a larger one is joined by shuffle
BROADCAST_ROWS, BROADCAST_BYTES = 20_000, 32 << 20


def bounded(small: DataFrame, limit: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame | None:
    """The frame as a local table if it has at most ``limit`` rows and ``size`` bytes, else None.  Reads no more than limit + 1 rows."""
    rows = small.limit(limit + 1).toArrow()
    if rows.num_rows > limit or rows.nbytes > size:
        return None
    return small.sparkSession.createDataFrame(rows, small.schema)


def attach(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join a dimension: broadcast when its size is proven small, a shuffled join (AQE splits hot keys) otherwise."""
    local = bounded(small, limit)
    if local is None:
        return df.join(small, list(keys), how)
    if not keys:
        raise ValueError("attach needs at least one key")
    return df.join(F.broadcast(local), list(keys), how)
