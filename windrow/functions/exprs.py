"""Small column helpers used everywhere."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def finite(value: ColumnLike) -> Column:
    """Not null, not NaN and not infinite."""
    c = col(value)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def nan_to_null(value: ColumnLike) -> Column:
    c = col(value)
    return F.when(finite(c), c)


def clip(value: ColumnLike, low: ColumnLike | float | None = None, high: ColumnLike | float | None = None) -> Column:
    """Bound a value and keep null as null (``greatest``/``least`` alone would skip nulls)."""
    c = col(value)
    out = c
    if low is not None:
        out = F.greatest(out, _bound(low))
    if high is not None:
        out = F.least(out, _bound(high))
    return F.when(c.isNotNull(), out)


def _bound(value: ColumnLike | float) -> Column:
    return value if isinstance(value, Column) else F.col(value) if isinstance(value, str) else F.lit(float(value))


def total(columns: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def mean_of(columns: Sequence[Column]) -> Column:
    return total(columns) / F.lit(float(len(columns)))


def std_of(columns: Sequence[Column]) -> Column:
    """Population standard deviation across columns of one row."""
    mean = mean_of(columns)
    return F.sqrt(mean_of([(c - mean) * (c - mean) for c in columns]))


def edge_bin(value: ColumnLike, edges: Sequence[float]) -> Column:
    """Right-side bin number: how many inner edges are less than or equal to the value."""
    c = col(value)
    return total([F.when(c >= F.lit(float(e)), 1).otherwise(0) for e in edges]).cast("int")


def edge_bin_array(value: ColumnLike, edges: ColumnLike) -> Column:
    """As :func:`edge_bin` with the edges in an array column."""
    return F.size(F.filter(col(edges), lambda e: e <= col(value)))


def r6(value: ColumnLike, places: int = 6) -> Column:
    """Stable output rounding.

    A thousandth of the last digit is added first, so that an exact tie rounds the same way whatever the order in which a
    distributed sum was formed; ``+ 0.0`` turns a negative zero into zero.
    """
    return F.round(col(value) + F.lit(float(f"1e-{places + 3}")), places) + F.lit(0.0)


def rounded(df: DataFrame, keys: Sequence[str], values: Sequence[str], places: int = 6) -> DataFrame:
    return df.select(*keys, *[r6(v, places).alias(v) for v in values])


def sum_when(condition: Column, value: ColumnLike | None = None) -> Column:
    if value is None:
        return F.coalesce(F.sum(F.when(condition, F.lit(1)).otherwise(0)), F.lit(0)).cast("bigint")
    return F.coalesce(F.sum(F.when(condition, col(value))), F.lit(0.0))


def scalar(df: DataFrame) -> Column:
    """One-row, one-column frame as a scalar subquery."""
    return df.scalar()
