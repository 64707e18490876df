"""Row-level results in a form both engines agree on: every row's values, rounded, beside its keys."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame

from windrow.functions.exprs import r6


def row_values(df: DataFrame, keys: Sequence[str | Column], values: Iterable[str], places: int = 6) -> DataFrame:
    return df.select(*keys, *[r6(v, places).alias(v) for v in values])


def row_values_sql(source: str, keys: Sequence[str], values: Iterable[str], places: int = 6) -> str:
    """SQL twin of :func:`row_values` over the relation ``source``."""
    return f"SELECT {', '.join(keys)}, {', '.join(f'round({v} + 1e-{places + 3}, {places}) + 0 AS {v}' for v in values)} FROM {source}"
