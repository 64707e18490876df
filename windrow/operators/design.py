"""Design matrices: node pivots, spatial means, product pivots."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.functions.timekeys import hours_between
from windrow.functions.wind import calendar_columns


def node_matrix(df: DataFrame, channels: Sequence[str], nodes: Sequence[int], ts: str = "forecast_ts",
                issued: str = "issued_ts", grid: str = "grid_id") -> DataFrame:
    """Registered node x channel columns side by side plus the clock of valid hour and issuance.  For an open list of nodes
    see :func:`node_rows`."""
    cells = [
        F.max(F.when(F.col(grid) == g, F.col(c))).alias(f"grid_{g:02d}__{c}") for c in channels for g in nodes
    ]
    return _with_clock(df.groupBy(ts).agg(F.min(issued).alias("_issued"), *cells), ts)


def node_rows(df: DataFrame, channels: Sequence[str], ts: str = "forecast_ts", issued: str = "issued_ts", grid: str = "grid_id") -> DataFrame:
    """One row per hour, node and channel, for all nodes there are, with the clock of valid hour and issuance."""
    values = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("value")) for c in channels])
    return _with_clock(df.select(ts, F.col(issued).alias("_issued"), grid, F.inline(values)), ts)


def _with_clock(df: DataFrame, ts: str) -> DataFrame:
    two_pi = 2.0 * math.pi
    angles = {
        "forecast_hour": two_pi * F.hour(ts) / 24.0,
        "forecast_dayofyear": two_pi * (F.dayofyear(ts) - 1) / 365.25,
        "run_hour": two_pi * F.hour("_issued") / 24.0,
    }
    out = df.withColumn("lead_hours", hours_between(ts, "_issued"))
    for name, angle in angles.items():
        out = out.withColumn(f"{name}_sin", F.sin(angle)).withColumn(f"{name}_cos", F.cos(angle))
    return out.drop("_issued")


def mean_weather(df: DataFrame, variables: Sequence[str], ts: str = "forecast_ts") -> DataFrame:
    """Plain mean over grids per hour, with the nine calendar columns."""
    means = df.groupBy(ts).agg(*[F.avg(v).alias(f"{v}_mean") for v in variables])
    calendar = calendar_columns(ts)
    return means.select(ts, *[c.alias(n) for n, c in calendar.items()], *[f"{v}_mean" for v in variables])


def pivot_products(df: DataFrame, keys: Sequence[str], product: str, names: Mapping[object, str], value: str) -> DataFrame:
    """Native (key, product) rows to one column per registered product; the list is fixed, so no extra pass finds it."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(product) == F.lit(p), F.col(value))).alias(n) for p, n in names.items()])
