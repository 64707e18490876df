"""Gap filling that uses nothing but the same forecast issuance, then training fallbacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from windrow.functions.exprs import sum_when, total
from windrow.functions.ranks import exact_quantiles
from windrow.operators.lookups import attach
from windrow.session import checkpoint


def missing_counts(df: DataFrame, variables: Sequence[str], ts: str = "forecast_ts") -> DataFrame:
    """Missing cells and grids with any missing cell per hour, before filling."""
    nulls = [F.col(v).isNull() for v in variables]
    anything = nulls[0]
    for n in nulls[1:]:
        anything = anything | n
    return df.groupBy(ts).agg(
        F.sum(total([n.cast("int") for n in nulls])).cast("bigint").alias("raw_missing_cells"),
        sum_when(anything).alias("raw_missing_grids"),
    )


def fill_in_time(df: DataFrame, variables: Sequence[str], run: str = "issued_ts", grid: str = "grid_id",
                 ts: str = "forecast_ts") -> DataFrame:
    """Midpoint of the previous and the next known value of the same run and grid, else the one that is known."""
    w = Window.partitionBy(run, grid).orderBy(ts)
    back = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    out = {}
    for v in variables:
        before, after = F.last(v, ignorenulls=True).over(back), F.first(v, ignorenulls=True).over(ahead)
        out[v] = F.coalesce(F.col(v), (before + after) * 0.5, before, after)
    return df.withColumns(out)


def long_form(df: DataFrame, keys: Sequence[str], variables: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value")) for v in variables])
    return df.select(*keys, F.inline(pairs))


def training_medians(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """(variable, median): the last fallback, learned from training rows only."""
    q = exact_quantiles(long_form(df, [], variables), ["variable"], "value", [0.5])
    return q.select("variable", F.col("q")[0].alias("median"))


def fill_gaps(df: DataFrame, variables: Sequence[str], fallback: DataFrame, run: str = "issued_ts", grid: str = "grid_id",
              ts: str = "forecast_ts") -> DataFrame:
    """Temporal fill, then the median over grids of the same hour (of the temporally filled values), then the training
    median, then zero.  Spatial medians are formed only for the (hour, variable) pairs that still have a gap."""
    filled = checkpoint(fill_in_time(df, variables, run, grid, ts))  # read by three branches
    cells = long_form(filled, [ts], variables)
    gaps = cells.where(F.col("value").isNull()).select(ts, "variable").distinct()
    medians = exact_quantiles(cells.join(gaps, [ts, "variable"], "left_semi"), [ts, "variable"], "value", [0.5])
    wide = medians.groupBy(ts).pivot("variable", list(variables)).agg(F.first(F.col("q")[0]))
    for v in variables:
        wide = wide.withColumnRenamed(v, f"{v}__spatial")
    last = {r["variable"]: r["median"] for r in fallback.limit(len(variables) + 1).collect()}
    joined = attach(filled, wide, [ts])
    return joined.withColumns({
        v: F.coalesce(F.col(v), F.col(f"{v}__spatial"), F.lit(last.get(v)).cast("double"), F.lit(0.0)) for v in variables
    }).drop(*[f"{v}__spatial" for v in variables])
