"""Meta features of component forecasts, daily run features and targets over groups."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.functions.exprs import ColumnLike, col, mean_of, std_of
from windrow.functions.timekeys import RUN_HOURS, YEAR_DAYS, run_position


def meta_features(base: str, components: Sequence[str], differences: Sequence[tuple[str, str]], ts: ColumnLike, capacity: ColumnLike,
                  weather: Mapping[str, ColumnLike] | None = None) -> dict[str, Column]:
    """Capacity factors of baseline and components, their spread, pair differences, weather as given, and the clock."""
    cf = {c: F.col(c) / col(capacity) for c in (base, *components)}
    parts = [cf[c] for c in components]
    position = run_position(ts).cast("double")
    lead, day = 2.0 * math.pi * position / RUN_HOURS, 2.0 * math.pi * (F.dayofyear(col(ts)) - 1.0) / YEAR_DAYS
    low, high = F.least(*parts), F.greatest(*parts)
    return {
        "base_cf": cf[base], **{f"{c}_cf": cf[c] for c in components},
        "component_mean_cf": mean_of(parts), "component_std_cf": std_of(parts), "component_min_cf": low, "component_max_cf": high,
        "component_range_cf": high - low, **{f"{a}_minus_{b}_cf": cf[a] - cf[b] for a, b in differences},
        **{n: col(c) for n, c in (weather or {}).items()},
        "lead_fraction": position / (RUN_HOURS - 1.0), "lead_sin": F.sin(lead), "lead_cos": F.cos(lead),
        "day_of_year_sin": F.sin(day), "day_of_year_cos": F.cos(day),
    }


def daily_features(df: DataFrame, keys: Sequence[str], baseline_cf: Column, series: Mapping[str, Column], day: ColumnLike) -> DataFrame:
    """One row per complete run: mean baseline, moments and quartiles of every series, and the season.  A run has 24 rows,
    so the exact quartiles are bounded."""
    aggs = [F.count(F.lit(1)).alias("_n"), F.avg(baseline_cf).alias("baseline_daily_mean_cf")]
    for name, c in series.items():
        aggs += [F.avg(c).alias(f"{name}_mean"), F.stddev_pop(c).alias(f"{name}_std"),
                 *[F.percentile(c, F.lit(p)).alias(f"{name}_q{int(p * 100)}") for p in (0.25, 0.5, 0.75)]]
    angle = 2.0 * math.pi * (F.dayofyear(col(day)) - 1.0) / YEAR_DAYS
    out = df.groupBy(*keys).agg(*aggs).where(F.col("_n") == RUN_HOURS).drop("_n")
    return out.withColumns({"doy_sin1": F.sin(angle), "doy_cos1": F.cos(angle), "doy_sin2": F.sin(2.0 * angle), "doy_cos2": F.cos(2.0 * angle)})


def daily_ratio(df: DataFrame, keys: Sequence[str], label: str, baseline: str) -> DataFrame:
    """Label energy over baseline energy of complete days only."""
    out = df.groupBy(*keys).agg(F.sum(label).alias("_l"), F.sum(baseline).alias("_b"), F.count(label).alias("_nl"), F.count(baseline).alias("_nb"))
    whole = (F.col("_nl") == RUN_HOURS) & (F.col("_nb") == RUN_HOURS) & (F.col("_b") > 0)
    return out.where(whole).select(*keys, (F.col("_l") / F.col("_b")).alias("ratio"))


def common_target(df: DataFrame, ts: str, cf: str, minimum: int = 2) -> DataFrame:
    """Mean and median capacity factor over the registered groups of an hour, null below the minimum count."""
    n = F.count(cf)
    return df.groupBy(ts).agg(n.alias("groups"), F.when(n >= minimum, F.avg(cf)).alias("common_mean"),
                              F.when(n >= minimum, F.percentile(cf, F.lit(0.5))).alias("common_median"))
